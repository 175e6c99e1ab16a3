"""MD5-based keys: stable over runs, engines, partitions and machines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def device_group(device, n_groups: int) -> Column:
    """128-bit MD5 of the id modulo ``n_groups``, by Horner's rule over four 32-bit pieces."""
    device = F.col(device) if isinstance(device, str) else device
    digest = F.md5(device.cast("binary"))
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        piece = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(4294967296) + piece) % F.lit(n_groups)
    return acc.cast("int")


def uniform_draw(seed: int, *parts) -> Column:
    """A number in (0, 1) fixed by the seed and the parts: top 52 MD5 bits plus one half."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
