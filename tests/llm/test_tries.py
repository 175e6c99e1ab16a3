"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sojourn.llm import tries


def brute_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    chains = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        head, mine = ([t[2:] for t in sorted(own.get(x, []))] for x in (c - c % 100, c))
        chains[c] = tuple(head[:h] + mine[h:])
    members, ended, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, chain in chains.items():
        ended[chain].append(c)
        for d in range(len(chain) + 1):
            members[chain[:d]].append(c)
            if d:
                children[chain[: d - 1]].add(chain[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = own_saved + sum(saved[x] for x in children[p])
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("key", "chars", "turns", "head", "prefix", "depth"):
        df = df.selectExpr("*", f"'x' AS {c}")
    out = tries.trie(tries.rebuilt(df), **options)
    assert out.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    assert {t for c, t in out.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("block_turns", [3, 40, 1 << 18])
def test_random_conversations(spark, block_turns):
    rng = random.Random(block_turns)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(230, 260)]:  # conversation 200 is absent
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["", "a", "bb", "ü€😀"])))
    rng.shuffle(rows)
    assert made(spark, rows, block_turns=block_turns) == brute_force(rows)


def test_nulls_copies_and_long_chains(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 1, "user", None), (2, 2, None, "x" * 100_000)]
    rows += [(c, t, "user", "same") for c in range(1000, 1500) for t in range(4)]  # one group of copies
    rows += [(7, t, "user", str(t)) for t in range(300)] + [(8, t, "user", str(t)) for t in range(299)]
    assert made(spark, rows, block_turns=100) == brute_force(rows)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(3, 0, "ab", "c"), (5, 0, "a", "bc"), (9, 0, "", "abc")]
    assert made(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert made(spark, []) == []
