"""Token counts that follow edits: per document a segment tree over runs of pre-tokens.

A text is cut into leaves at single blanks between other characters, where the vocabulary's split
always starts a new pre-token. So the tokens of a text are those of its leaves. The tree over the
leaves holds the sum of every subtree. An edit re-encodes the leaves it touches, with neighbours
where a cut between leaves is no longer one, and adds the difference on the way to the root.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import unused

#: A leaf ends at the first cut after so many characters.
LEAF_CHARS = 512
TREE = "struct<starts:array<int>,sums:array<bigint>>"
EDITS = "array<struct<start:int,stop:int,text:string>>"
COUNTS = "struct<n_before:bigint,n_after:bigint,n_leaves:bigint,n_reencoded:bigint>"

#: Personal data and secrets that ``redactions`` replaces.
PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\b[0-9a-f]{32,}\b", "<SECRET>"),
    (r"\b\d{9,}\b", "<NUMBER>"),
]

_CODERS: dict[str, tiktoken.Encoding] = {}


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def coder(path: str) -> tiktoken.Encoding:
    """One encoder for all tasks of a Python worker."""
    if path not in _CODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[path] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _CODERS[path]


def is_cut(text: str, at: int) -> bool:
    """Whether a single blank between other characters stands here: pre-tokens never span it."""
    return (
        0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()
    )


def leaves(text: str, size: int = LEAF_CHARS) -> list[int]:
    """The start of every leaf; the empty text has one."""
    starts, at = [0], size
    while (at := text.find(" ", at)) >= 0:
        if is_cut(text, at):
            starts.append(at)
            at += size
        else:
            at += 1
    return starts


class Tree:
    """Sums over leaf counts, the root at 1, the children of i at 2i and 2i + 1."""

    def __init__(self, sums: list[int]) -> None:
        self.sums = sums
        self.width = len(sums) // 2

    @classmethod
    def of(cls, counts: list[int]) -> Tree:
        width = 1 << max(0, (len(counts) - 1).bit_length())
        sums = np.zeros(2 * width, dtype=np.int64)
        sums[width : width + len(counts)] = counts
        level = width
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2
        return cls(sums.tolist())

    @property
    def total(self) -> int:
        return self.sums[1]

    def put(self, leaf: int, count: int) -> None:
        """Set one leaf, updating the sums above it."""
        i = self.width + leaf
        change = count - self.sums[i]
        while i and change:
            self.sums[i] += change
            i //= 2


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text after the edits, which are sorted and do not overlap."""
    parts, at = [], 0
    for start, stop, new in edits:
        parts += [text[at:start], new]
        at = stop
    return "".join([*parts, text[at:]])


def recount(
    text: str, starts: list[int], tree: Tree, edits: list[tuple[int, int, str]], count
) -> tuple[int, list[int]]:
    """Apply the edits to the tree; the number of leaves encoded again and the new starts.

    Leaves that an edit merges keep their places in the tree: the first takes the count of all, the
    others become empty. ``count`` gives the tokens of a text.
    """
    if not edits:
        return 0, starts
    after = edited(text, edits)
    ends = [*starts[1:], len(text)]
    shift = np.zeros(len(edits) + 1, dtype=np.int64)
    shift[1:] = np.cumsum([len(new) - (stop - start) for start, stop, new in edits])
    stops = np.array([stop for _, stop, _ in edits])
    begins = np.array([start for start, _, _ in edits])

    def moved(at: int) -> int | None:
        """Where a place is after the edits; None inside of one."""
        k = int(np.searchsorted(stops, at, side="right"))
        if k < len(edits) and begins[k] < at:
            return None
        return at + int(shift[k])

    def sound(leaf: int) -> bool:
        """Whether the cut before this leaf is still one."""
        if leaf in (0, len(starts)):
            return True
        at = starts[leaf]
        k = int(np.searchsorted(stops, at, side="left"))
        if k < len(edits) and begins[k] <= at:
            return False  # an edit ends or starts at the cut, or spans it
        new = moved(at)
        return new is not None and is_cut(after, new)

    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.maximum(np.searchsorted(starts, np.maximum(stops - 1, begins), side="right") - 1, first)
    regions: list[list[int]] = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        while not sound(a):
            a -= 1
        while not sound(b + 1):
            b += 1
        if regions and a <= regions[-1][1]:
            regions[-1] = [min(a, regions[-1][0]), max(b, regions[-1][1])]
        else:
            regions.append([a, b])
    again = 0
    new_starts: list[int] = []
    at = 0
    for a, b in regions:
        new_starts += [moved(s) for s in starts[at:a]]
        low = 0 if a == 0 else moved(starts[a])
        high = len(after) if b == len(starts) - 1 else moved(ends[b])
        tree.put(a, count(after[low:high]))
        for leaf in range(a + 1, b + 1):
            tree.put(leaf, 0)
        new_starts += [low] + [high] * (b - a)
        again += b - a + 1
        at = b + 1
    return again, new_starts + [moved(s) for s in starts[at:]]


def folded(starts: list[int], tree: Tree, length: int) -> tuple[list[int], Tree]:
    """Starts and tree without the leaves that edits emptied, for the next round of edits."""
    ends = [*starts[1:], length]
    full = [i for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if a < b] or [0]
    return [starts[i] for i in full], Tree.of([tree.sums[tree.width + i] for i in full])


def _trees(states: list[tuple[list[int], list[int]]]) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array([x for x, _ in states], pa.list_(pa.int32())), pa.array([x for _, x in states], pa.list_(pa.int64()))],
        ["starts", "sums"],
    )


def _count(path: str):
    encode = coder(path).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def counted(
    docs: DataFrame, text: str = "text", into: str = "tree", vocabulary: str | None = None
) -> DataFrame:
    """All rows and columns of ``docs`` with the segment tree of each text in a struct ``into``.

    A null text has the tree of the empty one, a single leaf of no tokens. Repeated rows have equal
    trees, an empty table gives no rows. A text without single blanks is one leaf. ``into`` must not
    be a column of ``docs``.
    """
    path = vocabulary or default_vocabulary()

    @F.arrow_udf(TREE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _count(path)
        for b in batches:
            out = []
            for t in b:
                s = t.as_py() or ""
                starts = leaves(s)
                parts = [s[x:y] for x, y in zip(starts, [*starts[1:], len(s)], strict=True)]
                out.append((starts, Tree.of([count(p) for p in parts]).sums))
            yield _trees(out)

    return docs.withColumn(unused(docs, into), run(F.col(text)))


def redactions(docs: DataFrame, text: str = "text", into: str = "edits") -> DataFrame:
    """All rows and columns of ``docs`` with the edits in ``into`` that take personal data out.

    Null and empty texts have none, repeated rows the same, an empty table gives no rows. ``into``
    must not be a column of ``docs``.
    """
    pattern = re.compile("|".join(f"({p})" for p, _ in PATTERNS), re.ASCII)
    names = [name for _, name in PATTERNS]

    @F.arrow_udf(EDITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
        for b in batches:
            yield pa.array(
                [
                    [
                        {"start": m.start(), "stop": m.end(), "text": names[m.lastindex - 1]}
                        for m in pattern.finditer(t.as_py() or "")
                    ]
                    for t in b
                ],
                kind,
            )

    return docs.withColumn(unused(docs, into), run(F.col(text)))


def recounted(
    docs: DataFrame, text: str = "text", tree: str = "tree", edits: str = "edits", into: str = "counts",
    vocabulary: str | None = None, state: bool = False,
) -> DataFrame:
    """All rows and columns of ``docs`` with the counts before and after ``edits`` in a struct ``into``.

    ``n_reencoded`` of the ``n_leaves`` leaves were encoded again. With ``state`` the struct also holds
    the edited ``text`` and its ``tree``, from which the next round of edits goes on. Edits (places in characters of the
    old text) are sorted here; null edits are none, an edit with null text deletes, and overlapping
    edits or such beyond the text are an error. Null texts count as empty, repeated rows alike, an
    empty table gives no rows. ``into`` must not be a column of ``docs``.
    """
    path = vocabulary or default_vocabulary()

    @F.arrow_udf(COUNTS if not state else f"{COUNTS[:-1]},text:string,tree:{TREE}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        count = _count(path)
        names = ["n_before", "n_after", "n_leaves", "n_reencoded", *(["text", "tree"] if state else [])]
        for texts, trees, changes in batches:
            out, kept = [], []
            for t, k, e in zip(texts, trees, changes, strict=True):
                s, old = t.as_py() or "", k.as_py()
                todo = sorted((x["start"], x["stop"], x["text"] or "") for x in e.as_py() or [])
                places = [p for a, b, _ in todo for p in (a, b)]
                if places != sorted(places) or places and (places[0] < 0 or places[-1] > len(s)):
                    raise ValueError("edits overlap or lie beyond the text")
                sums = Tree(old["sums"])
                before = sums.total
                again, starts = recount(s, old["starts"], sums, todo, count)
                out.append((before, sums.total, len(old["starts"]), again))
                if state:
                    after = edited(s, todo)
                    starts, sums = folded(starts, sums, len(after)) if todo else (starts, sums)
                    kept.append((after, (starts, sums.sums)))
            columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [[], [], [], []]]
            if state:
                columns += [pa.array([s for s, _ in kept], pa.string()), _trees([x for _, x in kept])]
            yield pa.StructArray.from_arrays(columns, names)

    return docs.withColumn(unused(docs, into), run(F.col(text), F.col(tree), F.col(edits)))
