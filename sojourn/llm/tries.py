"""Prefix trie of conversations: union-find over the LCP edges of sorted neighbours.

Every turn is a hash of 128 bits of its role and text, and a conversation the chain of its turns.
Equal conversations are folded, then the chains are sorted by range. Within a block of sorted
chains the edges between neighbours are taken in descending order of their common depth; each
merger of two components makes a branching node or adds a child to it. Nodes between two branching
nodes share the figures of the lower one and are written out at the end.

What a block has in common with its neighbours lies on the path of its first or of its last chain.
Those nodes are contracted to partial sums that are added up by the hash of their prefix. Where two
blocks meet, a seam takes back what both have counted: shared nodes, children, and the leaf that the
next chain continues. A conversation fits in a row, as a document does (24 bytes a turn); nothing
else is bounded by memory, and no group of conversations is ever held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import batch, small_batches, stored

#: Turns of one block of sorted chains; a task holds one block at a time.
BLOCK_TURNS = 1 << 18
#: Conversation ids that one row of a list of members spans.
ID_BLOCK = 1 << 14
#: A conversation takes over fewer turns than this from the first of its hundred.
HEAD = 6
WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()

_SEQ = pa.schema(
    [("key", pa.binary()), ("chars", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string())]
)
_SEQ_SQL = "key binary, chars binary, n long, first long, ends string"
_NODE = pa.schema(
    [
        ("kind", pa.int32()),
        ("task", pa.int32()),
        ("depth", pa.int64()),
        ("prefix", pa.binary()),
        ("parent", pa.binary()),
        ("first", pa.int64()),
        ("parent_first", pa.int64()),
        ("n", pa.int64()),
        ("children", pa.int64()),
        ("leaves", pa.int64()),
        ("saved", pa.int64()),
        ("ends", pa.string()),
        ("chars", pa.binary()),
        ("last", pa.binary()),
        ("last_chars", pa.binary()),
    ]
)
_NODE_SQL = (
    "kind int, task int, depth long, prefix binary, parent binary, first long, parent_first long, n long, "
    "children long, leaves long, saved long, ends string, chars binary, last binary, last_chars binary"
)
#: A node whose figures are whole, a part of a node to be added up, the two end chains of a task.
_CLOSED, _OPEN, _BOUND = range(3)


def rebuilt(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, key, chars): the chain of every conversation, its first turns taken from its hundred's first.

    With h = crc32(conv_id as decimal text) % 6, the first h turns are those of conversation
    conv_id - conv_id % 100 (fewer if it has fewer), then come its own after its first h. Turns are
    ordered by number, null first; equal numbers by role, then by the hash of role and text. A null
    role or text is empty; rows without conv_id belong to no conversation. ``key`` holds 16 bytes a
    turn, ``chars`` the code points of the texts as 64-bit integers.
    """
    said = F.coalesce(F.col(role), F.lit(""))
    words = F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            said.alias("role"),
            F.md5(F.concat_ws(":", F.octet_length(said).cast("string"), said, words).cast("binary")).alias("hash"),
            F.char_length(words).cast("long").alias("chars"),
        ).alias("t"),
    )
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = stored(own.withColumn("turns", F.transform("turns", lambda t: F.struct(t["hash"], t["chars"]))), "turns")
    hundred = F.col("conv_id") - F.col("conv_id") % 100
    heads = own.where(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("hundred"), F.slice("turns", 1, HEAD - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    chain = F.concat(
        F.slice(F.coalesce("head", F.expr("slice(turns, 1, 0)")), F.lit(1), h),
        F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))),
    )
    found = own.withColumn("hundred", hundred).join(heads, "hundred", "left").withColumn("chain", chain)
    return found.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("chain", lambda t: t["hash"]), "")).alias("key"),
        F.unhex(
            F.array_join(F.transform("chain", lambda t: F.lpad(F.hex(t["chars"]), 16, "0")), "")
        ).alias("chars"),
    )


def _hashed_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chain from its blocks of member ids, sorted by chain and block; holds no list."""
    at, row, sha = None, None, None
    done: list[tuple] = []
    for b in batches:
        columns = [b.column(c) for c in ("seq", "key", "chars", "n", "low", "ids")]
        for seq, key, chars, n, low, ids in zip(*(c.to_pylist() for c in columns), strict=True):
            if seq != at:
                if row:
                    done.append((*row, sha.hexdigest()))
                at, row, sha = seq, (key, chars, n, low), hashlib.sha256(ids.encode())
            else:
                row = (*row[:2], row[2] + n, min(row[3], low))
                sha.update(b"," + ids.encode())
        if done:
            yield batch(_SEQ, list(zip(*done, strict=True)))
            done = []
    if row:
        yield batch(_SEQ, [[v] for v in (*row, sha.hexdigest())])


def folded(chains: DataFrame) -> DataFrame:
    """(key, chars, n, first, ends) of every distinct chain: its members, the smallest, and their hash.

    Members meet in blocks of ids, so a chain of very many members is hashed block by block.
    """
    blocks = (
        chains.select(
            F.md5("key").alias("seq"), F.floor(F.col("conv_id") / ID_BLOCK).alias("block"), "conv_id", "key", "chars"
        )
        .groupBy("seq", "block")
        .agg(
            F.array_sort(F.collect_list("conv_id")).alias("ids"),
            F.any_value("key").alias("key"),
            F.any_value("chars").alias("chars"),
        )
        .select(
            "seq", "block", "key", "chars",
            F.size("ids").cast("long").alias("n"),
            F.get("ids", F.lit(0)).alias("low"),
            F.array_join("ids", ",").alias("ids"),
        )
    )
    return (
        blocks.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(_hashed_members, _SEQ_SQL)
    )


def common(a: bytes, b: bytes) -> int:
    """Turns that two chains have in common from the start."""
    n = min(len(a), len(b)) // WIDTH * WIDTH
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


def _sums(chars: bytes) -> np.ndarray:
    """Running sums of a chain's code points from depth 0."""
    out = np.zeros(len(chars) // 8 + 1, np.int64)
    np.cumsum(np.frombuffer(chars, ">i8"), out=out[1:])
    return out


def _name(key: bytes, depth: int) -> bytes:
    return hashlib.md5(key[: depth * WIDTH]).digest()


class Forest:
    """The trie of one block of sorted distinct chains, by union-find over its neighbour edges.

    Nodes are numbered: the chains' own ends first, then branching nodes as mergers make them. A node
    stands for itself and the chain of single children above it, up to its parent.
    """

    def __init__(self, keys: list[bytes], chars: list[bytes], n: list[int], first: list[int]) -> None:
        m = len(keys)
        self.sums = [_sums(c) for c in chars]
        self.depth = [len(k) // WIDTH for k in keys]
        self.lcp = [0] + [common(keys[j - 1], keys[j]) for j in range(1, m)]
        self.left, self.right = list(range(m)), list(range(m))
        self.n, self.first = list(n), list(first)
        self.children, self.leaves = [0] * m, [1] * m
        self.weighted, self.distinct = [0] * m, [0] * m  # code points below the node: by member, by node
        self.parent = [-1] * m
        root = list(range(m))
        top = list(range(m))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for j in sorted(range(1, m), key=lambda j: -self.lcp[j]):  # ties stay in ascending order
            d, x, y = self.lcp[j], find(j - 1), find(j)
            node = top[x]
            if self.depth[node] != d:
                node = self._branch(top[x], d)
            self._attach(top[y], node)
            root[y] = x
            top[x] = node

    def _branch(self, child: int, depth: int) -> int:
        for values, v in (
            (self.depth, depth), (self.left, self.left[child]), (self.right, self.right[child]), (self.n, 0),
            (self.first, self.first[child]), (self.children, 0), (self.leaves, 0), (self.weighted, 0),
            (self.distinct, 0), (self.parent, -1),
        ):
            values.append(v)
        self._attach(child, len(self.depth) - 1)
        return len(self.depth) - 1

    def _attach(self, child: int, node: int) -> None:
        s = self.sums[self.left[child]]
        between = int(s[self.depth[child]] - s[self.depth[node]])
        if not self.children[node]:
            self.leaves[node] = 0  # a chain's end that others continue
        self.parent[child] = node
        self.right[node] = max(self.right[node], self.right[child])
        self.weighted[node] += self.weighted[child] + self.n[child] * between
        self.distinct[node] += self.distinct[child] + between
        self.n[node] += self.n[child]
        self.first[node] = min(self.first[node], self.first[child])
        self.children[node] += 1
        self.leaves[node] += self.leaves[child]

    def nodes(self) -> dict[str, np.ndarray]:
        """Every node as a row: owner (numbered node), depth and its figures."""
        depth, parent = np.array(self.depth), np.array(self.parent)
        above = np.where(parent < 0, -1, depth[parent])  # depth of the parent
        many = depth - above
        owner = np.repeat(np.arange(len(depth)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + above[owner] + 1
        lengths = np.array([len(s) for s in self.sums])
        flat, offset = np.concatenate(self.sums), np.cumsum(lengths) - lengths
        base = offset[np.array(self.left)[owner]]
        own = flat[base + depth[owner]] - flat[base + np.maximum(at - 1, 0)]
        n, first = np.array(self.n, np.int64)[owner], np.array(self.first, np.int64)
        weighted, distinct = np.array(self.weighted, np.int64)[owner], np.array(self.distinct, np.int64)[owner]
        end = at == depth[owner]
        starts = (at == above[owner] + 1) & (parent[owner] >= 0)
        return {
            "owner": owner,
            "depth": at,
            "n": n,
            "first": first[owner],
            "parent_first": np.where(starts, first[parent[owner]], first[owner]),
            "children": np.where(end, np.array(self.children)[owner], 1),
            "leaves": np.array(self.leaves, np.int64)[owner],
            "saved": weighted + n * own - distinct - own,
            "end": end,
        }


def seam(last: bytes, key: bytes, sums: np.ndarray) -> Iterator[tuple]:
    """What the blocks before and after a boundary have both counted, by shared node:
    (depth, prefix, parent, children, leaves, saved) to be added."""
    shared = common(last, key)
    leaf = -1 if len(last) // WIDTH == shared else 0
    above = b""
    for d in range(shared + 1):
        name = _name(key, d)
        yield d, name, above, -1 if d < shared else 0, leaf, int(sums[shared] - sums[max(d - 1, 0)])
        above = name


def _open_rows(task: int, seams: list[tuple]) -> pa.RecordBatch:
    d, prefix, parent, children, leaves, saved = zip(*seams, strict=True)
    none = [None] * len(d)
    zero = [0] * len(d)
    kind, tasks = [_OPEN] * len(d), [task] * len(d)
    return batch(_NODE, [kind, tasks, d, prefix, parent, none, none, zero, children, leaves, saved, none, none, none, none])


def _grow(block_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes, parts of nodes and seams of the chains of one task, which come sorted."""
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []
        turns, before, bound = 0, None, None

        def block() -> Iterator[pa.RecordBatch]:
            keys, chars, n, first, ends = zip(*rows, strict=True)
            f = Forest(keys, chars, n, first)
            v = f.nodes()
            if before is not None:
                yield _open_rows(task, list(seam(before, keys[0], f.sums[0])))
            owner, depth = v["owner"], v["depth"]
            left, right = np.array(f.left)[owner], np.array(f.right)[owner]
            # Any node on the path of the first or the last chain may go on in another block.
            opened = (left == 0) | (right == len(keys) - 1)
            opened_parent = np.concatenate([[False], opened[:-1]])
            at_top = depth == np.where(np.array(f.parent)[owner] < 0, 0, np.array(f.depth)[f.parent][owner] + 1)
            # Rows of one owner ascend in depth, so the parent of all but the topmost is the row before.
            by_node = np.zeros(len(f.depth), bool)
            by_node[owner[v["end"]]] = opened[v["end"]]
            opened_parent = np.where(at_top, by_node[np.array(f.parent)[owner]], opened_parent)
            names: list[bytes | None] = [None] * len(depth)
            above: list[bytes | None] = [None] * len(depth)
            for i in np.flatnonzero(opened | opened_parent).tolist():
                key, d = keys[left[i]], int(depth[i])
                names[i] = _name(key, d) if opened[i] else None
                above[i] = _name(key, d - 1) if d else b""
            own_end = v["end"] & (owner < len(keys))
            listed = [ends[o] if e else None for o, e in zip(owner.tolist(), own_end.tolist(), strict=True)]
            none = pa.nulls(len(depth), pa.binary())
            columns = [
                np.where(opened, _OPEN, _CLOSED).astype(np.int32), np.full(len(depth), task, np.int32), depth, names, above,
                v["first"], pa.array(v["parent_first"], mask=opened | opened_parent), v["n"], v["children"], v["leaves"],
                v["saved"], listed, none, none, none,
            ]
            yield batch(_NODE, columns)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _SEQ.names), strict=True):
                if rows and turns + len(row[0]) // WIDTH > block_turns:
                    yield from block()
                    before, rows, turns = rows[-1][0], [], 0
                bound = bound or row
                rows.append(row)
                turns += len(row[0]) // WIDTH + 1
        if rows:
            yield from block()
            ends = [[bound[0]], [bound[1]], [rows[-1][0]], [rows[-1][1]]]
            nothing = [[None]] * 8
            yield batch(_NODE, [[_BOUND], [task], [0], ends[0], *nothing, ends[1], ends[2], ends[3]])

    return run


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for task, last, key, chars in zip(*(b.column(c).to_pylist() for c in ("task", "before", "prefix", "chars")), strict=True):
            if last is not None:
                yield _open_rows(task, list(seam(last, key, _sums(chars))))


def trie(chains: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the prefix trie of ``chains`` (conv_id, key, chars as from ``rebuilt``).

    conv_id is the smallest member, parent_conv_id that of the parent (null at the root), ends_sha256
    the SHA-256 of the ids, ascending and joined by commas, of the members that end at the node. An
    empty table has no node, not even a root. conv_id must not repeat.
    """
    small_batches(chains.sparkSession)
    distinct = stored(folded(chains), "chains")
    ordered = distinct.repartitionByRange("key").sortWithinPartitions("key")
    found = stored(ordered.mapInArrow(_grow(block_turns), _NODE_SQL), "trie")
    # One row per task, so this window is bounded by the number of partitions.
    bounds = found.where(F.col("kind") == _BOUND).withColumn("before", F.lag("last").over(Window.orderBy("task")))
    seams = bounds.select("task", "before", "prefix", "chars").mapInArrow(_seams, _NODE_SQL)
    parts = found.where(F.col("kind") == _OPEN)
    opened = stored(
        parts.unionByName(seams)
        .groupBy("depth", "prefix", "parent")
        .agg(
            F.min("first").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")),
            F.max("ends").alias("ends"),
        ),
        "trie-open",
    )
    named = opened.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    figures = ["conv_id", "depth", "n", "children", "leaves", "saved", "ends"]
    shared = opened.join(named, "parent", "left").select("parent_conv_id", *figures)
    closed = found.where(F.col("kind") == _CLOSED).withColumnRenamed("first", "conv_id")
    inner = closed.where(F.col("parent").isNull()).select(F.col("parent_first").alias("parent_conv_id"), *figures)
    # By task as well: the children of the root are then dealt out as the tasks were.
    known = parts.select("task", F.col("prefix").alias("parent")).distinct().join(named, "parent")
    outer = closed.where(F.col("parent").isNotNull()).join(known, ["task", "parent"]).select("parent_conv_id", *figures)
    return shared.unionByName(inner).unionByName(outer).select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
