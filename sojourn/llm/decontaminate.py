"""Benchmark decontamination by templates: finds items whose numbers, names and units were changed.

Texts become template words: numbers, units beside numbers and names turn into typed placeholders.
Windows of template words are hashed and joined between benchmark and documents, in three forms:
by the words themselves; with names inside a sentence as placeholders; and with every capitalised
word as part of a name, where a run of name words is one placeholder whose value is the whole run.
The last does not depend on what stands before a passage, nor on how many words a name has.

An alignment of a document with an item counts when its windows span enough words and either have
the item's own words, or hold enough ordinary words over the span and have consistent slots: one value
of the item always stands for one value of the document, and the other way round. Windows of
placeholders alone say nothing and are compared by their words only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sojourn.llm.common import batch, stored, tidy
from sojourn.llm.passages import Hasher

WINDOW = 8
#: Ordinary words that an alignment with changed values has to hold, or all if it is shorter.
LITERALS = 5
#: Alignments whose shifts differ by so much at most may add up: a changed value had more words.
DRIFT = 2
#: An alignment has to span so many template words, or the whole item if that is shorter.
SPAN = 13

# Unit words (beside a number) and unit signs.
UNITS = frozenset(
    "km m cm mm mi mile miles metre metres meter meters ft foot feet inch inches yd yard yards "
    "kg g mg lb lbs oz ton tons tonne tonnes gram grams kilogram kilograms pound pounds ounce ounces "
    "l ml litre litres liter liters gallon gallons cup cups s sec second seconds min minute minutes "
    "h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp degree degrees mph kph".split()
)
SIGNS = "%$€£°"

_TOKEN = re.compile(rf"[^\W\d_]+|\d+(?:[.,:]\d+)*|[.!?\n{SIGNS}]")
_WORD, _CAPITAL, _NUMBER, _UNIT, _SIGN, _STOP = range(6)
#: Bits of the filter that windows of documents pass before they are shuffled: two megabytes,
#: whatever the benchmark. A fuller filter lets more windows through, and loses none.
_BITS = 24

_WORDS, _INNER, _RUNS = range(3)

_WINDOW_FIELDS = [
    ("form", pa.int32()),
    ("length", pa.int32()),
    ("hash", pa.int64()),
    ("place", pa.int32()),
    ("word", pa.int32()),
    ("n_windows", pa.int32()),
    ("plain", pa.list_(pa.int32())),
    ("slots", pa.list_(pa.string())),
]
_WINDOW_SQL = (
    "form int, length int, hash long, place int, word int, n_windows int, plain array<int>, slots array<string>"
)
#: Texts are turned into templates together, up to so many characters.
_CHARS = 1 << 18


class Canon:
    """Turns texts into template codes; what a token is gets looked up once."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.kinds = np.zeros(1 << 16, np.int8)

    @staticmethod
    def _kind(token: str) -> int:
        first = token[0]
        if first.isalpha():
            if len(token) > 1 and first.isupper() and not token[1:].isupper():
                return _CAPITAL
            return _UNIT if token.lower() in UNITS else _WORD
        return _NUMBER if first.isdecimal() else _SIGN if first in SIGNS else _STOP

    def _learn(self, tokens: set[str]) -> None:
        for t in tokens:
            at = len(self.known)
            if at == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
                self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            self.hashes[at] = xxhash.xxh3_64_intdigest(t.lower().encode())
            self.kinds[at] = self._kind(t)
            self.known[t] = at

    def forms(self, texts: list[str | None]) -> list[Form]:
        """The texts, one after the other, in the three forms."""
        tokens: list[str] = []
        sizes = []
        for t in texts:
            found = _TOKEN.findall(t) if t else []
            tokens += found
            tokens.append("\n")  # a stop, so that nothing is seen beyond the text
            sizes.append(len(found) + 1)
        found = list(map(self.known.get, tokens))
        if None in found:
            if len(self.known) > 150_000:
                self._clear()
            self._learn(set(tokens).difference(self.known))
            found = list(map(self.known.__getitem__, tokens))
        at = np.array(found, dtype=np.int64)
        kind, exact = self.kinds[at], self.hashes[at]
        before = np.concatenate([[_STOP], kind[:-1]])
        after = np.concatenate([kind[1:], [_STOP]])
        capital = kind == _CAPITAL
        name = capital & (before != _STOP)
        unit = ((kind == _UNIT) | (kind == _SIGN)) & (before == _NUMBER) | (kind == _SIGN) & (after == _NUMBER)
        number = kind == _NUMBER
        codes = np.where(unit, np.uint64(2), np.where(number, np.uint64(3), exact))
        keep = (kind != _STOP) & ((kind != _SIGN) | unit)
        word = np.flatnonzero(keep)
        folded = np.flatnonzero(keep & ~(capital & (before == _CAPITAL)))
        inner = np.where(name, np.uint64(1), codes)
        runs = np.where(capital, np.uint64(1), codes)
        source = Source(texts, tokens, np.array(sizes), keep, unit, number)
        none = np.zeros(len(word), dtype=bool)
        return [
            Form(_WORDS, exact[word], none, word, source, capital),
            Form(_INNER, inner[word], (name | unit | number)[word], word, source, None),
            Form(_RUNS, runs[folded], (capital | unit | number)[folded], folded, source, capital),
        ]


class Source:
    """The tokens of some texts: whose each is, and which word of its text."""

    def __init__(self, texts, tokens, sizes, keep, unit, number) -> None:
        self.n, self.tokens, self.unit, self.number = len(texts), tokens, unit, number
        self.text = np.repeat(np.arange(self.n), sizes)
        words = np.cumsum(keep)
        ends = np.cumsum(sizes)
        self.word = words - 1 - np.concatenate([[0], words[ends[:-1] - 1]])[self.text]

    def label(self, i: int) -> str:
        return "u" if self.unit[i] else "n" if self.number[i] else "a"


class Form:
    """Codes of one form of some texts, whether each is a slot, and the values of the slots when asked."""

    def __init__(self, form, codes, slot, at, source, capital) -> None:
        self.form, self.codes, self.slot, self.at = form, codes, slot, at
        self._source, self._capital = source, capital
        self._known: dict[int, str] = {}
        #: The text of every code; the number of codes of every text and where they begin.
        self.text = source.text[at]
        self.sizes = np.bincount(self.text, minlength=source.n)
        self.first = np.cumsum(self.sizes) - self.sizes

    def words(self, at: np.ndarray) -> np.ndarray:
        """The places of codes among the words of their texts."""
        return self._source.word[self.at[at]]

    def _value(self, i: int) -> str:
        if i not in self._known:
            a = int(self.at[i])
            z, tokens = a + 1, self._source.tokens
            if self._capital is not None and self._capital[a]:
                while z < len(tokens) and self._capital[z]:
                    z += 1
            self._known[i] = f"{self._source.label(a)}:{' '.join(tokens[a:z]).lower()}"
        return self._known[i]

    def values(self, i: int, length: int) -> list[str]:
        return [self._value(j) for j in range(i, i + length) if self.slot[j]]

    def plain(self, i: int, length: int) -> list[int]:
        """The places, in their text, of the codes of a window that are no slots."""
        first = int(self.first[self.text[i]])
        return [j - first for j in range(i, i + length) if not self.slot[j]]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window of ``length`` codes, and whether it has an ordinary word and lies in one text."""
        plain = np.concatenate([[0], np.cumsum(~self.slot)])
        inside = self.text[length - 1 :] == self.text[: len(self.text) - length + 1]
        return Hasher.runs(self.codes, length) + np.uint64(self.form), (plain[length:] > plain[:-length]) & inside


def _together(b: pa.RecordBatch) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of a batch in groups of about _CHARS characters; a longer text is alone."""
    ids, texts, held = [], [], 0
    for row, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
        t = text.as_py()
        if texts and held + len(t or "") > _CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row)
        texts.append(t)
        held += len(t or "")
    if texts:
        yield ids, texts


def _templates(lengths: list[int] | None, passing: np.ndarray | None, window: int, kind: pa.DataType):
    """Windows of all texts; of items (``lengths`` None) by the item's own length, up to ``window``."""
    schema = pa.schema([("id", kind), *_WINDOW_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            for rows, texts in _together(b):
                ids, forms, sizes, hashes, places, word, counts, plain, slots = ([] for _ in range(9))
                for f in canon.forms(texts):
                    own = np.minimum(f.sizes, window)
                    for length in lengths or np.unique(own[own > 0]).tolist():
                        if len(f.codes) < length:
                            continue
                        h, some = f.windows(length)
                        if lengths is None:
                            some &= own[f.text[: len(h)]] == length
                        if passing is not None:
                            bit = h >> np.uint64(64 - _BITS)
                            on = passing[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                            some &= on.astype(bool)
                        at = np.flatnonzero(some)
                        if not at.size:
                            continue
                        text = f.text[at]
                        ids += [rows[i] for i in text.tolist()]
                        forms += [f.form] * len(at)
                        sizes += [length] * len(at)
                        counts.append(f.sizes[text] - length + 1)
                        hashes.append(h[at])
                        places.append(at - f.first[text])
                        word.append(f.words(at))
                        at = at.tolist()
                        plain += [f.plain(i, length) if passing is None else None for i in at]
                        slots += [f.values(i, length) for i in at]
                if ids:
                    h = np.concatenate(hashes).view(np.int64)
                    numbers = [np.concatenate(x) for x in (places, word, counts)]
                    yield batch(schema, [ids, forms, sizes, h, *numbers, plain, slots])

    return run


def _filter(templates: DataFrame) -> np.ndarray:
    """Bit b is set when a window hash starts with the bits b; 2 ** (_BITS - 6) rows at most come back."""
    bit = F.shiftrightunsigned("hash", 64 - _BITS)
    rows = templates.select(bit.alias("bit")).selectExpr(
        "shiftright(bit, 6) AS w", "shiftleft(1L, cast(bit & 63L AS int)) AS m"
    )
    out = np.zeros(1 << (_BITS - 6), np.int64)
    for r in rows.groupBy("w").agg(F.bit_or("m").alias("m")).collect():
        out[r["w"]] = r["m"]
    return out.view(np.uint8)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    span: int = SPAN,
) -> DataFrame:
    """(doc_id, item_id, n_windows, place, exact), one row per document and benchmark item it holds.

    ``n_windows`` counts the item's windows found, ``place`` is the first template word of the match
    in the document, ``exact`` tells whether a long enough span has the item's own values. Texts that are
    null or without words match nothing. Repeated rows count once; rows that share a doc_id, or have
    none, count as one document, and likewise items. Empty tables give no rows. Other columns are
    not looked at. A doc_id is a whole number or a string.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    of_items = _templates(None, None, window, pa.int64())
    templates = stored(items.mapInArrow(of_items, f"id long, {_WINDOW_SQL}"), "templates")
    lengths = sorted(r["length"] for r in templates.select("length").distinct().collect())  # <= window of them
    passing = spark.sparkContext.broadcast(_filter(templates))
    named = isinstance(docs.select(doc_id).schema[0].dataType, StringType)
    kind, sql = (pa.string(), "string") if named else (pa.int64(), "long")
    texts = docs.select(F.col(doc_id).cast(sql).alias("id"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lengths:
            yield from _templates(lengths, passing.value, window, kind)(batches)

    found = texts.mapInArrow(tidy(scan), f"id {sql}, {_WINDOW_SQL}").selectExpr(
        "id AS doc_id", "form", "length", "hash", "place AS at", "word", "slots AS values"
    )
    known = templates.selectExpr(
        "id AS item_id", "form", "length", "hash", "place", "n_windows AS of", "plain", "slots"
    )
    pairs = found.join(known, ["form", "length", "hash"]).where(F.size("slots") == F.size("values"))
    # Every alignment is judged by its telling windows, by all windows, and with its neighbours.
    telling = (F.size("plain") >= F.least(F.lit(LITERALS), F.col("length"))) | (F.col("slots") == F.col("values"))
    shift = F.col("at") - F.col("place")

    def view(kind: int, by: int = 0):
        return F.struct(F.lit(kind).alias("kind"), (shift + by).alias("shift"))

    views = F.when(F.col("form") == _WORDS, F.array(view(1))).otherwise(
        F.concat(
            F.when(telling, F.array(view(0))).otherwise(F.array().cast("array<struct<kind:int,shift:int>>")),
            F.array(view(1), *(view(2, d) for d in range(-DRIFT, DRIFT + 1))),
        )
    )
    # A name at either end of an item may run on into the words around the passage.
    last = F.col("of") + F.col("length") - 2
    zipped = F.transform(
        F.arrays_zip("slots", "values"),
        lambda z, i: F.struct(
            z["slots"].alias("slots"),
            z["values"].alias("values"),
            (
                (F.col("form") == _RUNS)
                & z["slots"].startswith("a:")
                & (
                    (F.col("place") == 0) & ~F.array_contains("plain", 0) & (i == 0)
                    | (F.col("place") == F.col("of") - 1)
                    & ~F.array_contains("plain", last.cast("int"))
                    & (i == F.size("slots") - 1)
                )
            ).alias("edge"),
        ),
    )

    def fits(e, s):
        """Whether the value at an end may be that of slot s, where it is the same slot of the item."""
        v = F.substring(s["values"], 3, 1 << 30)
        more = e["values"].endswith(F.concat(F.lit(" "), v)) | e["values"].startswith(F.concat(s["values"], F.lit(" ")))
        same = e["values"] == s["values"]
        return F.when(e["slots"] == s["slots"], same | more).otherwise(~same)

    slots, places = F.filter("slots", lambda s: ~s["edge"]), F.array_sort("places")
    ends = F.filter("slots", lambda s: s["edge"])
    consistent = (
        (F.size(F.array_distinct(slots["slots"])) == F.size(slots))
        & (F.size(F.array_distinct(slots["values"])) == F.size(slots))
        & F.forall(ends, lambda e: F.forall(slots, lambda s: fits(e, s)))
    )
    # Windows between two that overlap or touch are found with them, and count.
    steps = F.transform(
        F.arrays_zip(F.slice(places, 2, F.size("places")).alias("z"), F.slice(places, 1, F.size("places") - 1).alias("a")),
        lambda s: F.when(s["z"] - s["a"] <= F.col("length"), s["z"] - s["a"]).otherwise(1),
    )
    n_found = F.lit(1) + F.aggregate(steps, F.lit(0), lambda x, y: x + y)
    need = F.least(F.col("of"), F.greatest(F.lit(1), F.lit(span + 1) - F.col("length")))
    aligned = (
        pairs.withColumn("compared", zipped)
        .withColumn("view", F.explode(views))
        .groupBy("doc_id", "item_id", "form", "view")
        .agg(
            F.collect_set("place").alias("places"),
            F.min("word").alias("at"),
            F.max("of").alias("of"),
            F.max("length").alias("length"),
            F.array_distinct(F.flatten(F.collect_set("plain"))).alias("plain"),
            F.array_distinct(F.flatten(F.collect_set("compared"))).alias("slots"),
        )
        .withColumn("n", F.when(F.col("view.kind") == 1, n_found).otherwise(F.size("places")))
        # A span with the item's own words is a leak whatever happened to the rest.
        .withColumn("exact", F.col("form") == _WORDS)
        .where(
            (F.col("n") >= need)
            & (F.col("exact") | consistent & (F.size("plain") >= F.least(F.lit(LITERALS), F.col("length"))))
        )
    )
    return aligned.groupBy("doc_id", "item_id").agg(
        F.max("n").cast("long").alias("n_windows"),
        F.min("at").cast("long").alias("place"),
        F.max("exact").alias("exact"),
    )
