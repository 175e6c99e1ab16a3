"""Language by rank-order profiles: out-of-place distance of the most frequent n-grams.

Letters are lower-cased, anything else is a word boundary. A profile lists the most frequent
n-grams of one to three characters by rank. The distance of a document to a language is the sum
over the document's n-grams of the difference of the ranks; an n-gram that the language's profile
lacks costs the length of a profile.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import batch, unused

RANKS = 300
#: Profiles are learnt from at most so many documents of a language, those of the smallest hashes,
#: out of those the hash lets through; documents are classified whole, all of them.
SAMPLE_ROWS = 3000
UNKNOWN = "und"
_OTHER_THAN_LETTERS = regex.compile(r"\P{L}+")
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def folded(text: str | None) -> str:
    """Lower-cased letters with single blanks around and between the words; '' without letters."""
    inner = _OTHER_THAN_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {inner} " if inner else ""


def grams(line: str) -> Counter[str]:
    """Counts of the n-grams of one to three characters that do not reach over a boundary."""
    n: Counter[str] = Counter(line.replace(" ", ""))
    n.update(line[i : i + 2] for i in range(len(line) - 1))
    n.update(g for i in range(len(line) - 2) if (g := line[i : i + 3])[1] != " ")
    return n


@dataclass(frozen=True)
class Profiles:
    """Ranks by language over the union of all profile n-grams, coded in an alphabet of their letters."""

    langs: list[str]
    letters: np.ndarray  # code points, sorted
    codes: np.ndarray  # sorted codes of the union of n-grams
    ranks: np.ndarray  # languages x codes; RANKS where a profile lacks the n-gram

    @staticmethod
    def of(rows: list[tuple[str, str, int]]) -> Profiles:
        """From (lang, n-gram, rank)."""
        langs = sorted({r[0] for r in rows})
        letters = np.array(sorted({ord(c) for _, g, _ in rows for c in g if c != " "}), dtype=np.int64)
        base = len(letters) + 2
        code = {" ": 0} | {chr(c): i + 1 for i, c in enumerate(letters.tolist())}

        def coded(g: str) -> int:
            out = 0
            for c in g:
                out = out * base + code[c]
            return out + _offset(len(g), base)

        union = sorted({coded(g) for _, g, _ in rows})
        at = {c: i for i, c in enumerate(union)}
        ranks = np.full((len(langs), len(union)), RANKS, dtype=np.int64)
        for lang, g, rank in rows:
            ranks[langs.index(lang), at[coded(g)]] = rank
        return Profiles(langs, letters, np.array(union, dtype=np.int64), ranks)

    def _document(self, line: str) -> np.ndarray:
        """Codes of the most frequent n-grams by rank; ties go by code, so by letters."""
        points = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        base = len(self.letters) + 2
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        c = np.where(self.letters[at] == points, at + 1, base - 1)
        c[points == 32] = 0
        one = c[c > 0] + _offset(1, base)
        two = c[:-1] * base + c[1:] + _offset(2, base)
        three = ((c[:-2] * base + c[1:-1]) * base + c[2:] + _offset(3, base))[c[1:-1] > 0]
        every = np.sort(np.concatenate([one, two, three]))
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.diff(np.append(start, len(every)))
        order = np.argsort(-count, kind="stable")[:RANKS]
        return every[start[order]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name of equals) and one minus its share of the largest distance."""
        line = folded(text)
        if not line or not self.langs:
            return UNKNOWN, 0.0
        own = self._document(line)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        place = np.arange(len(own))
        out = np.where(known, np.abs(self.ranks[:, at] - place), RANKS)
        out[self.ranks[:, at] == RANKS] = RANKS
        distance = out.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (RANKS * len(own)))


def _offset(length: int, base: int) -> int:
    """Where the codes of n-grams of this length begin."""
    return sum(base**k for k in range(1, length))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, Counter[str]] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(grams(folded(text)))
    rows = [(lang, g, n) for lang, c in by.items() for g, n in c.items()]
    if rows:
        yield batch(_GRAMS, list(zip(*rows, strict=True)))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all languages in ``docs``; rows with a null language are left out.

    The profiles (RANKS rows per language) are the only thing that reaches the driver.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    # Of a language with n documents a share of SAMPLE_ROWS / n is let through, by hash.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") < SAMPLE_ROWS)
    found = sample.select("lang", "text").mapInArrow(_count, "lang string, gram string, n long")
    totals = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = totals.withColumn("rank", rank).where(F.col("rank") < RANKS)
    return Profiles.of([(r["lang"], r["gram"], r["rank"]) for r in top.collect()])


def predicted(docs: DataFrame, profiles: Profiles, text: str = "text", into: str = "language") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``into`` of lang_pred and score.

    Null texts, texts without letters, and all texts where no language was learnt are ``und`` with
    score 0. Repeated rows are predicted alike, an empty table gives no rows. ``into`` must not be a
    column of ``docs``.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [profiles.predict(t.as_py()) for t in b]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["lang_pred", "score"],
            )

    return docs.withColumn(unused(docs, into), run(F.col(text)))
