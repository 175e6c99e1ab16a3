"""URL filter: host and path rules, and a character model ratio for urls that no rule fits.

Two smoothed Markov models of variable order (up to three characters of context) are counted from
urls that the rules accept and reject. A url is judged by the mean difference of its characters'
log-likelihoods; the cut lies between the means of both kinds of urls, as far from each as their
spreads have it. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import stored

# (host, path, verdict)
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: The model knows 32 characters: a-z, one for all digits, four marks, and one for all others.
#: So it has 32 ** 4 contexts with a next character at most, whatever the number of urls.
SYMBOLS = 32
PRIOR = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ://; only A-Z of the host are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it, and the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _characters(url: Column) -> Column:
    """The url in the model's characters: digits are 0, rare characters ~."""
    plain = F.translate(F.lower(url), "123456789", "000000000")
    return F.coalesce(F.regexp_replace(plain, r"[^a-z0./?-]", "~"), F.lit(""))


def _grams(s: str) -> Column:
    """Every character behind the three before it, as strings of four."""
    return F.expr(
        f"""flatten(transform(array(split(concat('~~~', {s}), '')),
            a -> transform(sequence(0, size(a) - 4), i -> concat(a[i], a[i + 1], a[i + 2], a[i + 3]))))"""
    )


def _model(grams: DataFrame) -> DataFrame:
    """(gram, llr) from (gram, accepted, rejected) counts; a bounded table."""
    total = grams.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).first()
    for kind in ("accepted", "rejected"):
        p: Column = F.lit(1.0 / SYMBOLS)
        for order in range(4):
            def seen(start: int, length: int, kind: str = kind) -> Column:
                return F.sum(kind).over(Window.partitionBy(F.substring("gram", start, length)))

            pair = seen(4 - order, order + 1)
            context = seen(4 - order, order) if order else F.lit(total[kind] or 0)
            grams = grams.withColumn(f"p_{kind}", (pair + PRIOR * p) / (context + PRIOR))
            p = F.col(f"p_{kind}")
    return grams.select("gram", (F.ln("p_accepted") - F.ln("p_rejected")).alias("llr"))


def judged(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of ``pages``.

    ``score`` is the mean log-likelihood ratio less the cut; at zero or more a url without a rule is
    allowed. Where the rules do not give urls of both kinds to learn from, such urls are allowed with
    score 0, and so are null and empty urls. Repeated rows are judged alike but counted once. An
    empty table gives no rows. Other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), _characters(F.col("url")).alias("s"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    # Urls that are the same to the model are scored once, and count once for each verdict.
    urls = stored(
        rows.groupBy("s").agg(
            F.max((F.col("fit.verdict") == "allow").cast("int")).alias("accepted"),
            F.max((F.col("fit.verdict") == "block").cast("int")).alias("rejected"),
        )
        .fillna(0, ["accepted", "rejected"])
        .where("s <> ''"),
        "urls",
    )
    spots = urls.select("s", "accepted", "rejected", F.explode(_grams("s")).alias("gram"))
    counts = stored(
        spots.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams"
    )
    model = stored(_model(counts), "url-model")
    scores = stored(
        # 32 ** 4 rows at most, see SYMBOLS.
        spots.join(F.broadcast(model), "gram")
        .groupBy("s")
        .agg(F.avg("llr").alias("llr"), F.max("accepted").alias("accepted"), F.max("rejected").alias("rejected")),
        "url-scores",
    )
    cut = scores.agg(
        *(f(F.when(F.col(k) == 1, F.col("llr"))).alias(f"{n}_{k}")
          for k in ("accepted", "rejected") for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))
    ).first()
    if cut["mean_accepted"] is None or cut["mean_rejected"] is None:
        score = F.lit(0.0)
    else:
        a, r = cut["sd_accepted"] + 1e-9, cut["sd_rejected"] + 1e-9
        score = F.coalesce(F.col("llr") - (cut["mean_accepted"] * r + cut["mean_rejected"] * a) / (a + r), F.lit(0.0))
    return rows.join(scores.select("s", "llr"), "s", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(score >= 0, "allow").otherwise("block")).alias("verdict"),
        score.alias("score"),
    )
