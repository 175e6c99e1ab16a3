"""Graph work as DataFrame rounds: connected components and map-equation communities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.kernels import TIE
from sojourn.session import cut, written


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the smallest node id of each connected component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): O(log n) rounds, every
    round one partial aggregate and one join on node ids, no neighbour list is ever collected.
    ``edges`` has src and dst; each round is checkpointed so that a lost executor costs one round.
    """
    current = cut(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    signature = None
    while True:
        current = cut(_small_star(_large_star(current)))
        # The edge set is stable when its size and an order-free digest stop changing.
        row = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row["n"], row["h"]) == signature:
            break
        signature = (row["n"], row["h"])
    roots = current.select(F.col("u").alias(node), F.col("v").alias("component"))
    return (
        nodes.select(node)
        .join(roots, node, "left")
        .select(node, F.coalesce("component", F.col(node)).alias("component"))
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(low, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return linked.union(low.select("u", F.col("m").alias("v"))).distinct()


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * (F.log(x) / math.log(2.0))).otherwise(F.lit(0.0))


def map_equation_communities(edges: DataFrame) -> DataFrame:
    """(node, module) by the two-level map equation on edges (component, src, dst, weight; each pair once).

    Every component is optimised on its own. Each round scores all linked module pairs by how much
    their merger shortens the description, and merges the pairs that are each other's best choice;
    ties are broken by a number of the pair that changes per round, so that equal choices pair off at
    random. Pairs never overlap, so rounds only improve and must end. A module is named by its least
    node. ``kernels.merged_modules`` makes the same mergers in memory: flows stay sums of weights, which
    are exact for counts, and gains are rounded.
    """
    both = written(
        edges.select("component", "src", "dst", "weight").union(
            edges.select("component", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        )
    )
    total = written(both.groupBy("component").agg(F.sum("weight").alias("total")))
    links = both.select("component", "src", "dst", F.col("weight").alias("w"))
    flow = written(links.groupBy("component", F.col("src").alias("module")).agg(F.sum("w").alias("p")))
    membership = flow.select(F.col("module").alias("node"), "module")
    turn = 0
    while True:
        merges = written(_best_mergers(links, flow, total, turn))
        if merges.isEmpty():
            return membership.select("node", "module")
        turn += 1
        membership = written(_renamed(membership, merges, "module"))
        moved = _renamed(_renamed(links, merges, "src"), merges, "dst").where(F.col("src") != F.col("dst"))
        links = written(moved.groupBy("component", "src", "dst").agg(F.sum("w").alias("w")))
        flow = written(_renamed(flow, merges, "module").groupBy("component", "module").agg(F.sum("p").alias("p")))


def _renamed(rows: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    new = merges.select(F.col("b").alias(column), F.col("a").alias("_new"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def _best_mergers(links: DataFrame, flow: DataFrame, total: DataFrame, turn: int) -> DataFrame:
    """Disjoint pairs (a < b) whose merger is the best choice of both."""
    out = links.groupBy(F.col("src").alias("module")).agg(F.sum("w").alias("q"))
    sums = links.groupBy("component").agg(F.sum("w").alias("qs")).join(total, "component")
    stats = flow.select("module", "p").join(out, "module")
    one = stats.select(F.col("module").alias("src"), F.col("p").alias("pa"), F.col("q").alias("qa"))
    two = stats.select(F.col("module").alias("dst"), F.col("p").alias("pb"), F.col("q").alias("qb"))
    pairs = links.where(F.col("src") < F.col("dst")).join(one, "src").join(two, "dst").join(sums, "component")
    qa, qb, pa, pb, qs = (F.col(x) / F.col("total") for x in ("qa", "qb", "pa", "pb", "qs"))
    q = F.greatest((F.col("qa") + F.col("qb") - 2 * F.col("w")) / F.col("total"), F.lit(0.0))
    left = F.greatest((F.col("qs") - 2 * F.col("w")) / F.col("total"), F.lit(0.0))
    gain = (
        _plogp(left)
        - _plogp(qs)
        - 2 * (_plogp(q) - _plogp(qa) - _plogp(qb))
        + _plogp(q + pa + pb)
        - _plogp(qa + pa)
        - _plogp(qb + pb)
    )
    a, b, m = F.pmod("src", F.lit(TIE[0])), F.pmod("dst", F.lit(TIE[0])), F.lit(TIE[3])
    tie = F.pmod(a * TIE[1] + b * TIE[2] + F.lit(turn) * a * b, m)
    choice = F.struct(F.round(gain, 10).alias("gain"), tie.alias("tie"), F.col("src").alias("a"), F.col("dst").alias("b"))
    good = pairs.select(choice.alias("c")).where(F.col("c.gain") < 0)
    sides = good.select("c", F.explode(F.array("c.a", "c.b")).alias("module"))
    best = sides.groupBy("module").agg(F.min("c").alias("c"))
    return best.groupBy("c.a", "c.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).select("a", "b")
