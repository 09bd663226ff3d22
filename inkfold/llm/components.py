"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Edges hold u > v. The least neighbour of each node is written first, so that both sides of the join
    are plain exchanges, which Spark can split where a hub has many rows."""
    if large:
        seen = edges.select(F.col("v").alias("n"), F.col("u").alias("o")).union(edges.select(F.col("u").alias("n"), F.col("v").alias("o")))
        least = save(seen.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m")))
        out = edges.join(least, edges.v == least.n).select(F.col("u"), F.col("m").alias("v"))
    else:
        least = save(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")))
        hooked = edges.join(least, edges.u == least.n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hooked.union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    done = save(out.distinct())
    drop_saved(least)
    return done


def _settled(edges: DataFrame) -> bool:
    up = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    per = up.union(down).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (two columns a, b of one orderable type); component: its least node.

    Null ends and loops are left out; repeated edges count once; no edges give no rows. Each round is written to the
    shared folder. The rounds end when the edges are stars: no node has two lesser ones, or a lesser and a greater one."""
    a, b = edges.columns[:2]
    now = save(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _settled(now):
        mid = _stars(now, large=True)
        drop_saved(now)
        now = _stars(mid, large=False)
        drop_saved(mid)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
