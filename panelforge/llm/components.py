"""Connected components on tables of links, by alternating large and small stars.

Each round moves every link nearer to its component's smallest node; rounds grow with the logarithm
of the longest path. Links stay in the shared folder between rounds; the driver sees one checksum
and one count a round, never links or labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e: distinct (u, v) with u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    j = both.join(low, "u")
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: (a, b). Returns (node, component) for every node that has a link; component is its
    smallest node."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, f"{name}_0")
    was, i = _sum(e), 0
    while was[0]:
        i += 1
        new = materialize(_star(_star(e, True), False), f"{name}_{i}")
        now = _sum(new)
        forget(e)
        e = new
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
    out._scratch = e._scratch
    return out
