"""Connected components of an edge table by alternating stars.

Large-star hangs every larger neighbour of a node on the smallest label around
it, small-star does so with the smaller ones; both keep the components and the
edges shrink to one star for each.  A round costs a few equi-joins on the edges
and is written to the shared folder; a hub's edges meet its label by broadcast
(``skew``).  Nothing is collected but a few numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, release
from .skew import join_totals


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"), "labels")
    joined = join_totals(both, low, ["u"], "degree")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    done = materialize(out.where("u <> v").distinct(), "edges")
    release(low, edges)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its
    smallest node.  ``edges`` has u and v; direction, order, loops and repeats
    do not matter, null ends are dropped."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == seen or not mark["n"]:
            break
        seen = mark["n"], mark["s"]
        now = _star(_star(now, large=True), large=False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
