"""Connected components of a large, sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), 64-bit ids, to ``id`` and ``root``, its component's least id.

    Large-star and small-star steps in turn until nothing changes: about log(n)
    rounds, each a few shuffles of no more edges than were given. Each round is
    written to the shared folder. Loops and repeats are dropped; ids without a
    link to another don't appear.
    """
    edges = stored(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        last, edges = edges, stored(_small_star(_large_star(edges)))
        discard(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            )
        mark = now
