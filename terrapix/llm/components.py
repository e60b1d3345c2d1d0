"""Connected components by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.sources.store import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots: the smallest node it is connected to.

    Large stars tie every larger neighbour to a node's smallest one, small
    stars the smaller ones; both keep components as they are and end with one
    star each.  Smallest neighbours are partial minima before the shuffle, so
    a node with very many edges is gathered nowhere.  Each round is written
    to the shared folder; loops, nulls and repeated edges are ignored.
    """
    cur = materialize(edges.where("a is not null and b is not null and a <> b")
                      .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "llm-edges")
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        old, cur = cur, materialize(small, "llm-edges")
        discard(old)
        before, state = state, _state(cur)
        if state == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
