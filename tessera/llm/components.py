"""Connected components of an edge table, by alternating stars.

Large-star hangs every larger neighbour of a node on the least node it knows;
small-star hangs a node and its smaller neighbours on the least of them. Each
round ends in a written table. Both steps are an aggregation and a join, so
a hub is pre-aggregated before the shuffle and its join can be split.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node u that isn't the least of its component, and that least node v.

    edges has two columns, longs, in either direction, repeats and loops
    allowed; rows with a null end are no edges.
    """
    a, b = edges.columns
    e = edges.filter(f"`{a}` != `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        last, e = e, written(small.distinct(), "edges")
        dropped(last)
        before, state = state, _state(e)
        if state == before:
            break
    return e
