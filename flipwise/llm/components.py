"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregation and one join on the link table, whose rows never
outgrow the links given; AQE splits the join of a node with very many links.
The table is written to the shared folder after each pair of steps, so a lost
executor repeats one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links (a, b) with a > b.  Small: a's smaller neighbours go to the least of them; large: all larger ones do."""
    near = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("x"), "m").unionByName(joined.select(F.col("a").alias("x"), "m"))
    else:
        out = joined.where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is its least node.

    Links from a node to itself and repeated links change nothing; no links, no rows.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        now = stored(_star(_star(now, False), True), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
