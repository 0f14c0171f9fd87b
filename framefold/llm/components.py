"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Edges stay in Spark throughout; every round is written to the shared scratch
folder, and the driver sees only a count and a checksum of it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.scratch import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook each node's larger (large star) or smaller neighbours to its least one."""
    near = edges if not large else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The least neighbour is aggregated before the shuffle, so a hub costs one row a task.
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hooked = near.join(least, "a")
    if large:
        return hooked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return hooked.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id reachable.

    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    def down(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")

    now = stored(down(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))).distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = stored(_star(_star(now, large=True), large=False), "edges")
        then = _state(after)
        drop_stored(edges.sparkSession, now)
        now = after
        if then == state:
            break
        state = then
    roots = now.select(F.col("b").alias("id")).distinct()
    return (now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .union(roots.select("id", F.col("id").alias("component"))))
