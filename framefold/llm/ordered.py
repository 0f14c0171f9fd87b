"""Numbering rows inside keys of any size, shared by the conversation operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framefold.llm.scratch import stored


def numbered(df: DataFrame, key: str, order: list[str], at: str = "at", sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``at``, the place (from 0) of each row among those of its key.

    Two levels: rows are range partitioned by key and order, numbered inside each partition, and shifted by
    the totals of the key's earlier partitions, so one key may hold any share of all rows. ``sums`` and
    ``xors`` (new column: long column) add the sum, or the exclusive or, over the earlier rows of the key; 0 at its first.
    Null keys form one group. The rows are written to the scratch folder first, so that places stay.
    """
    adds = {**{c: (v, F.sum) for c, v in (sums or {}).items()}, **{c: (v, F.bit_xor) for c, v in (xors or {}).items()}}
    ranged = stored(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
                    .withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "ordered")
    zero = F.lit(0).cast("long")
    earlier = Window.partitionBy(key, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({"_at": F.count(F.lit(1)).over(earlier), **{f"_{c}": F.coalesce(agg(v).over(earlier), zero) for c, (v, agg) in adds.items()}})
    totals = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), *[agg(v).alias(f"_{c}") for c, (v, agg) in adds.items()])
    parts = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition of the key
    shift = totals.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(parts), zero).alias("_shift"),
                          *[F.coalesce(agg(f"_{c}").over(parts), zero).alias(f"_{c}_shift") for c, (_, agg) in adds.items()])
    both = {F.sum: lambda x, y: x + y, F.bit_xor: lambda x, y: x.bitwiseXOR(y)}
    placed = local.join(shift, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return placed.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(at),
                         *[both[agg](F.col(f"_{c}"), F.col(f"_{c}_shift")).alias(c) for c, (_, agg) in adds.items()])
