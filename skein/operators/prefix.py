"""Running values over groups of any size: local windows over range-sorted pieces, and what the pieces before them add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpointed, parts_for


def running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, how: str = "sum", inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum, max or last non-null ``value`` of the rows of a group up to each one, or (not inclusive) before it.

    Rows are range-sorted by group and order, so a group of any size is cut
    over as many partitions as it needs; each piece is one window.  A piece's
    total is one row, and only a partition's first group can go on from the
    ones before, so what is sent back is at most one row a partition.  Null
    values add nothing; a row with nothing before it gets null.
    """
    pick = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.select("*", *[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys)], value.alias("_value"))
    ranged = rows.repartitionByRange(partitions or parts_for(df), *keys, *order)
    ranged = checkpointed(ranged.withColumn("_pid", F.spark_partition_id()))
    piece = Window.partitionBy("_pid", *keys).orderBy(*order)
    local = pick("_value").over(piece.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    # Of the last non-null value of a piece, the order decides; sums and maxima do not need it.
    if how == "last":
        ends = ranged.withColumn("_total", F.last("_value", ignorenulls=True).over(piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        totals = ends.groupBy("_pid", *keys).agg(F.first("_total").alias("_total"))
    else:
        totals = ranged.groupBy("_pid", *keys).agg(pick("_value").alias("_total"))
    earlier = pick("_total").over(Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.withColumn("_before", earlier).filter("_before is not null").select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"{k}b") for k in keys], "_before")
    same = F.col("_pid") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}b"))
    out = ranged.withColumn(name, local).join(F.broadcast(before), same, "left")
    both = {"sum": F.coalesce(F.col(name) + F.col("_before"), F.col(name), F.col("_before")), "max": F.greatest(name, "_before"), "last": F.coalesce(name, "_before")}[how]
    return out.withColumn(name, both).drop("_pid", "_p", "_value", "_before", *keys, *[f"{k}b" for k in keys])

