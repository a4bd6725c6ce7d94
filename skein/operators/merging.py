"""Two versions of one thing: entity differences, conflicts, three-way sets, latest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running


def entity_diff(before: DataFrame, after: DataFrame, keys: list[str], text: str) -> DataFrame:
    """JN32, JN35: (keys, change): ADD, REMOVE or MODIFY; equal entities do not come out."""
    a = before.select(*keys, F.col(text).alias("_old"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(text).alias("_new"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "ADD").when(F.col("_b").isNull(), "REMOVE").when(~F.col("_old").eqNullSafe(F.col("_new")), "MODIFY")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def conflicts(ours: DataFrame, theirs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """JN33: (keys, kind): both sides changed; the same text commutes, another conflicts."""
    a, b = ours.select(*keys, F.col(text).alias("_x")), theirs.select(*keys, F.col(text).alias("_y"))
    return a.join(b, keys).select(*keys, F.when(F.col("_x").eqNullSafe(F.col("_y")), "commutes").otherwise("conflict").alias("kind"))


def overlapping(segments: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """JN34, WIN15: segments that begin before the greatest end before them, for groups of any size."""
    out = running(segments, keys, [F.col(start), F.col(end)], F.col(end), "_reach", "max", inclusive=False)
    return out.filter(F.col(start) < F.col("_reach")).drop("_reach")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """SET09: (base without what either removed) with what either added."""
    kept = base.join(ours, keys, "left_semi").join(theirs, keys, "left_semi")
    added = ours.join(base, keys, "left_anti").unionByName(theirs.join(base, keys, "left_anti"))
    return kept.unionByName(added).distinct()


def latest_wins(rows: DataFrame, key: str, order: Column, value: list[str]) -> DataFrame:
    """WIN17, STR10: the last row per key, and how many it replaced."""
    out = rows.groupBy(key).agg(F.max_by(F.struct(*value), order).alias("_v"), (F.count("*") - 1).alias("superseded"))
    return out.select(key, *[F.col(f"_v.{v}").alias(v) for v in value], "superseded")


def replaced(rows: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    """JN46: keys renamed where a rename is known."""
    r = renames.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(r, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
