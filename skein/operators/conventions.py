"""Conventions: criteria over a file's structure, discovery and compliance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _criterion(kind: str, value: str) -> Column:
    if kind == "file_path":
        return F.col("path").rlike(value)
    if kind == "imports":
        return F.exists("imports", lambda i: i.rlike(value))
    if kind == "not_imports":
        return ~F.coalesce(F.exists("imports", lambda i: i.rlike(value)), F.lit(False))
    if kind == "exports":
        return F.exists("exports", lambda e: e.rlike(value))
    if kind == "class_ends_with":
        return F.exists("exports", lambda e: F.endswith(e, F.lit(value)))
    if kind == "language":
        return F.col("language") == value
    raise ValueError(f"unknown criterion {kind}")


def matches_convention(rule: dict) -> Column:
    """FLT06: any_of and all_of over criteria, nested at will; a null property matches nothing."""
    if "any_of" in rule:
        return reduce(lambda a, b: a | b, [matches_convention(r) for r in rule["any_of"]], F.lit(False))
    if "all_of" in rule:
        return reduce(lambda a, b: a & b, [matches_convention(r) for r in rule["all_of"]], F.lit(True))
    return reduce(lambda a, b: a & b, [F.coalesce(_criterion(k, v), F.lit(False)) for k, v in rule.items()], F.lit(True))


def compliance(df: DataFrame, matching: Column, compliant: Column) -> DataFrame:
    """AGG41: the compliant share of the matching rows; 1 if none match."""
    out = df.agg(F.count_if(matching).alias("matching"), F.count_if(matching & compliant).alias("compliant"))
    return out.withColumn("compliance", F.when(F.col("matching") > 0, F.col("compliant") / F.col("matching")).otherwise(1.0))


def discover_groups(df: DataFrame, key: str, passes: list[tuple[str, Column]], least: int = 3) -> DataFrame:
    """AGG38: (kind, value, n): groups of ``least`` or more keys that share a value; a key counts in the first pass that groups it.

    Each pass names a kind and an array of values per row.
    """
    claimed = None
    out = None
    for kind, values in passes:
        rows = df.select(key, F.explode(F.array_distinct(values)).alias("value")).filter("value is not null")
        if claimed is not None:
            rows = rows.join(claimed, key, "left_anti")
        groups = rows.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        mine = rows.join(groups, "value", "left_semi").select(key).distinct()
        claimed = mine if claimed is None else claimed.unionByName(mine)
        found = groups.select(F.lit(kind).alias("kind"), "value", "n")
        out = found if out is None else out.unionByName(found)
    return out
