"""Assertions over what a request returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _held(scopes: DataFrame, assertions: DataFrame) -> DataFrame:
    """Each scope with the assertions of its own name and those for all (scope *), which are few and sent."""
    a = assertions.withColumnRenamed("scope", "_of")
    own = scopes.join(a, F.col("scope") == F.col("_of"))
    return own.unionByName(scopes.join(F.broadcast(a.filter("_of = '*'")))).drop("_of")


def required_files(scopes: DataFrame, assertions: DataFrame) -> DataFrame:
    """FLT09: (scope, file): files an assertion wants included."""
    return _held(scopes.select("scope"), assertions).select("scope", F.explode("includes").alias("file")).filter("file is not null").distinct()


def failed_assertions(results: DataFrame, assertions: DataFrame) -> DataFrame:
    """FLT09: (scope, kind, detail): texts a context lacks, whatever their case, and results without the constraints asked for.

    ``results`` has scope, context and n_constraints; a null context lacks everything.
    """
    held = _held(results.select("scope", F.lower(F.coalesce("context", F.lit(""))).alias("_c"), F.coalesce("n_constraints", F.lit(0)).alias("_n")), assertions)
    texts = held.select("scope", "_c", F.explode("contains").alias("detail")).filter("detail is not null").filter(~F.contains(F.col("_c"), F.lower("detail")))
    bare = held.filter(F.coalesce("constraints", F.lit(False)) & (F.col("_n") == 0)).select("scope", F.lit("constraints").alias("kind"), F.lit("no constraint").alias("detail"))
    return texts.select("scope", F.lit("context").alias("kind"), "detail").unionByName(bare).distinct()
