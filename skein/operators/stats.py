"""Evaluation metrics, percentiles and confidence intervals."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def set_scores(predicted: Column, actual: Column) -> tuple[Column, Column]:
    """AGG22: recall and precision of two arrays as sets, 1.0 where the denominator is empty, rounded to 3."""
    empty = F.array().cast("array<string>")
    p, a = F.array_distinct(F.array_compact(F.coalesce(predicted, empty))), F.array_distinct(F.array_compact(F.coalesce(actual, empty)))
    both = F.size(F.array_intersect(p, a))
    share = lambda of: F.round(F.when(F.size(of) > 0, both / F.size(of)).otherwise(1.0), 3)
    return share(a), share(p)


def nearest_rank(df: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """AGG27: (group, p, value): s[min(int(n * p / 100), n - 1)] of the sorted values.

    Equal values are counted first, so what the window sorts is the distinct
    values of a group, not its rows.
    """
    each = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group)
    run = each.withColumn("_to", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    asked = run.withColumn("p", F.explode(F.array(*map(F.lit, percents))))
    at = F.least(F.floor(F.col("_n") * F.col("p") / 100), F.col("_n") - 1)
    return asked.filter((at < F.col("_to")) & (at >= F.col("_to") - F.col("_c"))).select(*group, "p", F.col(value).alias("value"))


def wilson(df: DataFrame, group: list[str], success: Column) -> DataFrame:
    """AGG30: (group, n, rate, ci_lower, ci_upper) in percent, rounded to 3."""
    out = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(success).alias("_k"))
    n, p = F.col("n"), F.col("_k") / F.col("n")
    below = 1 + Z * Z / n
    center, margin = (p + Z * Z / (2 * n)) / below, Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n) / below
    return out.select(*group, "n", F.round(p * 100, 3).alias("rate"), F.round(F.greatest(F.lit(0.0), center - margin) * 100, 3).alias("ci_lower"), F.round(F.least(F.lit(1.0), center + margin) * 100, 3).alias("ci_upper"))


def bootstrap_exact(values: list[float], resamples: int = 10_000, seed: int = 1337) -> tuple[float, float, float]:
    """AGG29 for one short list: mean and percentile bounds by the seeded Mersenne twister."""
    rng, n = random.Random(seed), len(values)
    if n < 2:
        return (values[0],) * 3 if values else (math.nan,) * 3
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))

    def at(q: float) -> float:
        i = q * (resamples - 1)
        lo, hi = math.floor(i), math.ceil(i)
        return means[lo] * (hi - i) + means[hi] * (i - lo) if hi > lo else means[lo]

    return sum(values) / n, at(0.025), at(0.975)


def bootstrap(df: DataFrame, group: str, key: str, value: str, resamples: int = 1000, seed: int = 1337) -> DataFrame:
    """AGG29 for groups of any size: (group, n, mean, ci_lower, ci_upper), rounded to 6.

    Every row draws a Poisson(1) weight for each resample from its own key, so
    the resamples of a partition add up to vectors of fixed length; groups are
    never gathered, and the result does not depend on the partitioning.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for g, k, v in zip(pdf["g"], pdf["k"], pdf["v"]):
                w = np.random.Generator(np.random.PCG64((int(k) ^ seed) & (2**63 - 1))).poisson(1.0, resamples)
                total, count, own = sums.setdefault(g, (np.zeros(resamples), np.zeros(resamples), [0, 0.0]))
                total += w * v
                count += w
                own[0] += 1
                own[1] += v
        for g, (total, count, own) in sums.items():
            yield pd.DataFrame({"g": g, "b": np.arange(resamples), "t": total, "c": count, "n": own[0], "s": own[1]})

    rows = df.select(F.col(group).cast("string").alias("g"), F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v")).dropna()
    added = rows.mapInPandas(partial, "g string, b int, t double, c double, n long, s double").groupBy("g", "b").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = added.withColumn("m", F.when(F.col("c") > 0, F.col("t") / F.col("c")).otherwise(F.col("s") / F.col("n")))
    out = means.groupBy("g").agg(F.max("n").alias("n"), F.max(F.col("s") / F.col("n")).alias("mean"), F.percentile("m", [0.025, 0.975]).alias("ci"))
    return out.select(F.col("g").alias(group), "n", F.round("mean", 6).alias("mean"), F.round(F.col("ci")[0], 6).alias("ci_lower"), F.round(F.col("ci")[1], 6).alias("ci_upper"))


def validation_class(df: DataFrame, trial: str, run: str, passed: Column) -> DataFrame:
    """AGG33: (trial, status): success if every run passed whole, failure if none did, else flaky."""
    runs = df.groupBy(trial, run).agg(F.every(passed).alias("_ok"))
    out = runs.groupBy(trial).agg(F.every("_ok").alias("_all"), F.some("_ok").alias("_any"))
    return out.select(trial, F.when(F.col("_all"), "success").when(~F.col("_any"), "failure").otherwise("flaky").alias("status"))


def unpivot_delta(before: DataFrame, after: DataFrame, metrics: list[str], tolerance: float = 0.01) -> DataFrame:
    """AGG54: (metric, before, after, delta, verdict) of two one-row tables."""
    long = lambda df, name: df.unpivot([], metrics, "metric", name)
    out = long(before, "before").join(long(after, "after"), "metric").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))
    return out.withColumn("verdict", F.when(F.col("delta") > tolerance, "better").when(F.col("delta") < -tolerance, "worse").otherwise("same"))
