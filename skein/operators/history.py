"""What changes together: history mining over (commit, file) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def file_history(changes: DataFrame) -> DataFrame:
    """AGG01: (file, commits, lines, stability)."""
    out = changes.groupBy("file").agg(F.countDistinct("commit_id").alias("commits"), F.sum(F.col("ins") + F.col("dels")).alias("lines"))
    return out.withColumn("stability", S.stability("commits", "lines"))


def active(files: DataFrame, least: int, most_files: int | None = None) -> DataFrame:
    """Rows of files with at least ``least`` commits, without commits of more than ``most_files`` files.

    Both cuts come before any pair is made, so that rare files and sweeping
    commits never fan out.
    """
    rows = files.select("commit_id", "file").distinct()
    if most_files is not None:
        rows = rows.join(rows.groupBy("commit_id").agg(F.count("*").alias("k")).filter(F.col("k") <= most_files), "commit_id", "left_semi")
    return rows.join(rows.groupBy("file").agg(F.count("*").alias("k")).filter(F.col("k") >= least), "file", "left_semi")


def pair_counts(rows: DataFrame) -> DataFrame:
    """JN02: (file_a, file_b, n_ab) with file_a < file_b, counted with map-side combine.

    The files of a commit are gathered once (their number is bounded by the
    commit), and the pairs unfold from the sorted array: one shuffle by commit
    instead of a self-join.
    """
    per = rows.groupBy("commit_id").agg(F.array_sort(F.collect_set("file")).alias("fs"))
    firsts = per.select("fs", F.posexplode("fs").alias("i", "file_a"))
    pairs = firsts.select("file_a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("n_ab"))


def couplings(files: DataFrame, threshold: float = 0.5, least_pair: int = 3, least_file: int = 3, most_files: int | None = None, top: int | None = 50) -> DataFrame:
    """AGG03, TOP02: (file_a, file_b, n_ab, strength); strength = n_ab / min(n_a, n_b), rounded to 3."""
    rows = active(files, least_file, most_files)
    n = rows.groupBy("file").agg(F.count("*").alias("n"))
    pairs = pair_counts(rows).filter(F.col("n_ab") >= least_pair)
    out = pairs.join(n.select(F.col("file").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(n.select(F.col("file").alias("file_b"), F.col("n").alias("n_b")), "file_b")
    out = out.withColumn("strength", F.col("n_ab") / F.least("n_a", "n_b")).filter(F.col("strength") >= threshold)
    out = out.select("file_a", "file_b", "n_ab", F.round("strength", 3).alias("strength"))
    return out.orderBy(F.desc("strength"), F.desc("n_ab"), "file_a", "file_b").limit(top) if top else out


def contracts(files: DataFrame, threshold: float = 0.7, least_pair: int = 3, least_file: int = 5, most_files: int | None = None, top: int | None = 30) -> DataFrame:
    """JN03, AGG04: (trigger, coupled, n_ab, confidence) with P(coupled | trigger) >= threshold."""
    rows = active(files, least_file, most_files)
    n = rows.groupBy("file").agg(F.count("*").alias("n"))
    pairs = pair_counts(rows).filter(F.col("n_ab") >= least_pair)
    both = pairs.select(F.col("file_a").alias("trigger"), F.col("file_b").alias("coupled"), "n_ab").unionAll(pairs.select("file_b", "file_a", "n_ab"))
    out = both.join(n.select(F.col("file").alias("trigger"), "n"), "trigger").withColumn("confidence", F.col("n_ab") / F.col("n")).filter(F.col("confidence") >= threshold)
    out = out.select("trigger", "coupled", "n_ab", F.round("confidence", 3).alias("confidence"))
    return out.orderBy(F.desc("confidence"), F.desc("n_ab"), "trigger", "coupled").limit(top) if top else out


def npmi(files: DataFrame, least_pair: int = 2, most_files: int | None = None) -> DataFrame:
    """AGG05: (file_a, file_b, npmi), symmetric, at least 0; N is the number of commits."""
    rows = active(files, least_pair, most_files)
    every = files.select("commit_id").distinct().agg(F.count("*").alias("total"))
    n = rows.groupBy("file").agg(F.count("*").alias("n"))
    pairs = pair_counts(rows).filter(F.col("n_ab") >= least_pair)
    out = pairs.join(n.select(F.col("file").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(n.select(F.col("file").alias("file_b"), F.col("n").alias("n_b")), "file_b").join(F.broadcast(every))
    p = F.col("n_ab") / F.col("total")
    pmi = F.log2(F.col("n_ab") * F.col("total") / (F.col("n_a") * F.col("n_b")))
    score = F.when(p == 1, 0.0).otherwise(F.greatest(pmi / F.when(p < 1, -F.log2(p)), F.lit(0.0)))
    out = out.select("file_a", "file_b", F.round(score, 6).alias("npmi"))
    return out.unionAll(out.select("file_b", "file_a", "npmi"))


def repeat_weights(files: DataFrame, most_files: int = 100) -> DataFrame:
    """AGG06: (file_a, file_b, weight): pairs seen twice or more, one less than their count; exact, not probabilistic."""
    rows = active(files, 2, most_files)
    return pair_counts(rows).filter("n_ab >= 2").select("file_a", "file_b", (F.col("n_ab") - 1).alias("weight"))


def recent_by_module(rows: DataFrame, module: str, order: list, n: int = 5) -> DataFrame:
    """WIN02: the first n rows of each module."""
    rank = F.row_number().over(Window.partitionBy(module).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)
