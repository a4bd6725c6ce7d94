"""Top N items of every group by statistics-guided skipping.

1. Each partition of the input drops the rows that N others of their group in
   the same partition beat.  No such row can be among the N of the whole, and
   however many items a group has, at most N a partition of it go on.
2. What is left is clustered into Parquet files by group, each group whole in
   one file, and sorted by group and score descending, in small row groups.
3. The footer alone tells, for every row group, its groups and its largest and
   smallest score.  A row group of one single group with at least N rows bounds
   that group's N-th score from below by its smallest score; those strictly
   below the bound are dropped unread.
4. The other row groups of a file are read one after the other, which for each
   group is the order of descending maximum score.  One of a single group that
   lies strictly below the N-th score read so far is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import parts_for, scratch_path, size_in_bytes

#: Rows a task holds at most before it passes on what is left of them.
_HELD_ROWS = 1_000_000


def _opened(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    # The schemes of Hadoop's own clients name the same stores.
    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return pq.ParquetFile(system.open_input_file(inner))


def _changes(table: pa.Table, keys: list[str], by: np.ndarray) -> np.ndarray:
    """Where each group begins in a table sorted by group; ``by`` is its hash column."""
    new = by[1:] != by[:-1]
    for k in keys:
        column = table[k].combine_chunks() if isinstance(table[k], pa.ChunkedArray) else table[k]
        new = new | pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.r_[True, new] if len(by) else np.empty(0, dtype=bool)


def _ranks(new: np.ndarray) -> np.ndarray:
    """Place of each row in its run, from 0."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _best(table: pa.Table, keys: list[str], n: int) -> pa.Table:
    """The n best rows of every group of the table, in sorted order."""
    by, score, tie = (table[c].to_numpy() for c in ("_g", "_score", "_tie"))
    order = np.lexsort((tie, -score, by))
    out = table.take(pa.array(order))
    hashes = by[order]
    new = _changes(out, keys, hashes)
    if (new[1:] & (hashes[1:] == hashes[:-1])).any():  # two groups of one hash lie mixed
        order = pc.sort_indices(table, [("_g", "ascending"), *((k, "ascending") for k in keys), ("_score", "descending"), ("_tie", "ascending")])
        out = table.take(order)
        new = _changes(out, keys, out["_g"].to_numpy())
    return out.filter(pa.array(_ranks(new) < n))


def _beaten_dropped(keys: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, limit = 0, _HELD_ROWS
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > limit:
                held = [_best(pa.concat_tables(held), keys, n)]
                rows = held[0].num_rows
                if rows > _HELD_ROWS // 2:  # many groups; what is held cannot shrink much
                    yield from held[0].combine_chunks().to_batches(max_chunksize=100_000)
                    held, rows = [], 0
        if rows:
            yield from _best(pa.concat_tables(held), keys, n).combine_chunks().to_batches(max_chunksize=100_000)

    return run


def _plan(meta, keys: list[str], n: int) -> list[tuple[int, tuple | None, float]]:
    """(row group, its only group or None, largest score) of the row groups that may hold one of the n best, by the footer alone."""
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    groups, bounds = [], {}
    for k in range(meta.num_row_groups):
        g = meta.row_group(k)
        named = [g.column(at[c]).statistics for c in ("_g", *keys)]
        single = all(s is not None and s.has_min_max and s.min == s.max for s in named)
        only = tuple(s.min for s in named) if single else None
        scores = g.column(at["_score"]).statistics
        low, high = (scores.min, scores.max) if scores is not None and scores.has_min_max else (-np.inf, np.inf)
        groups.append((k, only, high))
        if only is not None and g.num_rows >= n:
            bounds[only] = max(bounds.get(only, -np.inf), low)
    return [x for x in groups if x[1] is None or x[2] >= bounds.get(x[1], -np.inf)]


def _survivors(keys: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file = _opened(path)
                group, count, nth = None, 0, -np.inf  # the group read last, how many of its rows, the score of the n-th
                for k, only, high in _plan(file.metadata, keys, n):
                    if only is not None and only == group and count >= n and high < nth:
                        continue
                    table = file.read_row_group(k, columns=["_g", *keys, "_score", "_tie"])
                    new = _changes(table, keys, table["_g"].to_numpy())
                    if not len(new):
                        continue
                    named = lambda i: tuple(table[c][i].as_py() for c in ("_g", *keys))
                    ranks = _ranks(new)
                    starts = np.flatnonzero(new)
                    if named(0) == group:
                        ranks[: starts[1] if len(starts) > 1 else len(ranks)] += count
                    else:
                        nth = -np.inf
                    last, score = int(starts[-1]), table["_score"].to_numpy()
                    if len(starts) > 1:
                        nth = -np.inf
                    here = np.flatnonzero(ranks[last:] == n - 1)
                    nth = float(score[last + here[0]]) if len(here) else nth
                    group, count = named(last), int(ranks[-1]) + 1
                    yield from table.filter(pa.array(ranks < n)).combine_chunks().to_batches()

    return run


def top_n_per_group(df: DataFrame, groups: list[str], score: str, tie: str, n: int, partitions: int | None = None, row_group_bytes: int | None = None) -> DataFrame:
    """The ``n`` rows of each group with the highest score: (groups, tie, score).

    At equal scores the smaller ``tie`` wins; ``tie`` must be unique in its
    group for the result to be one.  Rows with a null group column, a null
    tie, or a null or NaN score drop out; +-infinity are ordinary scores.
    Smaller groups give all their rows; an empty input gives an empty result.
    Only the named columns are read, so others may have any name.

    No group is ever whole in one place before its beaten rows are gone: of a
    group of any size at most ``n`` rows a partition of the input are moved.
    ``row_group_bytes`` sets how fine the statistics are; by default a file has
    about 64 row groups, of 256 KB to 128 MB.
    """
    spark = df.sparkSession
    keys = [f"_k{i}" for i in range(len(groups))]
    rows = df.select(
        F.xxhash64(*groups).alias("_g"), *[F.col(f"`{g}`").cast("string").alias(k) for g, k in zip(groups, keys)], (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("_score"), F.col(f"`{tie}`").cast("long").alias("_tie")
    ).dropna()
    rows = rows.filter(~F.isnan("_score"))
    parts = partitions or parts_for(df)
    block = row_group_bytes or min(128 << 20, max(256 << 10, size_in_bytes(df) // parts // 64))
    schema = f"_g long, {', '.join(f'{k} string' for k in keys)}, _score double, _tie long"
    path = scratch_path(spark, "topn")
    left = rows.mapInArrow(_beaten_dropped(keys, n), schema)
    left.repartition(parts, "_g").sortWithinPartitions("_g", *keys, F.col("_score").desc(), "_tie").write.option("parquet.block.size", block).parquet(path)

    files = spark.read.schema(schema).parquet(path).inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    best = listed.mapInArrow(_survivors(keys, n), schema)
    return best.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("_tie").alias(tie), F.col("_score").alias(score))
