"""Overlapping and gapped time intervals, merged per entity.

The rows are range-sorted once by (entity, start).  A hot entity is cut over
as many partitions as its rows need, because the range key ends in the start,
the end and a hash of the row.  Each sorted partition is then summarised by
the largest end of its first and of its last entity; the summaries (one row
per partition) are prefix-combined, which gives each partition the end that
is open where it begins.  A second scan starts from that carried end, emits
every gap, and labels islands.  Islands that touch a partition's edge come
out as at most two pieces a partition, which are stitched at the end.

Nothing of the size of an entity ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpointed, parts_for

_LEAST = np.iinfo(np.int64).min
_PIECES = "entity string, kind string, start long, end long, pid int, edge int"


def _runs(entity: np.ndarray) -> np.ndarray:
    """Where each run of one entity begins in a sorted column."""
    return np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last entity of a partition, each with its largest end."""
    pid = first = last = None
    first_end = last_end = _LEAST
    for pdf in batches:
        if not len(pdf):
            continue
        names, ends = pdf["entity"].to_numpy(), pdf["end"].to_numpy()
        pid = int(pdf["pid"].iloc[0])
        starts = _runs(names)
        peaks = np.maximum.reduceat(ends, starts)
        for name, peak in zip((names[starts[0]], names[starts[-1]]), (peaks[0], peaks[-1])):
            if first is None:
                first, last = name, name
            if name == first:
                first_end = max(first_end, peak)
            last_end = max(last_end, peak) if name == last else peak
            last = name
    if pid is not None:
        yield pd.DataFrame({"pid": [pid], "first": [first], "first_end": [first_end], "last": [last], "last_end": [last_end]})


def _combine(summaries: list) -> dict[int, tuple[str, int]]:
    """Exclusive prefix: per partition, the entity and end open before it."""
    carried: dict[int, tuple[str, int]] = {}
    name, end = None, _LEAST
    for row in sorted(summaries, key=lambda r: r["pid"]):
        if name is not None:
            carried[row["pid"]] = (name, end)
        if row["first"] == row["last"]:
            end = max(end, row["first_end"]) if row["first"] == name else row["first_end"]
        else:
            end = row["last_end"]
        name = row["last"]
    return carried


def _rescan(carried: dict[int, tuple[str, int]]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, name, reach = None, None, _LEAST
        held: tuple | None = None  # the open island: entity, start, end, is a continuation
        for pdf in batches:
            if not len(pdf):
                continue
            names, starts, ends = pdf["entity"].to_numpy(), pdf["start"].to_numpy(), pdf["end"].to_numpy()
            if pid is None:
                pid = int(pdf["pid"].iloc[0])
                name, reach = carried.get(pid, (None, _LEAST))
            heads = _runs(names)
            rank = np.zeros(len(names), dtype=np.int64)
            rank[heads] = 1
            rank = np.cumsum(rank) - 1
            run_max = np.empty(len(names), dtype=np.int64)
            for a, b in zip(heads, np.r_[heads[1:], len(names)]):
                np.maximum.accumulate(ends[a:b], out=run_max[a:b])
            if names[0] == name:
                stop = heads[1] if len(heads) > 1 else len(names)
                np.maximum(run_max[:stop], reach, out=run_max[:stop])
            before = np.r_[_LEAST, run_max[:-1]]
            before[heads] = _LEAST
            if names[0] == name:
                before[0] = reach
            opens = starts > before
            at = np.flatnonzero(opens)
            gap = at[before[at] != _LEAST]
            parts = [pd.DataFrame({"entity": names[gap], "kind": "gap", "start": before[gap], "end": starts[gap], "edge": 0})]
            if not opens[0]:  # goes on from the batch or partition before
                stop = at[0] if len(at) else len(names)
                held = (names[0], held[1], max(held[2], int(ends[:stop].max())), held[3]) if held else (names[0], int(starts[0]), int(ends[:stop].max()), True)
            if len(at):
                if held:
                    parts.append(pd.DataFrame({"entity": [held[0]], "kind": "period", "start": [held[1]], "end": [held[2]], "edge": [2 if held[3] else 0]}))
                stops = np.r_[at[1:], len(names)]
                parts.append(pd.DataFrame({"entity": names[at[:-1]], "kind": "period", "start": starts[at[:-1]], "end": run_max[stops[:-1] - 1], "edge": 0}))
                held = (names[at[-1]], int(starts[at[-1]]), int(run_max[-1]), False)
            name, reach = names[-1], int(run_max[-1])
            yield pd.concat(parts).assign(pid=pid)[["entity", "kind", "start", "end", "pid", "edge"]]
        if held:
            yield pd.DataFrame({"entity": [held[0]], "kind": ["period"], "start": [held[1]], "end": [held[2]], "pid": [pid], "edge": [3 if held[3] else 1]})

    return scan


def merge_intervals(df: DataFrame, entity: Column, start: Column, end: Column, spread: Column | None = None, partitions: int | None = None) -> DataFrame:
    """Continuous periods and the gaps between them: (entity, kind, start, end).

    ``start`` and ``end`` are long columns.  Rows with a null entity, start or
    end, or with end <= start, drop out.  Intervals that only touch belong to
    one period.  Repeated rows change nothing.  An empty input gives an empty
    result.  Other columns of ``df`` are never read, whatever their names.
    ``spread`` is any deterministic column that tells equal rows apart, so
    that even equal rows can be cut over partitions.

    The collected summaries are one row per partition.
    """
    spark = df.sparkSession
    rows = df.select(
        entity.cast("string").alias("entity"), start.cast("long").alias("start"), end.cast("long").alias("end"), (spread if spread is not None else F.lit(0)).alias("_spread")
    ).filter("entity is not null and start is not null and end is not null and end > start")
    by = ["entity", "start", "end"]
    ranged = (
        rows.repartitionByRange(partitions or parts_for(rows), *by, "_spread").drop("_spread").sortWithinPartitions(*by).withColumn("pid", F.spark_partition_id())
    )
    ranged = checkpointed(ranged)
    summary = ranged.mapInPandas(_summaries, "pid int, first string, first_end long, last string, last_end long").collect()
    pieces = checkpointed(ranged.mapInPandas(_rescan(_combine(summary)), _PIECES))

    whole = pieces.filter("edge = 0").select("entity", "kind", "start", "end")
    # At most two rows per partition: one open at its end, one gone on from before.
    order = Window.orderBy("pid", F.when(F.col("edge") == 1, 1).otherwise(0))
    chained = pieces.filter("edge > 0").withColumn("chain", F.sum((F.col("edge") == 1).cast("int")).over(order))
    stitched = chained.groupBy("chain").agg(F.first("entity").alias("entity"), F.lit("period").alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.unionByName(stitched.select("entity", "kind", "start", "end"))
