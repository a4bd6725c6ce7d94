"""Source files that do not parse: per file, and as rates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...common import latest, spread
from .parser import EXTENSIONS, LANGUAGES, Parser, make_tables

_SCHEMA = "file_id long, repo string, path string, language string, at timestamp, valid boolean, line int, column int, token string"


@lru_cache(maxsize=1)
def _parsers(_: int, shared) -> dict[str, Parser]:
    return {name: Parser(name, tables) for name, tables in shared.value.items()}


def check_files(df: DataFrame, at: str | None = "recorded_at") -> DataFrame:
    """(file_id, repo, path, language, valid, line, column, token), one row per file.

    The language is that of the path's extension; files of other extensions,
    a null path or a null content have valid = null.  line, column and token
    say where the first unrecoverable error is (token is empty at the end of
    the text).  Of rows with one file_id the latest ``at`` counts; rows with a
    null file_id drop out.  An empty text is valid where the grammar allows
    it (Python, JavaScript, TypeScript, Rust, Java; not Go).  The contents are
    parsed where they are read, whole, and never shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(make_tables(LANGUAGES))
    rows = df.select(
        F.col("file_id").cast("long"), F.col("repo").cast("string"), F.col("path").cast("string"), (F.col(at) if at else F.lit(None)).cast("timestamp").alias("at"), F.col("content").cast("string")
    ).filter("file_id is not null")
    rows = spread(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = _parsers(id(shared), shared)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for path, text in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                language = EXTENSIONS.get(path.rpartition(".")[2]) if path and "." in path else None
                if language is None or text is None:
                    row = (language, None, None, None, None)
                else:
                    fault = parsers[language].check(text)
                    row = (language, fault is None, *(fault or (None, None, None)))
                for column, value in zip(out, row):
                    column.append(value)
            found = [pa.array(c, type=t) for c, t in zip(out, (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), found[0], batch.column(3), *found[1:]], ["file_id", "repo", "path", "language", "at", "valid", "line", "column", "token"]
            )

    return latest(rows.mapInArrow(run, _SCHEMA), ["file_id"], "at").drop("at") if at else rows.mapInArrow(run, _SCHEMA).drop("at")


def fault_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate) over the files that could be checked."""
    return (
        checked.filter("valid is not null").groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
