"""Writes: versions, logs, caches and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str) -> str:
    """SNK01, SNK06: a new version beside the old ones, then the pointer; readers never see half a version."""
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.range(1).select(F.lit(path).alias("path"), F.unix_micros(F.current_timestamp()).alias("at")).coalesce(1).write.mode("append").json(f"{root}/_versions")
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    last = spark.read.schema("path string, at long").json(f"{root}/_versions").orderBy(F.desc("at")).first()
    return spark.read.parquet(last["path"])


def append_log(df: DataFrame, path: str) -> None:
    """SNK02: JSON lines, appended by the committer."""
    df.write.mode("append").json(path)


def write_caches(root: str, tables: dict[str, DataFrame]) -> None:
    """SNK05, SNK10, SNK12: named derived tables, each replaced whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_caches(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC21-23: the named derived tables; one that was never written is left out."""
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")
    conf = spark._jsc.hadoopConfiguration()
    return {name: spark.read.parquet(f"{root}/{name}") for name in names if path(name).getFileSystem(conf).exists(path(name))}


def upsert(state: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """SNK13, STR08: rows of ``updates`` replace those of ``state`` by key."""
    return state.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def as_json(df: DataFrame) -> DataFrame:
    """SNK08: one JSON text per row, fields in the order of the columns."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def graph_payload(edges: DataFrame) -> DataFrame:
    """SNK11: nodes and edges of a graph as one table (kind, a, b)."""
    nodes = edges.select(F.col("src").alias("a")).union(edges.select("dst")).distinct()
    return nodes.select(F.lit("node").alias("kind"), "a", F.lit(None).cast("long").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def markdown_table(df: DataFrame, order: list, limit: int = 100) -> str:
    """SNK09: the first rows as a markdown table, for a report; the limit is the report's length."""
    rows = df.orderBy(*order).limit(limit).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows])
