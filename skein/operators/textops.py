"""Operators on lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Signal words of comments with their priority (fixed values).
SIGNALS = ((10, "WARNING|DANGER|CRITICAL"), (9, "IMPORTANT|INVARIANT"), (8, "HACK|WORKAROUND"), (6, "NOTE|NB"), (5, "TODO|FIXME|XXX"))


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, line) with carriage returns removed; a null text gives no line."""
    return df.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("no", "line"))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """FN24: (key, section, heading, body_lines); text before the first heading is the Introduction.

    Sections are cut inside each text by array functions, without a shuffle.
    """
    lines = F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")
    numbered = df.select(key, lines.alias("_lines"), F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.startswith("#").alias("h"))).alias("_n"))
    heads = numbered.select(key, "_lines", F.concat(F.array(F.lit(-1)), F.transform(F.filter("_n", lambda x: x["h"]), lambda x: x["i"])).alias("_at"))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_lines")))
    cut = heads.select(key, F.posexplode(F.zip_with("_at", ends, lambda a, b: F.struct(a.alias("i"), (b - a - 1).cast("long").alias("n"), F.when(a < 0, "Introduction").otherwise(F.trim(F.regexp_replace(F.get("_lines", a), "^#+", ""))).alias("heading")))).alias("section", "s"))
    return cut.filter("s.n > 0").select(key, F.col("section").cast("long").alias("section"), F.col("s.heading").alias("heading"), F.col("s.n").alias("body_lines"))


def signal_comments(df: DataFrame, key: str, text: str) -> DataFrame:
    """FN25: (key, no, signal, priority, text), one match per line."""
    words = "|".join(w for _, w in SIGNALS)
    pattern = rf"(?i)(?:#|//)\s*({words})\b\s*:?\s*(.*?)(?:\s+#.*|\s+//.*)?$"
    lines = numbered_lines(df, key, text).filter(F.col("line").rlike(pattern))
    signal = F.upper(F.regexp_extract("line", pattern, 1))
    priority = F.lit(None).cast("int")
    for level, some in SIGNALS:
        priority = F.when(signal.isin(*some.split("|")), level).otherwise(priority)
    return lines.select(key, "no", signal.alias("signal"), priority.alias("priority"), F.trim(F.regexp_extract("line", pattern, 2)).alias("text"))


def line_chunks(df: DataFrame, key: str, text: str, size: int = 100, overlap: int = 10) -> DataFrame:
    """WIN08: (key, chunk, first, n_lines) in strides of size - overlap, stopping when a chunk reaches the end."""
    lines = F.split(F.col(text), "\n")
    n = F.size(lines)
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(stride))
    out = df.filter(F.col(text).isNotNull()).select(key, n.alias("n"), F.posexplode(starts).alias("chunk", "first"))
    return out.select(key, F.col("chunk").cast("long").alias("chunk"), F.col("first").cast("long").alias("first"), F.least(F.lit(size), F.col("n") - F.col("first")).cast("long").alias("n_lines"))


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """WIN07: (keys, first, last) of each run of consecutive positions."""
    label = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return df.select(*keys, position).distinct().withColumn("_run", label).groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("_run")
