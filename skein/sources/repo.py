"""Scans over source trees and logs as relations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.globs import glob_regex
from ..operators.prefix import running

#: Extension -> language (fixed values).
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java"}
#: Directories no source scan enters (fixed values).
SKIP_DIRS = ("node_modules", "vendor", "build")
#: Directories and names no walk of a repository enters (fixed values).
PRUNED = (".git/", "node_modules/", "vendor/", "target/", "dist/", "build/", "__pycache__/", ".idea/", ".vscode/", "*.pyc")
#: Extensions whose changes a watcher reports (fixed values).
WATCHED = ("py", "ts", "js", "rs", "go")


def _system(root: str):
    """The file system of a root and the root's path in it."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", root)
    return fs.FileSystem.from_uri(uri if re.match(r"^[a-z][a-z0-9+.-]*:", uri) else "file://" + uri)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified): all files under a root, hidden ones and those of a leading underscore too, path relative to it.

    Spark's own listing passes over both kinds, and so over every ``__init__.py``.
    """
    from pyarrow import fs

    system, inner = _system(root)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    rows = [(f.path[len(inner) :].lstrip("/"), f.size, f.mtime) for f in found if f.is_file]
    return spark.createDataFrame(rows, "path string, length long, modified timestamp")


def _with_content(df: DataFrame, root: str) -> DataFrame:
    """Listed files with their bytes, read where the rows are."""

    def read(batches):
        import pyarrow as pa

        system, inner = _system(root)
        for batch in batches:
            data = []
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{inner}/{path}") as f:
                    data.append(f.read())
                if sum(map(len, data)) > 64 << 20:  # no batch holds many long files
                    yield pa.RecordBatch.from_arrays([*(c.slice(0, len(data)) for c in batch.columns), pa.array(data, pa.binary())], ["path", "length", "modified", "content"])
                    batch, data = batch.slice(len(data)), []
            if data:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], ["path", "length", "modified", "content"])

    return df.select("path", "length", "modified").mapInArrow(read, "path string, length long, modified timestamp, content binary")


def walk(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SRC01, SRC19: (path, length, modified, content) of the files under a directory whose name fits, path relative to it."""
    named = _listed(spark, root).filter(F.substring_index("path", "/", -1).rlike(glob_regex(pattern)))
    return _with_content(named, root)


def ignore_rules(directory: str, text: str) -> list[tuple[str, bool, bool]]:
    """(regular expression over a path, directories only, ignored) of each line of an ignore file in ``directory``, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        line = line if ignored else line[1:]
        only_dirs, line = line.endswith("/"), line.rstrip("/").removeprefix("\\")
        anchored, line = "/" in line, line.removeprefix("/")
        if not line:
            continue
        rx = ""
        for part in re.findall(r"/\*\*/|\*\*/|/\*\*|\*+|\?|\[[!^]?\]?[^\]]*\]|[^*?\[/]+|/|\[", line):
            if part == "/**/":
                rx += "/(?:.*/)?"
            elif part == "**/":
                rx += "(?:.*/)?"
            elif part == "/**":
                rx += "/.*"
            elif part[0] == "*":
                rx += "[^/]*"
            elif part == "?":
                rx += "[^/]"
            elif part[0] == "[" and len(part) > 1:
                rx += glob_regex(part)[1:-1]
            else:
                rx += re.escape(part)
        base = re.escape(directory.strip("/")) + "/" if directory.strip("/") else ""
        out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{rx}$", only_dirs, ignored))
    return out


def ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """SRC01, SRC04: is the file, or a directory above it, ignored?  Of the rules that fit one of them the last decides."""
    parts = F.split(path, "/")

    def verdict(p: Column, is_dir: Column) -> Column:
        out = F.lit(False)
        for rx, only_dirs, yes in rules:
            fits = p.rlike(rx) & is_dir if only_dirs else p.rlike(rx)
            out = F.when(fits, F.lit(yes)).otherwise(out)
        return out

    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("p"), (i < F.size(parts)).alias("d")))
    return F.coalesce(F.exists(ups, lambda x: verdict(x["p"], x["d"])), F.lit(False))


def walk_repository(spark: SparkSession, root: str, below: str = "", prune: tuple[str, ...] = PRUNED) -> DataFrame:
    """SRC01, SRC04: (path, length, modified, content), path relative to the root, without pruned and ignored files.

    Ignore files of all directories count, deeper ones after the ones above;
    they are few and read first.  Names are judged before a content is read.
    ``below`` keeps one directory and what is under it.
    """
    found = _listed(spark, root)
    files = _with_content(found.filter(F.substring_index("path", "/", -1) == ".gitignore"), root).select("path", F.col("content").cast("string").alias("text")).collect()
    rules = [r for p in prune for r in ignore_rules("", p)]
    for f in sorted(files, key=lambda f: (f["path"].count("/"), f["path"])):
        rules += ignore_rules(f["path"].rpartition("/")[0], f["text"])
    out = found.filter(~ignored(F.col("path"), rules))
    out = out.filter(F.col("path").startswith(below.rstrip("/") + "/")) if below else out
    return _with_content(out, root)


def watch(spark: SparkSession, root: str, extensions: tuple[str, ...] = WATCHED) -> DataFrame:
    """SRC25: a stream of (path, modified) of new and rewritten files of the extensions."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    return raw.select("path", F.col("modificationTime").alias("modified"))


def read_pull_pages(spark: SparkSession, path: str, label: str = "bug") -> DataFrame:
    """SRC24: (number, title, closed_at, merged_at) of merged pull requests with the label, from saved pages of the service's answers.

    Each file is one page, a JSON array; fetching them is not the engine's work.
    """
    schema = "number long, title string, closed_at string, merged_at string, labels array<struct<name string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.filter(F.col("merged_at").isNotNull() & F.exists("labels", lambda x: F.lower(x["name"]).contains(label))).select("number", "title", "closed_at", "merged_at").distinct()


def source_files(df: DataFrame, path: str = "path", skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """SRC02: files of a known language outside the skipped directories, with ``lang``."""
    lang = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        lang = F.when(F.substring_index(path, ".", -1) == ext, name).otherwise(lang)
    return df.withColumn("lang", lang).filter(F.col("lang").isNotNull() & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, skip))))


def under_headers(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """SRC06-08, SRC11: (key, no, header, line): lines below the last line that ``header`` matched, with its first group.

    The header is carried inside each text by a window over that text's lines.
    """
    lines = df.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("no", "line"))
    mark = F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1))
    carried = F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy("no"))
    return lines.withColumn("header", carried).filter(F.col("header").isNotNull() & ~F.col("line").rlike(header)).select(key, "no", "header", "line")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): the lines of text files with their order, whatever number of tasks reads a file."""
    at = F.monotonically_increasing_id()
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def below_headers(lines: DataFrame, header: str) -> DataFrame:
    """SRC06-09: (file, block, at, header, line): the lines below the last line of their file that ``header`` matched; a log of any length."""
    mark = F.when(F.col("line").rlike(header), F.col("line"))
    out = running(lines, ["file"], [F.col("block"), F.col("at")], mark, "header", "last")
    return out.filter(F.col("header").isNotNull() & ~F.col("line").rlike(header)).select("file", "block", "at", "header", "line")


def _recent(rows: DataFrame, max_commits: int | None) -> DataFrame:
    """The rows of the first commits of a log, which are the latest."""
    if max_commits is None:
        return rows
    first = rows.groupBy("hash").agg(F.min(F.struct("file", "block", "at")).alias("first")).orderBy("first").limit(max_commits)
    return rows.join(first.select("hash"), "hash", "left_semi")


def git_numstat(spark: SparkSession, path: str, max_commits: int | None = None) -> DataFrame:
    """SRC06: (hash, ts, message, path, ins, dels) from ``git log --numstat --format=%H|%aI|%s`` output; - counts as 0."""
    rows = below_headers(ordered_lines(spark, path), r"^[0-9a-f]{7,40}\|").filter(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    cells, meta = F.split("line", "\t"), F.split("header", r"\|", 3)
    count = lambda i: F.coalesce(F.expr(f"try_cast(split(line, '\\t')[{i}] as bigint)"), F.lit(0))
    out = rows.select("file", "block", "at", meta[0].alias("hash"), F.to_timestamp(meta[1]).alias("ts"), meta[2].alias("message"), cells[2].alias("path"), count(0).alias("ins"), count(1).alias("dels"))
    return _recent(out, max_commits).drop("file", "block", "at")


def git_files(spark: SparkSession, path: str, max_commits: int | None = None) -> DataFrame:
    """SRC07-08: (hash, message, files) from ``git log --name-only --format=%H%x09%s`` output, files in order."""
    rows = below_headers(ordered_lines(spark, path), r"^[0-9a-f]{7,40}(\t|$)").filter(F.trim("line") != "")
    meta = F.split("header", "\t", 2)
    out = rows.select("file", "block", "at", meta[0].alias("hash"), F.coalesce(F.try_element_at(meta, F.lit(2)), F.lit("")).alias("message"), "line")
    per = _recent(out, max_commits).groupBy("hash", "message").agg(F.array_sort(F.collect_list(F.struct("file", "block", "at", "line"))).alias("xs"))
    return per.select("hash", "message", F.transform("xs", lambda x: x["line"]).alias("files"))


def git_renames(spark: SparkSession, path: str, max_commits: int | None = None) -> DataFrame:
    """SRC09: (hash, change, path, old) from ``git log -M --first-parent --name-status --format=%H`` output; a rename has both paths."""
    rows = below_headers(ordered_lines(spark, path), r"^[0-9a-f]{7,40}$").withColumnRenamed("header", "hash")
    return name_status(_recent(rows, max_commits), "hash", "line")


def name_status(df: DataFrame, key: str, text: str) -> DataFrame:
    """SRC10: (key, change, path, old) of ``git diff --name-status`` output; a rename has both paths."""
    cells = F.split("line", "\t")
    lines = df.select(key, F.explode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("line")).filter(F.col("line").rlike(r"^[ACDMRT]\d*\t"))
    kind = F.substring("line", 1, 1)
    moved = kind.isin("R", "C")
    change = F.when(kind == "A", "added").when(kind == "D", "deleted").when(kind == "R", "renamed").when(kind == "C", "copied").otherwise("changed")
    return lines.select(key, change.alias("change"), F.when(moved, F.try_element_at(cells, F.lit(3))).otherwise(F.try_element_at(cells, F.lit(2))).alias("path"), F.when(moved, F.try_element_at(cells, F.lit(2))).alias("old"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, bad: str = "skip") -> DataFrame:
    """SRC14-15: JSON lines; bad lines are skipped, with bad="keep" come out with nulls, with bad="stop" end their file."""
    if bad == "stop":
        lines = ordered_lines(spark, path).filter(F.trim("line") != "")
        broken = F.when(F.col("line").isNotNull() & F.expr("try_parse_json(line)").isNull(), F.lit(1))
        kept = running(lines, ["file"], [F.col("block"), F.col("at")], broken, "_broken", "sum").filter("_broken is null")
        kind = schema if isinstance(schema, str) else schema.simpleString()
        return kept.select(F.from_json("line", kind).alias("r")).select("r.*")
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if bad == "skip" else "PERMISSIVE").json(path)


def newest_json(spark: SparkSession, path: str, schema: T.StructType | str, limit: int) -> DataFrame:
    """SRC16: records of a directory of JSON files, newest file first."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file"))
    return rows.orderBy(F.desc("_at"), "_file").limit(limit).drop("_at", "_file")


def decode_bytes(df: DataFrame, content: str = "content") -> DataFrame:
    """SRC20: text, encoding and used_replacement of binary contents: by byte order mark, else UTF-8, else with replacements."""
    head = F.hex(F.substring(F.col(content), 1, 3))
    utf8 = F.decode(content, "UTF-8")
    bom = head == "EFBBBF"
    wide = F.when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE")
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    text = F.when(bom, F.regexp_replace(F.col(content).cast("string"), "^﻿", "")).when(wide.isNotNull(), F.decode(content, "UTF-16")).otherwise(F.make_valid_utf8(F.col(content).cast("string")))
    encoding = F.when(bom, "utf-8-sig").when(wide.isNotNull(), "utf-16").otherwise("utf-8")
    del utf8
    return df.withColumns({"text": text, "encoding": encoding, "used_replacement": ~bom & wide.isNull() & ~valid})
