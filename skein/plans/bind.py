"""Relations the operators run on, over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import latest, table

#: The explicit clock of every recency rule, in epoch seconds.
AS_OF = 1767225600.0

_LATE = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY recorded_at DESC) = 1"

CTES = {
    "files": f"SELECT file_id, repo, path, lower(language) AS language, content, imports, exports, node_count, docstring, is_entry_point FROM file_analyses WHERE file_id IS NOT NULL {_LATE.format('file_id')}",
    "sessions": f"SELECT session_id, repo, timestamp AS ts, scope_expr, task, predicted_files, context_hash, constraints_surfaced FROM session_logs WHERE session_id IS NOT NULL {_LATE.format('session_id')}",
    "commits": f"SELECT commit_hash AS commit_id, repo, session_id, actual_files_modified, predicted_not_touched, touched_not_predicted, recall, precision, timestamp AS ts FROM observation_logs WHERE commit_hash IS NOT NULL {_LATE.format('commit_hash')}",
    "rules": f"SELECT constraint_id, session_id, scope_dir, replace(lower(trim(category)), '-', '_') AS category, message, file, confidence FROM scope_constraints WHERE constraint_id IS NOT NULL {_LATE.format('constraint_id')}",
    "locks": "SELECT DISTINCT lock_id, lower(trim(agent_id)) AS agent, primary_files, exclusive_files, shared_files, created_at, expires_at FROM swarm_locks WHERE agent_id IS NOT NULL AND created_at IS NOT NULL AND expires_at > created_at",
    "touched": "SELECT DISTINCT repo, commit_id, ts, file FROM (SELECT repo, commit_id, ts, replace(unnest(actual_files_modified), chr(92), '/') AS file FROM commits WHERE repo IS NOT NULL) WHERE file IS NOT NULL",
    "predicted": "SELECT DISTINCT repo, session_id, ts, file FROM (SELECT repo, session_id, ts, replace(unnest(predicted_files), chr(92), '/') AS file FROM sessions WHERE repo IS NOT NULL) WHERE file IS NOT NULL",
    "changes": "SELECT o_orderkey AS commit_id, o_orderdate AS ts, 'n' || s_nationkey AS module, 'n' || s_nationkey || '/s' || s_suppkey AS file, CAST(sum(l_quantity) AS BIGINT) AS ins, CAST(sum(l_linenumber) AS BIGINT) AS dels FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "nodes": "SELECT file_id AS id, repo, repo || '/' || CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS module, path FROM files",
    "edges": r"SELECT DISTINCT i.file_id AS src, t.file_id AS dst FROM (SELECT file_id, repo, coalesce(nullif(regexp_extract(i, 'from ''[./]*([A-Za-z_]\w*)', 1), ''), nullif(regexp_extract(i, '^use crate::(\w+)', 1), ''), nullif(regexp_extract(i, '^from [.](\w+)', 1), '')) AS word FROM (SELECT file_id, repo, unnest(imports) AS i FROM files)) i JOIN (SELECT file_id, repo, string_split(path, '/')[-2] AS word FROM files) t ON t.repo = i.repo AND t.word = i.word WHERE i.file_id <> t.file_id",
    "links": "SELECT a.file_id AS provider, b.file_id AS consumer, a.repo || ':' || a.path AS provider_file, b.repo || ':' || b.path AS consumer_file FROM files a JOIN files b ON a.repo = b.repo AND regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '') WHERE (a.path LIKE '%.py' OR a.path LIKE '%.go') AND b.path LIKE '%.ts'",
}
_NEEDS = {"links": ["files"], "touched": ["commits"], "predicted": ["sessions"], "edges": ["files"], "nodes": ["files"]}


def sql(body: str, *names: str) -> str:
    """``body`` behind the common table expressions it names."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        recursive = body.upper().startswith("WITH RECURSIVE")
        rest = body[14:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {rest}" if head else body
    return f"WITH {head} {body}" if head else body


def files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_analyses").select("file_id", "repo", "path", F.lower("language").alias("language"), "content", "imports", "exports", "node_count", "docstring", "is_entry_point", "recorded_at")
    return latest(rows, ["file_id"]).drop("recorded_at")


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Files without their contents, so that these never reach the shuffle."""
    rows = table(spark, d, "file_analyses").select("file_id", "repo", "path", F.lower("language").alias("language"), "recorded_at")
    return latest(rows, ["file_id"]).drop("recorded_at")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "session_logs").select("session_id", "repo", F.col("timestamp").alias("ts"), "scope_expr", "task", "predicted_files", "context_hash", "constraints_surfaced", "recorded_at")
    return latest(rows, ["session_id"]).drop("recorded_at")


def commits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "observation_logs").select(
        F.col("commit_hash").alias("commit_id"), "repo", "session_id", "actual_files_modified", "predicted_not_touched", "touched_not_predicted", "recall", "precision", F.col("timestamp").alias("ts"), "recorded_at"
    )
    return latest(rows, ["commit_id"]).drop("recorded_at")


def rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scope_constraints").select("constraint_id", "session_id", "scope_dir", F.translate(F.lower(F.trim("category")), "-", "_").alias("category"), "message", "file", "confidence", "recorded_at")
    return latest(rows, ["constraint_id"]).drop("recorded_at")


def locks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "swarm_locks").filter("agent_id is not null and created_at is not null and expires_at > created_at")
    return rows.select("lock_id", F.lower(F.trim("agent_id")).alias("agent"), "primary_files", "exclusive_files", "shared_files", "created_at", "expires_at").distinct()


def touched(spark: SparkSession, d: str) -> DataFrame:
    """One row per repo, commit and distinct file."""
    rows = commits(spark, d).filter("repo is not null").select("repo", "commit_id", "ts", F.explode("actual_files_modified").alias("file"))
    return rows.select("repo", "commit_id", "ts", F.translate("file", "\\", "/").alias("file")).filter("file is not null").distinct()


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """One row per repo, session and distinct predicted file."""
    rows = sessions(spark, d).filter("repo is not null").select("repo", "session_id", "ts", F.explode("predicted_files").alias("file"))
    return rows.select("repo", "session_id", "ts", F.translate("file", "\\", "/").alias("file")).filter("file is not null").distinct()


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Commit files with line counts: orders as commits, suppliers as files, nations as modules."""
    item, order, supp = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "supplier")
    module = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    joined = item.join(order, item.l_orderkey == order.o_orderkey).join(supp, item.l_suppkey == supp.s_suppkey)
    return joined.groupBy(
        F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), module.alias("module"), F.concat(module, F.lit("/s"), F.col("s_suppkey").cast("string")).alias("file")
    ).agg(F.sum("l_quantity").cast("long").alias("ins"), F.sum("l_linenumber").cast("long").alias("dels"))


def _import_word():
    """The directory that the import ``i`` names, null where it names none."""
    found = lambda pattern: F.nullif(F.regexp_extract("i", pattern, 1), F.lit(""))
    return F.coalesce(found(r"from '[./]*([A-Za-z_]\w*)"), found(r"^use crate::(\w+)"), found(r"^from [.](\w+)"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The import graph of files: an import that names a directory leads to the files of that directory in the repo."""
    rows = latest(table(spark, d, "file_analyses").select("file_id", "repo", "path", "imports", "recorded_at"), ["file_id"])
    source = rows.select(F.col("file_id").alias("src"), "repo", F.explode("imports").alias("i")).select("src", "repo", _import_word().alias("word")).dropna().distinct()
    target = rows.select(F.col("file_id").alias("dst"), "repo", F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("word"))
    return source.join(target, ["repo", "word"]).filter("src <> dst").select("src", "dst").distinct()


def folder_imports(spark: SparkSession, d: str) -> DataFrame:
    """(module, via, next): the import graph before it is unfolded into edges between files.

    A file of the module lies in the folder ``via`` and imports the folder
    ``next``; either may be null.  A folder is a directory's name in a repo, as
    imports name it.  The rows are distinct, so that they grow with the names
    of folders and not with the files in them.
    """
    rows = latest(table(spark, d, "file_analyses").select("file_id", "repo", "path", "imports", "recorded_at"), ["file_id"])
    folder = lambda word: F.concat(word, F.lit("/"), "repo")
    rows = rows.select("repo", _module().alias("module"), folder(F.try_element_at(F.split("path", "/"), F.lit(-2))).alias("via"), F.explode_outer("imports").alias("i"))
    return rows.select("module", "via", folder(_import_word()).alias("next")).filter("via is not null or next is not null").distinct()


def _module():
    """A repo's first directory."""
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("")
    return F.concat("repo", F.lit("/"), top)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files as nodes; a module is a repo's first directory."""
    return paths(spark, d).select(F.col("file_id").alias("id"), "repo", _module().alias("module"), "path")


def links(spark: SparkSession, d: str) -> DataFrame:
    """Network links of files, as JN13 stands in for them: Python and Go provide, TypeScript of the same repo and folder consumes."""
    rows = paths(spark, d).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    side = lambda df, name: df.select("repo", "folder", F.col("file_id").alias(name), F.concat("repo", F.lit(":"), "path").alias(f"{name}_file"))
    both = side(rows.filter("path like '%.py' or path like '%.go'"), "provider").join(side(rows.filter("path like '%.ts'"), "consumer"), ["repo", "folder"])
    return both.select("provider", "consumer", "provider_file", "consumer_file")
