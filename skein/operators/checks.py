"""Rule checks over what commits touch; every family gives (commit_id, family, severity, file, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["commit_id", "family", "severity", "file", "detail"]


def _row(df: DataFrame, family: str, severity: Column | str, file: str, detail: Column) -> DataFrame:
    return df.select("commit_id", F.lit(family).alias("family"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(file).alias("file"), detail.alias("detail"))


def contract_breaks(touched: DataFrame, contracts: DataFrame, least: float = 0.65) -> DataFrame:
    """JN11: one side of a contract changed without the other, in both directions."""
    c = contracts.filter(F.col("confidence") >= least)
    both = c.select(F.col("trigger").alias("file"), F.col("coupled").alias("other"), "confidence").unionByName(c.select(F.col("coupled").alias("file"), F.col("trigger").alias("other"), "confidence"))
    both = both.groupBy("file", "other").agg(F.max("confidence").alias("confidence"))
    due = touched.select("commit_id", "file").join(both, "file")
    broken = due.join(touched.select("commit_id", F.col("file").alias("other")), ["commit_id", "other"], "left_anti")
    return _row(broken, "contract", "nudge", "file", F.col("other"))


def outside_session(commits: DataFrame, sessions: DataFrame, scopes: list[str]) -> DataFrame:
    """JN12: files changed but not predicted by the commit's session, and whether any scope covers them."""
    made = commits.select("commit_id", "session_id", F.array_distinct(F.array_compact("actual_files_modified")).alias("a"))
    said = sessions.select("session_id", F.array_compact("predicted_files").alias("p")).filter("size(p) > 0")
    out = made.join(said, "session_id").select("commit_id", F.explode(F.array_except("a", "p")).alias("file"))
    inside = reduce(lambda x, y: x | y, [F.col("file").startswith(sc + "/") for sc in scopes], F.lit(False))
    return _row(out, "boundary", "nudge", "file", F.when(inside, "in a scope").otherwise("in no scope"))


def antipatterns(lines: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """JN14: (key columns, pattern): added lines that match a named pattern, one row per pattern and file.

    ``lines`` has commit_id, file and line.  The patterns are a short list of
    the caller's, unfolded in place: no join.
    """
    named = F.filter(F.array(*[F.when(F.col("line").rlike(rx), name) for name, rx in patterns]), lambda x: x.isNotNull())
    hit = lines.select("commit_id", "file", F.explode(named).alias("pattern")).distinct()
    return _row(hit, "antipattern", "guard", "file", F.col("pattern"))


def reversed_directions(module_edges: DataFrame, least: int = 2) -> DataFrame:
    """JN15: (src_module, dst_module, n, back): imports against the direction that prevails between two modules."""
    a = module_edges.filter("src_module <> dst_module")
    b = a.select(F.col("dst_module").alias("src_module"), F.col("src_module").alias("dst_module"), F.col("n").alias("back"))
    return a.join(b, ["src_module", "dst_module"]).filter((F.col("back") >= least) & (F.col("n") < F.col("back")))


def large_changes(changes: DataFrame, history: DataFrame, lines: int = 20) -> DataFrame:
    """JN16: many added lines in a file that history calls stable."""
    out = changes.filter(F.col("ins") >= lines).join(history.filter("stability = 'stable'").select("file", "commits"), "file")
    return _row(out, "stability", "note", "file", F.concat(F.col("ins").cast("string"), F.lit(" lines, "), F.col("commits").cast("string"), F.lit(" commits")))


def frozen(touched: DataFrame, prefixes: list[str]) -> DataFrame:
    """JN17: changes below a frozen directory."""
    hit = reduce(lambda x, y: x | y, [F.col("file").startswith(p) for p in prefixes], F.lit(False))
    return _row(touched.filter(hit), "intent", "hold", "file", F.lit("frozen"))


def deprecated_imports(imports: DataFrame, deprecated: DataFrame) -> DataFrame:
    """JN17: (commit_id, file) that import a deprecated target; both sides joined on the target."""
    return _row(imports.join(deprecated.select("target").distinct(), "target", "left_semi"), "intent", "guard", "file", F.col("target"))


#: The shortest level of time buckets, in seconds, and the number of levels, each twice as wide as the one before.
_FINEST, _LEVELS = 60.0, 40


def _level(start: str, end: str) -> Column:
    """The first level whose buckets are as wide as the interval is long, so that it lies in at most two of them."""
    return F.least(F.greatest(F.ceil(F.log2((F.col(end) - F.col(start)) / _FINEST)), F.lit(0)), F.lit(_LEVELS)).cast("int")


def _buckets(start: str, end: str, level: Column) -> Column:
    width = F.lit(_FINEST) * F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """JN21: (lock_a, lock_b, kind): locks of two agents that overlap in time and files.

    hard = both exclusive on a file, soft = exclusive against shared.  Locks
    meet by file and time bucket: each stands in the at most two buckets of
    the level of its own length, and looks into those of its own and all
    longer levels.  So the locks of a hot file meet those of their time, not
    all others.  Locks without a time, or that end before they start, drop out.
    """
    long = locks.filter("expires_at > created_at").select("lock_id", "agent", "created_at", "expires_at", F.explode(F.concat(
        F.transform(F.array_distinct(F.coalesce("exclusive_files", F.array().cast("array<string>"))), lambda f: F.struct(f.alias("file"), F.lit(1).alias("x"))),
        F.transform(F.array_distinct(F.coalesce("shared_files", F.array().cast("array<string>"))), lambda f: F.struct(f.alias("file"), F.lit(0).alias("x"))),
    )).alias("e")).select("lock_id", "agent", "created_at", "expires_at", "e.file", "e.x").filter("file is not null")
    long = long.withColumn("level", _level("created_at", "expires_at"))
    most = long.agg(F.max("level")).first()[0] or 0
    looks = long.withColumn("l", F.explode(F.sequence(F.col("level"), F.lit(most)))).withColumn("b", F.explode(_buckets("created_at", "expires_at", F.col("l"))))
    stands = long.withColumn("l", F.col("level")).withColumn("b", F.explode(_buckets("created_at", "expires_at", F.col("l"))))
    side = lambda df, n: df.select("file", "l", "b", F.col("lock_id").alias(f"lock_{n}"), F.col("agent").alias(f"a{n}"), F.col("created_at").alias(f"c{n}"), F.col("expires_at").alias(f"e{n}"), F.col("x").alias(f"x{n}"))
    hit = side(looks, "a").join(side(stands, "b"), ["file", "l", "b"]).filter("lock_a <> lock_b and aa <> ab and ca < eb and cb < ea and xa + xb >= 1")
    pairs = hit.select(F.least("lock_a", "lock_b").alias("lock_a"), F.greatest("lock_a", "lock_b").alias("lock_b"), (F.col("xa") + F.col("xb")).alias("x"))
    return pairs.groupBy("lock_a", "lock_b").agg(F.when(F.max("x") == 2, "hard").otherwise("soft").alias("kind"))


def locked_changes(touched: DataFrame, locks: DataFrame) -> DataFrame:
    """JN22: changes to a file while someone held it exclusively; they meet by file and time bucket, as in ``lock_conflicts``."""
    held = locks.filter("expires_at > created_at").select("lock_id", "created_at", "expires_at", F.explode("exclusive_files").alias("file")).filter("file is not null").withColumn("l", _level("created_at", "expires_at"))
    most = held.agg(F.max("l")).first()[0] or 0
    stands = held.withColumn("b", F.explode(_buckets("created_at", "expires_at", F.col("l"))))
    width = lambda level: F.lit(_FINEST) * F.pow(F.lit(2.0), level)
    looks = touched.filter("ts is not null").withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("b", F.floor(F.col("ts") / width(F.col("l"))))
    out = looks.join(stands, ["file", "l", "b"]).filter("ts >= created_at and ts < expires_at").select("commit_id", "file", "lock_id").distinct()
    return _row(out, "lock", "hold", "file", F.col("lock_id"))


def violations(*families: DataFrame) -> DataFrame:
    """PIPE09: all families as one table."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(*COLUMNS) for f in families])


def verdicts(found: DataFrame, acknowledged: DataFrame, escalated: DataFrame) -> DataFrame:
    """PIPE09: (commit_id, n, blocking, passed): nudges of an escalated family become guards, acknowledged rows do not count."""
    open_ = found.join(acknowledged, ["family", "file"], "left_anti").join(escalated.select("family", F.lit(True).alias("_up")), "family", "left")
    severity = F.when((F.col("severity") == "nudge") & F.col("_up"), "guard").otherwise(F.col("severity"))
    blocks = severity.isin("guard", "hold").cast("long")
    out = open_.groupBy("commit_id").agg(F.count("*").alias("n"), F.sum(blocks).alias("blocking"))
    return out.withColumn("passed", F.col("blocking") == 0)
