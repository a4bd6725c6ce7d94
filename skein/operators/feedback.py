"""The observation loop: what was predicted or returned, and what was then changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, window_s: int, tie: list[str]) -> DataFrame:
    """JN05: each left row with the first right row of its keys with 0 <= right.at - left.at < window.

    ``at`` is epoch seconds on both sides; the right side's other columns keep
    their names.  Time is cut into buckets of the window, so a left row meets
    only the rows of its own bucket and the next: an equi-join that a hot key
    spreads over its buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / window_s)
    a = left.withColumn("_id", F.struct(*left.columns)).withColumn("_b", F.explode(F.array(bucket(at), bucket(at) + 1)))
    b = right.withColumnRenamed(at, "_rat").withColumn("_b", bucket("_rat"))
    hit = a.join(b, [*keys, "_b"]).withColumn("delta", F.col("_rat") - F.col(at)).filter((F.col("delta") >= 0) & (F.col("delta") < window_s))
    others = [c for c in b.columns if c not in (*keys, "_b", "_rat")]
    best = hit.groupBy("_id").agg(F.min(F.struct("delta", *tie, *[c for c in others if c not in tie])).alias("_m"))
    return best.select("_id.*", "_m.*")


def last_observation(commits: DataFrame) -> DataFrame:
    """One observation per session, the last by time."""
    rest = [c for c in commits.columns if c != "session_id"]
    out = commits.filter("session_id is not null").groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "commit_id")).alias("_r"))
    return out.select("session_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def observed(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """JN07: sessions with their last observation."""
    obs = last_observation(commits.select("session_id", "commit_id", "ts", "actual_files_modified", "touched_not_predicted", "recall", "precision")).withColumnRenamed("ts", "observed_at")
    return sessions.join(obs, "session_id")


def utility(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """AGG19: (file, resolves, touches, last_resolved, last_touched, ratio)."""
    r = sessions.select("ts", F.explode("predicted_files").alias("file")).filter("file is not null").groupBy("file").agg(F.count("*").alias("resolves"), F.max("ts").alias("last_resolved"))
    t = observed(sessions, commits).select("observed_at", F.explode("actual_files_modified").alias("file")).filter("file is not null").groupBy("file").agg(F.count("*").alias("touches"), F.max("observed_at").alias("last_touched"))
    out = r.join(t, "file", "full_outer").na.fill(0, ["resolves", "touches"])
    return out.withColumn("ratio", F.when(F.col("resolves") > 0, F.round(F.col("touches") / F.col("resolves"), 3)).otherwise(0.0))


def returned_stats(sessions: DataFrame, commits: DataFrame, least: int = 3) -> DataFrame:
    """AGG20: (file, returned, hit, ignored, missed, usage); usage needs ``least`` returns."""
    rows = observed(sessions, commits).select(F.array_distinct(F.array_compact("predicted_files")).alias("p"), F.array_distinct(F.array_compact("actual_files_modified")).alias("a"))
    p, a = F.coalesce("p", F.array().cast("array<string>")), F.coalesce("a", F.array().cast("array<string>"))
    kinds = F.concat(
        F.transform(F.array_intersect(p, a), lambda f: F.struct(f.alias("file"), F.lit("hit").alias("k"))), F.transform(F.array_except(p, a), lambda f: F.struct(f.alias("file"), F.lit("ignored").alias("k"))),
        F.transform(F.array_except(a, p), lambda f: F.struct(f.alias("file"), F.lit("missed").alias("k"))),
    )
    long = rows.select(F.explode(kinds).alias("x")).select("x.file", "x.k")
    count = lambda k: F.count_if(F.col("k") == k)
    out = long.groupBy("file").agg(F.count_if(F.col("k") != "missed").alias("returned"), count("hit").alias("hit"), count("ignored").alias("ignored"), count("missed").alias("missed"))
    usage = F.when(F.col("returned") >= least, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("hit") - F.col("ignored")) / F.col("returned")))).otherwise(0.0)
    return out.withColumn("usage", F.round(usage, 6))


def best_session(commits: DataFrame, sessions: DataFrame, hours: float = 4, least: float = 0.1) -> DataFrame:
    """JN06: (commit_id, session_id, jaccard): the session of the same repo within the hours before a commit that overlaps its files most."""
    span = int(hours * 3600)
    bucket = lambda c: F.floor(F.col(c) / span)
    a = commits.filter("repo is not null and ts is not null").select("commit_id", "repo", F.col("ts").alias("cts"), F.array_distinct(F.array_compact("actual_files_modified")).alias("a")).withColumn("_b", F.explode(F.array(bucket("cts"), bucket("cts") - 1)))
    b = sessions.filter("repo is not null and ts is not null").select(F.col("session_id").alias("sid"), "repo", "ts", F.array_distinct(F.array_compact("predicted_files")).alias("p")).withColumn("_b", bucket("ts"))
    hit = a.join(b, ["repo", "_b"]).filter((F.col("cts") >= F.col("ts")) & (F.col("cts") - F.col("ts") < span) & F.arrays_overlap("a", "p"))
    score = F.size(F.array_intersect("a", "p")) / F.size(F.array_union("a", "p"))
    hit = hit.withColumn("jaccard", score).filter(F.col("jaccard") >= least)
    best = hit.groupBy("commit_id").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "sid")).alias("m"))
    return best.select("commit_id", F.col("m.sid").alias("session_id"), F.round(-F.col("m.j"), 6).alias("jaccard"))


def lessons(sessions: DataFrame, commits: DataFrame, resolved: int = 10, gap: int = 3) -> DataFrame:
    """AGG42: (trigger, file, n, confidence): resolved often and never touched; touched often and never predicted."""
    o = observed(sessions, commits)
    each = lambda c: o.select(F.explode(c).alias("file")).filter("file is not null")
    r = each("predicted_files").groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") >= resolved).join(each("actual_files_modified").distinct(), "file", "left_anti")
    g = each("touched_not_predicted").groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") >= gap)
    row = lambda df, name, per: df.select(F.lit(name).alias("trigger"), "file", "n", F.round(F.least(F.col("n") / per, F.lit(1.0)), 6).alias("confidence"))
    return row(r, "resolved_never_touched", 2 * resolved).unionByName(row(g, "touched_not_predicted", 10))


def trend(rows: DataFrame, keys: list[str], value: str, order: list[Column], recent: int = 5) -> DataFrame:
    """AGG43, WIN12: (keys, n, mean, recent_mean, older_mean)."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    r = rows.withColumn("_k", k)
    mean = lambda c: F.round(F.avg(F.when(c, F.col(value))), 6)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), mean(F.col("_k") <= recent).alias("recent_mean"), mean(F.col("_k") > recent).alias("older_mean"))


def halves_drop(rows: DataFrame, keys: list[str], value: str, order: list[Column], drop: float = 0.15) -> DataFrame:
    """AGG44: (keys, first_half, second_half, dropped); with an odd number the middle row counts to the second half."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    first = F.avg(F.when(F.col("_k") <= F.floor(F.col("_n") / 2), F.col(value)))
    second = F.avg(F.when(F.col("_k") > F.floor(F.col("_n") / 2), F.col(value)))
    return r.groupBy(*keys).agg(F.round(first, 6).alias("first_half"), F.round(second, 6).alias("second_half"), F.coalesce(first - second >= drop, F.lit(False)).alias("dropped"))


def acknowledged(acks: DataFrame, key: str, at: str, as_of: float, days: int = 30) -> DataFrame:
    """AGG47, FN35: (key, n, confidence, acknowledged) over the last days."""
    from ..functions.scalar import decayed

    out = acks.groupBy(key).agg(F.count_if(F.col(at) > as_of - days * 86400).alias("n"))
    return out.withColumn("confidence", F.round(decayed(F.lit(1.0), "n"), 6)).withColumn("acknowledged", F.col("confidence") >= 0.5)


def escalated(events: DataFrame, key: str, at: str, resolved: Column, as_of: float, least: int = 3, days: int = 30) -> DataFrame:
    """AGG48: (key, n, escalated): occurrences since the last resolution, within the days."""
    last = events.filter(resolved).groupBy(key).agg(F.max(at).alias("_last"))
    open_ = events.filter(~resolved).join(last, key, "left").filter((F.col(at) > F.coalesce("_last", F.lit(0.0))) & (F.col(at) > as_of - days * 86400))
    counts = open_.groupBy(key).agg(F.count("*").alias("n"))
    return events.select(key).distinct().join(counts, key, "left").na.fill(0, ["n"]).withColumn("escalated", F.col("n") >= least)


def keep_recent(rows: DataFrame, at: str, as_of: float, days: int = 90) -> DataFrame:
    """SNK03: rows not older than the days; rows without a time go."""
    return rows.filter(F.col(at) >= as_of - days * 86400)


def keep_last(rows: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    """SNK04: the last n rows, by a distributed top-n."""
    return rows.orderBy(*order).limit(n)


def stale_scopes(changed: DataFrame, refreshed: DataFrame, keys: list[str], as_of: float, tolerance_s: float = 86_400, quiet_s: float = 604_800) -> DataFrame:
    """JN45: (keys, stale): changed later than refreshed, beyond a tolerance; a scope refreshed within the quiet time is not told again.

    ``changed`` has the keys and changed, ``refreshed`` the keys and refreshed, both in epoch seconds.
    """
    late = F.col("changed") > F.col("refreshed") + tolerance_s
    return changed.join(refreshed, keys).select(*keys, (late & (F.col("refreshed") < as_of - quiet_s)).alias("stale"))
