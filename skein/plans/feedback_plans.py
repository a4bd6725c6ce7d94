"""The observation loop, rule checks, evaluation and merging over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions import scalar as S
from ..operators import checks as K
from ..operators import conventions as V
from ..operators import feedback as L
from ..operators import graph as G
from ..operators import history as H
from ..operators import merging as M
from ..operators import stats as T
from . import bind as B

QUERIES: dict = {}


def q(name: str, sql: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, B.sql(sql, *names) if sql else None)
        return fn

    return keep


_EV = "SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, value FROM events WHERE event_type = '{}'"


def ev(s, d, kind):
    return table(s, d, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")


@q("JN05_next_commit", f"SELECT * FROM (SELECT v.event_id AS search_id, v.user_id, p.event_id AS commit_id, round(p.t - v.t, 3) AS delta, row_number() OVER (PARTITION BY v.event_id ORDER BY p.t - v.t, p.event_id) AS k FROM ({_EV.format('view')}) v JOIN ({_EV.format('purchase')}) p ON p.user_id = v.user_id AND p.t >= v.t AND p.t - v.t < 86400) WHERE k = 1")
def _(s, d):
    left = ev(s, d, "view").select(F.col("event_id").alias("search_id"), "user_id", "t")
    right = ev(s, d, "purchase").select(F.col("event_id").alias("commit_id"), "user_id", "t")
    out = L.next_within(left, right, ["user_id"], "t", 86400, ["commit_id"])
    return out.select("search_id", "user_id", "commit_id", F.round("delta", 3).alias("delta"), F.lit(1).cast("long").alias("k"))


_LAST = "lo AS (SELECT * FROM commits WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, commit_id DESC) = 1), ob AS (SELECT s.session_id, s.repo, s.ts, predicted_files, actual_files_modified, touched_not_predicted, lo.ts AS observed_at, lo.recall, lo.precision FROM sessions s JOIN lo USING (session_id))"


@q("JN06_best_session", "WITH a AS (SELECT commit_id, repo, ts, list_distinct([f FOR f IN actual_files_modified IF f IS NOT NULL]) AS a FROM commits WHERE repo IS NOT NULL), b AS (SELECT session_id, repo, ts, list_distinct([f FOR f IN predicted_files IF f IS NOT NULL]) AS p FROM sessions WHERE repo IS NOT NULL), h AS (SELECT commit_id, session_id, len(list_intersect(a, p)) / len(list_distinct(list_concat(a, p))) AS j FROM a JOIN b ON a.repo = b.repo AND a.ts >= b.ts AND a.ts - b.ts < 14400 AND list_has_any(a, p)) SELECT commit_id, session_id, round(j, 6) AS jaccard FROM h WHERE j >= 0.1 QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY j DESC, session_id) = 1", "commits", "sessions")
def _(s, d):
    return L.best_session(B.commits(s, d), B.sessions(s, d))


@q("JN07_observed", f"WITH {_LAST} SELECT session_id, observed_at, recall FROM ob", "commits", "sessions")
def _(s, d):
    return L.observed(B.sessions(s, d), B.commits(s, d)).select("session_id", "observed_at", "recall")


@q("AGG19_utility", f"WITH {_LAST}, r AS (SELECT file, count(*) AS resolves, max(ts) AS lr FROM (SELECT ts, unnest(predicted_files) AS file FROM sessions) WHERE file IS NOT NULL GROUP BY file), t AS (SELECT file, count(*) AS touches, max(observed_at) AS lt FROM (SELECT observed_at, unnest(actual_files_modified) AS file FROM ob) WHERE file IS NOT NULL GROUP BY file) SELECT coalesce(r.file, t.file) AS file, coalesce(resolves, 0) AS resolves, coalesce(touches, 0) AS touches, lr AS last_resolved, lt AS last_touched, CASE WHEN coalesce(resolves, 0) > 0 THEN round(coalesce(touches, 0) / resolves, 3) ELSE 0.0 END AS ratio FROM r FULL JOIN t ON r.file = t.file", "commits", "sessions")
def _(s, d):
    return L.utility(B.sessions(s, d), B.commits(s, d)).select("file", "resolves", "touches", "last_resolved", "last_touched", "ratio")


@q("FN32_effective_score", f"WITH {_LAST}, r AS (SELECT file, count(*) AS n FROM (SELECT unnest(predicted_files) AS file FROM sessions) WHERE file IS NOT NULL GROUP BY file), t AS (SELECT file, count(*) AS k, max(observed_at) AS lt FROM (SELECT observed_at, unnest(actual_files_modified) AS file FROM ob) WHERE file IS NOT NULL GROUP BY file) SELECT r.file, round(greatest(0.5 + coalesce(CASE WHEN n >= 3 THEN round(coalesce(k, 0) / n, 3) * CASE WHEN ({B.AS_OF} - lt) / 86400 < 30 THEN 1.1 ELSE 1.0 END ELSE 0 END, 0), 0.5), 6) AS score FROM r LEFT JOIN t USING (file)", "commits", "sessions")
def _(s, d):
    u = L.utility(B.sessions(s, d), B.commits(s, d)).filter("resolves > 0").withColumn("age", (F.lit(B.AS_OF) - F.col("last_touched")) / 86400)
    return u.select("file", F.round(S.effective_score(F.lit(1.0), "ratio", "resolves", "age", True), 6).alias("score"))


_STATS = f"WITH {_LAST}, x AS (SELECT coalesce(list_distinct([f FOR f IN predicted_files IF f IS NOT NULL]), []) AS p, coalesce(list_distinct([f FOR f IN actual_files_modified IF f IS NOT NULL]), []) AS a FROM ob), l AS (SELECT unnest([f FOR f IN p IF list_contains(a, f)]) AS file, 'hit' AS k FROM x UNION ALL SELECT unnest([f FOR f IN p IF NOT list_contains(a, f)]), 'ignored' FROM x UNION ALL SELECT unnest([f FOR f IN a IF NOT list_contains(p, f)]), 'missed' FROM x), g AS (SELECT file, count(*) FILTER (k <> 'missed') AS returned, count(*) FILTER (k = 'hit') AS hit, count(*) FILTER (k = 'ignored') AS ignored, count(*) FILTER (k = 'missed') AS missed FROM l GROUP BY file), st AS (SELECT *, round(CASE WHEN returned >= 3 THEN greatest(-1.0, least(1.0, (hit - ignored) / returned)) ELSE 0.0 END, 6) AS usage FROM g)"


@q("AGG20_returned_stats", f"{_STATS} SELECT * FROM st", "commits", "sessions")
def _(s, d):
    return L.returned_stats(B.sessions(s, d), B.commits(s, d))


@q("FN34_usage_factor", f"{_STATS} SELECT file, CAST(CASE WHEN usage > 0.3 THEN 1.15 WHEN usage < -0.3 THEN 0.85 ELSE 1.0 END AS DOUBLE) AS factor FROM st", "commits", "sessions")
def _(s, d):
    return L.returned_stats(B.sessions(s, d), B.commits(s, d)).select("file", S.usage_factor("usage").alias("factor"))


@q("FN33_recency_factor", f"WITH h AS (SELECT file, count(*) AS n, max(ts) AS lt FROM touched GROUP BY file), k AS (SELECT file, ({B.AS_OF} - lt) / 86400 AS age, CASE WHEN n >= 20 THEN 'volatile' WHEN n >= 5 THEN 'tweaked' ELSE 'stable' END AS kind FROM h) SELECT file, CAST(CASE WHEN kind = 'stable' AND coalesce(age, 181) > 180 THEN 0.75 WHEN kind = 'volatile' AND coalesce(age, 181) < 7 THEN 1.2 WHEN kind = 'volatile' AND coalesce(age, 181) < 30 THEN 1.1 ELSE 1.0 END AS DOUBLE) AS factor FROM k", "touched")
def _(s, d):
    h = B.touched(s, d).groupBy("file").agg(F.count("*").alias("n"), F.max("ts").alias("lt"))
    return h.select("file", S.recency_factor(S.stability_by_count("n"), (F.lit(B.AS_OF) - F.col("lt")) / 86400).alias("factor"))


@q("AGG42_lessons", f"WITH {_LAST}, r AS (SELECT file, count(*) AS n FROM (SELECT unnest(predicted_files) AS file FROM ob) WHERE file IS NOT NULL GROUP BY file HAVING count(*) >= 3), t AS (SELECT DISTINCT unnest(actual_files_modified) AS file FROM ob), g AS (SELECT file, count(*) AS n FROM (SELECT unnest(touched_not_predicted) AS file FROM ob) WHERE file IS NOT NULL GROUP BY file HAVING count(*) >= 3) SELECT 'resolved_never_touched' AS trigger, file, n, round(least(n / 6, 1.0), 6) AS confidence FROM r ANTI JOIN (SELECT * FROM t WHERE file IS NOT NULL) t2 USING (file) UNION ALL SELECT 'touched_not_predicted', file, n, round(least(n / 10, 1.0), 6) FROM g", "commits", "sessions")
def _(s, d):
    return L.lessons(B.sessions(s, d), B.commits(s, d), resolved=3)


@q("AGG43_trend", "WITH k AS (SELECT repo, recall, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, commit_id) AS k FROM commits WHERE repo IS NOT NULL AND recall IS NOT NULL) SELECT repo, count(*) AS n, round(avg(recall), 6) AS mean, round(avg(CASE WHEN k <= 5 THEN recall END), 6) AS recent_mean, round(avg(CASE WHEN k > 5 THEN recall END), 6) AS older_mean FROM k GROUP BY repo", "commits")
def _(s, d):
    rows = B.commits(s, d).filter("repo is not null and recall is not null")
    return L.trend(rows, ["repo"], "recall", [F.desc("ts"), F.col("commit_id")])


@q("AGG44_halves_drop", "WITH k AS (SELECT repo, recall, row_number() OVER (PARTITION BY repo ORDER BY ts, commit_id) AS k, count(*) OVER (PARTITION BY repo) AS n FROM commits WHERE repo IS NOT NULL AND recall IS NOT NULL), h AS (SELECT repo, avg(CASE WHEN k <= floor(n / 2) THEN recall END) AS a, avg(CASE WHEN k > floor(n / 2) THEN recall END) AS b FROM k GROUP BY repo) SELECT repo, round(a, 6) AS first_half, round(b, 6) AS second_half, coalesce(a - b >= 0.15, false) AS dropped FROM h", "commits")
def _(s, d):
    rows = B.commits(s, d).filter("repo is not null and recall is not null")
    return L.halves_drop(rows, ["repo"], "recall", [F.col("ts"), F.col("commit_id")])


_NOW = 1706745600.0  # the end of the events


@q("AGG47_acknowledged", f"SELECT user_id, n, CAST(round(CASE WHEN n <= 3 THEN 1.0 ELSE greatest(1.0 - 0.1 * (n - 3), 0.3) END, 6) AS DOUBLE) AS confidence, round(CASE WHEN n <= 3 THEN 1.0 ELSE greatest(1.0 - 0.1 * (n - 3), 0.3) END, 6) >= 0.5 AS acknowledged FROM (SELECT user_id, count(*) FILTER (t > {_NOW} - 30 * 86400) AS n FROM ({_EV.format('error')}) GROUP BY user_id)")
def _(s, d):
    return L.acknowledged(ev(s, d, "error"), "user_id", "t", _NOW)


@q("AGG48_escalated", f"WITH e AS (SELECT user_id, t, true AS res FROM ({_EV.format('signup')}) UNION ALL SELECT user_id, t, false FROM ({_EV.format('error')})), l AS (SELECT user_id, max(t) AS last FROM e WHERE res GROUP BY user_id), o AS (SELECT user_id, count(*) AS n FROM e LEFT JOIN l USING (user_id) WHERE NOT res AND t > coalesce(last, 0) AND t > {_NOW} - 30 * 86400 GROUP BY user_id) SELECT u.user_id, coalesce(n, 0) AS n, coalesce(n, 0) >= 3 AS escalated FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN o USING (user_id)")
def _(s, d):
    rows = ev(s, d, "signup").withColumn("res", F.lit(True)).unionByName(ev(s, d, "error").withColumn("res", F.lit(False)))
    return L.escalated(rows, "user_id", "t", F.col("res"), _NOW)


@q("SNK03_retention", f"SELECT session_id FROM sessions WHERE ts >= {B.AS_OF} - 90 * 86400", "sessions")
def _(s, d):
    return L.keep_recent(B.sessions(s, d), "ts", B.AS_OF).select("session_id")


@q("SNK04_keep_last", "SELECT session_id FROM sessions WHERE ts IS NOT NULL ORDER BY ts DESC, session_id LIMIT 100", "sessions")
def _(s, d):
    return L.keep_last(B.sessions(s, d).filter("ts is not null"), [F.desc("ts"), F.col("session_id")]).select("session_id")


_OBS = "cf AS (SELECT DISTINCT commit_id, repo || ':' || file AS file FROM touched), n AS (SELECT file, count(*) AS n FROM cf GROUP BY file), a AS (SELECT cf.* FROM cf JOIN n USING (file) WHERE n >= 5), p AS (SELECT x.file AS fa, y.file AS fb, count(*) AS n_ab FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT fa AS trig, fb AS coup, round(n_ab / n, 3) AS k FROM p JOIN n ON file = fa WHERE n_ab / n >= 0.4 UNION ALL SELECT fb, fa, round(n_ab / n, 3) FROM p JOIN n ON file = fb WHERE n_ab / n >= 0.4), b AS (SELECT trig AS file, coup AS other FROM c WHERE k >= 0.5 UNION SELECT coup, trig FROM c WHERE k >= 0.5)"


def obs(s, d):
    return B.touched(s, d).select("commit_id", "ts", F.concat("repo", F.lit(":"), "file").alias("file"))


@q("JN11_contract_breaks", f"WITH {_OBS} SELECT cf.commit_id, 'contract' AS family, 'nudge' AS severity, cf.file, b.other AS detail FROM cf JOIN b USING (file) WHERE NOT EXISTS (SELECT 1 FROM cf z WHERE z.commit_id = cf.commit_id AND z.file = b.other)", "touched")
def _(s, d):
    rows = obs(s, d)
    return K.contract_breaks(rows, H.contracts(rows, threshold=0.4, top=None), 0.5)


_BOUND = "SELECT commit_id, 'boundary' AS family, 'nudge' AS severity, file, CASE WHEN starts_with(file, 'src/') OR starts_with(file, 'lib/') THEN 'in a scope' ELSE 'in no scope' END AS detail FROM (SELECT DISTINCT c.commit_id, unnest([f FOR f IN c.actual_files_modified IF f IS NOT NULL AND NOT list_contains(s.predicted_files, f)]) AS file FROM commits c JOIN sessions s USING (session_id) WHERE len([f FOR f IN s.predicted_files IF f IS NOT NULL]) > 0)"


@q("JN12_outside_session", _BOUND, "commits", "sessions")
def _(s, d):
    return K.outside_session(B.commits(s, d), B.sessions(s, d), ["src", "lib"])


_PATTERNS = [("console", r"console\.(warn|log)"), ("catch all", r"except (IndexError|Exception)"), ("clone", r"\.clone\(\)")]


@q("JN14_antipatterns", r"WITH l AS (SELECT file_id, path, unnest(string_split(content, chr(10))) AS line FROM files) SELECT DISTINCT file_id AS commit_id, 'antipattern' AS family, 'guard' AS severity, path AS file, p AS detail FROM (SELECT file_id, path, unnest([CASE WHEN regexp_matches(line, 'console\.(warn|log)') THEN 'console' END, CASE WHEN regexp_matches(line, 'except (IndexError|Exception)') THEN 'catch all' END, CASE WHEN regexp_matches(line, '\.clone\(\)') THEN 'clone' END]) AS p FROM l) WHERE p IS NOT NULL", "files")
def _(s, d):
    lines = B.files(s, d).select(F.col("file_id").alias("commit_id"), F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("line"))
    return K.antipatterns(lines, _PATTERNS)


@q("JN15_reversed_directions", "WITH m AS (SELECT a.module AS x, b.module AS y, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.module <> b.module GROUP BY ALL) SELECT p.x AS src_module, p.y AS dst_module, p.n, r.n AS back FROM m p JOIN m r ON r.x = p.y AND r.y = p.x WHERE r.n >= 2 AND p.n < r.n", "edges", "nodes")
def _(s, d):
    return K.reversed_directions(G.module_edges(B.edges(s, d), B.nodes(s, d)))


_STABLE = "h AS (SELECT file, count(DISTINCT commit_id) AS commits, sum(ins + dels) AS lines FROM changes GROUP BY file)"


@q("JN16_large_changes", f"WITH {_STABLE} SELECT commit_id, 'stability' AS family, 'note' AS severity, file, ins || ' lines, ' || commits || ' commits' AS detail FROM changes JOIN h USING (file) WHERE ins >= 48 AND lines / commits < 29.5", "changes")
def _(s, d):
    c = B.changes(s, d)
    calm = H.file_history(c).withColumn("stability", F.when(F.col("lines") / F.col("commits") < 29.5, "stable"))
    return K.large_changes(c, calm, 48)


@q("JN17_frozen", "SELECT commit_id, 'intent' AS family, 'hold' AS severity, repo || ':' || file AS file, 'frozen' AS detail FROM touched WHERE starts_with(file, 'vendor/') OR starts_with(file, 'third_party/')", "touched")
def _(s, d):
    rows = K.frozen(B.touched(s, d).withColumn("raw", F.concat("repo", F.lit(":"), "file")).select("commit_id", "file", "raw"), ["vendor/", "third_party/"])
    full = B.touched(s, d).select("commit_id", "file", "repo")
    return rows.join(full, ["commit_id", "file"]).select("commit_id", "family", "severity", F.concat("repo", F.lit(":"), "file").alias("file"), "detail")


@q("JN17_deprecated_imports", "SELECT file_id AS commit_id, 'intent' AS family, 'guard' AS severity, path AS file, i AS detail FROM (SELECT DISTINCT file_id, path, unnest(imports) AS i FROM files) WHERE i IN (SELECT i FROM (SELECT unnest(imports) AS i FROM files) WHERE i LIKE '%logging%')", "files")
def _(s, d):
    imports = B.files(s, d).select(F.col("file_id").alias("commit_id"), F.col("path").alias("file"), F.explode("imports").alias("target")).distinct()
    return K.deprecated_imports(imports, imports.filter(F.col("target").contains("logging")).select("target"))


_LOCKS = "e AS (SELECT DISTINCT lock_id, agent, created_at AS c, expires_at AS x, unnest(exclusive_files) AS f, 1 AS k FROM locks UNION SELECT DISTINCT lock_id, agent, created_at, expires_at, unnest(shared_files), 0 FROM locks)"


@q("JN21_lock_conflicts", f"WITH {_LOCKS} SELECT a.lock_id AS lock_a, b.lock_id AS lock_b, CASE WHEN max(a.k + b.k) = 2 THEN 'hard' ELSE 'soft' END AS kind FROM e a JOIN e b ON a.f = b.f AND a.lock_id < b.lock_id AND a.agent <> b.agent AND a.c < b.x AND b.c < a.x AND a.k + b.k >= 1 GROUP BY ALL", "locks")
def _(s, d):
    return K.lock_conflicts(B.locks(s, d))


@q("JN22_locked_changes", "SELECT DISTINCT commit_id, 'lock' AS family, 'hold' AS severity, t.file, lock_id AS detail FROM touched t JOIN (SELECT lock_id, created_at, expires_at, unnest(exclusive_files) AS file FROM locks) l ON t.file = l.file AND t.ts >= created_at AND t.ts < expires_at", "touched", "locks")
def _(s, d):
    return K.locked_changes(B.touched(s, d).select("commit_id", "file", "ts"), B.locks(s, d))


@q("PIPE09_verdicts", f"WITH {_OBS}, bo AS ({_BOUND}), v AS (SELECT cf.commit_id, 'contract' AS family, 'nudge' AS severity, cf.file FROM cf JOIN b USING (file) WHERE NOT EXISTS (SELECT 1 FROM cf z WHERE z.commit_id = cf.commit_id AND z.file = b.other) UNION ALL SELECT commit_id, family, severity, file FROM bo UNION ALL SELECT DISTINCT commit_id, 'lock', 'hold', t.file FROM touched t JOIN (SELECT lock_id, created_at, expires_at, unnest(exclusive_files) AS file FROM locks) l ON t.file = l.file AND t.ts >= created_at AND t.ts < expires_at) SELECT commit_id, count(*) AS n, sum(CASE WHEN severity = 'hold' OR family = 'contract' THEN 1 ELSE 0 END)::BIGINT AS blocking, sum(CASE WHEN severity = 'hold' OR family = 'contract' THEN 1 ELSE 0 END) = 0 AS passed FROM v WHERE NOT (family = 'boundary' AND file LIKE '%CHANGELOG.md') GROUP BY commit_id", "touched", "sessions", "locks")
def _(s, d):
    rows = obs(s, d)
    locked = K.locked_changes(B.touched(s, d).select("commit_id", "file", "ts"), B.locks(s, d)).dropDuplicates(["commit_id", "file"])
    found = K.violations(K.contract_breaks(rows, H.contracts(rows, threshold=0.4, top=None), 0.5), K.outside_session(B.commits(s, d), B.sessions(s, d), ["src", "lib"]), locked)
    acks = found.filter((F.col("family") == "boundary") & F.col("file").like("%CHANGELOG.md")).select("family", "file").distinct()
    return K.verdicts(found, acks, s.createDataFrame([("contract",)], "family string"))


@q("AGG21_backtest", "WITH t AS (SELECT commit_id, repo, file, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) END AS top FROM touched), m AS (SELECT DISTINCT repo, commit_id, top AS scope FROM t WHERE top IN ('src', 'lib', 'app')), j AS (SELECT m.repo, m.scope, m.commit_id, bool_and(starts_with(t.file, m.scope || '/')) AS ok FROM m JOIN t ON t.commit_id = m.commit_id AND t.repo = m.repo GROUP BY ALL) SELECT repo, scope, count(*) AS commits, count(*) FILTER (ok) AS covered, round(count(*) FILTER (ok) / count(*), 3) AS recall FROM j GROUP BY ALL", "touched")
def _(s, d):
    t = B.touched(s, d).select("repo", "commit_id", "file")
    m = t.select("repo", "commit_id", S.top_module("file").alias("scope")).filter(F.col("scope").isin("src", "lib", "app")).distinct()
    j = m.join(t, ["repo", "commit_id"]).groupBy("repo", "scope", "commit_id").agg(F.every(F.startswith("file", F.concat("scope", F.lit("/")))).alias("ok"))
    return j.groupBy("repo", "scope").agg(F.count("*").alias("commits"), F.count_if("ok").alias("covered"), F.round(F.count_if("ok") / F.count("*"), 3).alias("recall"))


@q("JN10_misses", "WITH t AS (SELECT commit_id, repo, file, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) END AS top FROM touched), m AS (SELECT DISTINCT repo, commit_id, top AS scope FROM t WHERE top IN ('src', 'lib', 'app')), c AS (SELECT m.repo, scope, file, count(*) AS n FROM m JOIN t ON t.commit_id = m.commit_id AND t.repo = m.repo WHERE NOT starts_with(file, scope || '/') GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, scope ORDER BY n DESC, file) <= 10", "touched")
def _(s, d):
    t = B.touched(s, d).select("repo", "commit_id", "file")
    m = t.select("repo", "commit_id", S.top_module("file").alias("scope")).filter(F.col("scope").isin("src", "lib", "app")).distinct()
    c = m.join(t, ["repo", "commit_id"]).filter(~F.startswith("file", F.concat("scope", F.lit("/")))).groupBy("repo", "scope", "file").agg(F.count("*").alias("n")).filter("n >= 2")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("repo", "scope").orderBy(F.desc("n"), "file"))
    return c.withColumn("k", rank).filter("k <= 10").drop("k")


@q("AGG22_set_scores", f"WITH {_LAST}, x AS (SELECT session_id, coalesce(list_distinct([f FOR f IN predicted_files IF f IS NOT NULL]), []) AS p, coalesce(list_distinct([f FOR f IN actual_files_modified IF f IS NOT NULL]), []) AS a FROM ob) SELECT session_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(p, a)) / len(a) ELSE 1.0 END, 3) AS recall, round(CASE WHEN len(p) > 0 THEN len(list_intersect(p, a)) / len(p) ELSE 1.0 END, 3) AS precision FROM x", "commits", "sessions")
def _(s, d):
    recall, precision = T.set_scores(F.col("predicted_files"), F.col("actual_files_modified"))
    return L.observed(B.sessions(s, d), B.commits(s, d)).select("session_id", recall.alias("r"), precision.alias("p")).select("session_id", F.col("r").alias("recall"), F.col("p").alias("precision"))


@q("AGG23_mean_scores", "SELECT repo, count(*) AS n, round(avg(recall), 4) AS mean_recall, round(avg(precision), 4) AS mean_precision, round(avg(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END), 4) AS mean_f1, round(avg(CASE WHEN 4 * precision + recall > 0 THEN 5 * recall * precision / (4 * precision + recall) ELSE 0 END), 4) AS mean_f2 FROM commits WHERE repo IS NOT NULL AND recall IS NOT NULL AND precision IS NOT NULL GROUP BY repo", "commits")
def _(s, d):
    rows = B.commits(s, d).filter("repo is not null and recall is not null and precision is not null")
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return rows.groupBy("repo").agg(F.count("*").alias("n"), mean("recall", "mean_recall"), mean("precision", "mean_precision"), mean(S.f_beta("precision", "recall", 1.0), "mean_f1"), mean(S.f_beta("precision", "recall", 4.0), "mean_f2"))


@q("AGG26_median", "SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.median("value").alias("median"))


@q("AGG27_nearest_rank", "WITH g AS (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, p, l[CAST(least(floor(len(l) * p / 100), len(l) - 1) AS BIGINT) + 1] AS value FROM g, (VALUES (50), (95)) AS x(p)")
def _(s, d):
    return T.nearest_rank(table(s, d, "events"), ["event_type"], "value", [50, 95])


@q("AGG28_percentile", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.025), 6).alias("low"), F.round(F.percentile("value", 0.975), 6).alias("high"))


@q("AGG29_bootstrap", None)
def _(s, d):
    rows = B.commits(s, d).filter("repo is not null and recall is not null")
    return T.bootstrap(rows, "repo", "commit_id", "recall")


@q("AGG30_wilson", f"SELECT repo, n, round(p * 100, 3) AS rate, round(greatest(0.0, (p + {T.Z} * {T.Z} / (2 * n)) / (1 + {T.Z} * {T.Z} / n) - {T.Z} * sqrt((p * (1 - p) + {T.Z} * {T.Z} / (4 * n)) / n) / (1 + {T.Z} * {T.Z} / n)) * 100, 3) AS ci_lower, round(least(1.0, (p + {T.Z} * {T.Z} / (2 * n)) / (1 + {T.Z} * {T.Z} / n) + {T.Z} * sqrt((p * (1 - p) + {T.Z} * {T.Z} / (4 * n)) / n) / (1 + {T.Z} * {T.Z} / n)) * 100, 3) AS ci_upper FROM (SELECT repo, count(*) AS n, count(*) FILTER (recall >= 0.5) / count(*) AS p FROM commits WHERE repo IS NOT NULL GROUP BY repo)", "commits")
def _(s, d):
    return T.wilson(B.commits(s, d).filter("repo is not null"), ["repo"], F.col("recall") >= 0.5)


@q("AGG33_validation_class", "WITH r AS (SELECT l_orderkey AS trial, l_linenumber AS run, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL) SELECT trial, CASE WHEN bool_and(ok) THEN 'success' WHEN NOT bool_or(ok) THEN 'failure' ELSE 'flaky' END AS status FROM r GROUP BY trial")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("run"), (F.col("l_returnflag") != "R").alias("ok"))
    return T.validation_class(rows, "trial", "run", F.col("ok"))


@q("AGG36_bench", "SELECT event_type AS op, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS worst FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("worst"))


@q("AGG38_discover_groups", "WITH e AS (SELECT file_id, unnest(list_distinct(imports)) AS v FROM files), g AS (SELECT v, count(*) AS n FROM e WHERE v IS NOT NULL GROUP BY v HAVING count(*) >= 3), cl AS (SELECT DISTINCT file_id FROM e JOIN g USING (v)), x AS (SELECT file_id, '.' || split_part(path, '.', -1) AS v FROM files WHERE file_id NOT IN (SELECT file_id FROM cl)) SELECT 'import' AS kind, v AS value, n FROM g UNION ALL SELECT 'ending', v, count(*) FROM x GROUP BY v HAVING count(*) >= 3", "files")
def _(s, d):
    ending = F.array(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    return V.discover_groups(B.files(s, d), "file_id", [("import", F.col("imports")), ("ending", ending)])


@q("AGG41_compliance", "SELECT count(*) FILTER (path LIKE '%.py') AS matching, count(*) FILTER (path LIKE '%.py' AND len([i FOR i IN imports IF contains(i, 'logging')]) = 0) AS compliant, count(*) FILTER (path LIKE '%.py' AND len([i FOR i IN imports IF contains(i, 'logging')]) = 0) / count(*) FILTER (path LIKE '%.py') AS compliance FROM files", "files")
def _(s, d):
    quiet = ~F.coalesce(F.exists("imports", lambda i: i.contains("logging")), F.lit(False))
    return V.compliance(B.files(s, d), F.col("path").like("%.py"), quiet)


@q("AGG46_languages", "SELECT repo, count(*) AS n_files, count(DISTINCT ext) AS n_languages, min(ext) FILTER (n = top) AS main FROM (SELECT repo, ext, n, max(n) OVER (PARTITION BY repo) AS top FROM (SELECT repo, ext, count(*) OVER (PARTITION BY repo, ext) AS n FROM (SELECT repo, split_part(path, '.', -1) AS ext FROM files))) GROUP BY repo", "files")
def _(s, d):
    rows = B.paths(s, d).groupBy("repo", F.substring_index("path", ".", -1).alias("ext")).agg(F.count("*").alias("n"))
    return rows.groupBy("repo").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_languages"), F.min(F.struct((-F.col("n")).alias("n"), "ext"))["ext"].alias("main"))


@q("AGG54_compare_runs", "WITH a AS (SELECT avg(recall) AS recall, avg(precision) AS precision FROM commits WHERE ts < 1750000000), b AS (SELECT avg(recall) AS recall, avg(precision) AS precision FROM commits WHERE ts >= 1750000000), u AS (SELECT 'recall' AS metric, a.recall AS bef, b.recall AS aft FROM a, b UNION ALL SELECT 'precision', a.precision, b.precision FROM a, b) SELECT metric, round(bef, 6) AS before, round(aft, 6) AS after, round(aft - bef, 6) AS delta, CASE WHEN round(aft - bef, 6) > 0.01 THEN 'better' WHEN round(aft - bef, 6) < -0.01 THEN 'worse' ELSE 'same' END AS verdict FROM u", "commits")
def _(s, d):
    c = B.commits(s, d)
    side = lambda w: c.filter(w).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))
    out = T.unpivot_delta(side("ts < 1750000000"), side("ts >= 1750000000"), ["recall", "precision"])
    return out.select("metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "delta", "verdict")


_TWO = "a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS t FROM orders WHERE o_orderpriority <> '1-URGENT'), b AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'X' ELSE o_orderstatus END AS t FROM orders WHERE o_orderpriority <> '5-LOW')"


def _two(s, d):
    """Two versions of the orders: one lacks the urgent ones; the other lacks the low ones and changes the medium ones."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("t"), F.col("o_orderpriority").alias("p"))
    return o.filter("p <> '1-URGENT'").drop("p"), o.filter("p <> '5-LOW'").withColumn("t", F.when(F.col("p") == "3-MEDIUM", "X").otherwise(F.col("t"))).drop("p")


@q("JN32_entity_diff", f"WITH {_TWO} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'ADD' WHEN b.k IS NULL THEN 'REMOVE' ELSE 'MODIFY' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.t <> b.t")
def _(s, d):
    return M.entity_diff(*_two(s, d), ["k"], "t")


@q("JN33_conflicts", f"WITH {_TWO} SELECT a.k, CASE WHEN a.t = b.t THEN 'commutes' ELSE 'conflict' END AS kind FROM a JOIN b ON a.k = b.k")
def _(s, d):
    return M.conflicts(*_two(s, d), ["k"], "t")


@q("JN34_overlapping", "SELECT lock_id FROM (SELECT lock_id, created_at, max(expires_at) OVER (PARTITION BY agent ORDER BY created_at, expires_at, lock_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT DISTINCT lock_id, agent, created_at, expires_at FROM locks)) WHERE created_at < b", "locks")
def _(s, d):
    rows = B.locks(s, d).select("lock_id", "agent", "created_at", "expires_at").distinct()
    return M.overlapping(rows, ["agent"], "created_at", "expires_at").select("lock_id")


@q("SET09_three_way", "WITH base AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')), o AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), t AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 15) SELECT k FROM base WHERE k IN (SELECT k FROM o) AND k IN (SELECT k FROM t) UNION SELECT k FROM o WHERE k NOT IN (SELECT k FROM base) UNION SELECT k FROM t WHERE k NOT IN (SELECT k FROM base)")
def _(s, d):
    c = table(s, d, "customer")
    pick = lambda w: c.filter(w).select(F.col("c_custkey").alias("k"))
    return M.three_way(pick("c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY')"), pick("c_acctbal > 0"), pick("c_nationkey < 15"), ["k"])


@q("WIN17_latest_wins", "SELECT user_id, event_type, value, n - 1 AS superseded FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1")
def _(s, d):
    return M.latest_wins(table(s, d, "events"), "user_id", F.struct("ts", "event_id"), ["event_type", "value"])


@q("JN46_renames", "SELECT CASE WHEN file LIKE '%.js' THEN replace(file, '.js', '.mjs') ELSE file END AS file, count(*) AS n FROM touched GROUP BY ALL", "touched")
def _(s, d):
    t = B.touched(s, d).select("file")
    renames = t.filter("file like '%.js'").distinct().select(F.col("file").alias("old"), F.replace("file", F.lit(".js"), F.lit(".mjs")).alias("new"))
    return M.replaced(t, renames, "file").groupBy("file").agg(F.count("*").alias("n"))


@q("JN54_missing_paths", "SELECT DISTINCT t.repo, t.file FROM touched t WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = t.repo AND f.path = t.file)", "touched", "files")
def _(s, d):
    known = B.paths(s, d).select("repo", F.col("path").alias("file"))
    return B.touched(s, d).select("repo", "file").distinct().join(known, ["repo", "file"], "left_anti")


@q("WIN03_cap_per_category", "SELECT constraint_id FROM (SELECT constraint_id, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, constraint_id) AS k FROM rules WHERE category IS NOT NULL AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)) WHERE k <= 5", "rules")
def _(s, d):
    rows = B.rules(s, d).filter("category is not null and confidence between 0 and 1")
    return H.recent_by_module(rows, "category", [F.desc("confidence"), F.col("constraint_id")]).select("constraint_id")


@q("WIN04_best_route", "SELECT scope_dir, category, max(confidence) AS confidence, count(*) AS n FROM rules WHERE scope_dir IS NOT NULL AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) GROUP BY ALL", "rules")
def _(s, d):
    rows = B.rules(s, d).filter("scope_dir is not null and confidence between 0 and 1")
    return rows.groupBy("scope_dir", "category").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
