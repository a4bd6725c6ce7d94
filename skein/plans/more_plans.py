"""Streams, structure and the remaining joins and aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import table
from ..functions import scalar as S
from ..operators import feedback as L
from ..operators import graph as G
from ..operators import history as H
from ..operators import merging as M
from ..operators import scopes as C
from ..operators import structure as U
from ..streaming import stateful as R
from . import bind as B

QUERIES: dict = {}


def q(name: str, sql: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, B.sql(sql, *names) if sql else None)
        return fn

    return keep


def _events(s, d):
    return R.table_stream(s, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))


@q("STR01_debounce", "WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), w AS (SELECT user_id, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS e, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS items FROM g GROUP BY user_id, k) SELECT user_id, CAST(epoch_us(e) AS BIGINT) AS last_end, n, items FROM w WHERE e <= (SELECT max(ts) FROM events)")
def _(s, d):
    out = R.drained(R.debounced(_events(s, d), "at", "6 hours", ["user_id"], "event_type"))
    return out.select("user_id", F.unix_micros("last_end").alias("last_end"), "n", F.array_join("items", ",").alias("items"))


@q("STR10_latest_state", "SELECT user_id, event_type, value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1")
def _(s, d):
    return R.drained(R.latest_state(_events(s, d), "user_id", "at", ["event_type", "value"]), "complete")


@q("STR12_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return R.drained(R.deduplicated(_events(s, d), "at", ["user_id", "event_type"], "60 days").select("user_id", "event_type"))


@q("STR13_correlated", "SELECT v.event_id AS search_id, p.event_id AS commit_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts < v.ts + INTERVAL 6 HOUR")
def _(s, d):
    a = _events(s, d).filter("event_type = 'view'").select(F.col("event_id").alias("search_id"), F.col("user_id").alias("u"), "at")
    b = _events(s, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("commit_id"), F.col("user_id").alias("cu"), F.col("at").alias("cat"))
    return R.drained(R.correlated(a, b, "u", "at", "cu", "cat", "6 hours").select("search_id", "commit_id"))


@q("STR04_lock_decisions", None)
def _(s, d):
    rows = R.table_stream(s, d, "events").select(
        F.concat(F.lit("file"), (F.col("event_id") % 40).cast("string")).alias("file"), F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent"),
        F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "view", "renew").otherwise("claim").alias("action"), F.col("ts").cast("timestamp").alias("at"), F.lit(1800.0).alias("ttl_s"),
    )
    return R.drained(R.lock_decisions(rows))


@q("STR06_coalesced_jobs", "WITH j AS (SELECT event_id AS seq, 'r' || user_id % 40 AS repo, CASE WHEN event_type = 'purchase' AND value < 2 THEN NULL ELSE event_type END AS scope FROM events), w AS (SELECT repo, min(seq) AS seq FROM j WHERE scope IS NULL GROUP BY repo) SELECT seq, repo, NULL::VARCHAR AS scope FROM w UNION ALL SELECT min(seq), repo, scope FROM j WHERE scope IS NOT NULL AND repo NOT IN (SELECT repo FROM w) GROUP BY repo, scope")
def _(s, d):
    e = table(s, d, "events")
    jobs = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("repo"), F.when((F.col("event_type") == "purchase") & (F.col("value") < 2), F.lit(None)).otherwise(F.col("event_type")).alias("scope"))
    return R.coalesced_jobs(jobs, "seq", "repo", "scope")


@q("STR07_job_kind", "SELECT commit_id, CASE WHEN len(m) > 3 THEN 'repo' WHEN len(m) = 0 THEN 'unclassified' ELSE 'scope' END AS kind FROM (SELECT commit_id, list_distinct([split_part(f, '/', 1) FOR f IN actual_files_modified IF f IS NOT NULL AND contains(f, '/')]) AS m FROM commits WHERE actual_files_modified IS NOT NULL)", "commits")
def _(s, d):
    m = F.array_distinct(F.transform(F.filter("actual_files_modified", lambda f: F.contains(f, F.lit("/"))), lambda f: F.substring_index(f, "/", 1)))
    return B.commits(s, d).filter("actual_files_modified is not null").select("commit_id", F.when(F.size(m) > 3, "repo").when(F.size(m) == 0, "unclassified").otherwise("scope").alias("kind"))


@q("STR11_recent_sessions", f"SELECT repo, count(*) FILTER (ts > {B.AS_OF} - 14400) AS h4, count(*) FILTER (ts > {B.AS_OF} - 172800) AS h48, count(*) FILTER (ts > {B.AS_OF} - 2592000) AS d30, count(*) FILTER (ts > {B.AS_OF} - 7776000) AS d90 FROM sessions WHERE repo IS NOT NULL GROUP BY repo", "sessions")
def _(s, d):
    n = lambda x: F.count_if(F.col("ts") > B.AS_OF - x)
    return B.sessions(s, d).filter("repo is not null").groupBy("repo").agg(n(14400).alias("h4"), n(172800).alias("h48"), n(2592000).alias("d30"), n(7776000).alias("d90"))


@q("FN49_structure", None)
def _(s, d):
    out = U.file_structure(B.files(s, d), ["file_id", "path"], "path", "content")
    return out.select("file_id", F.size("imports").alias("n_imports"), F.size("classes").alias("n_classes"), F.size("functions").alias("n_functions"), "complexity", "parsed")


@q("FN50_script_classes", r"SELECT file_id, c AS class FROM (SELECT file_id, unnest(regexp_extract_all(content, 'class\s+([A-Za-z_$][\w$]*)', 1)) AS c FROM files WHERE path LIKE '%.ts' OR path LIKE '%.js')", "files")
def _(s, d):
    out = U.file_structure(B.files(s, d).filter("path like '%.ts' or path like '%.js'"), ["file_id"], "path", "content")
    return out.select("file_id", F.explode("classes").alias("class"))


@q("FN55_calls", r"SELECT file_id, c AS call, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(content, '([A-Za-z_]\w*)\(', 1)) AS c FROM files WHERE path LIKE '%.js') GROUP BY ALL", "files")
def _(s, d):
    calls = B.files(s, d).filter("path like '%.js'").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)\("), F.lit(1))).alias("call"))
    return calls.groupBy("file_id", "call").agg(F.count("*").alias("n"))


@q("FN43_rename_rewrite", "SELECT session_id, regexp_replace(scope_expr, 'billing', 'invoicing', 'g') AS expr FROM sessions WHERE scope_expr LIKE '%billing%'", "sessions")
def _(s, d):
    return B.sessions(s, d).filter("scope_expr like '%billing%'").select("session_id", F.regexp_replace("scope_expr", "billing", "invoicing").alias("expr"))


@q("FN45_loc", "SELECT commit_id, sum(ins + dels)::BIGINT AS loc, count(DISTINCT module) AS modules FROM changes GROUP BY commit_id", "changes")
def _(s, d):
    return B.changes(s, d).groupBy("commit_id").agg(F.sum(F.col("ins") + F.col("dels")).alias("loc"), F.countDistinct("module").alias("modules"))


@q("FN47_hint_lines", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS l FROM documents) WHERE regexp_matches(l, '(?i)\b(never|must|always|do not|avoid)\b') GROUP BY doc_id")
def _(s, d):
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("l"))
    return lines.filter(F.col("l").rlike(r"(?i)\b(never|must|always|do not|avoid)\b")).groupBy("doc_id").agg(F.count("*").alias("n"))


@q("FN62_snapshot_hash", "SELECT repo, sha256(string_agg(path || ':' || sha256(content), '|' ORDER BY path)) AS state FROM files WHERE content IS NOT NULL GROUP BY repo", "files")
def _(s, d):
    one = table(s, d, "file_analyses").filter("content is not null").select("file_id", F.concat("path", F.lit(":"), F.sha2("content", 256)).alias("h"), "repo", "recorded_at")
    rows = B.latest(one, ["file_id"])
    return rows.groupBy("repo").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "|"), 256).alias("state"))


@q("JN08_gravity", "WITH g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT nodes.id, coalesce(CASE WHEN n > 50 THEN 'CRITICAL HUB' WHEN n > 10 THEN 'HIGH' WHEN n > 3 THEN 'MODERATE' WHEN n IS NOT NULL THEN 'LOW' END, 'UNKNOWN') AS gravity FROM nodes LEFT JOIN g USING (id)", "edges", "nodes")
def _(s, d):
    g = G.degrees(B.edges(s, d)).select("id", S.gravity_label("degree").alias("gravity"))
    return B.nodes(s, d).select("id").join(g, "id", "left").na.fill("UNKNOWN", ["gravity"])


@q("JN09_commit_scopes", "SELECT DISTINCT commit_id, split_part(file, '/', 1) AS scope FROM touched WHERE split_part(file, '/', 1) IN ('src', 'lib', 'app', 'vendor')", "touched")
def _(s, d):
    scopes = s.createDataFrame([(x,) for x in ("src", "lib", "app", "vendor")], "scope string")
    return B.touched(s, d).select("commit_id", F.substring_index("file", "/", 1).alias("scope")).distinct().join(scopes, "scope", "left_semi")


@q("JN13_network_contracts", "WITH t AS (SELECT DISTINCT commit_id, file FROM touched), p AS (SELECT DISTINCT commit_id, file FROM t WHERE file LIKE '%.py' OR file LIKE '%.go') SELECT p.commit_id, p.file, CASE WHEN max(CASE WHEN regexp_replace(p.file, '.*/|[.].*', '', 'g') = regexp_replace(x.file, '.*/|[.].*', '', 'g') THEN 1.0 ELSE 0.5 END) >= 0.8 THEN 'hold' ELSE 'note' END AS severity FROM p JOIN (SELECT DISTINCT file FROM t WHERE file LIKE '%.ts') x ON regexp_replace(p.file, '/[^/]*$', '') = regexp_replace(x.file, '/[^/]*$', '') WHERE NOT EXISTS (SELECT 1 FROM t z WHERE z.commit_id = p.commit_id AND z.file = x.file) GROUP BY ALL", "touched")
def _(s, d):
    t = B.touched(s, d).select("commit_id", "file").distinct()
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    stem = lambda c: F.regexp_replace(c, r".*/|[.].*", "")
    providers = t.filter("file like '%.py' or file like '%.go'").withColumn("k", folder("file"))
    consumers = t.filter("file like '%.ts'").select(F.col("file").alias("consumer")).distinct().withColumn("k", folder("consumer"))
    due = providers.join(consumers, "k").withColumn("confidence", F.when(stem("file") == stem("consumer"), 1.0).otherwise(0.5))
    broken = due.join(t.select("commit_id", F.col("file").alias("consumer")), ["commit_id", "consumer"], "left_anti")
    return broken.groupBy("commit_id", "file").agg(F.when(F.max("confidence") >= 0.8, "hold").otherwise("note").alias("severity"))


@q("JN18_convention_drift", "SELECT file_id, 'no default logging' AS rule FROM files WHERE path LIKE '%.py' AND len([i FOR i IN imports IF contains(i, 'logging')]) > 0 UNION ALL SELECT file_id, 'index files export' FROM files WHERE regexp_matches(path, '(^|/)index_') AND coalesce(len(exports), 0) < 3", "files")
def _(s, d):
    f = B.files(s, d)
    has = F.coalesce(F.exists("imports", lambda i: i.contains("logging")), F.lit(False))
    broken = F.array_compact(F.array(
        F.when(F.col("path").like("%.py") & has, "no default logging"), F.when(F.col("path").rlike("(^|/)index_") & (F.coalesce(F.size("exports"), F.lit(0)) < 3), "index files export"),
    ))
    return f.select("file_id", F.explode(broken).alias("rule"))


@q("JN27_scope_pairs", "SELECT least(a.module, b.module) || ' <-> ' || greatest(a.module, b.module) AS pair, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.module <> b.module GROUP BY pair", "edges", "nodes")
def _(s, d):
    m = G.module_edges(B.edges(s, d), B.nodes(s, d)).filter("src_module <> dst_module")
    pair = F.concat(F.least("src_module", "dst_module"), F.lit(" <-> "), F.greatest("src_module", "dst_module"))
    return m.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n"))


@q("AGG14_coupling_clusters", "WITH cf AS (SELECT DISTINCT commit_id, module, file FROM changes), p AS (SELECT x.module AS a, y.module AS b, x.commit_id FROM cf x JOIN cf y ON x.commit_id = y.commit_id AND x.file < y.file WHERE x.module <> y.module) SELECT least(a, b) || ' <-> ' || greatest(a, b) AS pair, count(*) AS n FROM p GROUP BY pair", "changes")
def _(s, d):
    pairs = H.pair_counts(B.changes(s, d).select("commit_id", "file"))
    m = lambda c: F.substring_index(c, "/", 1)
    pair = F.concat(F.least(m("file_a"), m("file_b")), F.lit(" <-> "), F.greatest(m("file_a"), m("file_b")))
    return pairs.filter(m("file_a") != m("file_b")).groupBy(pair.alias("pair")).agg(F.sum("n_ab").alias("n"))


@q("JN31_resolve_imports", r"WITH i AS (SELECT repo, path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(split_part(path, '/', -1), '[.][^.]*$', '') AS stem FROM files WHERE path LIKE '%.ts' OR path LIKE '%.js'), c AS (SELECT repo, path, './' || stem AS imp, unnest(['', '.ts', '.tsx', '.js', '.jsx']) AS e, unnest([0, 1, 2, 3, 4]) AS o, dir, stem FROM i), h AS (SELECT c.repo, c.path, imp, o, f.path AS target FROM c JOIN files f ON f.repo = c.repo AND f.path = ltrim(dir || '/' || stem || e, '/')) SELECT repo, path, imp AS import, arg_min(target, o) AS target FROM h GROUP BY ALL", "files")
def _(s, d):
    f = B.paths(s, d).select("repo", "path")
    raw = f.filter("path like '%.ts' or path like '%.js'").withColumn("import", F.concat(F.lit("./"), S.stem("path")))
    return U.resolve_imports(raw, f, "repo")


@q("JN36_session_delta", "SELECT s.session_id, len(list_distinct([f FOR f IN actual_files_modified IF f IS NOT NULL AND NOT list_contains(coalesce(predicted_files, []), f)]))::BIGINT AS added, len(list_distinct([f FOR f IN predicted_files IF f IS NOT NULL AND NOT list_contains(coalesce(actual_files_modified, []), f)]))::BIGINT AS dropped FROM sessions s JOIN (SELECT * FROM commits WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, commit_id DESC) = 1) c USING (session_id) WHERE predicted_files IS NOT NULL AND actual_files_modified IS NOT NULL", "sessions", "commits")
def _(s, d):
    o = L.observed(B.sessions(s, d), B.commits(s, d)).filter("predicted_files is not null and actual_files_modified is not null")
    a, p = F.array_compact("actual_files_modified"), F.array_compact("predicted_files")
    return o.select("session_id", F.size(F.array_except(a, p)).cast("long").alias("added"), F.size(F.array_except(p, a)).cast("long").alias("dropped"))


@q("JN44_uncovered_dirs", "SELECT repo, split_part(path, '/', 1) AS dir, count(*) AS n FROM files WHERE contains(path, '/') AND split_part(path, '/', 1) NOT IN (SELECT split_part(split_part(scope_expr, ' ', 1), '/', 1) FROM sessions WHERE scope_expr IS NOT NULL) GROUP BY ALL", "files", "sessions")
def _(s, d):
    dirs = B.paths(s, d).filter("path like '%/%'").groupBy("repo", F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n"))
    known = B.sessions(s, d).filter("scope_expr is not null").select(F.substring_index(F.substring_index("scope_expr", " ", 1), "/", 1).alias("dir")).distinct()
    return dirs.join(known, "dir", "left_anti")


@q("JN45_stale_scopes", "WITH t AS (SELECT repo, split_part(file, '/', 1) AS dir, max(ts) AS changed FROM touched WHERE contains(file, '/') GROUP BY ALL), r AS (SELECT repo, split_part(file, '/', 1) AS dir, max(ts) AS refreshed FROM predicted WHERE contains(file, '/') GROUP BY ALL) SELECT repo, dir, changed > refreshed + 86400 AS stale FROM t JOIN r USING (repo, dir)", "touched", "predicted")
def _(s, d):
    top = lambda df, name: df.filter("file like '%/%'").groupBy("repo", F.substring_index("file", "/", 1).alias("dir")).agg(F.max("ts").alias(name))
    return top(B.touched(s, d), "changed").join(top(B.predicted(s, d), "refreshed"), ["repo", "dir"]).select("repo", "dir", (F.col("changed") > F.col("refreshed") + 86400).alias("stale"))


@q("JN47_related_scopes", "WITH RECURSIVE r(root, node, depth) AS (SELECT id, id, 0 FROM nodes UNION SELECT root, dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 3) SELECT root, count(DISTINCT node) AS n FROM r GROUP BY root", "edges", "nodes")
def _(s, d):
    roots = B.nodes(s, d).select("id")
    reach = G.closure(B.edges(s, d), roots, max_depth=3).select("root", "node")
    return reach.unionByName(roots.select(F.col("id").alias("root"), F.col("id").alias("node"))).distinct().groupBy("root").agg(F.count("*").alias("n"))


@q("JN49_session_bisect", "SELECT session_id, len(list_intersect(p, a))::BIGINT AS mattered, len(p)::BIGINT - len(list_intersect(p, a)) AS idle, len(a)::BIGINT - len(list_intersect(p, a)) AS missing FROM (SELECT s.session_id, coalesce(list_distinct([f FOR f IN predicted_files IF f IS NOT NULL]), []) AS p, coalesce(list_distinct([f FOR f IN actual_files_modified IF f IS NOT NULL]), []) AS a FROM sessions s JOIN (SELECT * FROM commits WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, commit_id DESC) = 1) c USING (session_id))", "sessions", "commits")
def _(s, d):
    none = F.array().cast("array<string>")
    each = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, none)))
    o = L.observed(B.sessions(s, d), B.commits(s, d)).select("session_id", each("predicted_files").alias("p"), each("actual_files_modified").alias("a"))
    both = F.size(F.array_intersect("p", "a")).cast("long")
    return o.select("session_id", both.alias("mattered"), (F.size("p") - both).alias("idle"), (F.size("a") - both).alias("missing"))


@q("JN50_scope_precedence", "SELECT DISTINCT name, coalesce(CASE WHEN name IN (SELECT split_part(path, '/', 1) FROM files) THEN 'directory' END, CASE WHEN name IN (SELECT ([x FOR x IN string_split(path, '/')[1:-2] IF x NOT IN ('src', 'lib', 'app')])[1] FROM files) THEN 'module' END, 'unknown') AS found FROM (SELECT regexp_replace(split_part(scope_expr, ' ', 1), '/$', '') AS name FROM sessions WHERE scope_expr IS NOT NULL)", "sessions", "files")
def _(s, d):
    names = B.sessions(s, d).filter("scope_expr is not null").select(F.regexp_replace(F.substring_index("scope_expr", " ", 1), "/$", "").alias("name")).distinct()
    p = B.paths(s, d)
    known = p.select(F.substring_index("path", "/", 1).alias("name"), F.lit(0).alias("k")).unionByName(p.select(C.module_of(F.col("path")).alias("name"), F.lit(1).alias("k"))).dropna()
    best = known.groupBy("name").agg(F.min("k").alias("k"))
    return names.join(best, "name", "left").select("name", F.when(F.col("k") == 0, "directory").when(F.col("k") == 1, "module").otherwise("unknown").alias("found"))


@q("JN53_blocked_moves", "SELECT DISTINCT p.repo, p.file, 'blocked' AS verdict FROM predicted p JOIN (SELECT unnest(exclusive_files) AS file FROM locks) l USING (file)", "predicted", "locks")
def _(s, d):
    held = B.locks(s, d).select(F.explode("exclusive_files").alias("file")).filter("file is not null").distinct()
    return B.predicted(s, d).select("repo", "file").distinct().join(held, "file", "left_semi").select("repo", "file", F.lit("blocked").alias("verdict"))


@q("AGG24_ratios", "SELECT repo, round(sum(hit) / greatest(sum(p), 1), 6) AS precision, round(sum(hit) / greatest(sum(a), 1), 6) AS recall, count(*) AS n FROM (SELECT s.repo, len(list_intersect(coalesce(predicted_files, []), coalesce(actual_files_modified, []))) AS hit, len(list_distinct(coalesce(predicted_files, []))) AS p, len(list_distinct(coalesce(actual_files_modified, []))) AS a FROM sessions s JOIN (SELECT * FROM commits WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, commit_id DESC) = 1) c USING (session_id) WHERE s.repo IS NOT NULL) GROUP BY repo", "sessions", "commits")
def _(s, d):
    none = F.array().cast("array<string>")
    each = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, none)))
    o = L.observed(B.sessions(s, d), B.commits(s, d)).filter("repo is not null").select("repo", each("predicted_files").alias("p"), each("actual_files_modified").alias("a"))
    hit = F.sum(F.size(F.array_intersect("p", "a")))
    return o.groupBy("repo").agg(F.round(hit / F.greatest(F.sum(F.size("p")), F.lit(1)), 6).alias("precision"), F.round(hit / F.greatest(F.sum(F.size("a")), F.lit(1)), 6).alias("recall"), F.count("*").alias("n"))


@q("AGG25_gates", "WITH c AS (SELECT repo, avg(recall) FILTER (ts >= 1750000000) AS cand, avg(recall) FILTER (ts < 1750000000) AS base FROM commits WHERE repo IS NOT NULL GROUP BY repo) SELECT repo, round(cand, 4) AS value, round(base - 0.02, 4) AS threshold, cand >= base - 0.02 AS passed, CASE WHEN cand >= base - 0.02 THEN round(cand, 4) ELSE 0.0 END AS fitness FROM c", "commits")
def _(s, d):
    c = B.commits(s, d).filter("repo is not null").groupBy("repo").agg(F.avg(F.when(F.col("ts") >= 1750000000, F.col("recall"))).alias("c"), F.avg(F.when(F.col("ts") < 1750000000, F.col("recall"))).alias("b"))
    ok = F.col("c") >= F.col("b") - 0.02
    return c.select("repo", F.round("c", 4).alias("value"), F.round(F.col("b") - 0.02, 4).alias("threshold"), ok.alias("passed"), F.when(ok, F.round("c", 4)).otherwise(0.0).alias("fitness"))


@q("AGG35_modules_in_order", "SELECT commit_id, string_agg(module, ',' ORDER BY first, module) AS modules FROM (SELECT commit_id, module, min(file) AS first FROM changes GROUP BY ALL) GROUP BY commit_id", "changes")
def _(s, d):
    m = B.changes(s, d).groupBy("commit_id", "module").agg(F.min("file").alias("first"))
    one = m.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("first", "module"))).alias("m"))
    return one.select("commit_id", F.array_join(F.transform("m", lambda x: x["module"]), ",").alias("modules"))


@q("AGG39_absent_imports", "WITH e AS (SELECT DISTINCT file_id, split_part(path, '.', -1) AS ext, unnest(imports) AS i FROM files), n AS (SELECT ext, count(DISTINCT file_id) AS files FROM e GROUP BY ext), f AS (SELECT ext, i, count(*) AS n FROM e WHERE i IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT f.ext, i AS import, f.n, round(f.n / files, 6) AS share FROM f JOIN n ON n.ext = f.ext", "files")
def _(s, d):
    e = B.files(s, d).select("file_id", F.substring_index("path", ".", -1).alias("ext"), F.explode("imports").alias("import")).distinct()
    n = e.groupBy("ext").agg(F.countDistinct("file_id").alias("files"))
    f = e.filter("import is not null").groupBy("ext", "import").agg(F.count("*").alias("n")).filter("n >= 3")
    return f.join(n, "ext").select("ext", "import", "n", F.round(F.col("n") / F.col("files"), 6).alias("share"))


@q("AGG40_centroid", "WITH k AS (SELECT split_part(path, '.', -1) AS ext, split_part(path, '/', 1) AS dir, count(*) AS n FROM files GROUP BY ALL) SELECT ext, first(dir ORDER BY n DESC, dir) AS dir, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) >= 0.8 AS dominant FROM k GROUP BY ext", "files")
def _(s, d):
    k = B.paths(s, d).groupBy(F.substring_index("path", ".", -1).alias("ext"), F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return k.groupBy("ext").agg(F.min_by("dir", F.struct((-F.col("n")).alias("n"), "dir")).alias("dir"), F.round(share, 6).alias("share"), (share >= 0.8).alias("dominant"))


@q("AGG45_session_totals", "SELECT repo, count(*) AS sessions, sum(coalesce(len(predicted_files), 0))::BIGINT AS files, count(DISTINCT scope_expr) AS scopes FROM sessions WHERE repo IS NOT NULL GROUP BY repo", "sessions")
def _(s, d):
    return B.sessions(s, d).filter("repo is not null").groupBy("repo").agg(F.count("*").alias("sessions"), F.sum(F.coalesce(F.size("predicted_files"), F.lit(0))).alias("files"), F.countDistinct("scope_expr").alias("scopes"))


@q("AGG49_precedents", "SELECT file, category, count(*) AS n, max(confidence) FILTER (confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)) AS best FROM rules WHERE file IS NOT NULL AND category IS NOT NULL GROUP BY ALL HAVING count(*) >= 3", "rules")
def _(s, d):
    r = B.rules(s, d).filter("file is not null and category is not null")
    return r.groupBy("file", "category").agg(F.count("*").alias("n"), F.max(F.when(F.col("confidence").between(0, 1), F.col("confidence"))).alias("best")).filter("n >= 3")


@q("AGG50_reduction", "WITH z AS (SELECT repo, split_part(path, '/', 1) AS top, sum(floor(length(content) / 4)) AS t FROM files WHERE content IS NOT NULL GROUP BY ALL) SELECT repo, round(avg(t), 6) AS mean_scope, round(100 - 100 * avg(t) / sum(t), 6) AS reduction FROM z GROUP BY repo", "files")
def _(s, d):
    rows = B.latest(table(s, d, "file_analyses").select("file_id", "repo", F.substring_index("path", "/", 1).alias("top"), S.tokens_estimate("content").alias("t"), "recorded_at"), ["file_id"]).filter("t is not null")
    z = rows.groupBy("repo", "top").agg(F.sum("t").alias("t"))
    return z.groupBy("repo").agg(F.round(F.avg("t"), 6).alias("mean_scope"), F.round(100 - 100 * F.avg("t") / F.sum("t"), 6).alias("reduction"))


@q("AGG56_health", "SELECT repo, count(*) AS files, count(*) FILTER (content IS NULL) AS missing, count(*) FILTER (contains(content, chr(13))) AS mixed_lines, round(100.0 * count(*) FILTER (docstring IS NOT NULL) / count(*), 6) AS documented FROM files GROUP BY repo", "files")
def _(s, d):
    rows = table(s, d, "file_analyses").select("file_id", "repo", F.col("content").isNull().alias("m"), F.contains("content", F.lit("\r")).alias("x"), F.col("docstring").isNotNull().alias("doc"), "recorded_at")
    r = B.latest(rows, ["file_id"])
    return r.groupBy("repo").agg(F.count("*").alias("files"), F.count_if("m").alias("missing"), F.count_if("x").alias("mixed_lines"), F.round(100.0 * F.count_if("doc") / F.count("*"), 6).alias("documented"))


@q("AGG57_scope_gravity", "WITH g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT module, sum(coalesce(n, 0))::BIGINT AS gravity, CASE WHEN sum(coalesce(n, 0)) > 50 THEN 'critical' WHEN sum(coalesce(n, 0)) > 10 THEN 'high' ELSE 'normal' END AS hint FROM nodes LEFT JOIN g USING (id) GROUP BY module", "edges", "nodes")
def _(s, d):
    g = G.degrees(B.edges(s, d)).select("id", "degree")
    out = B.nodes(s, d).join(g, "id", "left").groupBy("module").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("gravity"))
    return out.withColumn("hint", F.when(F.col("gravity") > 50, "critical").when(F.col("gravity") > 10, "high").otherwise("normal"))


@q("TOP07_task_overlap", "WITH r AS (SELECT constraint_id, scope_dir, len(list_intersect(list_distinct(regexp_extract_all(lower(message), '[a-z]+')), ['weak', 'policy', 'ingest', 'parse']))::BIGINT AS k FROM rules WHERE scope_dir IS NOT NULL) SELECT constraint_id, k FROM r WHERE k > 0 ORDER BY k DESC, constraint_id LIMIT 50", "rules")
def _(s, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("message"), F.lit("[a-z]+"), F.lit(0)))
    k = F.size(F.array_intersect(words, F.array(*map(F.lit, ("weak", "policy", "ingest", "parse"))))).cast("long")
    return B.rules(s, d).filter("scope_dir is not null").select("constraint_id", k.alias("k")).filter("k > 0").orderBy(F.desc("k"), "constraint_id").limit(50)


@q("TOP09_top_dirs", "WITH k AS (SELECT commit_id, split_part(file, '/', 1) AS dir, count(*) AS n FROM touched GROUP BY ALL) SELECT commit_id, dir, n FROM k QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY n DESC, dir) <= 2", "touched")
def _(s, d):
    k = B.touched(s, d).groupBy("commit_id", F.substring_index("file", "/", 1).alias("dir")).agg(F.count("*").alias("n"))
    return H.recent_by_module(k, "commit_id", [F.desc("n"), F.col("dir")], 2).drop("rank")


@q("TOP10_context_cap", "SELECT repo, module, path, size FROM (SELECT repo, split_part(path, '/', 1) AS module, path, length(docstring) AS size, sum(length(docstring)) OVER (PARTITION BY repo, split_part(path, '/', 1) ORDER BY path ROWS UNBOUNDED PRECEDING) AS used FROM files WHERE docstring IS NOT NULL) WHERE used <= 600", "files")
def _(s, d):
    f = B.files(s, d).filter("docstring is not null").select("repo", F.substring_index("path", "/", 1).alias("module"), "path", F.length("docstring").cast("long").alias("size"))
    used = F.sum("size").over(Window.partitionBy("repo", "module").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("used", used).filter("used <= 600").drop("used")


@q("TOP12_first_files", "SELECT commit_id, file FROM (SELECT commit_id, file, row_number() OVER (PARTITION BY commit_id ORDER BY file) AS k FROM touched) WHERE k <= 12", "touched")
def _(s, d):
    return H.recent_by_module(B.touched(s, d).select("commit_id", "file"), "commit_id", [F.col("file")], 12).drop("rank")


@q("SET11_auto_include", "WITH m AS (SELECT repo, split_part(file, '/', 1) AS top, file, count(*) AS n FROM touched WHERE contains(file, '/') GROUP BY ALL HAVING count(*) >= 3) SELECT repo, file FROM m UNION SELECT repo, path FROM files WHERE starts_with(path, 'src/')", "touched", "files")
def _(s, d):
    often = B.touched(s, d).filter("file like '%/%'").groupBy("repo", "file").agg(F.count("*").alias("n")).filter("n >= 3").select("repo", "file")
    return often.unionByName(B.paths(s, d).filter("path like 'src/%'").select("repo", F.col("path").alias("file"))).distinct()


@q("SET12_sync", "WITH a AS (SELECT DISTINCT repo, file FROM predicted), b AS (SELECT DISTINCT repo, file FROM touched) SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'ADD' ELSE 'REMOVE' END AS change FROM a FULL JOIN b ON a.repo = b.repo AND a.file = b.file WHERE a.file IS NULL OR b.file IS NULL", "predicted", "touched")
def _(s, d):
    a, b = (x(s, d).select("repo", "file").distinct().withColumn("t", F.lit("x")) for x in (B.predicted, B.touched))
    return M.entity_diff(a, b, ["repo", "file"], "t")


@q("WIN13_test_companions", r"WITH f AS (SELECT repo, path, regexp_replace(split_part(path, '/', -1), '[.][^.]*$', '') AS stem FROM files) SELECT a.repo, a.path, count(*) AS companions FROM f a JOIN f b ON a.repo = b.repo AND a.stem = b.stem AND a.path <> b.path GROUP BY ALL", "files")
def _(s, d):
    f = B.paths(s, d).select("repo", "path", S.stem("path").alias("stem"))
    k = f.groupBy("repo", "stem").agg((F.count("*") - 1).alias("companions")).filter("companions > 0")
    return f.join(k, ["repo", "stem"]).select("repo", "path", "companions")


@q("WIN14_canonical", "WITH c AS (SELECT repo, path, length(content) AS size, row_number() OVER (PARTITION BY repo ORDER BY file_id DESC) AS r FROM files WHERE content IS NOT NULL AND path LIKE '%.py'), m AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size, path) - 1 AS k, count(*) OVER (PARTITION BY repo) AS n FROM c WHERE r <= 10) SELECT repo, path, size FROM m WHERE k = n // 2", "files")
def _(s, d):
    f = B.files(s, d).filter("content is not null and path like '%.py'").select("repo", "path", "file_id", F.length("content").cast("long").alias("size"))
    w = Window.partitionBy("repo")
    ten = f.withColumn("r", F.row_number().over(w.orderBy(F.desc("file_id")))).filter("r <= 10")
    return ten.withColumn("k", F.row_number().over(w.orderBy("size", "path")) - 1).withColumn("n", F.count("*").over(w)).filter(F.col("k") == F.floor(F.col("n") / 2)).select("repo", "path", "size")


@q("VEC05_freshness", "SELECT repo, count(*) FILTER (ts > 1760000000) AS behind, count(*) FILTER (ts > 1760000000) > 50 AS stale FROM commits WHERE repo IS NOT NULL GROUP BY repo", "commits")
def _(s, d):
    out = B.commits(s, d).filter("repo is not null").groupBy("repo").agg(F.count_if(F.col("ts") > 1760000000).alias("behind"))
    return out.withColumn("stale", F.col("behind") > 50)


@q("PIPE06_scope_index", "SELECT module AS name, array_to_string(list_sort(list_distinct(list(w)))[1:15], ' ') AS keywords FROM (SELECT coalesce(([x FOR x IN string_split(path, '/')[1:-2] IF x NOT IN ('src', 'lib', 'app')])[1], '') AS module, unnest([w FOR w IN regexp_split_to_array(lower(path), '[/_. -]+') IF length(w) > 2]) AS w FROM files) WHERE module <> '' GROUP BY module", "files")
def _(s, d):
    w = B.paths(s, d).select(C.module_of(F.col("path")).alias("name"), F.explode(S.path_words("path")).alias("w")).filter("name is not null")
    return w.groupBy("name").agg(F.array_join(F.slice(F.array_sort(F.collect_set("w")), 1, 15), " ").alias("keywords"))


@q("PIPE16_integrity", "SELECT user_id, bool_and(event_id = k) AS contiguous, count(*) AS n FROM (SELECT user_id, event_id, first + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 1 AS k FROM (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first FROM events)) GROUP BY user_id")
def _(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count("*").alias("n"))
    return e.select("user_id", (F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("contiguous"), "n")
