"""Whole pipelines over the driver's tables: graph, documents, scopes, checks, replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import checkpointed, latest, scratch_path, table
from ..functions import scalar as S
from ..operators import assertions as A
from ..operators import feedback as L
from ..operators import graph as G
from ..operators import history as H
from ..operators import ingest as I
from ..operators import retrieval as R
from ..operators import structure as U
from . import bind as B
from . import feedback_plans as FP
from . import history_plans as HP
from . import search_plans as P

QUERIES: dict = {}
#: Observations before this time are the baseline, those from it on the candidate.
CUT = 1750000000


def q(name: str, sql: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, B.sql(sql, *names) if sql else None)
        return fn

    return keep


def _top(path: str) -> str:
    return f"CASE WHEN contains({path}, '/') THEN split_part({path}, '/', 1) ELSE '_root' END"


def sources(s, d):
    """Files with their contents and docstrings."""
    rows = table(s, d, "file_analyses").select("file_id", "repo", "path", "content", "docstring", "recorded_at")
    return latest(rows, ["file_id"]).filter("repo is not null and path is not null").select("repo", "path", "content", "docstring")


def docs(s, d):
    """Readmes and design notes as documents of their repository."""
    rows = table(s, d, "documents").filter("repo is not null and text is not null and doc_kind in ('readme', 'design_note')")
    return rows.select("repo", F.col("doc_id").cast("string").alias("source"), F.when(F.col("doc_kind") == "design_note", "architecture").otherwise("readme").alias("kind"), "text")


def path_edges(s, d):
    """The import graph of files by their paths."""
    n = B.nodes(s, d).select("id", "repo", "path")
    e = B.edges(s, d).join(n.select(F.col("id").alias("src"), "repo", F.col("path").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    return e.select("repo", F.col("a").alias("src"), F.col("b").alias("dst"))


def by_repo(df, a, b):
    """Pairs of ``repo:path`` names as paths of their repo; pairs over two repos drop out."""
    out = df.withColumns({"repo": F.substring_index(a, ":", 1), "_other": F.substring_index(b, ":", 1)}).filter("repo = _other").drop("_other")
    return out.withColumns({c: F.regexp_replace(c, "^[^:]*:", "") for c in (a, b)})


@q("GR04_graph", None)
def _(s, d):
    return I.build_graph(sources(s, d))["modules"]


@q("PIPE01_ingest", None)
def _(s, d):
    out = I.ingest(sources(s, d), docs(s, d), B.touched(s, d))
    scopes = out["scopes"].select("repo", "module", F.size("includes").alias("n_includes"), "confidence")
    return scopes.join(out["backtest"], ["repo", "module"], "left")


_GRAPH = f"""nd AS (SELECT id, repo, {_top("path")} AS module, path FROM nodes),
ed AS (SELECT DISTINCT a.repo, a.module, b.module AS dep, b.path AS file, a.path AS src FROM edges JOIN nd a ON a.id = src JOIN nd b ON b.id = dst),
cf AS (SELECT DISTINCT commit_id, repo || ':' || file AS file FROM touched), cn AS (SELECT file, count(*) AS n FROM cf GROUP BY file),
pr AS (SELECT x.file AS a, y.file AS b, count(*) AS n_ab FROM cf x JOIN cf y ON x.commit_id = y.commit_id AND x.file <> y.file GROUP BY ALL HAVING count(*) >= 3),
pn AS (SELECT split_part(a, ':', 1) AS repo, regexp_replace(a, '^[^:]*:', '') AS a, regexp_replace(b, '^[^:]*:', '') AS b, n_ab, x.n AS na, y.n AS nb FROM pr JOIN cn x ON x.file = a JOIN cn y ON y.file = b WHERE split_part(a, ':', 1) = split_part(b, ':', 1))"""
_SCOPES = f"""WITH {_GRAPH},
inc AS (SELECT repo, module, file FROM ed WHERE module <> dep UNION SELECT repo, {_top("a")}, b FROM pn WHERE na >= 3 AND nb >= 3 AND round(n_ab / least(na, nb), 3) >= 0.7 AND {_top("a")} <> {_top("b")}),
il AS (SELECT repo, module, list(file ORDER BY file) AS files FROM inc GROUP BY ALL),
dl AS (SELECT repo, module, list_sort(list(DISTINCT dep)) AS deps FROM ed WHERE module <> dep GROUP BY ALL), ul AS (SELECT repo, dep AS module, list_sort(list(DISTINCT module)) AS users FROM ed WHERE module <> dep GROUP BY ALL),
ct AS (SELECT repo, a, b, round(n_ab / na, 3) AS confidence FROM pn WHERE na >= 5 AND nb >= 5 AND n_ab / na >= 0.7),
cm AS (SELECT DISTINCT repo, m AS module, a, b, confidence FROM (SELECT *, unnest([{_top("a")}, {_top("b")}]) AS m FROM ct)),
cl AS (SELECT repo, module, string_agg('- ' || a || ' -> ' || b, chr(10) ORDER BY confidence DESC, a, b) AS t FROM (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY repo, module ORDER BY confidence DESC, a, b) <= 5) GROUP BY ALL),
hs AS (SELECT nd.repo, nd.module, path AS file, n FROM nd JOIN cn ON cn.file = nd.repo || ':' || path WHERE n >= 3),
hl AS (SELECT repo, module, string_agg('- ' || split_part(file, '/', -1) || ': ' || n || ' commits', chr(10) ORDER BY n DESC, file) AS t FROM (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY repo, module ORDER BY n DESC, file) <= 10) GROUP BY ALL),
co AS (SELECT repo, module, count(*) FILTER (module = dep) / count(*) AS c FROM ed GROUP BY ALL), dc AS (SELECT DISTINCT repo, {_top("path")} AS module FROM files WHERE length(docstring) > 20),
z AS (SELECT repo, {_top("path")} AS module, count(*) AS n_files, CAST(sum(floor(length(content) / 4)) AS BIGINT) AS tokens FROM files WHERE repo IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
j AS (SELECT z.*, coalesce(files, []) AS fs, coalesce(deps, []) AS dp, coalesce(users, []) AS us, cl.t AS c5, hl.t AS h10, coalesce(c, 1.0) AS coh, dc.module IS NOT NULL AS doc FROM z LEFT JOIN il USING (repo, module) LEFT JOIN dl USING (repo, module) LEFT JOIN ul USING (repo, module) LEFT JOIN cl USING (repo, module) LEFT JOIN hl USING (repo, module) LEFT JOIN co USING (repo, module) LEFT JOIN dc ON dc.repo = z.repo AND dc.module = z.module),
x AS (SELECT *, concat_ws(chr(10), '## Contracts' || chr(10) || c5, '## Stability' || chr(10) || h10, CASE WHEN len(dp) + len(us) > 0 THEN '## Dependencies' END, CASE WHEN len(dp) > 0 THEN 'imports from: ' || array_to_string(dp, ', ') END, CASE WHEN len(us) > 0 THEN 'used by: ' || array_to_string(us, ', ') END) AS ctx FROM j)
SELECT repo, module, array_to_string(list_concat([module || '/'], fs), ',') AS includes, array_to_string(list_sort(list_distinct(list_concat(dp, us))), ',') AS related, array_to_string(list_concat([lower(module)], [lower(p) FOR p IN dp[1:3]]), ',') AS tags,
CASE WHEN ctx = '' THEN module || ': ' || n_files || ' files' ELSE ctx END AS context, tokens, round(least(coh + CASE WHEN doc THEN 0.1 ELSE 0 END + CASE WHEN c5 IS NOT NULL THEN 0.1 ELSE 0 END, 1.0), 6) AS confidence FROM x"""


def scopes(s, d):
    f = sources(s, d)
    rows = checkpointed(HP.obs(s, d))
    files = f.select("repo", "path", S.tokens_estimate("content").alias("tokens"))
    documented = f.filter(F.length("docstring") > 20).select("repo", I.module_name(F.col("path")).alias("module"))
    commits = B.touched(s, d).select("repo", "file", "commit_id").distinct().groupBy("repo", "file").agg(F.count("*").alias("n"))
    couplings = by_repo(H.couplings(rows, 0.5, top=None), "file_a", "file_b")
    return I.synthesize(files, checkpointed(path_edges(s, d)), couplings, by_repo(H.contracts(rows, 0.7, top=None), "trigger", "coupled"), commits, documented)


@q("PIPE02_synthesis", _SCOPES, "files", "nodes", "edges", "touched")
def _(s, d):
    out = scopes(s, d)
    return out.select("repo", "module", *[F.array_join(c, ",").alias(c) for c in ("includes", "related", "tags")], "context", "tokens", "confidence")


_SIGNAL = r"(?i)(?:#|//)\s*(WARNING|DANGER|CRITICAL|IMPORTANT|INVARIANT|HACK|WORKAROUND|NOTE|NB|TODO|FIXME|XXX)\b\s*:?\s*(.*?)(?:\s+#.*|\s+//.*)?$"
_FRAGMENTS = f"""dr AS (SELECT repo, list_sort(list(DISTINCT split_part(path, '/', 1))) AS dirs FROM files WHERE repo IS NOT NULL AND contains(path, '/') GROUP BY repo),
ln AS (SELECT repo, doc_id, doc_kind, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT repo, doc_id, doc_kind, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM documents WHERE repo IS NOT NULL AND text IS NOT NULL AND doc_kind IN ('readme', 'design_note'))),
gr AS (SELECT *, sum(CASE WHEN starts_with(l, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ln),
sc AS (SELECT repo, doc_id, doc_kind, CAST(g AS BIGINT) AS no, coalesce(max(trim(regexp_replace(l, '^#+', ''))) FILTER (starts_with(l, '#')), 'Introduction') AS heading, trim(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT starts_with(l, '#')), ''), ' ' || chr(10) || chr(9)) AS body FROM gr GROUP BY ALL),
sl AS (SELECT sc.repo, coalesce([x FOR x IN coalesce(dirs, []) IF contains(lower(heading || ' ' || body), lower(x))][1], '_root') AS module, CASE WHEN doc_kind = 'design_note' THEN 'architecture' ELSE 'readme' END AS kind, CAST(doc_id AS VARCHAR) AS source, no, CASE WHEN doc_kind = 'design_note' THEN 7 ELSE 5 END AS priority, heading || ':' || chr(10) || substring(body, 1, 500) AS content FROM sc LEFT JOIN dr USING (repo) WHERE body <> ''),
cl AS (SELECT repo, path, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM (SELECT repo, path, string_split(replace(content, chr(13), ''), chr(10)) AS ls FROM files WHERE repo IS NOT NULL AND content IS NOT NULL)),
cm AS (SELECT repo, path, i, upper(regexp_extract(l, '{_SIGNAL}', 1)) AS sg, trim(regexp_extract(l, '{_SIGNAL}', 2)) AS t FROM cl WHERE regexp_matches(l, '{_SIGNAL}')),
fr AS (SELECT * FROM sl UNION ALL SELECT repo, {_top("path")}, 'docstring', path, 0, 4, docstring FROM files WHERE repo IS NOT NULL AND length(docstring) > 20
 UNION ALL SELECT repo, {_top("path")}, 'comment', path, i, CASE WHEN sg IN ('WARNING', 'DANGER', 'CRITICAL') THEN 10 WHEN sg IN ('IMPORTANT', 'INVARIANT') THEN 9 WHEN sg IN ('HACK', 'WORKAROUND') THEN 8 WHEN sg IN ('NOTE', 'NB') THEN 6 ELSE 5 END, t FROM cm WHERE t <> '')"""


@q("PIPE03_fragments", f"WITH {_FRAGMENTS} SELECT repo, module, kind, source, CAST(no AS BIGINT) AS no, priority, content FROM fr", "files")
def _(s, d):
    return I.absorb(docs(s, d), sources(s, d))


@q("PIPE03_context", f"WITH {_FRAGMENTS} SELECT repo, module, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM (SELECT *, sum(length(content)) OVER (PARTITION BY repo, module ORDER BY priority DESC, source, kind, no ROWS UNBOUNDED PRECEDING) AS used FROM fr) WHERE used <= 1500 GROUP BY ALL", "files")
def _(s, d):
    return I.context_of(I.absorb(docs(s, d), sources(s, d)))


@q("PIPE04_lazy_module", f"WITH r AS (SELECT min(repo) AS repo FROM files), nd AS (SELECT id, nodes.repo, {_top('path')} AS module, path FROM nodes JOIN r ON nodes.repo = r.repo), e AS (SELECT a.path AS a, a.module AS ma, b.path AS b, b.module AS mb FROM edges JOIN nd a ON a.id = src JOIN nd b ON b.id = dst) SELECT 'own' AS link, path FROM nd WHERE module = 'src' UNION ALL SELECT DISTINCT 'imports', b FROM e WHERE ma = 'src' AND mb <> 'src' UNION ALL SELECT DISTINCT 'imported by', a FROM e WHERE mb = 'src' AND ma <> 'src'", "files", "nodes", "edges")
def _(s, d):
    f = B.paths(s, d)
    repo = f.agg(F.min("repo")).first()[0]
    out = I.lazy_module(f, path_edges(s, d), B.touched(s, d), repo, "src")
    return out["files"].select(F.lit("own").alias("link"), "path").unionByName(out["neighbours"].select("link", "path"))


_SOURCES = f"""c AS (SELECT repo, m AS module, 'contract' AS category, a || ' -> ' || b AS message, confidence FROM (SELECT *, unnest(list_distinct([{_top("a")}, {_top("b")}])) AS m FROM (SELECT repo, a, b, round(n_ab / na, 3) AS confidence FROM pn WHERE na >= 5 AND nb >= 5 AND n_ab / na >= 0.7))),
dm AS (SELECT DISTINCT repo, module, dep FROM ed), al AS (SELECT DISTINCT repo, module FROM nd),
b AS (SELECT x.repo, x.module, 'boundary', 'no import of ' || y.module, 1.0 FROM al x JOIN al y ON x.repo = y.repo AND x.module <> y.module ANTI JOIN dm ON dm.repo = x.repo AND dm.module = x.module AND dm.dep = y.module),
h AS (SELECT n.repo, n.module, 'hub', n.path || ' has ' || k || ' importers', 1.0 FROM (SELECT dst, count(*) AS k FROM edges GROUP BY dst HAVING count(*) >= 10) JOIN nd n ON n.id = dst),
f AS (SELECT repo, {_top("file")}, 'stability', file || ' changes often', 0.8 FROM (SELECT repo, file, count(DISTINCT commit_id) AS n FROM touched GROUP BY ALL HAVING count(DISTINCT commit_id) >= 20)),
g AS (SELECT repo, {_top("file")}, 'gap', file || ' was missed ' || n || ' times', least(n / 10, 1.0) FROM (SELECT repo, f AS file, count(*) AS n FROM (SELECT repo, unnest(touched_not_predicted) AS f FROM commits WHERE repo IS NOT NULL) WHERE f IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)),
r AS (SELECT split_part(scope_dir, '/', 1), split_part(scope_dir, '/', 2), category, message, max(confidence) FROM rules WHERE contains(scope_dir, '/') AND category IS NOT NULL AND message IS NOT NULL AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) GROUP BY ALL),
u AS (SELECT * FROM c UNION ALL SELECT * FROM b UNION ALL SELECT * FROM h UNION ALL SELECT * FROM f UNION ALL SELECT * FROM g UNION ALL SELECT * FROM r)"""


@q("PIPE07_all_sources", f"WITH {_GRAPH}, {_SOURCES} SELECT repo, module, category, message, CAST(confidence AS DOUBLE) AS confidence FROM u QUALIFY row_number() OVER (PARTITION BY repo, module, category ORDER BY confidence DESC, message) <= 5", "nodes", "edges", "commits", "touched", "rules")
def _(s, d):
    rows = checkpointed(HP.obs(s, d))
    n, e = B.nodes(s, d), checkpointed(path_edges(s, d))
    m = lambda c: I.module_name(F.col(c))
    row = lambda df, module, category, message, confidence: df.select("repo", module.alias("module"), (category if not isinstance(category, str) else F.lit(category)).alias("category"), message.alias("message"), confidence.cast("double").alias("confidence"))
    promises = by_repo(H.contracts(rows, 0.7, top=None), "trigger", "coupled").withColumn("m", F.explode(F.array_distinct(F.array(m("trigger"), m("coupled")))))
    out = [row(promises, F.col("m"), "contract", F.concat("trigger", F.lit(" -> "), "coupled"), F.col("confidence"))]
    all_ = n.select("repo", m("path").alias("module")).distinct()
    used = e.select("repo", m("src").alias("module"), m("dst").alias("dep")).distinct()
    absent = all_.join(all_.withColumnRenamed("module", "dep"), "repo").filter("module <> dep").join(used, ["repo", "module", "dep"], "left_anti")
    out.append(row(absent, F.col("module"), "boundary", F.concat(F.lit("no import of "), "dep"), F.lit(1.0)))
    hubs = e.groupBy("repo", "dst").agg(F.count("*").alias("k")).filter("k >= 10")
    out.append(row(hubs, m("dst"), "hub", F.concat("dst", F.lit(" has "), F.col("k").cast("string"), F.lit(" importers")), F.lit(1.0)))
    often = B.touched(s, d).select("repo", "file", "commit_id").distinct().groupBy("repo", "file").agg(F.count("*").alias("n")).filter("n >= 20")
    out.append(row(often, m("file"), "stability", F.concat("file", F.lit(" changes often")), F.lit(0.8)))
    missed = B.commits(s, d).filter("repo is not null").select("repo", F.explode("touched_not_predicted").alias("file")).filter("file is not null").groupBy("repo", "file").agg(F.count("*").alias("n")).filter("n >= 3")
    out.append(row(missed, m("file"), "gap", F.concat("file", F.lit(" was missed "), F.col("n").cast("string"), F.lit(" times")), F.least(F.col("n") / 10, F.lit(1.0))))
    part = lambda i: F.coalesce(F.try_element_at(F.split("scope_dir", "/"), F.lit(i)), F.lit(""))
    told = B.rules(s, d).filter("scope_dir like '%/%' and category is not null and message is not null and confidence between 0 and 1 and not isnan(confidence)")
    told = told.groupBy(part(1).alias("repo"), part(2).alias("module"), "category", "message").agg(F.max("confidence").alias("confidence"))
    out.append(row(told, F.col("module"), F.col("category"), F.col("message"), F.col("confidence")))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("repo", "module", "category").orderBy(F.desc("confidence"), "message"))
    return both.withColumn("_k", rank).filter("_k <= 5").drop("_k")


_FOUND = f"SELECT commit_id, severity FROM ({FP.QUERIES['JN11_contract_breaks'][1]}) UNION ALL SELECT commit_id, severity FROM ({FP.QUERIES['JN12_outside_session'][1]}) UNION ALL SELECT commit_id, severity FROM ({FP.QUERIES['JN22_locked_changes'][1]})"
_CHECKED = f"WITH f AS ({_FOUND}), r AS (SELECT DISTINCT repo, commit_id, ts FROM touched QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, commit_id) <= 50), v AS (SELECT commit_id, count(*) FILTER (severity IN ('hold', 'guard')) AS h, count(*) FILTER (severity NOT IN ('hold', 'guard')) AS n FROM f GROUP BY commit_id), b AS (SELECT repo, count(*) AS commits, count(*) FILTER (coalesce(h, 0) = 0 AND coalesce(n, 0) = 0) AS clean, CAST(coalesce(sum(h), 0) AS BIGINT) AS holds, CAST(coalesce(sum(n), 0) AS BIGINT) AS notes FROM r LEFT JOIN v USING (commit_id) GROUP BY repo)"
# DISTINCT is applied after a window in SQL, so the rows are made distinct before.
_CHECKED = _CHECKED.replace("SELECT DISTINCT repo, commit_id, ts FROM touched QUALIFY", "SELECT * FROM (SELECT DISTINCT repo, commit_id, ts FROM touched) QUALIFY")


def checked(s, d):
    found = FP.QUERIES["JN11_contract_breaks"][0](s, d).unionByName(FP.QUERIES["JN12_outside_session"][0](s, d)).unionByName(FP.QUERIES["JN22_locked_changes"][0](s, d))
    return I.check_backtest(found, B.touched(s, d), 50)


@q("PIPE10_backtest", _CHECKED + " SELECT * FROM b", "touched")
def _(s, d):
    return checked(s, d)


@q("PIPE17_summary", _CHECKED + " SELECT repo, clean || ' of ' || commits || ' commits clean, ' || notes || ' note(s)' || CASE WHEN holds > 0 THEN ', ' || holds || ' would have been held' ELSE '' END AS line FROM b", "touched")
def _(s, d):
    return I.summary_lines(checked(s, d))


_TEST = "regexp_matches({0}, 'tests?/|_test\\.\\w+$|test_\\w+\\.\\w+$|\\.test\\.\\w+$|\\.spec\\.\\w+$')"
_TASKS = f"""k AS (SELECT commit_id, c.repo, trim(coalesce(task, '')) AS t, list_distinct([f FOR f IN coalesce(actual_files_modified, []) IF f IS NOT NULL]) AS fs FROM commits c LEFT JOIN sessions s USING (session_id)),
kt AS (SELECT *, [f FOR f IN fs IF {_TEST.format("f")}] AS ts FROM k WHERE len(fs) BETWEEN 2 AND 15),
tk AS (SELECT commit_id, repo, fs, ts, CASE WHEN t <> '' THEN t ELSE 'change ' || array_to_string(list_sort(list_distinct([CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE '_root' END FOR f IN fs IF NOT {_TEST.format("f")}])), ', ') END AS task FROM kt WHERE len(ts) < len(fs))"""


def tasks(s, d):
    said = B.sessions(s, d).select("session_id", F.col("task").alias("message"))
    commits = B.commits(s, d).select("commit_id", "repo", "session_id", F.col("actual_files_modified").alias("files")).join(said, "session_id", "left")
    return I.corpus(commits.na.fill("", ["message"]))


@q("PIPE11_corpus", f"WITH {_TASKS} SELECT commit_id, repo, task, CAST(len(fs) AS INTEGER) AS n_files, CAST(len(ts) AS INTEGER) AS n_tests FROM tk", "commits", "sessions")
def _(s, d):
    return tasks(s, d).select("commit_id", "repo", "task", F.size("expected_files").alias("n_files"), F.size("expected_tests").alias("n_tests"))


_TWELVE = "h AS (SELECT repo, file, count(*) AS n FROM touched GROUP BY ALL), p AS (SELECT repo, list(file) AS ps FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, file) <= 12) GROUP BY repo)"


@q("PIPE11_observations", f"WITH {_TASKS}, {_TWELVE}, o AS (SELECT commit_id, tk.repo, fs, coalesce(ps, []) AS ps, len(list_intersect(fs, coalesce(ps, []))) AS hit FROM tk LEFT JOIN p ON p.repo = tk.repo) SELECT commit_id, repo, round(hit / len(fs), 3) AS recall, CASE WHEN len(ps) > 0 THEN round(hit / len(ps), 3) ELSE 1.0 END AS precision, CAST(len(fs) - hit AS INTEGER) AS n_missed FROM o", "commits", "sessions", "touched")
def _(s, d):
    n = B.touched(s, d).groupBy("repo", "file").agg(F.count("*").alias("n"))
    twelve = H.recent_by_module(n, "repo", [F.desc("n"), F.col("file")], 12).groupBy("repo").agg(F.collect_list("file").alias("files"))
    return I.bootstrap_observations(tasks(s, d), twelve).select("commit_id", "repo", "recall", "precision", F.size("touched_not_predicted").alias("n_missed"))


def _side(when: str, a: str, b: str) -> str:
    return f"SELECT repo, avg(recall) AS {a}, avg(CASE WHEN len(coalesce(touched_not_predicted, [])) > 0 THEN 1.0 ELSE 0.0 END) AS {b} FROM commits WHERE repo IS NOT NULL AND {when} GROUP BY repo"


_GATES = f"""ca AS ({_side(f"ts >= {CUT}", "cr", "cs")}), ba AS ({_side(f"ts < {CUT}", "br", "bs")}),
tm AS (SELECT coalesce(quantile_cont(value, 0.95) FILTER (event_type = 'view'), 0.0) AS rs, coalesce(quantile_cont(value, 0.95) FILTER (event_type = 'click'), 0.0) AS ck FROM events),
al AS (SELECT repo, coalesce(cr, 0.0) AS cr, cs, coalesce(br, 0.0) AS br, coalesce(bs, 1.0) AS bs, rs, ck FROM ca LEFT JOIN ba USING (repo), tm),
g AS (SELECT repo, 'correctness' AS gate, round(cr, 4) AS value, round(br - 0.02, 4) AS threshold, cr >= br - 0.02 AS passed FROM al UNION ALL SELECT repo, 'freshness', round(cs, 4), round(bs, 4), cs <= bs FROM al UNION ALL SELECT repo, 'stability', 0.0, 0.0, true FROM al
 UNION ALL SELECT repo, 'resolve_latency', round(rs, 4), 500.0, rs <= 500 FROM al UNION ALL SELECT repo, 'check_latency', round(ck, 4), 1000.0, ck <= 1000 FROM al UNION ALL SELECT repo, 'no_worktree_churn', 0.0, 0.0, true FROM al)"""


def gates(s, d):
    c = B.commits(s, d).filter("repo is not null")
    timings = table(s, d, "events").filter("event_type in ('view', 'click')").select(F.when(F.col("event_type") == "view", "resolve").otherwise("check").alias("operation"), F.col("value").alias("duration_ms"))
    return I.gates(c.filter(F.col("ts") >= CUT), c.filter(F.col("ts") < CUT), timings, "repo")


@q("AGG25_six_gates", f"WITH {_GATES} SELECT * FROM g", "commits")
def _(s, d):
    return gates(s, d)


@q("PIPE12_fitness", f"WITH {_GATES}, sc AS (SELECT repo, avg(recall) AS primary_, avg(precision) AS secondary FROM commits WHERE repo IS NOT NULL AND ts >= {CUT} GROUP BY repo), ok AS (SELECT repo, bool_and(passed) AS ok FROM g GROUP BY repo) SELECT repo, CASE WHEN ok THEN round(primary_ + 0.01 * secondary, 4) ELSE 0.0 END AS fitness FROM ok JOIN sc USING (repo)", "commits")
def _(s, d):
    scores = B.commits(s, d).filter(F.col("repo").isNotNull() & (F.col("ts") >= CUT)).groupBy("repo").agg(F.avg("recall").alias("primary"), F.avg("precision").alias("secondary"))
    return I.fitness(gates(s, d), scores, "repo")


@q("VEC04_index", P.QUERIES["TOP03_bm25_top"][1])
def _(s, d):
    root = scratch_path(s, "index")
    R.build_index(table(s, d, "documents"), "doc_id", "text", root)
    return R.search_index(s, root, "doc_id", P.QUERY)


@q("FN23_section", "SELECT constraint_id, metadata['source'] AS source FROM scope_constraints WHERE constraint_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY constraint_id ORDER BY recorded_at DESC) = 1")
def _(s, d):
    rows = table(s, d, "scope_constraints").select("constraint_id", S.section_text("metadata", "Source").alias("source"), "recorded_at")
    return latest(rows, ["constraint_id"]).select("constraint_id", "source")


@q("FN46_billed_input", "SELECT l_orderkey, CAST(sum(coalesce(l_partkey, 0) + coalesce(l_suppkey, 0) + coalesce(l_linenumber, 0)) AS BIGINT) AS billed FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(S.billed_input("l_partkey", "l_suppkey", F.col("l_linenumber").cast("long"))).alias("billed"))


@q("FN52_rust_uses", r"SELECT DISTINCT file_id, trim(u) AS path FROM (SELECT file_id, unnest(regexp_extract_all(content, '(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;{]+);', 1)) AS u FROM files WHERE path LIKE '%.rs')", "files")
def _(s, d):
    out = U.file_structure(B.files(s, d).filter("path like '%.rs'"), ["file_id"], "path", "content")
    return out.select("file_id", F.explode("imports").alias("path")).distinct()


@q("FLT09_assertions", "WITH k AS (SELECT scope_dir AS scope, max(message) AS context, count(*) FILTER (confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)) AS n FROM rules WHERE scope_dir IS NOT NULL GROUP BY scope_dir) SELECT scope, 'context' AS kind, 'Policy' AS detail FROM k WHERE NOT contains(lower(coalesce(context, '')), 'policy') UNION ALL SELECT scope, 'constraints', 'no constraint' FROM k WHERE n = 0", "rules")
def _(s, d):
    known = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    k = B.rules(s, d).filter("scope_dir is not null").groupBy(F.col("scope_dir").alias("scope")).agg(F.max("message").alias("context"), F.count_if(known).alias("n_constraints"))
    rules = s.createDataFrame([("*", [], ["Policy"], True, None)], "scope string, includes array<string>, contains array<string>, constraints boolean, reason string")
    return A.failed_assertions(k, rules)


@q("JN45_stale_suppressed", f"WITH t AS (SELECT repo, {_top('file')} AS module, max(ts) AS changed FROM touched GROUP BY ALL), r AS (SELECT repo, {_top('file')} AS module, max(ts) AS refreshed FROM predicted GROUP BY ALL) SELECT repo, module, changed > refreshed + 86400 AND refreshed < {B.AS_OF} - 604800 AS stale FROM t JOIN r USING (repo, module)", "touched", "predicted")
def _(s, d):
    top = lambda df, name: df.groupBy("repo", I.module_name(F.col("file")).alias("module")).agg(F.max("ts").alias(name))
    return L.stale_scopes(top(B.touched(s, d), "changed"), top(B.predicted(s, d), "refreshed"), ["repo", "module"], B.AS_OF)
