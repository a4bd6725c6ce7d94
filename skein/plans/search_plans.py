"""Retrieval, budgets and scopes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions import scalar as S
from ..operators import retrieval as R
from ..operators import scopes as C
from ..operators import textops as X
from . import bind as B

QUERIES: dict = {}


def q(name: str, sql: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, B.sql(sql, *names) if sql else None)
        return fn

    return keep


QUERY = "the retry queue merges the slow queries of the ledger while the commit reader rebuilds the ledger and the index"
_TERMS = "(VALUES ('the'), ('retry'), ('queue'), ('merges'), ('the'), ('slow'), ('queries'), ('of'), ('the'), ('ledger'), ('while'), ('the'), ('commit'), ('reader'), ('rebuilds'), ('the'), ('ledger'), ('and'), ('the'), ('index')) AS t(term)"
_BM25 = f"""d AS (SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*') IF length(w) > 1] AS ws FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d), tf AS (SELECT doc_id, len(ws) AS dl, w AS term, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) GROUP BY doc_id, len(ws), w),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN {_TERMS} USING (term), st GROUP BY doc_id)"""


@q("AGG16_postings", "WITH d AS (SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*') IF length(w) > 1] AS ws FROM documents WHERE text IS NOT NULL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, unnest(ws) AS term, count(*) AS tf FROM d GROUP BY ALL) GROUP BY term".replace("SELECT doc_id, unnest(ws) AS term, count(*) AS tf FROM d GROUP BY ALL", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL"))
def _(s, d):
    return R.postings(table(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@q("AGG17_bm25", f"WITH {_BM25} SELECT * FROM bm")
def _(s, d):
    return R.bm25(table(s, d, "documents"), "doc_id", "text", QUERY, top=None)


@q("TOP03_bm25_top", f"WITH {_BM25} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def _(s, d):
    return R.bm25(table(s, d, "documents"), "doc_id", "text", QUERY, top=50)


def _query_vector(s, d):
    return [float(x) for x in table(s, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


_COS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qv AS (SELECT e AS qe FROM v WHERE vec_id = 0), cs AS (SELECT vec_id, round(list_sum([x * y FOR x, i IN e FOR y IN [qe[i]]]) / 1, 6) AS score FROM v, qv)"
_COS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qv AS (SELECT e AS qe FROM v WHERE vec_id = 0), cs AS (SELECT vec_id, round(list_inner_product(e, qe) / ((sqrt(list_inner_product(e, e)) + 1e-10) * (sqrt(list_inner_product(qe, qe)) + 1e-10)), 6) AS score FROM v, qv)"


@q("VEC02_cosine", f"WITH {_COS} SELECT vec_id, score FROM cs ORDER BY score DESC, vec_id LIMIT 50")
def _(s, d):
    return R.cosine_top(table(s, d, "embeddings"), "vec_id", "embedding", _query_vector(s, d), 50)


_RRF = f"{_BM25}, {_COS}, dl AS (SELECT 100 + 5 * vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS r FROM (SELECT * FROM cs ORDER BY score DESC, vec_id LIMIT 50)), sl AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50))"


@q("WIN01_rrf", f"WITH {_RRF} SELECT doc_id, round(1.0 / (60 + coalesce(dl.r, (SELECT count(*) FROM dl) + 100)) + 1.0 / (60 + coalesce(sl.r, (SELECT count(*) FROM sl) + 100)), 6) AS score FROM dl FULL JOIN sl USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20")
def _(s, d):
    dense = R.cosine_top(table(s, d, "embeddings"), "vec_id", "embedding", _query_vector(s, d), 50).select((F.col("vec_id") * 5 + 100).alias("doc_id"), "score")
    return R.rrf(dense, R.bm25(table(s, d, "documents"), "doc_id", "text", QUERY, 50), "doc_id", 20)


def sized(s, d):
    """Files with their module and token estimate."""
    rows = table(s, d, "file_analyses").select("file_id", "repo", "path", S.tokens_estimate("content").alias("tokens"), "recorded_at")
    return B.latest(rows, ["file_id"]).drop("recorded_at").filter("tokens is not null").withColumn("module", F.coalesce(C.module_of(F.col("path")), F.lit("")))


_MODULE = "coalesce(([x FOR x IN string_split(path, '/')[1:-2] IF x NOT IN ('src', 'lib', 'app')])[1], '')"
_SIZED = f"z AS (SELECT file_id, repo, path, CAST(floor(length(content) / 4) AS BIGINT) AS tokens, {_MODULE} AS module FROM files WHERE content IS NOT NULL)"


@q("WIN05_prefix_fill", f"WITH {_SIZED} SELECT * FROM (SELECT repo, module, path, tokens, sum(tokens) OVER (PARTITION BY repo, module ORDER BY path ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM z) WHERE used <= 2000", "files")
def _(s, d):
    return R.prefix_fill(sized(s, d), ["repo", "module"], [F.col("path")], "tokens", 2000).select("repo", "module", "path", "tokens", "used")


_GREEDY = f"""WITH RECURSIVE {_SIZED}, o AS (SELECT *, row_number() OVER (PARTITION BY repo, module ORDER BY path) AS k FROM z),
g(repo, module, k, path, tokens, room, taken) AS (
  SELECT repo, module, k, path, tokens, 2000 - CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END, tokens <= 2000 FROM o WHERE k = 1
  UNION ALL SELECT o.repo, o.module, o.k, o.path, o.tokens, g.room - CASE WHEN o.tokens <= g.room THEN o.tokens ELSE 0 END, o.tokens <= g.room FROM g JOIN o ON o.repo = g.repo AND o.module = g.module AND o.k = g.k + 1
) SELECT repo, module, path, tokens FROM g WHERE taken"""


@q("WIN06_greedy_fill", _GREEDY, "files")
def _(s, d):
    return R.greedy_fill(sized(s, d), ["repo", "module"], [F.col("path")], "tokens", 2000, "path")


_PATHS = "WITH w AS (SELECT repo, path, list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower(path), '[/_. -]+') IF length(w) > 2])) AS ws FROM files), st AS (SELECT repo, count(*) AS n, avg(len(ws)) AS a FROM w GROUP BY repo), h AS (SELECT repo, path, len(ws) AS dl, t.word FROM (SELECT repo, path, ws, unnest(ws) AS word FROM w) t WHERE t.word IN ('index', 'ledger', 'report')), df AS (SELECT repo, word, count(*) AS df FROM h GROUP BY ALL), sc AS (SELECT h.repo, h.path, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / a))) AS bm25 FROM h JOIN df USING (repo, word) JOIN st USING (repo) GROUP BY ALL)"


@q("AGG18_path_bm25", f"{_PATHS} SELECT w.repo, w.path, round(coalesce(bm25, 0), 6) AS bm25 FROM w LEFT JOIN sc USING (repo, path)".replace("SELECT repo, path, len(ws) AS dl, t.word FROM (SELECT repo, path, ws, unnest(ws) AS word FROM w) t", "SELECT repo, path, len(t.ws) AS dl, t.word FROM (SELECT repo, path, ws, unnest(ws) AS word FROM w) t"), "files")
def _(s, d):
    files = B.paths(s, d)
    words = files.select("repo").distinct().select("repo", F.explode(F.array(*map(F.lit, ("index", "ledger", "report")))).alias("word"))
    out = R.path_scores(files, ["repo"], "path", words)
    return out.select("repo", "path", F.round("bm25", 6).alias("bm25"))


@q("WIN08_line_chunks", "SELECT file_id, CAST(i AS BIGINT) AS chunk, CAST(i * 90 AS BIGINT) AS first, CAST(least(100, n - i * 90) AS BIGINT) AS n_lines FROM (SELECT file_id, n, unnest(range(0, CAST(floor(greatest(n - 11, 0) / 90) AS BIGINT) + 1)) AS i FROM (SELECT file_id, len(string_split(content, chr(10))) AS n FROM files WHERE content IS NOT NULL))", "files")
def _(s, d):
    return X.line_chunks(B.files(s, d), "file_id", "content")


@q("WIN07_islands", "WITH l AS (SELECT DISTINCT c_nationkey AS k, c_custkey AS n FROM customer WHERE c_acctbal > 0), r AS (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS run FROM l) SELECT k, min(n) AS first, max(n) AS last FROM r GROUP BY k, run")
def _(s, d):
    rows = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("n"))
    return X.islands(rows, ["k"], "n")


_TERMSQL = r"SELECT session_id, repo, scope_expr, CASE WHEN regexp_matches(ltrim(t), '^[+\-&]') THEN left(ltrim(t), 1) ELSE '+' END AS op, regexp_replace(trim(regexp_replace(t, '^\s*[+\-&]\s*', '')), '/$', '') AS name, pos FROM (SELECT session_id, repo, scope_expr, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT session_id, repo, scope_expr, regexp_extract_all(scope_expr, '([+\-&]?\s*[^+\-&]+)', 1) AS ts FROM sessions))"


@q("SET05_parse", f"SELECT session_id, CAST(pos AS BIGINT) AS pos, op, name FROM ({_TERMSQL})", "sessions")
def _(s, d):
    rows = B.sessions(s, d).select("session_id", F.posexplode(C.expression_terms(F.col("scope_expr"))).alias("pos", "t"))
    return rows.select("session_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("t.op").alias("op"), F.col("t.name").alias("name"))


_EVAL = f"""WITH t AS ({_TERMSQL}), e AS (SELECT DISTINCT repo, scope_expr, pos, op, name FROM t WHERE repo IS NOT NULL AND scope_expr IS NOT NULL), m AS (SELECT repo, path, ([x FOR x IN string_split(path, '/')[1:-2] IF x NOT IN ('src', 'lib', 'app')])[1] AS module FROM files),
c AS (SELECT DISTINCT e.repo, scope_expr, path, module FROM e JOIN m ON m.repo = e.repo AND m.module = e.name WHERE op = '+')
SELECT DISTINCT c.repo, c.scope_expr, c.path FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = c.repo AND e.scope_expr = c.scope_expr AND e.op = '-' AND e.name = c.module) AND NOT EXISTS (SELECT 1 FROM e WHERE e.repo = c.repo AND e.scope_expr = c.scope_expr AND e.op = '&' AND e.name <> c.module)"""


@q("SET06_evaluate", _EVAL, "sessions", "files")
def _(s, d):
    return C.evaluate(B.sessions(s, d), B.paths(s, d), ["repo"], "scope_expr", "path")


def _scope(s, d, prefix):
    return B.paths(s, d).filter(F.col("path").startswith(prefix)).select(F.concat("repo", F.lit(":"), "path").alias("file"), F.col("file_id").alias("ord"), (F.length("path") % 7).cast("double").alias("score"))


def _scope_sql(prefix):
    return f"SELECT repo || ':' || path AS file, file_id AS ord, CAST(length(path) % 7 AS DOUBLE) AS score FROM files WHERE starts_with(path, '{prefix}')"


@q("SET01_merge", f"SELECT file, max(score) AS score FROM ({_scope_sql('src/')} UNION ALL {_scope_sql('src/a')} UNION ALL {_scope_sql('app/')}) GROUP BY file", "files")
def _(s, d):
    return C.merge(C.merge(_scope(s, d, "src/"), _scope(s, d, "src/a")), _scope(s, d, "app/")).select("file", "score")


@q("SET02_subtract", f"SELECT file, ord FROM ({_scope_sql('src/')}) WHERE file NOT IN (SELECT file FROM ({_scope_sql('src/a')}))", "files")
def _(s, d):
    return C.subtract(_scope(s, d, "src/"), _scope(s, d, "src/a")).select("file", "ord")


@q("SET03_intersect", f"SELECT file, ord FROM ({_scope_sql('src/')}) WHERE file IN (SELECT file FROM ({_scope_sql('src/a')}))", "files")
def _(s, d):
    return C.intersect(_scope(s, d, "src/"), _scope(s, d, "src/a")).select("file", "ord")


@q("SET04_compose", f"SELECT file FROM (SELECT file FROM ({_scope_sql('src/')}) UNION SELECT file FROM ({_scope_sql('app/')})) WHERE file NOT IN (SELECT file FROM ({_scope_sql('src/a')}))", "files")
def _(s, d):
    named = {"source": _scope(s, d, "src/"), "app": _scope(s, d, "app/"), "alpha": _scope(s, d, "src/a")}
    return C.compose("source + app - alpha", named).select("file")


_SCOPE_DIM = f"SELECT module AS scope, list_sort(list_distinct(list(w))) AS keywords, 'files of the ' || module || ' module about ' || min(w) AS description FROM (SELECT {_MODULE} AS module, unnest([w FOR w IN regexp_split_to_array(lower(path), '[/_. -]+') IF length(w) > 2]) AS w FROM files) WHERE module <> '' GROUP BY module"


def scope_dim(s, d):
    rows = B.paths(s, d).select(C.module_of(F.col("path")).alias("scope"), F.explode(S.path_words("path")).alias("w")).filter("scope is not null")
    out = rows.groupBy("scope").agg(F.array_sort(F.collect_set("w")).alias("keywords"), F.min("w").alias("e"))
    return out.select("scope", "keywords", F.concat(F.lit("files of the "), "scope", F.lit(" module about "), "e").alias("description"))


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_TW = lambda x: f"list_distinct([w FOR w IN regexp_extract_all(lower({x}), '[a-z0-9_]+') IF length(w) > 1 AND w NOT IN ({_STOP})])"


@q("SET07_match_tasks", f"""WITH sc AS ({_SCOPE_DIM}), a AS (SELECT session_id, {_TW('task')} AS tw FROM sessions WHERE task IS NOT NULL), b AS (SELECT scope, {_TW("array_to_string(keywords, ' ')")} AS kw, {_TW('scope')} AS nw, {_TW('description')} AS dw FROM sc),
p AS (SELECT session_id, scope, round(least(CASE WHEN len(kw) > 0 THEN 0.6 * len(list_intersect(tw, kw)) / len(list_distinct(list_concat(tw, kw))) ELSE 0 END + CASE WHEN list_has_any(nw, tw) THEN 0.25 ELSE 0 END + CASE WHEN len(dw) > 0 THEN 0.15 * len(list_intersect(tw, dw)) / len(dw) ELSE 0 END, 1.0), 6) AS score FROM a, b WHERE len(tw) > 0)
SELECT session_id, scope, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, scope) AS rank FROM p WHERE score >= 0.05) WHERE rank <= 3""", "files", "sessions")
def _(s, d):
    return C.match_tasks(B.sessions(s, d).filter("task is not null"), "session_id", "task", scope_dim(s, d))


@q("JN30_overlay", "WITH t AS (SELECT repo, count(*) AS n FROM commits WHERE repo IS NOT NULL GROUP BY repo), r AS (SELECT repo, count(*) AS n FROM sessions WHERE repo IS NOT NULL GROUP BY repo HAVING count(*) >= 300) SELECT repo, coalesce(r.n, t.n) AS n, CASE WHEN r.n IS NULL THEN 'tracked' ELSE 'runtime' END AS source FROM t FULL JOIN r USING (repo)", "commits", "sessions")
def _(s, d):
    t = B.commits(s, d).filter("repo is not null").groupBy("repo").agg(F.count("*").alias("n"))
    r = B.sessions(s, d).filter("repo is not null").groupBy("repo").agg(F.count("*").alias("n")).filter("n >= 300")
    return C.overlay(t, r, "repo")


@q("JN48_covering_scope", "WITH sc AS (SELECT unnest(['src', 'src/auth', 'lib', 'app/billing', 'vendor']) AS scope), p AS (SELECT DISTINCT path FROM files) SELECT path, (SELECT max_by(scope, length(scope)) FROM sc WHERE starts_with(p.path, scope || '/')) AS scope FROM p", "files")
def _(s, d):
    scopes = s.createDataFrame([("src",), ("src/auth",), ("lib",), ("app/billing",), ("vendor",)], "scope string")
    return C.covering_scope(B.paths(s, d), "path", scopes)


@q("SET08_jaccard_dedup", "WITH m AS (SELECT session_id AS k, f AS i FROM (SELECT DISTINCT session_id, unnest(predicted_files) AS f FROM sessions) WHERE f IS NOT NULL), n AS (SELECT k, count(*) AS n FROM m GROUP BY k), p AS (SELECT a.k, b.k AS o, count(*) AS x FROM m a JOIN m b ON a.i = b.i AND a.k <> b.k GROUP BY ALL), f AS (SELECT DISTINCT p.k FROM p JOIN n a ON a.k = p.k JOIN n b ON b.k = p.o WHERE x / (a.n + b.n - x) > 0.7 AND (b.n > a.n OR (b.n = a.n AND p.o < p.k))) SELECT n.k AS session_id, n.k NOT IN (SELECT k FROM f) AS kept FROM n", "sessions")
def _(s, d):
    sets = B.sessions(s, d).select("session_id", F.array_compact("predicted_files").alias("files")).filter("size(files) > 0")
    return C.jaccard_dedup(sets, "session_id", "files")


_USE = "rc AS (SELECT file, count(*) AS resolves FROM (SELECT session_id, unnest(predicted_files) AS file FROM sessions) WHERE file IS NOT NULL GROUP BY file), tc AS (SELECT file, count(*) AS touches, max(ts) AS last FROM (SELECT c.ts, unnest(actual_files_modified) AS file FROM (SELECT * FROM commits WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, commit_id DESC) = 1) c JOIN sessions USING (session_id)) WHERE file IS NOT NULL GROUP BY file)"
_AGE = f"CAST(({B.AS_OF} - last) / 86400 AS DOUBLE)"


@q("VEC07_rank_files", f"""{_PATHS.replace("SELECT repo, path, len(ws) AS dl, t.word", "SELECT repo, path, len(t.ws) AS dl, t.word")}, {_SIZED}, {_USE}, u AS (SELECT coalesce(rc.file, tc.file) AS path, resolves, round(touches / resolves, 3) AS ratio, last FROM rc FULL JOIN tc ON rc.file = tc.file)
SELECT z.file_id, round((CASE WHEN list_has_any(string_split(lower(z.path), '/'), ['tests', 'test', 'fixtures', 'migrations', '__pycache__']) THEN 0.5 ELSE 1.0 END) * (CASE WHEN regexp_matches(lower(z.path), '([.]generated[.](py|ts)|[.]lock|[.]min[.]js)$') THEN 0.3 ELSE 1.0 END)
 * (CASE WHEN coalesce(bm25, 0) > 0 THEN 1 + least(bm25, 3.0) ELSE 1.0 END) * (CASE WHEN tokens > 0 AND tokens < 200 THEN 1.2 WHEN tokens > 2000 THEN 0.8 ELSE 1.0 END)
 * greatest(0.5 + coalesce(CASE WHEN resolves >= 3 THEN ratio * CASE WHEN {_AGE} < 30 THEN 1.1 ELSE 1.0 END ELSE 0 END, 0), 0.5), 6) AS score
FROM z LEFT JOIN sc ON sc.repo = z.repo AND sc.path = z.path LEFT JOIN u ON u.path = z.path""", "files", "sessions", "commits")
def _(s, d):
    from ..operators.feedback import utility

    files = sized(s, d)
    words = files.select("repo").distinct().select("repo", F.explode(F.array(*map(F.lit, ("index", "ledger", "report")))).alias("word"))
    scored = files.join(R.path_scores(B.paths(s, d), ["repo"], "path", words), ["repo", "path"])
    u = utility(B.sessions(s, d), B.commits(s, d)).withColumn("age", (F.lit(B.AS_OF) - F.col("last_touched")) / 86400)
    ranked = R.rank_files(scored.join(u.withColumnRenamed("file", "path"), "path", "left"), "path", "tokens", "bm25", "ratio", "resolves", "age")
    return ranked.select("file_id", "score")
