"""Scalar functions, filters and scans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions import scalar as S
from . import bind as B

QUERIES: dict = {}


def q(name: str, sql: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, B.sql(sql, *names) if sql else None)
        return fn

    return keep


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@q("FN01_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", S.tokens_estimate("text").alias("tokens"))


@q("FN02_repo_tokens", "SELECT repo, CAST(sum(floor(length(content) / 4)) AS BIGINT) AS tokens, count(*) AS n_files FROM files WHERE content IS NOT NULL GROUP BY repo", "files")
def _(s, d):
    rows = table(s, d, "file_analyses").select("file_id", "repo", S.tokens_estimate("content").alias("tokens"), "recorded_at")
    return B.latest(rows, ["file_id"]).filter("tokens is not null").groupBy("repo").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_files"))


@q("FN03_search_tokens", "SELECT file_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_words FROM (SELECT file_id, [w FOR w IN regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*') IF length(w) > 1] AS t FROM files WHERE content IS NOT NULL)", "files")
def _(s, d):
    t = S.search_tokens("content")
    rows = table(s, d, "file_analyses").filter("content is not null").select("file_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_words"), "recorded_at")
    return B.latest(rows, ["file_id"]).drop("recorded_at")


@q("FN04_task_words", f"SELECT session_id, array_to_string(list_sort(list_distinct([w FOR w IN regexp_extract_all(lower(task), '[a-z0-9_]+') IF length(w) > 1 AND w NOT IN ({_STOP})])), ' ') AS words FROM sessions WHERE task IS NOT NULL", "sessions")
def _(s, d):
    return B.sessions(s, d).filter("task is not null").select("session_id", F.array_join(S.task_words("task"), " ").alias("words"))


@q("FN05_path_words", "SELECT file_id, array_to_string(list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower(path), '[/_. -]+') IF length(w) > 2])), ' ') AS words FROM files", "files")
def _(s, d):
    return B.paths(s, d).select("file_id", F.array_join(S.path_words("path"), " ").alias("words"))


@q("FN06_top_module", "SELECT repo, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS module, count(*) AS n FROM files GROUP BY ALL", "files")
def _(s, d):
    return B.paths(s, d).groupBy("repo", S.top_module("path").alias("module")).agg(F.count("*").alias("n"))


@q("FN07_module_depth", """
SELECT file_id, p[1] AS top, CASE WHEN 1 < len(p) - 1 THEN p[2] ELSE p[greatest(1, len(p) - 1)] END AS depth2, CASE WHEN 2 < len(p) - 1 THEN p[3] ELSE p[greatest(1, len(p) - 1)] END AS depth3,
  CASE WHEN len(p) >= 2 THEN p[len(p) - 1] ELSE p[1] END AS leaf FROM (SELECT file_id, [x FOR x IN string_split(path, '/') IF x <> ''] AS p FROM files)""", "files")
def _(s, d):
    return B.paths(s, d).select("file_id", S.module_at("path", 0).alias("top"), S.module_at("path", 1).alias("depth2"), S.module_at("path", 2).alias("depth3"), S.leaf_dir("path").alias("leaf"))


@q("FN08_normal_path", "SELECT commit_id, f AS raw, regexp_replace(regexp_replace(regexp_replace(replace(trim(f), chr(92), '/'), '/+', '/', 'g'), '^([.]/)+', ''), '/$', '') AS path FROM (SELECT commit_id, unnest(actual_files_modified) AS f FROM commits) WHERE f IS NOT NULL", "commits")
def _(s, d):
    rows = B.commits(s, d).select("commit_id", F.explode("actual_files_modified").alias("raw")).filter("raw is not null")
    return rows.select("commit_id", "raw", S.normal_path("raw").alias("path"))


@q("FN09_test_file", r"SELECT repo, sum(CASE WHEN regexp_matches(file, '(tests?/)|(_test\.\w+$)|(test_\w+\.\w+$)|(\.test\.\w+$)|(\.spec\.\w+$)') THEN 1 ELSE 0 END)::BIGINT AS tests, count(*) AS n FROM touched GROUP BY repo", "touched")
def _(s, d):
    return B.touched(s, d).groupBy("repo").agg(F.sum(S.is_test_file("file").cast("long")).alias("tests"), F.count("*").alias("n"))


@q("FN10_test_path", "SELECT repo, sum(CASE WHEN starts_with(p, 'tests/') OR starts_with(p, 'testing/') OR contains(p, '/test_') OR contains(p, '/tests/') OR contains(p, '/testing/') OR contains(p, 'test_') OR contains(p, '_test.py') THEN 1 ELSE 0 END)::BIGINT AS tests FROM (SELECT repo, lower(file) AS p FROM touched) GROUP BY repo", "touched")
def _(s, d):
    return B.touched(s, d).groupBy("repo").agg(F.sum(S.is_test_path("file").cast("long")).alias("tests"))


_HIST = "SELECT file, count(DISTINCT commit_id) AS commits, sum(ins + dels)::BIGINT AS lines FROM changes GROUP BY file"


def _history(s, d):
    return B.changes(s, d).groupBy("file").agg(F.countDistinct("commit_id").alias("commits"), F.sum(F.col("ins") + F.col("dels")).alias("lines"))


@q("FN11_stability", f"SELECT file, CASE WHEN lines = 0 OR lines / commits < 10 THEN 'tweaked' WHEN lines / commits > 50 OR commits > 15 THEN 'volatile' ELSE 'stable' END AS stability FROM ({_HIST})", "changes")
def _(s, d):
    return _history(s, d).select("file", S.stability("commits", "lines").alias("stability"))


@q("FN12_stability_by_count", "SELECT file, CASE WHEN n >= 20 THEN 'volatile' WHEN n >= 5 THEN 'tweaked' ELSE 'stable' END AS stability FROM (SELECT file, count(*) AS n FROM touched GROUP BY file)", "touched")
def _(s, d):
    return B.touched(s, d).groupBy("file").agg(F.count("*").alias("n")).select("file", S.stability_by_count("n").alias("stability"))


@q("FN14_severity", "SELECT constraint_id, CASE WHEN confidence >= 0.8 THEN 'nudge' WHEN confidence >= 0.5 THEN 'note' ELSE 'retired' END AS severity FROM rules WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)", "rules")
def _(s, d):
    return B.rules(s, d).filter("confidence between 0 and 1").select("constraint_id", S.severity("confidence").alias("severity"))


@q("FN15_gravity_label", "SELECT id, CASE WHEN n > 50 THEN 'CRITICAL HUB' WHEN n > 10 THEN 'HIGH' WHEN n > 3 THEN 'MODERATE' ELSE 'LOW' END AS gravity FROM (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)", "edges")
def _(s, d):
    e = B.edges(s, d)
    ends = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("n")).select("id", S.gravity_label("n").alias("gravity"))


_ROUTES = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '/api/v1/' WHEN 1 THEN '/api/' WHEN 2 THEN '/' ELSE '/v3/' END || lower(split_part(p_type, ' ', 1)) || CASE p_size % 3 WHEN 0 THEN '/{id}' WHEN 1 THEN '/<int:key>/items' ELSE '' END AS route, CASE p_size % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN 'get' ELSE 'POST' END AS method, upper(left(lower(split_part(p_type, ' ', 1)), 1)) || substr(lower(split_part(p_type, ' ', 1)), 2) || CASE WHEN p_size % 2 = 0 THEN 'ViewSet' ELSE '' END AS handler FROM part WHERE p_size <= 25"
_CALLS = "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '/api/v1/' WHEN 1 THEN '/' ELSE '/my-' END || lower(split_part(p_type, ' ', 1)) || CASE p_size % 4 WHEN 0 THEN '/' || p_size WHEN 1 THEN '/7/items' ELSE '' END AS call, CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'post' END AS method FROM part WHERE p_size > 25"


def routes(s, d):
    """Endpoints made from parts: a path with variables, a method, a handler."""
    word = F.lower(F.substring_index("p_type", " ", 1))
    k = lambda n: F.col("p_size") % n
    path = F.concat(F.when(k(4) == 0, "/api/v1/").when(k(4) == 1, "/api/").when(k(4) == 2, "/").otherwise("/v3/"), word, F.when(k(3) == 0, "/{id}").when(k(3) == 1, "/<int:key>/items").otherwise(""))
    method = F.when(k(5) == 0, "ALL").when(k(5) == 1, "get").otherwise("POST")
    return table(s, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"), path.alias("route"), method.alias("method"), F.concat(F.initcap(word), F.when(k(2) == 0, "ViewSet").otherwise("")).alias("handler"))


def calls(s, d):
    word = F.lower(F.substring_index("p_type", " ", 1))
    k = lambda n: F.col("p_size") % n
    path = F.concat(F.when(k(3) == 0, "/api/v1/").when(k(3) == 1, "/").otherwise("/my-"), word, F.when(k(4) == 0, F.concat(F.lit("/"), F.col("p_size").cast("string"))).when(k(4) == 1, "/7/items").otherwise(""))
    return table(s, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("id"), path.alias("call"), F.when(k(2) == 0, "GET").otherwise("post").alias("method"))


_RX = "'^' || regexp_replace(regexp_replace(route, '[{][^}]+[}]', '[^/]+', 'g'), '<[^>]+>', '[^/]+', 'g') || '$'"


@q("FN16_route_regex", f"SELECT id, {_RX} AS regex FROM ({_ROUTES})")
def _(s, d):
    return routes(s, d).select("id", S.route_regex("route").alias("regex"))


_SHAPES = f"r AS (SELECT route, method AS pm, handler, {_RX} AS rx, count(*) AS np FROM ({_ROUTES}) GROUP BY ALL), c AS (SELECT call, method AS cm, count(*) AS nc FROM ({_CALLS}) GROUP BY ALL)"
_TAIL = "len(string_split(rtrim(call, '/'), '/')) <= len(string_split(rtrim(route, '/'), '/')) AND string_split(rtrim(route, '/'), '/')[len(string_split(rtrim(route, '/'), '/')) - len(string_split(rtrim(call, '/'), '/')) + 1:] = string_split(rtrim(call, '/'), '/')"
_ALIGN = f"(rtrim(route, '/') = rtrim(call, '/') OR regexp_replace(rtrim(route, '/'), '^/api/v1', '') = rtrim(call, '/') OR regexp_replace(rtrim(route, '/'), '^/api/v2', '') = rtrim(call, '/') OR regexp_replace(rtrim(route, '/'), '^/api', '') = rtrim(call, '/') OR ({_TAIL}))"
_CONF = f"CASE WHEN regexp_full_match(call, rx) THEN 1.0 WHEN {_ALIGN} THEN 0.8 WHEN contains(handler, 'ViewSet') AND replace(handler, 'ViewSet', '') <> '' AND contains(regexp_replace(lower(call), '[-_]', '', 'g'), lower(replace(handler, 'ViewSet', ''))) THEN 0.5 ELSE 0.0 END"


def shape_pairs(s, d):
    """Distinct shapes of routes and calls; both sides are small lists of shapes, whose number is checked."""
    r = routes(s, d).withColumn("rx", S.route_regex("route")).groupBy("route", F.col("method").alias("pm"), "handler", "rx").agg(F.count("*").alias("np"))
    c = calls(s, d).groupBy("call", F.col("method").alias("cm")).agg(F.count("*").alias("nc"))
    return r, c


@q("FN17_methods_match", f"WITH {_SHAPES} SELECT route, call, pm, cm, (pm = 'ALL' OR cm = 'ALL' OR upper(pm) = upper(cm)) AS ok FROM r JOIN c ON split_part(route, '/', 2) = split_part(call, '/', 2)")
def _(s, d):
    r, c = shape_pairs(s, d)
    seg = lambda x: F.split(x, "/")[1]
    return r.join(c, seg(r.route) == seg(c.call)).select("route", "call", "pm", "cm", S.methods_match("pm", "cm").alias("ok"))


@q("JN04_network_edges", f"WITH {_SHAPES} SELECT route, call, pm, cm, CAST(np * nc AS BIGINT) AS n, CAST({_CONF} AS DOUBLE) AS confidence FROM r JOIN c ON (pm = 'ALL' OR cm = 'ALL' OR upper(pm) = upper(cm)) WHERE {_CONF} > 0")
def _(s, d):
    from ..operators.network import match_routes

    r, c = shape_pairs(s, d)
    out = match_routes(r, c)
    return out.select("route", "call", "pm", "cm", (F.col("np") * F.col("nc")).alias("n"), "confidence")


@q("FN20_confidence_label", f"WITH {_SHAPES} SELECT label, count(*) AS n FROM (SELECT CASE WHEN k >= 1 THEN 'exact' WHEN k >= 0.8 THEN 'suffix' ELSE 'semantic' END AS label FROM (SELECT {_CONF} AS k FROM r JOIN c ON (pm = 'ALL' OR cm = 'ALL' OR upper(pm) = upper(cm))) WHERE k > 0) GROUP BY label")
def _(s, d):
    from ..operators.network import match_routes

    return match_routes(*shape_pairs(s, d)).groupBy(S.confidence_label("confidence").alias("label")).agg(F.count("*").alias("n"))


_LINES = "SELECT file_id, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (SELECT file_id, string_split(replace(content, chr(13), ''), chr(10)) AS l FROM files WHERE path LIKE '%.py')"


def code_lines(s, d):
    rows = table(s, d, "file_analyses").filter("path like '%.py' and content is not null")
    rows = B.latest(rows.select("file_id", "content", "recorded_at"), ["file_id"])
    return rows.select("file_id", F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


@q("FN21_code_lines", rf"""SELECT file_id, CAST(no AS BIGINT) AS no, code FROM (SELECT file_id, no, CASE WHEN starts_with(ltrim(line), '#') THEN '' ELSE regexp_replace(regexp_replace(line, '"[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''', '""', 'g'), '#.*$', '') END AS code FROM ({_LINES})) WHERE trim(code) <> ''""", "files")
def _(s, d):
    return code_lines(s, d).select("file_id", F.col("no").cast("long").alias("no"), S.code_only("line").alias("code")).filter(F.trim("code") != "")


@q("FN22_sections", r"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sections FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^##[^#]') GROUP BY doc_id")
def _(s, d):
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.col("line").rlike("^##[^#]")).groupBy("doc_id").agg(F.count("*").alias("n_sections"))


_MD = """WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
g AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS sec FROM l)
SELECT doc_id, CAST(sec AS BIGINT) AS section, CASE WHEN sec = 0 THEN 'Introduction' ELSE trim(ltrim(max(CASE WHEN starts_with(line, '#') THEN line END), '#'), ' ') END AS heading, CAST(sum(CASE WHEN starts_with(line, '#') THEN 0 ELSE 1 END) AS BIGINT) AS body_lines
FROM g GROUP BY doc_id, sec HAVING sum(CASE WHEN starts_with(line, '#') THEN 0 ELSE 1 END) > 0"""


@q("FN24_markdown_sections", _MD)
def _(s, d):
    from ..operators.textops import markdown_sections

    docs = table(s, d, "documents").filter("text is not null")
    return markdown_sections(docs, "doc_id", "text")


@q("FN25_signal_comments", r"SELECT file_id, upper(regexp_extract(line, '(?i)(?:#|//)\s*(WARNING|DANGER|CRITICAL|IMPORTANT|INVARIANT|HACK|WORKAROUND|NOTE|NB|TODO|FIXME|XXX)\b', 1)) AS signal, count(*) AS n FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS line FROM files) WHERE regexp_matches(line, '(?i)(?:#|//)\s*(WARNING|DANGER|CRITICAL|IMPORTANT|INVARIANT|HACK|WORKAROUND|NOTE|NB|TODO|FIXME|XXX)\b') GROUP BY ALL", "files")
def _(s, d):
    from ..operators.textops import signal_comments

    return signal_comments(B.files(s, d), "file_id", "content").groupBy("file_id", "signal").agg(F.count("*").alias("n"))


_DOC = r"^(?:\s*#[^\n]*\n)*\s*" + '"' * 3 + "(.*?)" + '"' * 3


@q("FN26_module_docstring", f"SELECT file_id, trim(regexp_extract(replace(content, chr(13), ''), '{_DOC}', 1, 's'), ' ' || chr(10)) AS doc FROM files WHERE path LIKE '%.py' AND regexp_matches(replace(content, chr(13), ''), '{_DOC}', 's')", "files")
def _(s, d):
    rows = B.files(s, d).filter("path like '%.py'").withColumn("c", F.replace("content", F.lit("\r"), F.lit("")))
    pattern = "(?s)" + _DOC
    return rows.filter(F.col("c").rlike(pattern)).select("file_id", F.trim(F.regexp_extract("c", pattern, 1), F.lit(" \n")).alias("doc"))


@q("FN28_docstring_style", r"SELECT style, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(content, '(?m)^\s*(Args|Returns|Raises|Yields|Examples):') THEN 'google' WHEN regexp_matches(content, '(?m)^\s*:(param|type|returns?|rtype|raises)\s*') THEN 'sphinx' WHEN regexp_matches(content, '(?m)^\s*(Parameters|Returns|Raises)\s*\n\s*-{3,}') THEN 'numpy' ELSE 'other' END AS style FROM files WHERE path LIKE '%.py' AND content IS NOT NULL) GROUP BY style", "files")
def _(s, d):
    rows = table(s, d, "file_analyses").filter("path like '%.py' and content is not null").select("file_id", S.docstring_style("content").alias("style"), "recorded_at")
    return B.latest(rows, ["file_id"]).groupBy("style").agg(F.count("*").alias("n"))


@q("FN29_names", "SELECT file_id, e AS symbol, regexp_replace(regexp_replace(e, '^@+', ''), '[(].*$', '') AS bare, length(ltrim(e, '_'))::BIGINT AS n FROM (SELECT file_id, unnest(exports) AS e FROM files) WHERE e IS NOT NULL", "files")
def _(s, d):
    rows = B.files(s, d).select("file_id", F.explode("exports").alias("symbol")).filter("symbol is not null")
    return rows.select("file_id", "symbol", S.bare_decorator("symbol").alias("bare"), F.length(F.regexp_replace("symbol", "^_+", "")).cast("long").alias("n"))


@q("FN30_f_scores", "SELECT commit_id, CAST(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS DOUBLE) AS f1, CAST(CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS DOUBLE) AS f2 FROM commits WHERE precision IS NOT NULL AND recall IS NOT NULL", "commits")
def _(s, d):
    return B.commits(s, d).filter("precision is not null and recall is not null").select("commit_id", S.f_beta("precision", "recall", 1.0).alias("f1"), S.f_beta("precision", "recall", 4.0).alias("f2"))


@q("FN36_age", f"SELECT session_id, CAST(greatest(1, floor(({B.AS_OF} - ts) / 3600)) AS BIGINT) AS hours FROM sessions WHERE ts IS NOT NULL", "sessions")
def _(s, d):
    return B.sessions(s, d).filter("ts is not null").select("session_id", S.hours_ago(F.lit(B.AS_OF) - F.col("ts")).alias("hours"))


@q("FN37_short_hash", "SELECT session_id, left(sha256(array_to_string(list_sort([f FOR f IN predicted_files IF f IS NOT NULL]), '|')), 12) AS id FROM sessions WHERE predicted_files IS NOT NULL", "sessions")
def _(s, d):
    return B.sessions(s, d).filter("predicted_files is not null").select("session_id", S.short_hash(F.array_compact("predicted_files"), 12).alias("id"))


@q("FN41_common_dir", r"SELECT file_a, file_b, CASE WHEN top_a = top_b THEN top_a ELSE '' END AS top FROM (SELECT commit_id, min(file) AS file_a, max(file) AS file_b, CASE WHEN contains(min(file), '/') THEN split_part(min(file), '/', 1) ELSE '' END AS top_a, CASE WHEN contains(max(file), '/') THEN split_part(max(file), '/', 1) ELSE '' END AS top_b FROM touched GROUP BY commit_id)", "touched")
def _(s, d):
    ends = B.touched(s, d).groupBy("commit_id").agg(F.min("file").alias("file_a"), F.max("file").alias("file_b"))
    return ends.select("file_a", "file_b", F.substring_index(S.common_dir("file_a", "file_b"), "/", 1).alias("top"))


@q("FN42_mean_line", "SELECT file_id, round((length(content) - len(string_split(content, chr(10))) + 1) / len(string_split(content, chr(10))), 6) AS mean_length, (length(content) - len(string_split(content, chr(10))) + 1) / len(string_split(content, chr(10))) > 500 AS minified FROM files WHERE content IS NOT NULL", "files")
def _(s, d):
    mean = S.mean_line_length("content")
    rows = table(s, d, "file_analyses").filter("content is not null").select("file_id", F.round(mean, 6).alias("mean_length"), (mean > 500).alias("minified"), "recorded_at")
    return B.latest(rows, ["file_id"]).drop("recorded_at")


@q("FN44_remote_id", "SELECT DISTINCT repo, 'git.example/' || repo AS remote FROM sessions WHERE repo IS NOT NULL", "sessions")
def _(s, d):
    made = F.concat(F.lit("git@git.example:"), "repo", F.lit(".git"))
    return B.sessions(s, d).filter("repo is not null").select("repo", S.remote_id(made).alias("remote")).distinct()


@q("FN58_task_text", "SELECT s.session_id, CASE WHEN trim(task) <> '' THEN trim(task) ELSE 'Modify ' || array_to_string(list_sort(list_distinct([CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE 'root' END FOR f IN predicted_files IF f IS NOT NULL]))[1:3], ', ') END AS task FROM sessions s WHERE predicted_files IS NOT NULL", "sessions")
def _(s, d):
    return B.sessions(s, d).filter("predicted_files is not null").select("session_id", S.task_text("task", F.array_compact("predicted_files")).alias("task"))


@q("FN48_import_sets", "SELECT file_id, count(DISTINCT trim(i)) AS n_imports, min(trim(i)) AS first_import FROM (SELECT file_id, unnest(imports) AS i FROM files) WHERE i IS NOT NULL GROUP BY file_id", "files")
def _(s, d):
    rows = B.files(s, d).select("file_id", F.explode("imports").alias("i")).filter("i is not null").select("file_id", F.trim("i").alias("i"))
    return rows.groupBy("file_id").agg(F.countDistinct("i").alias("n_imports"), F.min("i").alias("first_import"))


@q("FN56_public_names", "SELECT file_id, CAST(len([e FOR e IN exports IF e IS NOT NULL AND NOT starts_with(e, '_')]) AS BIGINT) AS n_public FROM files WHERE exports IS NOT NULL", "files")
def _(s, d):
    return B.files(s, d).filter("exports is not null").select("file_id", F.size(F.filter("exports", lambda e: e.isNotNull() & ~e.startswith("_"))).cast("long").alias("n_public"))


@q("FN63_import_modules", r"SELECT m AS module, count(*) AS n FROM (SELECT regexp_extract(i, '^(?:from|import)\s+([\w.]+)', 1) AS m FROM (SELECT unnest(imports) AS i FROM files WHERE path LIKE '%.py')) WHERE m <> '' GROUP BY m", "files")
def _(s, d):
    rows = B.files(s, d).filter("path like '%.py'").select(F.explode("imports").alias("i"))
    return rows.select(F.regexp_extract("i", r"^(?:from|import)\s+([\w.]+)", 1).alias("module")).filter("module <> ''").groupBy("module").agg(F.count("*").alias("n"))


@q("FLT05_commit_size", "SELECT commit_id, count(*) AS n FROM touched GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 20 AND NOT bool_and(regexp_matches(file, '(tests?/)|(_test[.]\\w+$)|(test_\\w+[.]\\w+$)'))", "touched")
def _(s, d):
    out = B.touched(s, d).groupBy("commit_id").agg(F.count("*").alias("n"), F.every(S.is_test_file("file")).alias("all_tests"))
    return out.filter("n between 2 and 20 and not all_tests").select("commit_id", "n")


@q("FLT01_excludes", "SELECT file_id FROM files WHERE NOT (starts_with(path, 'vendor/') OR contains('/' || path, '/generated/') OR path LIKE '%.min.js' OR regexp_matches(split_part(path, '/', -1), '^index_.*[.]ts$'))", "files")
def _(s, d):
    from ..operators.globs import exclude_paths

    return exclude_paths(B.paths(s, d), "path", ["vendor/", "**/generated/*", "*.min.js", "index_*.ts"]).select("file_id")


@q("FLT02_includes", "SELECT file_id, min(ord) AS ord FROM (SELECT file_id, 0 AS ord FROM files WHERE starts_with(path, 'src/auth/') UNION ALL SELECT file_id, 1 FROM files WHERE path LIKE '%.go' UNION ALL SELECT file_id, 2 FROM files WHERE starts_with(path, 'lib/')) GROUP BY file_id", "files")
def _(s, d):
    from ..operators.globs import include_paths

    return include_paths(B.paths(s, d), ["file_id"], "path", ["src/auth/", "*.go", "lib"])


@q("FLT04_in_scope", "SELECT module, sum(CASE WHEN starts_with(path, module || '/') THEN 1 ELSE 0 END)::BIGINT AS inside, sum(CASE WHEN starts_with(path, module) THEN 1 ELSE 0 END)::BIGINT AS by_prefix FROM files, (VALUES ('src'), ('vendor'), ('app')) AS m(module) GROUP BY module", "files")
def _(s, d):
    p = B.paths(s, d)
    modules = ["src", "vendor", "app"]
    long = p.select("path", F.explode(F.array(*map(F.lit, modules))).alias("module"))
    inside = F.startswith("path", F.concat("module", F.lit("/"))).cast("long")
    return long.groupBy("module").agg(F.sum(inside).alias("inside"), F.sum(F.startswith("path", F.col("module")).cast("long")).alias("by_prefix"))


@q("FLT06_convention_match", r"SELECT file_id FROM files WHERE regexp_matches(path, '(_|/)index') OR (len([i FOR i IN imports IF regexp_matches(i, 'HashMap')]) > 0 AND path LIKE '%.rs')", "files")
def _(s, d):
    from ..operators.conventions import matches_convention

    rule = {"any_of": [{"file_path": "(_|/)index"}, {"all_of": [{"imports": "HashMap"}, {"file_path": r"\.rs$"}]}]}
    return B.files(s, d).filter(matches_convention(rule)).select("file_id")


@q("SRC02_source_files", "SELECT file_id, path, CASE split_part(path, '.', -1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS lang FROM files WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', 'vendor', 'build'])", "files")
def _(s, d):
    from ..sources.repo import source_files

    return source_files(B.paths(s, d)).select("file_id", "path", "lang")


_DIFF = "WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS p FROM documents WHERE text IS NOT NULL)), h AS (SELECT *, last_value(CASE WHEN starts_with(line, '@@ ') THEN split_part(split_part(line, ' ', 2), ':', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no) AS file FROM l)"


@q("SRC11_diff_lines", _DIFF + " SELECT doc_id, file, count(*) AS n_lines FROM h WHERE file IS NOT NULL AND NOT starts_with(line, '@@ ') GROUP BY ALL")
def _(s, d):
    from ..sources.repo import under_headers

    docs = table(s, d, "documents").filter("text is not null")
    lines = under_headers(docs, "doc_id", "text", r"^@@ ([^: ]+)")
    return lines.groupBy("doc_id", F.col("header").alias("file")).agg(F.count("*").alias("n_lines"))


@q("SRC12_diff_files", "SELECT DISTINCT doc_id, f AS file FROM (SELECT doc_id, unnest(regexp_extract_all(text, '@@ ([^: ]+)', 1)) AS f FROM documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("@@ ([^: ]+)"), F.lit(1))).alias("file")).distinct()


@q("SRC13_grep", "SELECT file_id, count(*) AS hits, min(left(trim(line), 200)) AS snippet FROM (SELECT file_id, unnest(string_split(replace(content, chr(13), ''), chr(10))) AS line FROM files) WHERE regexp_matches(line, '(?i)invoice.*map') GROUP BY file_id ORDER BY hits DESC, file_id LIMIT 15", "files")
def _(s, d):
    lines = B.files(s, d).select("file_id", F.explode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("line")).filter(F.col("line").rlike("(?i)invoice.*map"))
    out = lines.groupBy("file_id").agg(F.count("*").alias("hits"), F.min(F.substring(F.trim("line"), 1, 200)).alias("snippet"))
    return out.orderBy(F.desc("hits"), "file_id").limit(15)
