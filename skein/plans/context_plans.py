"""Context, chunks, sinks and composed pipelines over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import checkpointed, table
from ..functions import scalar as S
from ..operators import chunks as Y
from ..operators import context as X
from ..operators import feedback as L
from ..operators import graph as G
from ..operators import history as H
from ..operators import merging as M
from ..operators import retrieval as R
from ..operators import scopes as C
from ..sources import sinks as K
from . import bind as B
from . import feedback_plans as FP
from . import history_plans as HP
from . import scalar_plans as Z
from . import search_plans as P

QUERIES: dict = {}


def q(name: str, sql: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, B.sql(sql, *names) if sql else None)
        return fn

    return keep


_CF = "cf AS (SELECT DISTINCT commit_id, repo || ':' || file AS file FROM touched), n AS (SELECT file, count(*) AS n FROM cf GROUP BY file)"


def obs(s, d):
    return B.touched(s, d).select("commit_id", F.concat("repo", F.lit(":"), "file").alias("file")).distinct()


@q("JN02_pair_counts", f"WITH {_CF}, a AS (SELECT cf.* FROM cf JOIN n USING (file) WHERE n >= 3) SELECT x.file AS file_a, y.file AS file_b, count(*) AS n_ab FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY ALL", "touched")
def _(s, d):
    return H.pair_counts(H.active(obs(s, d), 3))


@q("JN24_expand_hits", f"WITH {_CF}, h AS (SELECT repo AS query, repo || ':' || file AS hit, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, file) AS rank FROM touched GROUP BY repo, file QUALIFY rank <= 3), e AS (SELECT x.file AS hit, y.file, count(*) AS weight, 0 AS source FROM cf x JOIN cf y ON x.commit_id = y.commit_id AND x.file <> y.file WHERE x.file IN (SELECT hit FROM h) GROUP BY ALL HAVING count(*) >= 2), f AS (SELECT query, hit, file, source, rank, weight FROM h JOIN e USING (hit) WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.query = h.query AND z.hit = e.file)), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query, file ORDER BY rank, source, weight DESC, file) = 1) SELECT query, hit, file, source FROM o QUALIFY row_number() OVER (PARTITION BY query, hit ORDER BY rank, source, weight DESC, file) <= 8", "touched")
def _(s, d):
    t = B.touched(s, d).select("commit_id", F.col("repo").alias("query"), F.concat("repo", F.lit(":"), "file").alias("hit"), "file")
    counts = t.groupBy("query", "hit", "file").agg(F.count("*").alias("n"))
    hits = counts.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "file"))).filter("rank <= 3").select("query", "hit", "rank")
    top = t.join(hits.select("hit"), "hit", "left_semi").select("commit_id", "hit")
    near = top.join(obs(s, d), "commit_id").filter("hit <> file").groupBy("hit", "file").agg(F.count("*").alias("weight")).filter("weight >= 2")
    return X.expand_hits(hits, [near])


@q("JN25_flatten_calls", r"WITH c AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, '([A-Za-z_]\w*)\(', 1)) AS name FROM files WHERE path LIKE '%.ts' OR path LIKE '%.js'), e AS (SELECT DISTINCT repo, path AS target, unnest(exports) AS name FROM files) SELECT repo, path, name, target FROM c JOIN e USING (repo, name) WHERE path <> target QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY name, target) <= 3", "files")
def _(s, d):
    f = B.files(s, d)
    calls = f.filter("path like '%.ts' or path like '%.js'").select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)\("), F.lit(1)))).alias("name"))
    exports = f.select("repo", "path", F.explode(F.array_distinct("exports")).alias("name"))
    return X.flatten_calls(calls, exports, "repo")


@q("JN35_semantic_diff", "WITH a AS (SELECT DISTINCT repo, f AS file, 'x' AS t FROM (SELECT repo, unnest(predicted_files) AS f FROM sessions WHERE ts < 1750000000) WHERE f IS NOT NULL AND repo IS NOT NULL), b AS (SELECT DISTINCT repo, f AS file, 'x' AS t FROM (SELECT repo, unnest(predicted_files) AS f FROM sessions WHERE ts >= 1750000000) WHERE f IS NOT NULL AND repo IS NOT NULL) SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'ADD' ELSE 'REMOVE' END AS change FROM a FULL JOIN b ON a.repo = b.repo AND a.file = b.file WHERE a.file IS NULL OR b.file IS NULL", "sessions")
def _(s, d):
    side = lambda w: B.sessions(s, d).filter(w).select("repo", F.explode("predicted_files").alias("file")).dropna().distinct().withColumn("t", F.lit("x"))
    return M.entity_diff(side("ts < 1750000000"), side("ts >= 1750000000"), ["repo", "file"], "t")


@q("JN38_preflight", f"WITH {_CF}, a AS (SELECT cf.* FROM cf JOIN n USING (file) WHERE n >= 5), p AS (SELECT x.file, y.file AS partner FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file <> y.file JOIN n ON n.file = x.file GROUP BY x.file, y.file, n.n HAVING count(*) >= 3 AND round(count(*) / n.n, 3) >= 0.5 AND count(*) / n.n >= 0.5), c AS (SELECT commit_id AS claim, commit_id AS agent, file FROM cf), m AS (SELECT DISTINCT c.claim, p.partner AS file FROM c JOIN p USING (file) WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.claim = c.claim AND z.file = p.partner)), k AS (SELECT claim, count(*) AS n_partners FROM m GROUP BY claim) SELECT x.claim, coalesce(n_partners, 0) AS n_partners, 0::BIGINT AS n_locks, CASE WHEN coalesce(n_partners, 0) >= 4 THEN 'high' WHEN coalesce(n_partners, 0) >= 1 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT DISTINCT claim FROM c) x LEFT JOIN k USING (claim)", "touched")
def _(s, d):
    rows = obs(s, d)
    strong = H.contracts(rows, threshold=0.5, top=None).select(F.col("trigger").alias("file"), F.col("coupled").alias("partner"))
    claims = rows.select(F.col("commit_id").alias("claim"), F.col("commit_id").alias("agent"), "file")
    return X.preflight(claims, strong, rows.limit(0).select("file", F.col("commit_id").alias("holder")))


_CLAIMS = """{0}, w AS (SELECT file_a AS file, file_b AS partner FROM u WHERE npmi >= 0.5 UNION ALL SELECT file_b, file_a FROM u WHERE npmi >= 0.5),
c AS (SELECT commit_id AS claim, repo || ':' || file AS file, file AS path, ts FROM touched),
m AS (SELECT DISTINCT claim, partner AS file FROM c JOIN w USING (file) WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.claim = c.claim AND z.file = w.partner)), k AS (SELECT claim, count(*) AS n_partners FROM m GROUP BY claim),
g AS (SELECT claim, count(*) AS n_consumers FROM (SELECT DISTINCT claim, c.file, consumer_file FROM c JOIN links ON provider_file = c.file) GROUP BY claim),
e AS (SELECT replace(unnest(list_concat(coalesce(exclusive_files, []), coalesce(shared_files, []))), chr(92), '/') AS path, created_at, expires_at FROM locks),
h AS (SELECT claim, count(DISTINCT c.file) AS n_locks FROM c JOIN e ON e.path = c.path AND c.ts >= created_at AND c.ts < expires_at GROUP BY claim),
x AS (SELECT claim, coalesce(n_partners, 0) AS n_partners, coalesce(n_consumers, 0) AS n_consumers, coalesce(n_locks, 0) AS n_locks FROM (SELECT DISTINCT claim FROM c) LEFT JOIN k USING (claim) LEFT JOIN g USING (claim) LEFT JOIN h USING (claim))
SELECT *, CASE WHEN n_locks > 0 OR n_partners + n_consumers + n_locks >= 4 THEN 'high' WHEN n_partners + n_consumers + n_locks >= 1 THEN 'medium' ELSE 'low' END AS risk FROM x"""


@q("JN38_preflight_locks", _CLAIMS.format(HP._NPMI), "touched", "locks", "links")
def _(s, d):
    made = B.touched(s, d).select("commit_id", F.concat("repo", F.lit(":"), "file").alias("name"), F.col("file").alias("path"), "ts")
    # Files as numbers, given once: the pairs and claims below would else carry long names through every shuffle.
    made = checkpointed(made)
    ids = checkpointed(made.select("name").distinct().withColumn("file", F.monotonically_increasing_id()))
    made = checkpointed(made.join(ids, "name").select("commit_id", "file", "path", "ts"))
    strong = H.npmi(made.select("commit_id", "file")).filter("npmi >= 0.5").select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"))
    # A commit names no agent, so that every holder is another one.
    claims = made.select(F.col("commit_id").alias("claim"), F.col("commit_id").alias("agent"), "file")
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("exclusive_files", "shared_files")])
    held = B.locks(s, d).select(F.col("agent").alias("holder"), "created_at", "expires_at", F.explode(every).alias("path")).withColumn("path", F.translate("path", "\\", "/"))
    alive = made.join(held, "path").filter("ts >= created_at and ts < expires_at").select(F.col("commit_id").alias("claim"), "file", "holder").distinct()
    consumers = B.links(s, d).select(F.col("provider_file").alias("name"), "consumer").join(ids, "name").select("file", "consumer")
    return X.preflight(claims, strong, alive, consumers)


@q("JN19_colocation", "WITH u AS (SELECT dst AS id, count(DISTINCT a.module) AS n, min(a.module) AS first, list(DISTINCT a.module) AS al FROM edges JOIN nodes a ON a.id = src GROUP BY dst) SELECT u.id, module, CASE WHEN n = 1 THEN 'orphan' ELSE 'shared' END AS rule, CASE WHEN n = 1 THEN first END AS target FROM u JOIN nodes USING (id) WHERE NOT list_contains(al, module)", "edges", "nodes")
def _(s, d):
    return X.colocation(B.edges(s, d), B.nodes(s, d))


@q("JN20_bare_excepts", r"SELECT file_id, count(*) AS n FROM (SELECT file_id, unnest(string_split(replace(content, chr(13), ''), chr(10))) AS l FROM files WHERE path LIKE '%.py') WHERE regexp_matches(l, '^\s*except(\s+\w+)?\s*:') GROUP BY file_id", "files")
def _(s, d):
    lines = B.files(s, d).filter("path like '%.py'").select("file_id", F.explode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("l"))
    return lines.filter(F.col("l").rlike(r"^\s*except(\s+\w+)?\s*:")).groupBy("file_id").agg(F.count("*").alias("n"))


@q("JN39_action_hints", f"WITH {_CF}, t AS (SELECT repo, file, count(*) AS n FROM touched GROUP BY ALL), h AS (SELECT repo, 1 AS priority, file AS hint FROM t WHERE n >= 10 UNION ALL SELECT repo, 2, file FROM t WHERE n BETWEEN 5 AND 9 UNION ALL SELECT repo, 3, file FROM (SELECT DISTINCT repo, unnest(touched_not_predicted) AS file FROM commits WHERE repo IS NOT NULL) WHERE file IS NOT NULL), o AS (SELECT repo, hint, min(priority) AS priority FROM h GROUP BY ALL) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY repo ORDER BY priority, hint) <= 20", "touched")
def _(s, d):
    t = B.touched(s, d).groupBy("repo", "file").agg(F.count("*").alias("n"))
    row = lambda df, p: df.select("repo", F.lit(p).alias("priority"), F.col("file").alias("hint"))
    gaps = B.commits(s, d).filter("repo is not null").select("repo", F.explode("touched_not_predicted").alias("file")).filter("file is not null").distinct()
    h = row(t.filter("n >= 10"), 1).unionByName(row(t.filter("n between 5 and 9"), 2)).unionByName(row(gaps, 3))
    o = h.groupBy("repo", "hint").agg(F.min("priority").alias("priority"))
    return H.recent_by_module(o, "repo", [F.col("priority"), F.col("hint")], 20).select("repo", "hint", "priority")


@q("JN41_counterfactuals", f"WITH {_CF}, a AS (SELECT cf.* FROM cf JOIN n USING (file) WHERE n >= 5) SELECT x.commit_id, x.file AS trigger, y.file AS coupled FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file <> y.file JOIN (SELECT x.file AS f, y.file AS g FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file <> y.file JOIN n ON n.file = x.file GROUP BY x.file, y.file, n.n HAVING count(*) >= 3 AND count(*) / n.n >= 0.5) c ON c.f = x.file AND c.g = y.file", "touched")
def _(s, d):
    rows = obs(s, d)
    strong = H.contracts(rows, threshold=0.5, top=None)
    served = rows.select("commit_id", F.col("file").alias("trigger")).join(strong.select("trigger", "coupled"), "trigger")
    return X.counterfactuals(rows, strong, served).select("commit_id", "trigger", "coupled")


@q("JN42_adjacent_routing", "WITH m AS (SELECT a.module AS scope, b.module AS neighbour, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.module <> b.module GROUP BY ALL) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC, neighbour) <= 5", "edges", "nodes")
def _(s, d):
    m = G.module_edges(B.edges(s, d), B.nodes(s, d)).filter("src_module <> dst_module").select(F.col("src_module").alias("scope"), F.col("dst_module").alias("neighbour"), "n")
    return H.recent_by_module(m, "scope", [F.desc("n"), F.col("neighbour")]).select("scope", "neighbour", "n")


@q("JN43_import_drift", "WITH m AS (SELECT DISTINCT a.module AS scope, b.module AS dep FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.module <> b.module) SELECT scope, dep FROM m WHERE NOT EXISTS (SELECT 1 FROM m z WHERE z.scope = m.dep AND z.dep = m.scope)", "edges", "nodes")
def _(s, d):
    m = G.module_edges(B.edges(s, d), B.nodes(s, d)).filter("src_module <> dst_module").select(F.col("src_module").alias("scope"), F.col("dst_module").alias("dep"))
    return m.join(m.select(F.col("dep").alias("scope"), F.col("scope").alias("dep")), ["scope", "dep"], "left_anti")


@q("JN52_import_names", r"SELECT file_id, trim(n) AS name FROM (SELECT file_id, unnest(string_split(regexp_extract(i, '^from\s+\S+\s+import\s+(.*)$', 1), ',')) AS n FROM (SELECT file_id, unnest(imports) AS i FROM files WHERE path LIKE '%.py') WHERE regexp_matches(i, '^from\s')) WHERE trim(n) <> '' AND NOT regexp_matches(n, '\bas\b')", "files")
def _(s, d):
    from ..operators.structure import import_names

    f = B.files(s, d).filter("path like '%.py'").withColumn("imports", F.filter("imports", lambda i: i.rlike(r"^from\s")))
    return import_names(f, ["file_id"], "imports").select("file_id", "name")


@q("AGG11_hub_discoveries", "WITH RECURSIVE r(root, node) AS (SELECT dst, src FROM edges UNION SELECT r.root, e.src FROM r JOIN edges e ON e.dst = r.node), b AS (SELECT root, count(*) AS blast FROM r GROUP BY root), h AS (SELECT dst AS id, count(*) AS importers, count(DISTINCT a.module) AS modules FROM edges JOIN nodes a ON a.id = src GROUP BY dst HAVING count(*) >= 3 AND count(DISTINCT a.module) >= 2) SELECT id, importers, modules, blast + 1 AS blast FROM h JOIN b ON root = id", "edges", "nodes")
def _(s, d):
    e, n = B.edges(s, d), B.nodes(s, d)
    hubs = G.hubs(e, n, skip=())
    blast = G.reach_counts(G.reversed_edges(e), hubs.select("id")).select(F.col("root").alias("id"), (F.col("n") + 1).alias("blast"))
    return hubs.join(blast, "id").select("id", "importers", "modules", "blast")


@q("AGG37_docstring_share", "SELECT repo, count(*) AS files, count(*) FILTER (docstring IS NOT NULL) AS documented, round(count(*) FILTER (docstring IS NOT NULL) / count(*), 6) AS share, CASE WHEN count(*) FILTER (docstring IS NOT NULL) / count(*) > 0.4 THEN 'match' ELSE 'minimal' END AS rule FROM files WHERE path LIKE '%.py' GROUP BY repo", "files")
def _(s, d):
    f = B.files(s, d).filter("path like '%.py'").groupBy("repo").agg(F.count("*").alias("files"), F.count("docstring").alias("documented"))
    share = F.col("documented") / F.col("files")
    return f.select("repo", "files", "documented", F.round(share, 6).alias("share"), F.when(share > 0.4, "match").otherwise("minimal").alias("rule"))


@q("AGG51_endpoint_calls", f"WITH {Z._SHAPES} SELECT handler, CAST(sum(np * nc) AS BIGINT) AS n, CAST(max(k) AS DOUBLE) AS confidence FROM (SELECT handler, np, nc, {Z._CONF} AS k FROM r JOIN c ON (pm = 'ALL' OR cm = 'ALL' OR upper(pm) = upper(cm))) WHERE k > 0 GROUP BY handler")
def _(s, d):
    from ..operators.network import match_routes

    return match_routes(*Z.shape_pairs(s, d)).groupBy("handler").agg(F.sum(F.col("np") * F.col("nc")).alias("n"), F.max("confidence").alias("confidence"))


@q("AGG53_scope_confidence", "WITH z AS (SELECT module, count(*) AS n_files FROM nodes GROUP BY module), k AS (SELECT a.module, sum(CASE WHEN a.module = b.module THEN 1 ELSE 0 END) AS i, count(*) AS t FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY a.module) SELECT module, round(least(coalesce(i / t, 1.0) + 0.1 * least(n_files - 1, 1) + 0.1, 1.0), 6) AS confidence FROM z LEFT JOIN k USING (module)", "edges", "nodes")
def _(s, d):
    n = B.nodes(s, d)
    m = G.module_edges(B.edges(s, d), n).groupBy(F.col("src_module").alias("module")).agg(F.sum(F.when(F.col("src_module") == F.col("dst_module"), F.col("n")).otherwise(0)).alias("i"), F.sum("n").alias("t"))
    out = n.groupBy("module").agg(F.count("*").alias("k")).join(m, "module", "left")
    return out.select("module", F.round(F.least(F.coalesce(F.col("i") / F.col("t"), F.lit(1.0)) + 0.1 * F.least(F.col("k") - 1, F.lit(1)) + 0.1, F.lit(1.0)), 6).alias("confidence"))


@q("AGG55_stability_sections", f"WITH h AS (SELECT repo, file, count(*) AS n, ({B.AS_OF} - max(ts)) / 86400 AS age FROM touched GROUP BY ALL) SELECT repo, file, CASE WHEN age < 90 AND n > 5 THEN 'volatile' WHEN n < 5 AND age < 90 THEN 'destabilized' WHEN age > 180 THEN 'stable' ELSE 'settling' END AS section FROM h WHERE age IS NOT NULL", "touched")
def _(s, d):
    h = B.touched(s, d).groupBy("repo", "file").agg(F.count("*").alias("n"), ((F.lit(B.AS_OF) - F.max("ts")) / 86400).alias("age")).filter("age is not null")
    section = F.when((F.col("age") < 90) & (F.col("n") > 5), "volatile").when((F.col("n") < 5) & (F.col("age") < 90), "destabilized").when(F.col("age") > 180, "stable").otherwise("settling")
    return h.select("repo", "file", section.alias("section"))


@q("WIN09_chunks", None)
def _(s, d):
    return Y.chunk_files(B.files(s, d), "file_id", "path", "content")


@q("WIN11_chunk_order", "SELECT file_id FROM (SELECT file_id, CASE WHEN regexp_matches(path, 'test') THEN 2 WHEN regexp_matches(path, '(config|settings)') THEN 1 ELSE 0 END AS p, path FROM files) ORDER BY p, path, file_id LIMIT 200", "files")
def _(s, d):
    p = F.when(F.col("path").rlike("test"), 2).when(F.col("path").rlike("(config|settings)"), 1).otherwise(0)
    return B.paths(s, d).orderBy(p, "path", "file_id").limit(200).select("file_id")


@q("WIN12_recent_mean", "SELECT repo, round(avg(recall), 6) AS recent FROM (SELECT repo, recall, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, commit_id) AS k FROM commits WHERE repo IS NOT NULL AND recall IS NOT NULL) WHERE k <= 5 GROUP BY repo", "commits")
def _(s, d):
    rows = B.commits(s, d).filter("repo is not null and recall is not null")
    return H.recent_by_module(rows, "repo", [F.desc("ts"), F.col("commit_id")]).groupBy("repo").agg(F.round(F.avg("recall"), 6).alias("recent"))


@q("WIN15_neighbours", "SELECT lock_id, created_at - p AS wait FROM (SELECT lock_id, created_at, lag(created_at) OVER (PARTITION BY agent ORDER BY created_at, lock_id) AS p FROM (SELECT DISTINCT lock_id, agent, created_at FROM locks)) WHERE p IS NOT NULL", "locks")
def _(s, d):
    rows = B.locks(s, d).select("lock_id", "agent", "created_at").distinct()
    before = F.lag("created_at").over(Window.partitionBy("agent").orderBy("created_at", "lock_id"))
    return rows.withColumn("p", before).filter("p is not null").select("lock_id", (F.col("created_at") - F.col("p")).alias("wait"))


@q("TOP04_rank", "SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY floor(length(content) / 4) DESC, path) AS k FROM files WHERE content IS NOT NULL) WHERE k <= 12", "files")
def _(s, d):
    return H.recent_by_module(P.sized(s, d), "repo", [F.desc("tokens"), F.col("path")], 12).select("repo", "path")


_HINTS = r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, last_value(CASE WHEN starts_with(line, '#') THEN lower(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no) AS head FROM l),
s AS (SELECT doc_id, no, line, CASE WHEN head IS NULL THEN CASE WHEN contains(lower(line), 'co-change') OR contains(lower(line), 'commits') THEN 'git_history' WHEN regexp_matches(lower(line), 'invariant:|hack:|warning:|note:') THEN 'signal_comment' ELSE 'hand_authored' END WHEN regexp_matches(head, 'history|contract|stability') THEN 'git_history' WHEN regexp_matches(head, 'docstring|readme') THEN 'docstring' WHEN regexp_matches(head, 'signal|comment') THEN 'signal_comment' ELSE 'hand_authored' END AS source FROM h
  WHERE regexp_matches(line, '(?i)\b(never|always|must|warning|invariant|important|do not|don''t|avoid|careful)\b') AND NOT starts_with(line, '#') AND length(trim(line)) > 15)
SELECT doc_id, CAST(no AS BIGINT) AS no, source, trim(line) AS hint FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE source WHEN 'git_history' THEN 0 WHEN 'signal_comment' THEN 1 WHEN 'hand_authored' THEN 2 ELSE 3 END, no) <= 3"""


@q("TOP08_hints", _HINTS)
def _(s, d):
    return X.hint_lines(table(s, d, "documents").filter("text is not null"), "doc_id", "text")


@q("TOP11_learned_routing", "SELECT scope_dir, file, n FROM (SELECT scope_dir, file, count(*) AS n FROM rules WHERE scope_dir IS NOT NULL AND file IS NOT NULL AND category = 'routing' GROUP BY ALL HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY scope_dir ORDER BY n DESC, file) <= 3", "rules")
def _(s, d):
    r = B.rules(s, d).filter("scope_dir is not null and file is not null and category = 'routing'").groupBy("scope_dir", "file").agg(F.count("*").alias("n")).filter("n >= 2")
    return H.recent_by_module(r, "scope_dir", [F.desc("n"), F.col("file")], 3).drop("rank")


@q("FLT03_covers", "SELECT file_id FROM files WHERE starts_with(path, 'src/auth/') OR path = 'src/auth' OR regexp_full_match(path, '.*[.]go')", "files")
def _(s, d):
    from ..operators.globs import include_paths

    return include_paths(B.paths(s, d), ["file_id"], "path", ["src/auth/", "*.go"]).select("file_id")


@q("FLT07_live_contracts", f"WITH {_CF}, a AS (SELECT cf.* FROM cf JOIN n USING (file) WHERE n >= 5), c AS (SELECT x.file AS trigger, y.file AS coupled FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file <> y.file JOIN n ON n.file = x.file GROUP BY x.file, y.file, n.n HAVING count(*) >= 3 AND count(*) / n.n >= 0.4), k AS (SELECT DISTINCT repo || ':' || path AS file FROM files) SELECT trigger, coupled FROM c WHERE trigger IN (SELECT file FROM k) AND coupled IN (SELECT file FROM k)", "touched", "files")
def _(s, d):
    c = H.contracts(obs(s, d), threshold=0.4, top=None)
    k = B.paths(s, d).select(F.concat("repo", F.lit(":"), "path").alias("file")).distinct()
    return c.join(k.withColumnRenamed("file", "trigger"), "trigger", "left_semi").join(k.withColumnRenamed("file", "coupled"), "coupled", "left_semi").select("trigger", "coupled")


@q("FLT08_surprises", "WITH h AS (SELECT repo, file, count(*) AS n FROM touched GROUP BY ALL) SELECT repo, file, n FROM h WHERE n >= 10 AND regexp_matches(file, '(^|/)(config|configs|settings|constants|migrations|fixtures|static)/') UNION SELECT repo, file, n FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, file) = 1) WHERE n >= 10", "touched")
def _(s, d):
    h = B.touched(s, d).groupBy("repo", "file").agg(F.count("*").alias("n"))
    quiet = h.filter((F.col("n") >= 10) & F.col("file").rlike("(^|/)(config|configs|settings|constants|migrations|fixtures|static)/"))
    top = H.recent_by_module(h, "repo", [F.desc("n"), F.col("file")], 1).drop("rank").filter("n >= 10")
    return quiet.unionByName(top).distinct()


@q("FLT13_artifacts", "SELECT doc_kind, count(*) AS n FROM documents WHERE doc_kind IN ('readme', 'design_note') GROUP BY doc_kind")
def _(s, d):
    return table(s, d, "documents").filter(F.col("doc_kind").isin("readme", "design_note")).groupBy("doc_kind").agg(F.count("*").alias("n"))


@q("FN31_composite", "SELECT repo, round(0.5 * avg(CASE WHEN 4 * precision + recall > 0 THEN 5 * recall * precision / (4 * precision + recall) ELSE 0 END) + 0.25 + 0.15 + 0.1, 6) AS composite FROM commits WHERE repo IS NOT NULL AND recall IS NOT NULL AND precision IS NOT NULL GROUP BY repo", "commits")
def _(s, d):
    rows = B.commits(s, d).filter("repo is not null and recall is not null and precision is not null")
    return rows.groupBy("repo").agg(F.round(0.5 * F.avg(S.f_beta("precision", "recall", 4.0)) + 0.25 + 0.15 + 0.1, 6).alias("composite"))


@q("FN57_shape", "SELECT constraint_id, array_to_string(list_sort(map_keys(metadata)), ',') AS keys, len(map_keys(metadata))::BIGINT AS n FROM scope_constraints WHERE metadata IS NOT NULL AND constraint_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY constraint_id ORDER BY recorded_at DESC) = 1")
def _(s, d):
    keys = F.array_sort(F.map_keys("metadata"))
    rows = table(s, d, "scope_constraints").filter("metadata is not null").select("constraint_id", F.array_join(keys, ",").alias("keys"), F.size(keys).cast("long").alias("n"), "recorded_at")
    return B.latest(rows, ["constraint_id"]).drop("recorded_at")


@q("FN59_cluster_names", "SELECT file_id, CASE WHEN stem IN ('__init__', 'index') THEN parent ELSE stem || '_lifecycle' END AS name FROM (SELECT file_id, regexp_replace(split_part(path, '/', -1), '[.][^.]*$', '') AS stem, coalesce(string_split(path, '/')[-2], '') AS parent FROM files)", "files")
def _(s, d):
    parent = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    return B.paths(s, d).select("file_id", F.when(S.stem("path").isin("__init__", "index"), parent).otherwise(F.concat(S.stem("path"), F.lit("_lifecycle"))).alias("name"))


@q("FN60_first_definition", r"SELECT file_id, regexp_extract(content, '(?m)^(?:class|def|async def) +(\w+)', 1) AS name FROM files WHERE path LIKE '%.py' AND regexp_matches(content, '(?m)^(?:class|def|async def) +(\w+)')", "files")
def _(s, d):
    pattern = r"(?m)^(?:class|def|async def) +(\w+)"
    return B.files(s, d).filter(F.col("path").like("%.py") & F.col("content").rlike(pattern)).select("file_id", F.regexp_extract("content", pattern, 1).alias("name"))


@q("SNK08_json", "SELECT repo, n, '{\"repo\":\"' || repo || '\",\"n\":' || n || '}' AS value FROM (SELECT repo, count(*) AS n FROM files GROUP BY repo)", "files")
def _(s, d):
    rows = B.paths(s, d).groupBy("repo").agg(F.count("*").alias("n"))
    return rows.select("repo", "n", F.to_json(F.struct("repo", "n")).alias("value"))


@q("SNK11_payload", "SELECT 'node' AS kind, a, NULL::BIGINT AS b FROM (SELECT src AS a FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT 'edge', src, dst FROM edges", "edges")
def _(s, d):
    return K.graph_payload(B.edges(s, d))


@q("SNK01_versions", "SELECT repo, count(*) AS n FROM commits WHERE repo IS NOT NULL GROUP BY repo", "commits")
def _(s, d):
    from ..common import scratch_path

    root = scratch_path(s, "versions")
    K.write_version(B.commits(s, d).filter("repo is not null").select("repo").limit(0).groupBy("repo").agg(F.count("*").alias("n")), root)
    K.write_version(B.commits(s, d).filter("repo is not null").groupBy("repo").agg(F.count("*").alias("n")), root)
    return K.read_version(s, root)


@q("SNK13_upsert", "SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE o_orderstatus END AS v FROM orders")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    urgent = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    return K.upsert(o, urgent, ["k"])


_VIRTUAL = f"""WITH c AS (SELECT * FROM ({HP.QUERIES["AGG12_clusters"][1]}) WHERE cohesion >= 0.02), m AS (SELECT DISTINCT hub, src AS i FROM c JOIN edges ON dst = hub), n AS (SELECT hub, count(*) AS n FROM m GROUP BY hub),
p AS (SELECT a.hub, b.hub AS o, count(*) AS x FROM m a JOIN m b ON a.i = b.i AND a.hub <> b.hub GROUP BY ALL), f AS (SELECT DISTINCT p.hub FROM p JOIN n a ON a.hub = p.hub JOIN n b ON b.hub = p.o WHERE x / (a.n + b.n - x) > 0.7 AND (b.n > a.n OR (b.n = a.n AND p.o < p.hub)))
SELECT * FROM c WHERE hub NOT IN (SELECT hub FROM f)"""


@q("GR07_virtual_scopes", _VIRTUAL, "edges")
def _(s, d):
    e = B.edges(s, d)
    c = G.clusters(e, G.hubs(e, B.nodes(s, d))).filter("cohesion >= 0.02")
    members = c.select("hub").join(e, F.col("hub") == F.col("dst")).groupBy("hub").agg(F.collect_set("src").alias("items"))
    kept = C.jaccard_dedup(members, "hub", "items").filter("kept").select("hub")
    return c.join(kept, "hub", "left_semi")


@q("VEC03_hybrid", P.QUERIES["WIN01_rrf"][1])
def _(s, d):
    sparse = R.bm25(table(s, d, "documents"), "doc_id", "text", P.QUERY, 50)
    dense = R.cosine_top(table(s, d, "embeddings"), "vec_id", "embedding", P._query_vector(s, d), 50).select((F.col("vec_id") * 5 + 100).alias("doc_id"), "score")
    return R.rrf(dense, sparse, "doc_id", 20)


@q("PIPE05_directory_scan", "SELECT repo, split_part(path, '/', 1) AS dir, count(*) AS n, count(DISTINCT split_part(path, '.', -1)) AS languages FROM files WHERE contains(path, '/') GROUP BY ALL", "files")
def _(s, d):
    return B.paths(s, d).filter("path like '%/%'").groupBy("repo", F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n"), F.countDistinct(F.substring_index("path", ".", -1)).alias("languages"))


@q("PIPE07_constraints", "WITH r AS (SELECT constraint_id, scope_dir, category, confidence FROM rules WHERE scope_dir IS NOT NULL AND category IS NOT NULL AND confidence BETWEEN 0.5 AND 1 AND NOT isnan(confidence)) SELECT scope_dir, category, count(*) AS n, max(confidence) AS best FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY scope_dir, category ORDER BY confidence DESC, constraint_id) <= 5) GROUP BY ALL", "rules")
def _(s, d):
    r = B.rules(s, d).filter("scope_dir is not null and category is not null and confidence between 0.5 and 1")
    top = r.withColumn("k", F.row_number().over(Window.partitionBy("scope_dir", "category").orderBy(F.desc("confidence"), "constraint_id"))).filter("k <= 5")
    return top.groupBy("scope_dir", "category").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


@q("PIPE12_replay", "WITH h AS (SELECT repo, file, count(*) AS n FROM touched WHERE ts < 1750000000 GROUP BY ALL), k AS (SELECT repo, file FROM h QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, file) <= 12), c AS (SELECT repo, commit_id, count(*) AS a, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.repo = touched.repo AND k.file = touched.file)) AS hit FROM touched WHERE ts >= 1750000000 GROUP BY ALL) SELECT repo, count(*) AS commits, round(avg(hit / a), 6) AS recall, round(avg(hit / 12), 6) AS precision FROM c GROUP BY repo", "touched")
def _(s, d):
    t = B.touched(s, d)
    past = t.filter("ts < 1750000000").groupBy("repo", "file").agg(F.count("*").alias("n"))
    k = H.recent_by_module(past, "repo", [F.desc("n"), F.col("file")], 12).select("repo", "file", F.lit(1).alias("in"))
    c = t.filter("ts >= 1750000000").join(k, ["repo", "file"], "left").groupBy("repo", "commit_id").agg(F.count("*").alias("a"), F.count("in").alias("hit"))
    return c.groupBy("repo").agg(F.count("*").alias("commits"), F.round(F.avg(F.col("hit") / F.col("a")), 6).alias("recall"), F.round(F.avg(F.col("hit") / 12), 6).alias("precision"))


@q("PIPE15_rebuild", "SELECT 'sessions' AS log, count(*) AS n FROM sessions UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'rules', count(*) FROM rules", "sessions", "commits", "rules")
def _(s, d):
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("log"), "n")
    return one(B.sessions(s, d), "sessions").unionByName(one(B.commits(s, d), "commits")).unionByName(one(B.rules(s, d), "rules"))


_STATE = f"SELECT 'utility' AS state, * FROM ({FP.QUERIES['AGG19_utility'][1]}) UNION ALL BY NAME SELECT 'lesson' AS state, * FROM ({FP.QUERIES['AGG42_lessons'][1]}) UNION ALL BY NAME SELECT 'invariant' AS state, * FROM ({HP.QUERIES['JN28_absent_boundaries'][1]})"


@q("PIPE15_rebuilt_state", _STATE)
def _(s, d):
    sessions, commits = checkpointed(B.sessions(s, d)), checkpointed(B.commits(s, d))
    tables = {"utility": L.utility(sessions, commits), "lesson": L.lessons(sessions, commits, resolved=3), "invariant": G.absent_boundaries(B.edges(s, d), B.nodes(s, d))}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("state", F.lit(name)) for name, df in tables.items()])


@q("VEC06_search_in_budget", f"WITH {P._BM25}, top AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50), t AS (SELECT doc_id, score, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM top JOIN documents USING (doc_id)) SELECT doc_id, tokens, used FROM (SELECT doc_id, tokens, sum(tokens) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t) WHERE used <= 3000")
def _(s, d):
    docs = table(s, d, "documents")
    hits = R.bm25(docs, "doc_id", "text", P.QUERY, 50).join(docs.select("doc_id", S.tokens_estimate("text").alias("tokens")), "doc_id")
    # At most 50 rows reach the running sum.
    return R.prefix_fill(hits.withColumn("g", F.lit(0)), ["g"], [F.desc("score"), F.col("doc_id")], "tokens", 3000).select("doc_id", "tokens", "used")


@q("AGG52_bindings", "SELECT provider, consumer, count(*) AS n, max(confidence) AS confidence FROM (SELECT scope_dir AS provider, file AS consumer, CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence ELSE 1.0 END AS confidence FROM rules WHERE category = 'contract' AND scope_dir IS NOT NULL AND file IS NOT NULL) GROUP BY ALL", "rules")
def _(s, d):
    r = B.rules(s, d).filter("category = 'contract' and scope_dir is not null and file is not null")
    known = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(1.0)
    return r.groupBy(F.col("scope_dir").alias("provider"), F.col("file").alias("consumer")).agg(F.count("*").alias("n"), F.max(known).alias("confidence"))


@q("FN54_decorated", r"SELECT file_id, d AS decorator, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(content, '(?m)^\s*@([A-Za-z_][\w.]*)', 1)) AS d FROM files WHERE path LIKE '%.py' OR path LIKE '%.java') GROUP BY ALL", "files")
def _(s, d):
    f = B.files(s, d).filter("path like '%.py' or path like '%.java'")
    return f.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*@([A-Za-z_][\w.]*)"), F.lit(1))).alias("decorator")).groupBy("file_id", "decorator").agg(F.count("*").alias("n"))


@q("PIPE02_scopes", f"WITH {_CF}, a AS (SELECT cf.* FROM cf JOIN n USING (file) WHERE n >= 3), p AS (SELECT x.file AS file_a, y.file AS file_b FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT split_part(f, ':', 1) || '/' || CASE WHEN contains(f, '/') THEN split_part(split_part(f, ':', 2), '/', 1) ELSE '' END AS module, count(*) AS couplings FROM (SELECT file_a AS f FROM p UNION ALL SELECT file_b FROM p) GROUP BY module), z AS (SELECT repo || '/' || CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS module, count(*) AS n_files, sum(floor(length(content) / 4))::BIGINT AS tokens FROM files GROUP BY module) SELECT module, n_files, tokens, coalesce(couplings, 0) AS couplings FROM z LEFT JOIN c USING (module)", "touched", "files")
def _(s, d):
    pairs = H.pair_counts(H.active(obs(s, d), 3)).filter("n_ab >= 3")
    ends = pairs.select(F.col("file_a").alias("f")).unionAll(pairs.select("file_b"))
    inside = F.substring_index(F.col("f"), ":", -1)
    top = lambda p: F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise("")
    c = ends.groupBy(F.concat(F.substring_index("f", ":", 1), F.lit("/"), top(inside)).alias("module")).agg(F.count("*").alias("couplings"))
    rows = B.latest(table(s, d, "file_analyses").select("file_id", "repo", "path", S.tokens_estimate("content").alias("t"), "recorded_at"), ["file_id"])
    z = rows.groupBy(F.concat("repo", F.lit("/"), top(F.col("path"))).alias("module")).agg(F.count("*").alias("n_files"), F.sum("t").alias("tokens"))
    return z.join(c, "module", "left").na.fill(0, ["couplings"])


@q("TOP06_trim", "SELECT session_id, f AS file FROM (SELECT session_id, unnest(predicted_files[1:12]) AS f FROM sessions) WHERE f IS NOT NULL", "sessions")
def _(s, d):
    return B.sessions(s, d).select("session_id", F.explode(F.slice("predicted_files", 1, 12)).alias("file")).filter("file is not null")


@q("FN35_decay", "SELECT file, n, CAST(CASE WHEN n <= 3 THEN 1.0 ELSE greatest(1.0 - 0.1 * (n - 3), 0.3) END AS DOUBLE) AS confidence FROM (SELECT file, count(*) AS n FROM touched GROUP BY file)", "touched")
def _(s, d):
    return B.touched(s, d).groupBy("file").agg(F.count("*").alias("n")).select("file", "n", S.decayed(F.lit(1.0), "n").alias("confidence"))


@q("FN38_risk", "SELECT commit_id, CASE WHEN n <= 3 THEN 'LOW' WHEN n <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM (SELECT commit_id, count(*) AS n FROM touched GROUP BY commit_id)", "touched")
def _(s, d):
    return B.touched(s, d).groupBy("commit_id").agg(F.count("*").alias("n")).select("commit_id", S.risk("n").alias("risk"))
