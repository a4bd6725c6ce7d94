"""History mining and dependency graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import checkpointed
from ..functions import scalar as S
from ..operators import graph as G
from ..operators import history as H
from . import bind as B

QUERIES: dict = {}


def q(name: str, sql: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, B.sql(sql, *names) if sql else None)
        return fn

    return keep


# Commits of observation logs carry repository and path as the file's name.
_OBS = "WITH cf AS (SELECT DISTINCT commit_id, repo || ':' || file AS file FROM touched)"


def obs(s, d):
    return B.touched(s, d).select("commit_id", F.concat("repo", F.lit(":"), "file").alias("file")).distinct()


_HIST = "SELECT file, count(DISTINCT commit_id) AS commits, sum(ins + dels)::BIGINT AS lines FROM changes GROUP BY file"


@q("AGG01_file_history", f"SELECT *, CASE WHEN lines = 0 OR lines / commits < 10 THEN 'tweaked' WHEN lines / commits > 50 OR commits > 15 THEN 'volatile' ELSE 'stable' END AS stability FROM ({_HIST})", "changes")
def _(s, d):
    return H.file_history(B.changes(s, d))


@q("AGG02_module_churn", "SELECT module, sum(ins + dels)::BIGINT AS churn FROM changes GROUP BY module", "changes")
def _(s, d):
    return B.changes(s, d).groupBy("module").agg(F.sum(F.col("ins") + F.col("dels")).alias("churn"))


@q("TOP01_hotspots", "SELECT file, sum(ins + dels)::BIGINT AS lines FROM changes GROUP BY file ORDER BY lines DESC, file LIMIT 30", "changes")
def _(s, d):
    return B.changes(s, d).groupBy("file").agg(F.sum(F.col("ins") + F.col("dels")).alias("lines")).orderBy(F.desc("lines"), "file").limit(30)


def _pairs(least: int) -> str:
    return f"n AS (SELECT file, count(*) AS n FROM cf GROUP BY file), a AS (SELECT cf.* FROM cf JOIN n USING (file) WHERE n >= {least}), p AS (SELECT x.file AS file_a, y.file AS file_b, count(*) AS n_ab FROM a x JOIN a y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY ALL)"


@q("AGG03_couplings", f"{_OBS}, {_pairs(3)} SELECT file_a, file_b, n_ab, round(n_ab / least(na.n, nb.n), 3) AS strength FROM p JOIN n na ON na.file = file_a JOIN n nb ON nb.file = file_b WHERE n_ab >= 3 AND n_ab / least(na.n, nb.n) >= 0.5", "touched")
def _(s, d):
    return H.couplings(obs(s, d), top=None)


@q("TOP02_top_couplings", f"{_OBS}, {_pairs(3)} SELECT file_a, file_b, n_ab, round(n_ab / least(na.n, nb.n), 3) AS strength FROM p JOIN n na ON na.file = file_a JOIN n nb ON nb.file = file_b WHERE n_ab >= 3 AND n_ab / least(na.n, nb.n) >= 0.5 ORDER BY strength DESC, n_ab DESC, file_a, file_b LIMIT 50", "touched")
def _(s, d):
    return H.couplings(obs(s, d))


@q("AGG04_contracts", f"{_OBS}, {_pairs(5)}, b AS (SELECT file_a AS trigger, file_b AS coupled, n_ab FROM p UNION ALL SELECT file_b, file_a, n_ab FROM p) SELECT b.trigger, coupled, n_ab, round(n_ab / n.n, 3) AS confidence FROM b JOIN n ON n.file = b.trigger WHERE n_ab >= 3 AND n_ab / n.n >= 0.4", "touched")
def _(s, d):
    return H.contracts(obs(s, d), threshold=0.4, top=None)


@q("FN13_contract_text", f"{_OBS}, {_pairs(5)}, b AS (SELECT file_a AS trigger, file_b AS coupled, n_ab FROM p UNION ALL SELECT file_b, file_a, n_ab FROM p), c AS (SELECT b.trigger AS t, coupled AS c, n_ab / n.n AS k, split_part(b.trigger, '/', -1) AS tb, split_part(coupled, '/', -1) AS cb FROM b JOIN n ON n.file = b.trigger WHERE n_ab >= 3 AND n_ab / n.n >= 0.4) SELECT t AS trigger, c AS coupled, CASE WHEN contains(lower(c), 'test') AND NOT contains(lower(t), 'test') THEN 'test ' || cb || ' follows ' || tb || ' in ' WHEN regexp_replace(t, '/?[^/]*$', '') = regexp_replace(c, '/?[^/]*$', '') THEN tb || ' and ' || cb || ' go together in ' ELSE tb || ' needs ' || cb || ' elsewhere in ' END || CAST(CAST(round(round(k, 3) * 100) AS INT) AS VARCHAR) || '%' AS description FROM c", "touched")
def _(s, d):
    out = H.contracts(obs(s, d), threshold=0.4, top=None)
    return out.select("trigger", "coupled", S.contract_text("trigger", "coupled", "confidence").alias("description"))


_NPMI = f"{_OBS}, {_pairs(2)}, t AS (SELECT count(DISTINCT commit_id) AS total FROM cf), u AS (SELECT file_a, file_b, round(CASE WHEN n_ab = total THEN 0 ELSE greatest(log2(n_ab * total / (na.n * nb.n)) / -log2(n_ab / total), 0) END, 6) AS npmi FROM p JOIN n na ON na.file = file_a JOIN n nb ON nb.file = file_b, t WHERE n_ab >= 2)"


@q("AGG05_npmi", f"{_NPMI} SELECT * FROM u UNION ALL SELECT file_b, file_a, npmi FROM u", "touched")
def _(s, d):
    return H.npmi(obs(s, d))


@q("AGG06_repeat_weights", f"{_OBS}, {_pairs(2)} SELECT file_a, file_b, n_ab - 1 AS weight FROM p WHERE n_ab >= 2", "touched")
def _(s, d):
    return H.repeat_weights(obs(s, d))


@q("JN51_cochange_of_scope", f"{_NPMI} SELECT file_a, file_b, npmi FROM u WHERE npmi >= 0.5 AND (contains(file_a, '/report/') OR contains(file_b, '/report/')) ORDER BY npmi DESC, file_a, file_b LIMIT 40", "touched")
def _(s, d):
    out = H.npmi(obs(s, d)).filter("file_a < file_b and npmi >= 0.5")
    return out.filter(F.col("file_a").contains("/report/") | F.col("file_b").contains("/report/")).orderBy(F.desc("npmi"), "file_a", "file_b").limit(40)


@q("WIN02_recent_by_module", "SELECT module, commit_id, rank FROM (SELECT module, commit_id, CAST(row_number() OVER (PARTITION BY module ORDER BY ts DESC, commit_id) AS INT) AS rank FROM (SELECT DISTINCT module, commit_id, ts FROM changes)) WHERE rank <= 5", "changes")
def _(s, d):
    rows = B.changes(s, d).select("module", "commit_id", "ts").distinct()
    return H.recent_by_module(rows, "module", [F.desc("ts"), F.col("commit_id")]).select("module", "commit_id", "rank")


@q("JN01_importers", "SELECT dst AS id, count(*) AS importers FROM edges GROUP BY dst", "edges")
def _(s, d):
    return G.in_degree(B.edges(s, d))


@q("AGG07_merged_weights", "SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM edges GROUP BY ALL", "edges")
def _(s, d):
    return G.merged_weights(B.edges(s, d).withColumn("w", F.lit(1)), "w")


@q("AGG08_degrees", "SELECT id, count(*) AS degree, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id", "edges")
def _(s, d):
    return G.degrees(B.edges(s, d))


@q("GR01_dependencies", "WITH RECURSIVE r(root, node) AS (SELECT src, dst FROM edges UNION SELECT r.root, e.dst FROM r JOIN edges e ON e.src = r.node) SELECT root, count(*) AS n FROM r GROUP BY root", "edges")
def _(s, d):
    return G.reach_counts(B.edges(s, d), B.nodes(s, d))


@q("GR02_dependents", "WITH RECURSIVE r(root, node) AS (SELECT dst, src FROM edges UNION SELECT r.root, e.src FROM r JOIN edges e ON e.dst = r.node) SELECT root, count(*) AS n FROM r GROUP BY root", "edges")
def _(s, d):
    return G.reach_counts(G.reversed_edges(B.edges(s, d)), B.nodes(s, d))


@q("GR06_impact", "WITH RECURSIVE r(root, node) AS (SELECT dst, src FROM edges UNION SELECT r.root, e.src FROM r JOIN edges e ON e.dst = r.node) SELECT root, count(*) AS n, count(DISTINCT module) AS modules, CASE WHEN count(*) <= 3 THEN 'LOW' WHEN count(*) <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM r JOIN nodes ON id = node GROUP BY root", "edges", "nodes")
def _(s, d):
    n = B.nodes(s, d)
    out = G.reach_counts(G.reversed_edges(B.edges(s, d)), n, n).select("root", F.col("known").alias("n"), "modules")
    return out.withColumn("risk", S.risk("n"))


@q("GR03_one_hop", "SELECT src AS seed, count(DISTINCT dst) AS n FROM edges GROUP BY src", "edges")
def _(s, d):
    return B.edges(s, d).groupBy(F.col("src").alias("seed")).agg(F.countDistinct("dst").alias("n"))


@q("GR08_deep_dependencies", "WITH RECURSIVE r(root, node) AS (SELECT src, dst FROM edges UNION SELECT r.root, e.dst FROM r JOIN edges e ON e.src = r.node), m AS (SELECT DISTINCT a.module, b.module AS dep FROM r JOIN nodes a ON a.id = root JOIN nodes b ON b.id = node WHERE a.module <> b.module), d AS (SELECT DISTINCT a.module, b.module AS dep FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst) SELECT module, dep FROM m ANTI JOIN d USING (module, dep)", "edges", "nodes")
def _(s, d):
    return G.deep_modules(B.folder_imports(s, d))


@q("AGG09_boundaries", "WITH RECURSIVE r(root, node) AS (SELECT src, dst FROM edges UNION SELECT r.root, e.dst FROM r JOIN edges e ON e.src = r.node), k AS (SELECT a.module, sum(CASE WHEN a.module = b.module THEN 1 ELSE 0 END)::BIGINT AS internal, sum(CASE WHEN a.module <> b.module THEN 1 ELSE 0 END)::BIGINT AS external FROM r JOIN nodes a ON a.id = root JOIN nodes b ON b.id = node GROUP BY a.module), z AS (SELECT module, count(*) AS n_files FROM nodes GROUP BY module) SELECT module, n_files, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, round(CASE WHEN coalesce(internal + external, 0) > 0 THEN internal / (internal + external) ELSE 1.0 END, 3) AS cohesion FROM z LEFT JOIN k USING (module)", "edges", "nodes")
def _(s, d):
    n = B.nodes(s, d)
    return G.module_boundaries(G.reach_counts(B.edges(s, d), n, n), n)


@q("AGG10_hubs", "SELECT dst AS id, count(*) AS importers, count(DISTINCT a.module) AS modules FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE lower(b.module) NOT IN ('utils', 'helpers', 'common', 'shared', 'lib', 'core') GROUP BY dst HAVING count(*) >= 3 AND count(DISTINCT a.module) >= 2", "edges", "nodes")
def _(s, d):
    return G.hubs(B.edges(s, d), B.nodes(s, d))


_HUBS = "h AS (SELECT dst AS hub FROM edges JOIN nodes a ON a.id = src GROUP BY dst HAVING count(*) >= 3 AND count(DISTINCT a.module) >= 2)"


@q("AGG12_clusters", f"WITH {_HUBS}, i AS (SELECT hub, src AS member FROM edges JOIN h ON dst = hub), sh AS (SELECT hub, e.dst AS member FROM i JOIN edges e ON e.src = i.member WHERE e.dst <> hub GROUP BY hub, e.dst HAVING count(DISTINCT i.member) >= 2), m AS (SELECT hub, hub AS member FROM h UNION SELECT * FROM i UNION SELECT * FROM sh), o AS (SELECT m.hub, e.dst, x.member AS ins FROM m JOIN edges e ON e.src = m.member LEFT JOIN m x ON x.hub = m.hub AND x.member = e.dst), k AS (SELECT hub, count(ins) AS internal, count(*) - count(ins) AS external FROM o GROUP BY hub), z AS (SELECT hub, count(*) AS size FROM m GROUP BY hub) SELECT hub, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, round(CASE WHEN coalesce(internal + external, 0) > 0 THEN internal / (internal + external) ELSE 0.0 END, 3) AS cohesion FROM z LEFT JOIN k USING (hub)", "edges", "nodes")
def _(s, d):
    e = B.edges(s, d)
    return G.clusters(e, G.hubs(e, B.nodes(s, d)))


@q("AGG13_hub_share", "SELECT dst AS id, count(*) AS importers, round(count(*) / (SELECT count(*) FROM nodes), 6) AS share FROM edges GROUP BY dst HAVING count(*) / (SELECT count(*) FROM nodes) >= 0.002", "edges", "nodes")
def _(s, d):
    total = B.nodes(s, d).agg(F.count("*").alias("total"))
    out = G.in_degree(B.edges(s, d)).join(F.broadcast(total)).withColumn("share", F.col("importers") / F.col("total"))
    return out.filter("share >= 0.002").select("id", "importers", F.round("share", 6).alias("share"))


@q("AGG15_module_matrix", "SELECT a.module AS src_module, b.module AS dst_module, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL", "edges", "nodes")
def _(s, d):
    return G.module_edges(B.edges(s, d), B.nodes(s, d))


@q("JN28_absent_boundaries", "SELECT x.module AS src_module, y.module AS dst_module FROM (SELECT DISTINCT repo, module FROM nodes) x JOIN (SELECT DISTINCT repo, module FROM nodes) y ON x.repo = y.repo AND x.module <> y.module WHERE NOT EXISTS (SELECT 1 FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.module = x.module AND b.module = y.module)", "edges", "nodes")
def _(s, d):
    return G.absent_boundaries(B.edges(s, d), B.nodes(s, d))


_FLOW = """WITH RECURSIVE g(start, node, chain, hops) AS (
  SELECT id, id, [id], 0 FROM nodes
  UNION ALL SELECT start, min(dst), list_append(chain, min(dst)), hops + 1 FROM g JOIN edges ON src = node WHERE NOT list_contains(chain, dst) AND hops < 6 GROUP BY start, chain, hops
) SELECT start, CAST(hops AS BIGINT) AS hops, array_to_string([CAST(x AS VARCHAR) FOR x IN chain], '>') AS chain FROM g QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1"""


@q("GR05_flow_chains", _FLOW, "edges", "nodes")
def _(s, d):
    return G.flow_chains(B.edges(s, d), B.nodes(s, d))


@q("JN23_blast_radius", "WITH p AS (SELECT module AS \"group\", id FROM nodes), x AS (SELECT DISTINCT \"group\", src AS id FROM p JOIN edges ON dst = p.id WHERE NOT EXISTS (SELECT 1 FROM p z WHERE z.\"group\" = p.\"group\" AND z.id = src)), y AS (SELECT DISTINCT \"group\", e.src AS id FROM x JOIN edges e ON e.dst = x.id WHERE NOT EXISTS (SELECT 1 FROM p z WHERE z.\"group\" = x.\"group\" AND z.id = e.src) AND NOT EXISTS (SELECT 1 FROM x z WHERE z.\"group\" = x.\"group\" AND z.id = e.src)) SELECT \"group\", id, 'exclusive' AS ring FROM x UNION ALL SELECT \"group\", id, 'shared' FROM y", "edges", "nodes")
def _(s, d):
    e, n = B.edges(s, d), B.nodes(s, d)
    none = n.select("id", F.col("id").alias("partner")).limit(0)
    return G.blast_radius(n.select(F.col("module").alias("group"), "id"), e, none)


_RINGS = """{0}, pr AS (SELECT a.file_id AS id, b.file_id AS partner FROM (SELECT file_a, file_b FROM u WHERE npmi > 0.5 UNION ALL SELECT file_b, file_a FROM u WHERE npmi > 0.5) JOIN files a ON a.repo || ':' || a.path = file_a JOIN files b ON b.repo || ':' || b.path = file_b UNION SELECT provider, consumer FROM links UNION SELECT consumer, provider FROM links),
pm AS (SELECT module AS "group", id FROM nodes), nb AS (SELECT "group", src AS id FROM pm JOIN edges ON dst = id UNION SELECT "group", partner FROM pm JOIN pr USING (id)),
x AS (SELECT * FROM nb ANTI JOIN pm USING ("group", id)), y AS (SELECT DISTINCT "group", src AS id FROM x JOIN edges ON dst = x.id), z AS (SELECT * FROM y ANTI JOIN pm USING ("group", id))
SELECT "group", id, 'exclusive' AS ring FROM x UNION ALL SELECT "group", id, 'shared' FROM z ANTI JOIN x USING ("group", id)"""


@q("JN23_blast_radius_coupled", _RINGS.format(_NPMI), "touched", "edges", "nodes", "links")
def _(s, d):
    e, n, links = checkpointed(B.edges(s, d)), checkpointed(B.nodes(s, d)), B.links(s, d)
    # Pairs are counted over ids, and only over files that are known; the number of commits stays that of all.
    key = F.concat("repo", F.lit(":"), "path")
    names = n.select("id", key.alias("file"))
    rows = checkpointed(obs(s, d).join(names, "file", "left").select("commit_id", F.col("id").alias("file")))
    strong = H.npmi(rows).filter("npmi > 0.5").select(F.col("file_a").alias("id"), F.col("file_b").alias("partner"))
    calls = links.select(F.col("provider").alias("id"), F.col("consumer").alias("partner"))
    partners = strong.unionByName(calls).unionByName(calls.select(F.col("partner").alias("id"), F.col("id").alias("partner"))).distinct()
    return G.blast_radius(n.select(F.col("module").alias("group"), "id"), e, partners)


@q("JN26_ghost_couplings", f"{_OBS}, {_pairs(3)} SELECT file_a, file_b, n_ab FROM p WHERE n_ab >= 5 AND NOT EXISTS (SELECT 1 FROM p z WHERE z.file_a = p.file_a AND z.file_b = p.file_b AND regexp_replace(p.file_a, '/[^/]*$', '') = regexp_replace(p.file_b, '/[^/]*$', ''))", "touched")
def _(s, d):
    pairs = H.pair_counts(H.active(obs(s, d), 3)).filter("n_ab >= 5")
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    links = pairs.filter(parent("file_a") == parent("file_b")).select(F.col("file_a").alias("src"), F.col("file_b").alias("dst"))
    return G.ghost_couplings(pairs, links)


@q("JN29_cross_module_imports", "SELECT DISTINCT src, dst FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE b.module <> a.module", "edges", "nodes")
def _(s, d):
    e, n = B.edges(s, d), B.nodes(s, d)
    a, b = n.select(F.col("id").alias("src"), F.col("module").alias("a")), n.select(F.col("id").alias("dst"), F.col("module").alias("b"))
    return e.join(a, "src").join(b, "dst").filter("a <> b").select("src", "dst").distinct()


@q("WIN16_max_confidence", "SELECT repo, file, max(confidence) AS confidence FROM (SELECT scope_dir AS repo, file, confidence FROM rules WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) AND file IS NOT NULL AND scope_dir IS NOT NULL) GROUP BY ALL", "rules")
def _(s, d):
    rows = B.rules(s, d).filter("confidence between 0 and 1 and file is not null and scope_dir is not null")
    return rows.groupBy(F.col("scope_dir").alias("repo"), "file").agg(F.max("confidence").alias("confidence"))
