"""Dependency graphs as edge tables (src imports dst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, spread
from ..functions import scalar as S


#: Edges whose adjacency is sent to all tasks, at most; 16 bytes each.
MAX_SENT_EDGES = 4_000_000


def _sent(step: DataFrame):
    """The adjacency for all tasks: node ids, where each one's targets begin, and the targets as places in the ids."""
    table = step.select(F.col("src").cast("long"), F.col("dst").cast("long")).toArrow()
    src, dst = table["src"].to_numpy(), table["dst"].to_numpy()
    ids = np.unique(np.r_[src, dst])
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.r_[ids, np.iinfo(np.int64).max] if len(ids) else [0])
    return step.sparkSession.sparkContext.broadcast((ids, first, np.searchsorted(ids, dst[order]).astype(np.int32)))


class _Walker:
    """Breadth first from one root after the other, with one mark a node."""

    def __init__(self, adjacency: tuple):
        self.ids, self.first, self.to = adjacency
        self.mark, self.round = np.zeros(len(self.ids), dtype=np.int64), 0

    def rings(self, root: int, max_depth: int) -> Iterator[np.ndarray]:
        """Places of the nodes first reached by one step, two steps, and so on."""
        at = int(np.searchsorted(self.ids, root))
        if at >= len(self.ids) or self.ids[at] != root:
            return
        self.round += 1
        ring, depth = np.array([at]), 0
        while len(ring) and depth < max_depth:
            depth += 1
            lo, n = self.first[ring], self.first[ring + 1] - self.first[ring]
            near = self.to[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            ring = np.unique(near[self.mark[near] != self.round])
            self.mark[ring] = self.round
            if len(ring):
                yield ring


def _reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Breadth first in memory, each task over its own roots, with the whole adjacency."""
    sent = _sent(edges)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = _Walker(sent.value)
        for pdf in batches:
            for root in pdf["id"]:
                for depth, ring in enumerate(walker.rings(root, max_depth), 1):
                    yield pd.DataFrame({"root": root, "node": walker.ids[ring], "depth": depth})

    return spread(roots.select(F.col("id").cast("long").alias("id")).distinct()).mapInPandas(walk, "root long, node long, depth int")


def reach_counts(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None, max_depth: int = 1000, max_sent: int = MAX_SENT_EDGES) -> DataFrame:
    """GR01, GR02, GR06: (root, n) of the roots that reach anything; with ``nodes`` (id, module) also (known, modules, inside).

    n is the number of reachable nodes, known those among ``nodes``, modules
    how many modules these have, inside those of the root's own module.  Where
    the adjacency is sent (see ``closure``) a root is counted where it is
    searched, and no (root, node) row is made.
    """
    step = edges.select("src", "dst").distinct()
    if step.limit(max_sent + 1).count() > max_sent or nodes is not None and nodes.limit(max_sent + 1).count() > max_sent:
        reach = closure(edges, roots, max_depth, max_sent)
        if nodes is None:
            return reach.groupBy("root").agg(F.count("*").alias("n"))
        far = reach.join(nodes.select(F.col("id").alias("node"), F.col("module").alias("m")), "node", "left").join(nodes.select(F.col("id").alias("root"), "module"), "root", "left")
        return far.groupBy("root").agg(F.count("*").alias("n"), F.count("m").alias("known"), F.countDistinct("m").alias("modules"), F.count_if(F.col("m") == F.col("module")).alias("inside"))
    sent = _sent(step)
    named = None
    if nodes is not None:
        table = nodes.select(F.col("id").cast("long"), "module").distinct().toArrow().to_pandas().sort_values("id")
        named = edges.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), pd.factorize(table["module"])[0].astype(np.int64)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = _Walker(sent.value)
        module = None
        if named is not None:
            ids, codes = named.value
            place = np.minimum(np.searchsorted(ids, walker.ids), max(0, len(ids) - 1))
            module = np.where(ids[place] == walker.ids, codes[place], -1) if len(ids) else np.full(len(walker.ids), -1)
        for pdf in batches:
            out = []
            for root in pdf["id"]:
                rings = list(walker.rings(root, max_depth))
                if not rings:
                    continue
                reached = np.concatenate(rings)
                if module is None:
                    out.append((root, len(reached), 0, 0, 0))
                else:
                    found = module[reached]
                    found = found[found >= 0]
                    own = module[np.searchsorted(walker.ids, root)]
                    out.append((root, len(reached), len(found), len(np.unique(found)), int((found == own).sum())))
            yield pd.DataFrame(out, columns=["root", "n", "known", "modules", "inside"])

    got = spread(roots.select(F.col("id").cast("long").alias("id")).distinct()).mapInPandas(walk, "root long, n long, known long, modules long, inside long")
    return got if nodes is not None else got.select("root", "n")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int = 1000, max_sent: int = MAX_SENT_EDGES, every: int = 4) -> DataFrame:
    """GR01: (root, node, depth): nodes reachable from each root by one step or more, with the fewest steps.

    A root comes out itself only if it lies on a cycle.  The number of edges
    is checked: up to ``max_sent`` the adjacency goes to every task and each
    root is searched there, without a shuffle.  Beyond that, breadth first by
    joins: each round joins the frontier with the edges and drops what is
    known; lineage is cut every few rounds through the shared folder.
    """
    step = edges.select("src", "dst").distinct()
    if step.limit(max_sent + 1).count() <= max_sent:
        return _reach(step, roots, max_depth)
    known = roots.select(F.col("id").alias("root")).join(step, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct()
    frontier = known
    for depth in range(2, max_depth + 1):
        more = frontier.select("root", F.col("node").alias("src")).join(step, "src").select("root", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(more.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % every == 0:
            known = checkpointed(known)
    return known


def deep_modules(steps: DataFrame, every: int = 4) -> DataFrame:
    """GR08: (module, dep): modules that files of ``module`` reach over others and never import themselves.

    ``steps`` has (module, via, next): a file of the module lies in the folder
    ``via`` and imports all files of the folder ``next``, either may be null.
    Modules spread over folders by joins until no new one is reached, however
    many steps away; no (file, file) row is made, and nothing is sent to the
    driver or to all tasks.
    """
    steps = checkpointed(steps.distinct())
    holds = steps.select("via", F.col("module").alias("dep")).dropna().distinct()
    leads = steps.select("module", F.col("next").alias("via")).dropna().distinct().join(holds, "via", "left_semi")
    onward = checkpointed(steps.select("via", "next").dropna().distinct().join(holds.select(F.col("via").alias("next")), "next", "left_semi"))
    leads = known = frontier = checkpointed(leads.select("module", "via"))
    depth = 1
    while not frontier.isEmpty():
        more = frontier.join(onward, "via").select("module", F.col("next").alias("via")).distinct()
        frontier = checkpointed(more.join(known, ["module", "via"], "left_anti"))
        known = known.unionByName(frontier)
        depth += 1
        if depth % every == 0:
            known = checkpointed(known)
    reached = lambda df: df.join(holds, "via").select("module", "dep").distinct()
    return reached(known).filter("module <> dep").join(reached(leads), ["module", "dep"], "left_anti")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def in_degree(edges: DataFrame) -> DataFrame:
    """JN01: (id, importers)."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("importers"))


def degrees(edges: DataFrame) -> DataFrame:
    """AGG08: (id, degree, indegree, outdegree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def merged_weights(edges: DataFrame, weight: str) -> DataFrame:
    """AGG07: parallel edges of either direction as one, weights summed."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).alias("weight"))


def module_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG15: (src_module, dst_module, n)."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("module").alias("src_module")), nodes.select(F.col("id").alias("dst"), F.col("module").alias("dst_module"))
    return edges.join(a, "src").join(b, "dst").groupBy("src_module", "dst_module").agg(F.count("*").alias("n"))


def module_boundaries(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG09: (module, n_files, internal, external, cohesion) from ``reach_counts`` over the nodes; 1.0 without any."""
    pairs = counts.join(nodes.select(F.col("id").alias("root"), "module"), "root")
    sums = pairs.groupBy("module").agg(F.sum("inside").alias("internal"), F.sum(F.col("known") - F.col("inside")).alias("external"))
    sizes = nodes.groupBy("module").agg(F.count("*").alias("n_files"))
    out = sizes.join(sums, "module", "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return out.withColumn("cohesion", F.round(F.when(total > 0, F.col("internal") / total).otherwise(1.0), 3))


def hubs(edges: DataFrame, nodes: DataFrame, least_importers: int = 3, least_modules: int = 2, skip: tuple[str, ...] = S.UTILITY_DIRS) -> DataFrame:
    """AGG10: (id, importers, modules): imported often and from several modules, outside utility directories."""
    m = nodes.select(F.col("id").alias("src"), F.col("module").alias("src_module"))
    own = nodes.select(F.col("id").alias("dst"), F.col("module").alias("dst_module"))
    out = edges.join(m, "src").groupBy("dst").agg(F.count("*").alias("importers"), F.countDistinct("src_module").alias("modules"))
    out = out.filter((F.col("importers") >= least_importers) & (F.col("modules") >= least_modules)).join(own.filter(~F.lower("dst_module").isin(*skip)), "dst", "left_semi")
    return out.withColumnRenamed("dst", "id")


def clusters(edges: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """AGG12: (hub, size, internal, external, cohesion): a hub, its importers, and what two or more of them import."""
    h = hub_ids.select(F.col("id").alias("hub"))
    imp = edges.join(h, edges.dst == h.hub).select("hub", F.col("src").alias("member"))
    shared = imp.join(edges, imp.member == edges.src).select("hub", "member", "dst").filter("dst <> hub").groupBy("hub", "dst").agg(F.countDistinct("member").alias("k")).filter("k >= 2").select("hub", F.col("dst").alias("member"))
    members = h.select("hub", F.col("hub").alias("member")).unionByName(imp).unionByName(shared).distinct()
    out = members.join(edges, members.member == edges.src).select("hub", "dst")
    inside = members.select("hub", F.col("member").alias("dst"), F.lit(1).alias("in"))
    counts = out.join(inside, ["hub", "dst"], "left").groupBy("hub").agg(F.count("in").alias("internal"), F.count_if(F.col("in").isNull()).alias("external"))
    sizes = members.groupBy("hub").agg(F.count("*").alias("size"))
    both = sizes.join(counts, "hub", "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return both.withColumn("cohesion", F.round(F.when(total > 0, F.col("internal") / total).otherwise(0.0), 3))


def flow_chains(edges: DataFrame, starts: DataFrame, max_hops: int = 6) -> DataFrame:
    """GR05: (start, hops, chain): the greedy path that always takes the smallest next node not yet on it."""
    step = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("next"))
    at = starts.select(F.col("id").alias("start"), F.col("id").alias("src"), F.array("id").alias("chain"))
    for _ in range(max_hops):
        go = at.join(step, "src", "left")
        choice = F.try_element_at(F.array_except(F.coalesce("next", F.array().cast("array<bigint>")), "chain"), F.lit(1))
        at = go.select("start", choice.alias("src"), F.when(choice.isNotNull(), F.concat("chain", F.array(choice))).otherwise(F.col("chain")).alias("chain"))
    return at.select("start", (F.size("chain") - 1).cast("long").alias("hops"), F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


def absent_boundaries(edges: DataFrame, nodes: DataFrame, group: str = "repo") -> DataFrame:
    """JN28: pairs of modules of one group without an import; modules meet only inside their group."""
    m = nodes.select(group, "module").distinct()
    pairs = m.select(group, F.col("module").alias("src_module")).join(m.select(group, F.col("module").alias("dst_module")), group).filter("src_module <> dst_module")
    return pairs.select("src_module", "dst_module").join(module_edges(edges, nodes), ["src_module", "dst_module"], "left_anti")


def ghost_couplings(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """JN26: coupled pairs (file_a, file_b) that no link (src, dst) of either direction explains."""
    known = links.select(F.least("src", "dst").alias("file_a"), F.greatest("src", "dst").alias("file_b")).distinct()
    return pairs.join(known, ["file_a", "file_b"], "left_anti")


def blast_radius(primary: DataFrame, edges: DataFrame, partners: DataFrame) -> DataFrame:
    """JN23: (group, id, ring): exclusive = importers and strong partners of the group's files, shared = importers of those.

    ``primary`` has group and id, ``partners`` (id, partner) holds strong couplings.
    """
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("dep"))
    near = primary.join(back, "id").select("group", F.col("dep").alias("id")).unionByName(primary.join(partners, "id").select("group", F.col("partner").alias("id"))).distinct()
    exclusive = near.join(primary, ["group", "id"], "left_anti")
    far = exclusive.join(back, "id").select("group", F.col("dep").alias("id")).distinct().join(primary, ["group", "id"], "left_anti").join(exclusive, ["group", "id"], "left_anti")
    return exclusive.withColumn("ring", F.lit("exclusive")).unionByName(far.withColumn("ring", F.lit("shared")))
