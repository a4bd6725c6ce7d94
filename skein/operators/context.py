"""What a request gets around its files: neighbours, hints, warnings, preflight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signals that a line is a warning (fixed values).
HINTS = r"(?i)\b(never|always|must|warning|invariant|important|do not|don't|avoid|careful)\b"


#: Forms of advice: what not to use, and what to use instead (fixed values).
ADVICE = (
    r"[Nn]ever\s+(?:call\s+)?(\S+).*?use\s+(\S+)",
    r"[Dd]on'?t\s+(?:use\s+)?(\S+).*?use\s+(\S+)",
    r"[Aa]void\s+(\S+).*?use\s+(\S+)",
    r"(\S+)\s+is\s+deprecated.*?use\s+(\S+)",
)


def expand_hits(hits: DataFrame, sources: list[DataFrame], per_hit: int = 8) -> DataFrame:
    """JN24: (query, hit, file, source): neighbours of each hit, a file once per query, at most ``per_hit`` each.

    ``hits`` has query, hit and rank; each source has hit, file and weight, in
    order of precedence.  A file goes to the best ranked hit, then the first
    source, then the greatest weight.
    """
    near = reduce(lambda a, b: a.unionByName(b), [s.select("hit", "file", "weight", F.lit(i).alias("source")) for i, s in enumerate(sources)])
    own = hits.select("query", F.col("hit").alias("file"))
    found = hits.join(near, "hit").join(own, ["query", "file"], "left_anti")
    order = [F.col("rank"), F.col("source"), F.desc("weight"), F.col("file")]
    once = found.withColumn("_k", F.row_number().over(Window.partitionBy("query", "file").orderBy(*order))).filter("_k = 1")
    capped = once.withColumn("_k", F.row_number().over(Window.partitionBy("query", "hit").orderBy(*order))).filter(F.col("_k") <= per_hit)
    return capped.select("query", "hit", "file", "source")


def flatten_calls(calls: DataFrame, exports: DataFrame, group: str, cap: int = 3) -> DataFrame:
    """JN25: (group, path, name, target): called names that another file of the group exports, up to ``cap`` per file."""
    hit = calls.join(exports.select(group, "name", F.col("path").alias("target")), [group, "name"]).filter("path <> target")
    rank = F.row_number().over(Window.partitionBy(group, "path").orderBy("name", "target"))
    return hit.withColumn("_k", rank).filter(F.col("_k") <= cap).select(group, "path", "name", "target")


def preflight(claims: DataFrame, partners: DataFrame, locks: DataFrame, consumers: DataFrame | None = None) -> DataFrame:
    """JN38, FN39: (claim, n_partners, n_locks, risk): strong partners not claimed, files locked by others.

    ``claims`` has claim, agent and file; ``partners`` file and partner;
    ``locks`` file and holder, and claim where a lock counts for some claims
    only.  With ``consumers`` (file, consumer), n_consumers comes out as well.
    """
    missing = claims.join(partners, "file").select("claim", F.col("partner").alias("file")).distinct().join(claims.select("claim", "file"), ["claim", "file"], "left_anti")
    held = claims.join(locks, [c for c in ("claim", "file") if c in locks.columns]).filter("holder <> agent").select("claim", "file").distinct()
    parts = {"n_partners": missing, "n_locks": held}
    if consumers is not None:
        parts["n_consumers"] = claims.join(consumers, "file").select("claim", "file", "consumer").distinct()
    out = claims.select("claim").distinct()
    for name, df in parts.items():
        out = out.join(df.groupBy("claim").agg(F.count("*").alias(name)), "claim", "left")
    out = out.na.fill(0, list(parts))
    total = reduce(lambda a, b: a + b, [F.col(name) for name in parts])
    return out.withColumn("risk", F.when((F.col("n_locks") > 0) | (total >= 4), "high").when(total >= 1, "medium").otherwise("low"))


def hint_lines(df: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """FN40, FN47, TOP08: (key, no, source, hint): warning lines with the provenance of their section, the first few by provenance."""
    lines = df.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("no", "line"))
    head = F.last(F.when(F.col("line").startswith("#"), F.lower("line")), ignorenulls=True).over(Window.partitionBy(key).orderBy("no"))
    low = F.lower("line")
    fallback = F.when(low.contains("co-change") | low.contains("commits"), "git_history").when(low.rlike("invariant:|hack:|warning:|note:"), "signal_comment").otherwise("hand_authored")
    source = F.when(head.isNull(), fallback).when(head.rlike("history|contract|stability"), "git_history").when(head.rlike("docstring|readme"), "docstring").when(head.rlike("signal|comment"), "signal_comment").otherwise("hand_authored")
    rows = lines.withColumn("source", source).filter(F.col("line").rlike(HINTS) & ~F.col("line").startswith("#") & (F.length(F.trim("line")) > 15))
    priority = F.when(F.col("source") == "git_history", 0).when(F.col("source") == "signal_comment", 1).when(F.col("source") == "hand_authored", 2).otherwise(3)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(priority, "no"))
    return rows.withColumn("_k", rank).filter(F.col("_k") <= most).select(key, F.col("no").cast("long").alias("no"), "source", F.trim("line").alias("hint"))


def warning_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """FN27: (key, anti, safe) of lines that say to use one thing instead of another; the first form that fits wins."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("line"))
    bare = lambda c: F.regexp_replace(c, r"^[.,;:()]+|[.,;:()]+$", "")
    pick = lambda g: F.coalesce(*[F.nullif(F.regexp_extract("line", f, g), F.lit("")) for f in ADVICE])
    return lines.select(key, bare(pick(1)).alias("anti"), bare(pick(2)).alias("safe")).filter("anti is not null and safe is not null")


def near_misses(pairs: DataFrame, diffs: DataFrame, key: str) -> DataFrame:
    """JN40: (key, anti, safe): the safe form is in the change and the other is not."""
    both = pairs.join(diffs, key)
    has = lambda c: F.contains(F.lower("diff"), F.lower(c))
    return both.filter(has("safe") & ~has("anti")).select(key, "anti", "safe").distinct()


def counterfactuals(touched: DataFrame, contracts: DataFrame, served: DataFrame) -> DataFrame:
    """JN41: (commit_id, trigger, coupled): contracts that were served and whose two files both changed."""
    c = served.join(contracts, ["trigger", "coupled"], "left_semi").select("commit_id", "trigger", "coupled").distinct()
    have = lambda name: touched.select("commit_id", F.col("file").alias(name))
    return c.join(have("trigger"), ["commit_id", "trigger"], "left_semi").join(have("coupled"), ["commit_id", "coupled"], "left_semi")


def colocation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN19: (id, module, rule, target): imported by one module only, and that is not its own; or by several without its own."""
    m = nodes.select(F.col("id").alias("src"), F.col("module").alias("by"))
    users = edges.join(m, "src").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("by").alias("n"), F.min("by").alias("first"), F.collect_set("by").alias("all"))
    out = users.join(nodes, "id").filter(~F.array_contains("all", F.col("module")))
    return out.select("id", "module", F.when(F.col("n") == 1, "orphan").otherwise("shared").alias("rule"), F.when(F.col("n") == 1, F.col("first")).alias("target"))


def share_in(values: Column, total: Column) -> Column:
    return F.round(F.when(total > 0, values / total).otherwise(0.0), 6)
