"""Scopes as ordered file sets, and the expressions over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET01: files of either, in the order of a then b, with the greatest score; (file, ord, score)."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    out = both.groupBy("file").agg(F.min(F.struct("_side", "ord")).alias("o"), F.max("score").alias("score"))
    return out.select("file", (F.col("o._side") * F.lit(1_000_000_000_000) + F.col("o.ord")).alias("ord"), "score")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET02: files of a that b lacks, in the order of a."""
    return a.join(b.select("file"), "file", "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET03: files of a that b has, in the order of a."""
    return a.join(b.select("file"), "file", "left_semi")


def parse(expression: str) -> list[tuple[str, str, str | None]]:
    """SET05: [(op, name, modifier)], left to right without precedence; the only modifier is ``context``."""
    out = []
    for op, ref in re.findall(r"([+\-&]?)\s*([^+\-&]+)", expression.strip()):
        name, _, modifier = ref.strip().partition("@")
        if modifier and modifier != "context":
            raise ValueError(f"unknown modifier @{modifier}")
        if not name.strip():
            raise ValueError(f"empty scope name in {expression!r}")
        out.append((op or "+", name.strip(), modifier or None))
    if not out:
        raise ValueError("empty expression")
    return out


def compose(expression: str, scopes: dict[str, DataFrame]) -> DataFrame:
    """SET04-05: an expression over named scopes, folded from the left; ``a@context`` brings no files."""
    result = None
    for op, name, modifier in parse(expression):
        scope = scopes[name].limit(0) if modifier == "context" else scopes[name]
        result = scope if result is None else {"+": merge, "-": subtract, "&": intersect}[op](result, scope)
    return result


def expression_terms(expr: Column) -> Column:
    """SET05 as a column: array of (op, name), a trailing slash removed."""
    tokens = F.regexp_extract_all(expr, F.lit(r"([+\-&]?\s*[^+\-&]+)"), F.lit(1))
    op = lambda t: F.when(F.ltrim(t).rlike(r"^[+\-&]"), F.substring(F.ltrim(t), 1, 1)).otherwise("+")
    name = lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, r"^\s*[+\-&]\s*", "")), "/$", "")
    return F.transform(tokens, lambda t: F.struct(op(t).alias("op"), name(t).alias("name")))


def module_of(path: Column) -> Column:
    """The first directory below src, lib and app."""
    dirs = F.split(path, "/")
    dirs = F.slice(dirs, 1, F.size(dirs) - 1)
    return F.try_element_at(F.filter(dirs, lambda x: ~x.isin("src", "lib", "app")), F.lit(1))


def evaluate(queries: DataFrame, files: DataFrame, keys: list[str], expr: str, path: str) -> DataFrame:
    """Every expression over its group's files at once: (keys, expr, path).

    A file can only come in through a scope that an expression adds, so the
    join is by (keys, module), not by all files of the group.  The fold over an
    expression's terms is a column.
    """
    asked = queries.select(*keys, expr).dropna().distinct().withColumn("_terms", expression_terms(F.col(expr)))
    added = asked.select(*keys, expr, "_terms", F.explode(F.array_distinct(F.transform(F.filter("_terms", lambda t: t["op"] == "+"), lambda t: t["name"]))).alias("_module"))
    held = files.select(*keys, path, module_of(F.col(path)).alias("_module"))
    pairs = added.join(held, [*keys, "_module"])
    hit = lambda t: t["name"] == F.col("_module")
    inside = F.aggregate("_terms", F.lit(False), lambda a, t: F.when(t["op"] == "+", a | hit(t)).when(t["op"] == "-", a & ~hit(t)).otherwise(a & hit(t)))
    return pairs.filter(inside).select(*keys, expr, path).distinct()


def _tagged(column: str) -> Column:
    return F.transform(column, lambda w: F.struct(w.alias("w"), F.lit(column).alias("kind")))


def match_tasks(tasks: DataFrame, key: str, task: str, scopes: DataFrame, threshold: float = 0.05, top: int = 3) -> DataFrame:
    """SET07, TOP05: (key, scope, score), best scopes of each task.

    Scores: .6 of the Jaccard overlap of words and keywords, .25 for a word of
    the name, .15 of the share of the description's words.  Only scopes that
    share a word with the task can score, so the join is by word.
    """
    asked = tasks.select(key, F.array_join(S.task_words(task), " ").alias("_t")).filter("_t <> ''")
    # Tasks of the same words are matched once.
    t = asked.select("_t").distinct().withColumn("_tw", F.split("_t", " "))
    kinds = ("k", "n", "d")
    s = scopes.select("scope", S.task_words(F.array_join("keywords", " ")).alias("k"), S.task_words("scope").alias("n"), S.task_words("description").alias("d"))
    held = F.explode(F.concat(*[_tagged(k) for k in kinds])).alias("x")
    words = s.select("scope", held).select("scope", "x.w", "x.kind")
    # Overlaps are counted from the joined words, so no array is compared with another.
    hits = t.select("_t", F.size("_tw").alias("_words"), F.explode("_tw").alias("w")).join(words, "w").groupBy("_t", "_words", "scope").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in kinds])
    pairs = hits.join(s.select("scope", F.size("k").alias("_sk"), F.size("d").alias("_sd")), "scope")
    score = F.when(F.col("_sk") > 0, 0.6 * F.col("_k") / (F.col("_words") + F.col("_sk") - F.col("_k"))).otherwise(0.0)
    score = score + F.when(F.col("_n") > 0, 0.25).otherwise(0.0)
    score = score + F.when(F.col("_sd") > 0, 0.15 * F.col("_d") / F.col("_sd")).otherwise(0.0)
    out = pairs.select("_t", "scope", F.round(F.least(score, F.lit(1.0)), 6).alias("score")).filter(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("score"), "scope"))
    return asked.join(out.withColumn("rank", rank).filter(F.col("rank") <= top), "_t").select(key, "scope", "score", "rank")


def overlay(tracked: DataFrame, runtime: DataFrame, key: str) -> DataFrame:
    """JN30, SET10: one row per key, the runtime row before the tracked one, with ``source``."""
    only = tracked.join(runtime.select(key), key, "left_anti").withColumn("source", F.lit("tracked"))
    return only.unionByName(runtime.withColumn("source", F.lit("runtime")))


def covering_scope(files: DataFrame, path: str, scopes: DataFrame) -> DataFrame:
    """JN48: (path, scope): the deepest directory above a file that is a scope; null if none is."""
    dirs = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(dirs) - 1), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))
    up = files.select(path, F.explode(F.when(F.size(dirs) > 1, ups)).alias("scope"))
    best = up.join(scopes.select("scope"), "scope", "left_semi").groupBy(path).agg(F.max_by("scope", F.length("scope")).alias("scope"))
    return files.select(path).distinct().join(best, path, "left")


def jaccard_dedup(sets: DataFrame, key: str, items: str, threshold: float = 0.7) -> DataFrame:
    """SET08: (key, kept): a set falls to a larger one (then the first by key) it overlaps by more than ``threshold``.

    Two sets above the threshold share one of the first items of each in order
    of rarity, so only those prefixes are joined: a hot item is in a prefix
    only where a set has hardly another.  Sizes that cannot reach the
    threshold drop out, and the rest is compared whole.
    """
    rows = sets.select(key, F.array_distinct(F.array_compact(items)).alias("_s")).filter("size(_s) > 0")
    each = rows.select(key, F.explode("_s").alias("_i"))
    often = each.groupBy("_i").agg(F.count("*").alias("_f"))
    # By the length of a set, an overlap above t needs t of its items; all but the first n - ceil(t n) + 1 may be missing.
    ranked = each.join(often, "_i").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_f", "_i"))).alias("_s"))
    ranked = ranked.select(key, F.transform("_s", lambda x: x["_i"]).alias("_s"), F.size("_s").alias("_n"))
    prefix = F.slice("_s", 1, (F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9) + 1).cast("int"))
    heads = ranked.select(key, "_n", F.explode(prefix).alias("_i"))
    other = heads.select(F.col(key).alias("_k"), F.col("_n").alias("_m"), "_i")
    bigger = (F.col("_m") > F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("_k") < F.col(key)))
    pairs = heads.join(other, "_i").filter(bigger & (F.col("_n") > F.col("_m") * threshold)).select(key, "_k").distinct()
    both = pairs.join(ranked.select(key, "_s"), key).join(ranked.select(F.col(key).alias("_k"), F.col("_s").alias("_t")), "_k")
    shared = F.size(F.array_intersect("_s", "_t"))
    fallen = both.filter(shared / (F.size("_s") + F.size("_t") - shared) > threshold).select(key).distinct().withColumn("_f", F.lit(True))
    return sets.select(key).distinct().join(fallen, key, "left").select(key, F.col("_f").isNull().alias("kept"))
