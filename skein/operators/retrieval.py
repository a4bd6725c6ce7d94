"""Keyword and vector search, rank fusion, file ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..common import parts_for, scratch_path, spread
from ..functions import scalar as S
from .prefix import running

K1, LENGTH_WEIGHT, RRF = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """AGG16: (key, term, tf, dl); one shuffle on (key, term) with map-side combine."""
    # Cut once, before the terms unfold; else every term of a text would cut it again for its length.
    cut = spread(docs.filter(F.col(text).isNotNull()).select(key, text)).select(key, S.search_tokens(text).alias("_t")).select(key, F.size("_t").cast("long").alias("dl"), "_t")
    rows = cut.select(key, "dl", F.explode("_t").alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _count(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def bm25(docs: DataFrame, key: str, text: str, query: str, top: int | None = 50) -> DataFrame:
    """AGG17, TOP03: (key, score) of the documents that hold a query term; a term repeated in the query counts again.

    Terms are counted where a document is read: only query terms and the
    length leave the scan, and no posting of another term is shuffled.
    """
    import re

    terms: dict[str, int] = {}
    for t in re.findall("[a-z_][a-z0-9_]*", query.lower()):
        if len(t) > 1:
            terms[t] = terms.get(t, 0) + 1
    names = sorted(terms)
    if not names:  # nothing is asked for, so nothing is read, and nothing would be observed
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = spread(docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_x")))
    # Two projections, so that the tokens are cut once and only query terms are counted.
    rows = rows.select("_key", S.search_tokens("_x").alias("_t")).select("_key", F.size("_t").alias("_dl"), F.filter("_t", lambda w: w.isin(names)).alias("_t"))
    rows = rows.select("_key", "_dl", *[_count("_t", t).alias(f"_f{i}") for i, t in enumerate(names)])
    # One pass over the texts: the statistics are observed while the rows with a hit are written.
    seen = Observation()
    every = rows.observe(seen, F.count("*").alias("n"), F.sum("_dl").alias("dl"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(names))])
    path = scratch_path(docs.sparkSession, "bm25")
    every.filter(" or ".join(f"_f{i} > 0" for i in range(len(names))) or "false").write.parquet(path)
    stats = seen.get
    n, average = stats["n"] or 0, (stats["dl"] or 0) / (stats["n"] or 1)
    scored = docs.sparkSession.read.schema(rows.schema).parquet(path)
    score: Column = F.lit(0.0)
    for i, t in enumerate(names):
        tf = F.col(f"_f{i}")
        idf = math.log((n - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5) + 1)
        score = score + F.lit(terms[t] * idf) * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("_dl") / (average or 1.0)))
    out = scored.select(F.col("_key").alias(key), F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(top) if top else out


def cosine_top(vectors: DataFrame, key: str, vector: str, query: list[float], top: int | None = 50) -> DataFrame:
    """VEC02: (key, score) by cosine, exact; vectors stay on the JVM side."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(x * x for x in query) ** 0.5 + 1e-10
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)) + 1e-10
    out = vectors.select(key, F.round(dot / (size * norm), 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(top) if top else out


def rrf(dense: DataFrame, sparse: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """WIN01: (key, score) by reciprocal ranks of two top lists; a missing rank is the list's length + 100."""
    ranked = []
    for name, df in (("d", dense), ("s", sparse)):
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key))
        ranked.append(df.withColumn(f"_{name}", rank - 1).withColumn(f"_n{name}", F.count("*").over(Window.partitionBy())).select(key, f"_{name}", f"_n{name}"))
    both = ranked[0].join(ranked[1], key, "full_outer")
    sizes = both.agg(F.coalesce(F.max("_nd"), F.lit(0)).alias("ld"), F.coalesce(F.max("_ns"), F.lit(0)).alias("ls"))
    part = lambda r, n: 1.0 / (F.lit(RRF) + F.coalesce(F.col(r), F.col(n) + 100))
    out = both.join(F.broadcast(sizes)).select(key, F.round(part("_d", "ld") + part("_s", "ls"), 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit)


def greedy_fill(files: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int, key: str) -> DataFrame:
    """WIN06: the rows of each group that fit a token budget, taken in order, skipping what does not fit.

    The fold over a group is sequential, but what it has to see is bounded by
    the budget, not by the data: of the rows of one size t only the first
    budget // t can ever fit, as an earlier row of that size that did not fit
    rules out every later one.  Rows of size 0 always fit and skip the fold.
    """
    rows = files.withColumn("_ord", F.struct(*order)).filter(F.col(tokens) <= budget)
    free = rows.filter(F.col(tokens) == 0).select(*group, key, tokens)
    rank = F.row_number().over(Window.partitionBy(*group, tokens).orderBy("_ord"))
    few = rows.filter(F.col(tokens) > 0).withColumn("_r", rank).filter(F.col("_r") <= F.floor(F.lit(budget) / F.col(tokens)))
    packed = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_ord", F.col(key).alias("k"), F.col(tokens).cast("long").alias("t")))).alias("fs"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.filter(F.transform("fs", lambda x: F.struct(x["k"].alias("k"), x["t"].alias("t"))), lambda x: F.lit(False)).alias("took"))
    fold = F.aggregate(
        "fs", start, lambda s, x: F.when(x["t"] <= s["left"], F.struct((s["left"] - x["t"]).alias("left"), F.concat(s["took"], F.array(F.struct(x["k"].alias("k"), x["t"].alias("t")))).alias("took"))).otherwise(s)
    )
    taken = packed.select(*group, F.explode(fold["took"]).alias("x")).select(*group, F.col("x.k").alias(key), F.col("x.t").alias(tokens))
    return taken.unionByName(free.withColumn(tokens, F.col(tokens).cast("long")))


def prefix_fill(files: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """WIN05: rows before the first one that overflows the budget, by a running sum over groups of any size."""
    return running(files, group, order, F.col(tokens), "used", "sum").filter(F.col("used") <= budget)


def path_scores(files: DataFrame, group: list[str], path: str, words: DataFrame, word: str = "word") -> DataFrame:
    """AGG18: files with ``bm25`` of a group's task words against path words, each counted once."""
    rows = files.select(*group, path, S.path_words(path).alias("_w")).withColumn("_dl", F.size("_w"))
    size = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"))
    long = rows.select(*group, path, "_dl", F.explode("_w").alias("_term"))
    hits = long.join(words.select(*group, F.col(word).alias("_term")).distinct(), [*group, "_term"])
    df = hits.groupBy(*group, "_term").agg(F.count("*").alias("_df"))
    idf = F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    norm = (K1 + 1) / (1 + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("_dl") / F.col("_avg")))
    scored = hits.join(df, [*group, "_term"]).join(size, group).groupBy(*group, path).agg(F.sum(idf * norm).alias("bm25"))
    return rows.select(*group, path).join(scored, [*group, path], "left").na.fill(0.0, ["bm25"])


def rank_files(files: DataFrame, path: str, tokens: str, bm25: str, ratio: str, resolves: str, touched_age_days: str) -> DataFrame:
    """VEC07, TOP04: files with ``score``, a product of signals: place, name, task words, size, use."""
    parts = F.split(F.lower(path), "/")
    name = F.substring_index(F.lower(path), "/", -1)
    score = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, ("tests", "test", "fixtures", "migrations", "__pycache__")))), 0.5).otherwise(1.0)
    weak = name.endswith(".generated.py") | name.endswith(".generated.ts") | name.endswith(".lock") | name.endswith(".min.js")
    score = score * F.when(weak, 0.3).otherwise(1.0)
    score = score * F.when(F.col(bm25) > 0, 1 + F.least(F.col(bm25), F.lit(3.0))).otherwise(1.0)
    score = score * F.when((F.col(tokens) > 0) & (F.col(tokens) < 200), 1.2).when(F.col(tokens) > 2000, 0.8).otherwise(1.0)
    return files.withColumn("score", F.round(S.effective_score(score, ratio, resolves, touched_age_days, True), 6))


def build_index(docs: DataFrame, key: str, text: str, root: str, vectors: DataFrame | None = None, version: str = "1") -> None:
    """VEC04: write a search index: postings clustered by term, lengths, totals, vectors, and last of all its description.

    Every document is indexed; a query reads only the row groups of its terms.
    """
    posts = postings(docs, key, text)
    posts.repartition(parts_for(posts), "term").sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{root}/postings")
    rows = spread(docs.filter(F.col(text).isNotNull()).select(key, text)).select(F.size(S.search_tokens(text)).cast("long").alias("dl"))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
    totals.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").parquet(f"{root}/totals")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{root}/vectors")


def search_index(spark, root: str, key: str, query: str, top: int | None = 50) -> DataFrame:
    """VEC04, SRC22: (key, score) by the written index, equal to ``bm25`` over the documents."""
    import re

    terms: dict[str, int] = {}
    for t in re.findall("[a-z_][a-z0-9_]*", query.lower()):
        if len(t) > 1:
            terms[t] = terms.get(t, 0) + 1
    totals = spark.read.parquet(f"{root}/totals").first()
    n, average = totals["n"] or 0, (totals["dl"] or 0) / (totals["n"] or 1)
    hits = spark.read.parquet(f"{root}/postings").filter(F.col("term").isin(sorted(terms)))
    # One row a term of the query.
    found = {r["term"]: r["d"] for r in hits.groupBy("term").agg(F.count("*").alias("d")).collect()}
    weight: Column = F.lit(0.0)
    for t, d in sorted(found.items()):
        weight = F.when(F.col("term") == t, F.lit(terms[t] * math.log((n - d + 0.5) / (d + 0.5) + 1))).otherwise(weight)
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("dl") / (average or 1.0)))
    out = hits.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(top) if top else out


def search(sparse: DataFrame, dense: DataFrame, docs: DataFrame, near: list[DataFrame], key: str, budget: int, hits: int = 20, per_hit: int = 8) -> DataFrame:
    """VEC06: (key, score, tokens, used): both sides fused, the fused hits with what stands next to them, as far as the budget goes.

    ``docs`` has key, tokens, stability and age_days, ``near`` tables of (hit, file,
    weight) in order of precedence.  Scores are lowered by age; neighbours
    come after all hits.
    """
    from .context import expand_hits

    fused = rrf(dense, sparse, key, hits).join(docs.select(key, "tokens", "stability", "age_days"), key)
    fused = fused.withColumn("score", F.round(F.col("score") * S.recency_factor("stability", "age_days"), 9))
    ranked = fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # at most ``hits`` rows
    one = ranked.select(F.lit(0).alias("query"), F.col(key).alias("hit"), "rank")
    beside = expand_hits(one, near, per_hit).select(F.col("file").alias(key)).distinct().join(docs.select(key, "tokens"), key).select(key, F.lit(0.0).alias("score"), "tokens", F.lit(1).alias("_side"))
    rows = ranked.select(key, "score", "tokens", F.lit(0).alias("_side")).unionByName(beside)
    return prefix_fill(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col("_side"), F.desc("score"), F.col(key)], "tokens", budget).select(key, "score", "tokens", "used")
