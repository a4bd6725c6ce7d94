"""Evaluation texts leaking into a corpus, by a prefix-filtered set join.

Words are maximal runs of letters and digits in lower case.  Texts are sets of
shingles of ``k`` words.  A shared run of ``run`` words holds ``run - k + 1``
consecutive shingles of the item, all of which must be in the document, so of
every such item window one shingle is enough as its prefix: its rarest one, by
the number of occurrences in the whole corpus.

1. One scan of the corpus counts the occurrences of the items' shingles, and
   keeps, of each document in which ``run - k + 1`` of them follow each other,
   where they stand.  No other document can hold a window.
2. The prefix tokens of all item windows are joined with the kept shingles.  A
   hit names a diagonal (document position minus item position).
3. Length and position bounds drop a hit whose window would leave the document.
4. What is left is verified along the diagonal, over item-sized windows: equal
   shingles at consecutive places are equal words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, spread

_WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def shingles(words: list[str], k: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(k))))


def prefix_tokens(items: dict[int, list[str]], k: int, run: int, counts: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], list[tuple[int, int]]]:
    """shingle -> its (item, position), for the rarest shingle of each window of ``run`` words."""
    chosen: dict[tuple[str, ...], set[tuple[int, int]]] = {}
    width = run - k + 1
    for item, words in items.items():
        own = shingles(words, k)
        for o in range(len(words) - run + 1):
            at = min(range(o, o + width), key=lambda p: (counts.get(own[p], 0), own[p], p))
            # A window with a shingle the corpus lacks cannot be there.
            if counts.get(own[at], 0):
                chosen.setdefault(own[at], set()).add((item, at))
    return {s: sorted(where) for s, where in chosen.items()}


def longest_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> int:
    """Most consecutive equal shingles of doc and item along doc position - item position = diagonal."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return 0
    differ = np.flatnonzero(doc[lo + diagonal : hi + diagonal] != item[lo:hi])
    return int(np.diff(np.r_[-1, differ, hi - lo]).max()) - 1


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 10, k: int = 5, max_item_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, n_words): documents sharing at least ``run`` consecutive words with an item.

    n_words is the longest shared run.  Null and empty texts, and texts of
    fewer than ``run`` words, share nothing.  Repeated documents come out once
    per id; one row per pair.  The bytes of the item texts are counted before
    they are sent to the workers; a set of more than ``max_item_bytes`` is cut
    into blocks below it by hash, each of which reads the corpus once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    rows = spread(rows)
    source = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).dropna()
    size = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // max_item_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, 2 * blocks)))  # twice as many, so that an uneven one fits too
    out = None
    for b in range(2 * blocks if blocks > 1 else 1):
        part = source.filter(block == b) if blocks > 1 else source
        one = _leaked(spark, rows, [(r["item_id"], words_of(r["text"])) for r in part.collect()], run, k)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def _leaked(spark, rows: DataFrame, listed: list[tuple[int, list[str]]], run: int, k: int) -> DataFrame:
    listed = [(i, w) for i, w in listed if len(w) >= run]
    names = sorted({s for _, w in listed for s in shingles(w, k)})
    order = {s: i for i, s in enumerate(names)}
    width = run - k + 1
    sent = spark.sparkContext.broadcast(order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, totals = sent.value, {}
        first = {s[0] for s in order}
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            for doc, t in zip(*(batch.column(i).to_pylist() for i in range(2))):
                words = words_of(t)
                if first.isdisjoint(words):
                    continue
                hits = [(at, i) for at, s in enumerate(zip(*(words[i:] for i in range(k)))) if (i := order.get(s)) is not None]
                for _, i in hits:
                    totals[i] = totals.get(i, 0) + 1
                if any(hits[j + width - 1][0] - hits[j][0] == width - 1 for j in range(len(hits) - width + 1)):
                    for column, value in zip(found, (doc, len(words), [at for at, _ in hits], [i for _, i in hits])):
                        column.append(value)
            yield _scanned(*found, [None] * len(found[0]), [None] * len(found[0]))
        none = [None] * len(totals)
        yield _scanned(none, none, none, none, list(totals), list(totals.values()))

    # A few numbers a candidate document, and one row a partition and shingle of the items.
    scanned = checkpointed(rows.mapInArrow(scan, "doc_id long, words int, at array<int>, s array<int>, counted int, n long"))
    counts = {names[r["counted"]]: r["n"] for r in scanned.filter("counted is not null").groupBy("counted").agg(F.sum("n").alias("n")).collect()}
    texts = dict(enumerate(w for _, w in listed))
    tokens: dict[int, dict[int, list[int]]] = {}
    for s, where in prefix_tokens(texts, k, run, counts).items():
        for item, pos in where:
            tokens.setdefault(order[s], {}).setdefault(item, []).append(pos)
    coded = [np.array([order[s] for s in shingles(w, k)], dtype=np.int32) for _, w in listed]
    prefix = spark.sparkContext.broadcast((tokens, coded, [i for i, _ in listed]))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, coded, ids = prefix.value
        fresh: dict[tuple[int, int, int], list[int]] = {}

        def begins(before: int, i: int, item: int) -> list[int]:
            """Places of token i in the item whose diagonal the hit of the document position before has not named."""
            key = (before, i, item)
            if key not in fresh:
                if len(fresh) > 1_000_000:
                    fresh.clear()
                known = {p + 1 for p in tokens[before].get(item, ())}
                fresh[key] = [p for p in tokens[i][item] if p not in known]
            return fresh[key]

        for pdf in batches:
            found = []
            for doc, n, at, s in zip(pdf["doc_id"], pdf["words"], pdf["at"], pdf["s"]):
                codes = np.full(n - k + 1, -1, dtype=np.int32)
                codes[at] = s
                tried: set[tuple[int, int]] = set()
                best: dict[int, int] = {}
                last, before = -2, -1
                for a, i in zip(np.asarray(at).tolist(), np.asarray(s).tolist()):
                    follows, last = a == last + 1 and before in tokens, a
                    for item, places in tokens.get(i, {}).items():
                        length = len(coded[item]) + k - 1
                        if best.get(item) == length:  # wholly there
                            continue
                        for pos in begins(before, i, item) if follows else places:
                            d = a - pos
                            # Length and position: some window of `run` words around the hit lies in both texts.
                            lo, hi = max(0, -d, pos + k - run), min(length, n - d, pos + run)
                            if hi - lo >= run and (item, d) not in tried:
                                tried.add((item, d))
                                same = longest_run(codes, coded[item], d) + k - 1
                                if same >= run:
                                    best[item] = max(same, best.get(item, 0))
                    before = i
                found += [(doc, ids[item], same) for item, same in best.items()]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "n_words"])

    return scanned.filter("counted is null").select("doc_id", "words", "at", "s").mapInPandas(join, "doc_id long, item_id long, n_words int")


def _scanned(doc: list, words: list, at: list, s: list, counted: list, n: list) -> pa.RecordBatch:
    lists = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int32(), lists, lists, pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip((doc, words, at, s, counted, n), kinds)], ["doc_id", "words", "at", "s", "counted", "n"])
