import random

import numpy as np
import pytest

from skein.llm.leaks import leaked_items, longest_run, prefix_tokens, words_of

DOCS = "doc_id long, text string, item_id string, n_words long"
ITEMS = "item_id long, text string"


def brute(docs, items, run=10):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = words_of(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def run(spark, docs, items, **more):
    got = [tuple(r)[:2] for r in leaked_items(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "text", **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", "x1", "ü", "и", "q", "zz"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(25)]
    docs = []
    for d in range(150):
        text = [word() for _ in range(rng.randrange(30))]
        if rng.random() < 0.6:
            w = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(w))
            text += w[a : a + rng.randrange(5, 30)] + [word()]
        docs.append((d, rng.choice([" ", "\n> ", "_", ", "]).join(text).upper(), None, None))
    assert run(spark, docs, items) == brute(docs, items)


def test_exactly_nine_and_ten_words(spark):
    item = [(1, " ".join(f"w{i}" for i in range(30)))]
    cut = lambda a, n: " ".join(f"W{i}" for i in range(a, a + n))
    docs = [(1, "x " + cut(3, 9) + " y", None, None), (2, cut(20, 10), None, None), (3, cut(0, 10) + "!", None, None), (4, cut(0, 9) + " z " + cut(9, 9), None, None)]
    assert run(spark, docs, item) == {(2, 1), (3, 1)}


def test_repeated_words_nulls_and_empty(spark):
    item = [(1, "no " * 12), (2, None), (3, ""), (None, "no " * 12)]
    docs = [(1, "no " * 11, None, None), (2, None, None, None), (3, "", None, None), (4, "no " * 9, None, None), (1, "no " * 11, None, None), (5, "no " * 20_000, None, None)]
    assert run(spark, docs, item) == {(1, 1), (5, 1)}
    assert run(spark, [], item) == set() and run(spark, docs, []) == set()


def test_items_in_blocks_find_the_same(spark):
    items = [(i, " ".join(f"w{i}_{k}" for k in range(12))) for i in range(9)]
    docs = [(i, t, None, None) for i, t in items]
    assert run(spark, docs, items, max_item_bytes=150) == run(spark, docs, items) == {(i, i) for i in range(9)}


def test_prefix_is_the_rarest_shingle():
    w = [f"w{i}" for i in range(11)]
    counts = {tuple(w[i : i + 5]): 10 - i for i in range(7)}
    assert prefix_tokens({0: w}, 5, 10, counts) == {tuple(w[5:10]): [(0, 5)], tuple(w[6:11]): [(0, 6)]}
    assert longest_run(np.array([9, 1, 2, 3, 7]), np.array([1, 2, 3]), 1) == 3
    assert longest_run(np.array([1, 2, 8, 3, 4, 5]), np.array([1, 2, 3, 3, 4, 5, 6]), 0) == 3
    assert longest_run(np.array([1]), np.array([1]), 4) == 0


def test_repetitive_texts_do_not_blow_up(spark):
    item = [(1, "no " * 2_000), (2, "yes " + "no " * 2_000 + "yes")]
    docs = [(1, "no " * 200_000, None, None), (2, "no " * 1_999, None, None)]
    assert run(spark, docs, item) == {(1, 1), (2, 1), (1, 2), (2, 2)}
