import random
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest

from skein.llm import pairs
from skein.llm.pairs import pairs_above_chance
from skein.llm.queries import _clean_paths

SCHEMA = "k string, r string, items array<string>, item string, n long"


def brute(rows, least, lift):
    n, single, pair = Counter(), Counter(), Counter()
    for k, r, items, *_ in rows:
        if k is None or r is None:
            continue
        s = {x for x in items or [] if x is not None}
        if s:
            n[k] += 1
        single.update((k, x) for x in s)
        pair.update((k, *p) for p in combinations(sorted(s), 2))
    return {(k, a, b, c, single[k, a], single[k, b], n[k]) for (k, a, b), c in pair.items() if c >= least and c * n[k] >= lift * single[k, a] * single[k, b]}


@pytest.mark.parametrize("item_block,record_block", [(1024, 16384), (4, 16384), (3, 10)])
def test_against_brute_force(spark, item_block, record_block):
    rng = random.Random(item_block)
    rows = []
    for i in range(400):
        base = rng.choice([["a", "b"], ["c", "d", "ä"], []])
        rows.append((rng.choice(["hot", "hot", "x"]), str(i), base + [f"i{rng.randrange(30)}" for _ in range(rng.randrange(4))] + [None] * rng.randrange(2), None, 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in pairs_above_chance(df, ["k"], "r", "items", 5, 2, item_block, record_block).collect()}
    assert got == brute(rows, 5, 2) and got


def test_hot_items_are_sent(spark):
    rng = random.Random(3)
    rows = [(rng.choice("gh"), str(i), rng.choice([["all", "p", "q"], ["all", "x"], ["p", "q"], ["all"]]) + [f"i{rng.randrange(9)}"], None, 0) for i in range(300)]
    got = {tuple(r) for r in pairs_above_chance(spark.createDataFrame(rows, SCHEMA), ["k"], "r", "items", 5, 1, least_hot=50).collect()}
    assert got == brute(rows, 5, 1) and any("all" in r for r in got)


def test_more_items_than_a_tile_holds(monkeypatch):
    monkeypatch.setattr(pairs, "_TILE", 7)
    rng = random.Random(4)
    left = pd.DataFrame([(rng.randrange(20), rng.randrange(9)) for _ in range(80)], columns=["rec", "item"]).drop_duplicates()
    right = pd.DataFrame([(rng.randrange(20), 100 + rng.randrange(9)) for _ in range(80)], columns=["rec", "item"]).drop_duplicates()
    for other in (right, None):
        want = Counter((a, b) for r in range(20) for a in left.item[left.rec == r] for b in (right if other is not None else left).item[(right if other is not None else left).rec == r] if other is not None or a < b)
        a, b, n = pairs._gram(left, other, 2)
        assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == {k: v for k, v in want.items() if v >= 2}


def test_a_hot_item_and_a_long_basket(spark):
    rows = [("g", str(i), ["all", f"x{i % 3}"], None, 0) for i in range(60)] + [("g", "long", [f"f{i:04d}" for i in range(3000)], None, 0)] + [("g", f"y{i}", ["p", "q"], None, 0) for i in range(6)]
    got = {tuple(r)[1:4] for r in pairs_above_chance(spark.createDataFrame(rows, SCHEMA), ["k"], "r", "items", 5, 3).collect()}
    assert got == {("p", "q", 6)}


def test_nothing_to_pair(spark):
    rows = [(None, "1", ["a", "b"], None, 0), ("k", None, ["a", "b"], None, 0), ("k", "2", None, None, 0), ("k", "3", [], None, 0), ("k", "4", [None], None, 0), ("k", "5", ["a", "a"], None, 0)]
    assert pairs_above_chance(spark.createDataFrame(rows, SCHEMA), ["k"], "r", "items", 1, 0).count() == 0
    assert pairs_above_chance(spark.createDataFrame([], SCHEMA), ["k"], "r", "items").count() == 0


def test_path_spelling(spark):
    df = spark.createDataFrame([(["./a//b.py", "a\\b.py", None, "a/b.py", "././c"],), (None,)], "f array<string>")
    assert [r[0] for r in df.select(_clean_paths("f")).collect()] == [["a/b.py", "./c"], None]
