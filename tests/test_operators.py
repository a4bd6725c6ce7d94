import math

import pytest
from pyspark.sql import functions as F

from skein.functions import scalar as S
from skein.operators import checks as K
from skein.operators import feedback as L
from skein.operators import graph as G
from skein.operators import history as H
from skein.operators import merging as M
from skein.operators import retrieval as R
from skein.operators import scopes as C
from skein.operators import stats as T
from skein.operators import textops as X


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_paths_and_words(spark):
    df = spark.createDataFrame([("src/auth/test_login.py", "Fix the login_flow of Auth"), ("README.md", None), (None, "")], "p string, t string")
    got = df.select(S.top_module("p"), S.module_at("p", 1), S.leaf_dir("p"), S.is_test_file("p"), F.array_join(S.task_words("t"), " "), F.array_join(S.path_words("p"), " ")).collect()
    assert tuple(got[0]) == ("src", "auth", "auth", True, "auth login_flow", "auth login src test")
    assert tuple(got[1])[:4] == (None, "README.md", "README.md", False)
    assert got[2][4] == ""


def test_route_matching(spark):
    df = spark.createDataFrame([("/api/users/{id}", "/api/users/7", "h"), ("/api/v1/users", "/users", "h"), ("/docs", "/my-document-types/", "DocumentTypeViewSet"), ("/a", "/b", "")], "p string, c string, h string")
    got = [r[0] for r in df.select(S.route_confidence("p", S.route_regex("p"), "c", "h")).collect()]
    assert got == [1.0, 0.8, 0.5, 0.0]


def test_couplings_and_contracts(spark):
    files = spark.createDataFrame([(c, f) for c in range(6) for f in ("a", "b")] + [(9, "a"), (10, "z"), (None, "a")], "commit_id int, file string")
    assert rows(H.couplings(files)) == [("a", "b", 6, 1.0)]
    assert ("b", "a", 6, 1.0) in rows(H.contracts(files))
    assert rows(H.couplings(files.limit(0))) == []
    wide = spark.createDataFrame([(c, f"f{i}") for c in range(3) for i in range(50)], "commit_id int, file string")
    assert H.couplings(wide, most_files=20, top=None).count() == 0


@pytest.mark.parametrize("max_sent", [0, 1000])
def test_closure_of_a_cycle(spark, max_sent):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i, "m") for i in range(1, 8)], "id long, module string")
    got = {(r.root, r.node) for r in G.closure(edges, nodes, max_sent=max_sent).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 4), (5, 6)}
    assert G.closure(edges.limit(0), nodes, max_sent=max_sent).count() == 0
    assert {tuple(r) for r in G.closure(edges, nodes.filter("id = 1"), 2, max_sent).collect()} == {(1, 2, 1), (1, 3, 2)}


def test_flow_chain_does_not_loop(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    got = rows(G.flow_chains(edges, spark.createDataFrame([(1,), (3,)], "id long")))
    assert got == [(1, 2, "1>2>3"), (3, 0, "3")]


def greedy(items, budget):
    took = []
    for k, t in items:
        if t <= budget:
            budget -= t
            took.append(k)
    return took


@pytest.mark.parametrize("seed", range(4))
def test_greedy_fill_against_a_loop(spark, seed):
    import random

    rng = random.Random(seed)
    items = [(f"{i:04d}", rng.choice([0, 1, 2, 3, 7, 50, 99, 120])) for i in range(400)]
    df = spark.createDataFrame([("g", k, t) for k, t in items], "g string, k string, t long")
    got = sorted(r.k for r in R.greedy_fill(df, ["g"], [F.col("k")], "t", 100, "k").collect())
    assert got == sorted(greedy(items, 100))


def test_bm25_and_cosine(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta"), (3, None), (4, "")], "id long, t string")
    got = R.bm25(docs, "id", "t", "alpha alpha")
    assert [r.id for r in got.collect()] == [1]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    assert [tuple(r) for r in R.cosine_top(vec, "id", "v", [2.0, 0.0]).collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_rrf_of_one_sided_lists(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    got = R.rrf(a, a.limit(0), "id").collect()
    assert [r.id for r in got] == [1, 2] and math.isclose(got[0].score, round(1 / 60 + 1 / 160, 6))


def test_scope_expressions(spark):
    make = lambda *fs: spark.createDataFrame([(f, i, 1.0) for i, f in enumerate(fs)], "file string, ord long, score double")
    named = {"a": make("x", "y"), "b": make("y", "z"), "c": make("x")}
    got = C.compose("a + b - c", named).orderBy("ord").collect()
    assert [r.file for r in got] == ["y", "z"]
    assert C.compose("a@context + c", named).count() == 1
    assert C.parse("a-b & c") == [("+", "a", None), ("-", "b", None), ("&", "c", None)]
    for bad in ("", "a@nothing"):
        with pytest.raises(ValueError):
            C.parse(bad)


def test_next_within_takes_the_first(spark):
    left = spark.createDataFrame([(1, "u", 0.0), (2, "u", 95.0), (3, "v", 0.0)], "id long, k string, t double")
    right = spark.createDataFrame([(7, "u", 0.0), (8, "u", 99.0), (9, "u", 101.0), (6, "w", 1.0)], "cid long, k string, t double")
    got = rows(L.next_within(left, right, ["k"], "t", 100, ["cid"]).select("id", "cid", "delta"))
    assert got == [(1, 7, 0.0), (2, 8, 4.0)]


def test_utility_counts(spark):
    s = spark.createDataFrame([("s1", 1.0, ["a", "b"]), ("s2", 2.0, ["a", "c"])], "session_id string, ts double, predicted_files array<string>")
    c = spark.createDataFrame(
        [("c1", "s1", 3.0, ["a"], [], 1.0, 1.0), ("c2", "s2", 4.0, ["a", "c"], [], 1.0, 1.0)],
        "commit_id string, session_id string, ts double, actual_files_modified array<string>, touched_not_predicted array<string>, recall double, precision double",
    )
    got = {r.file: (r.resolves, r.touches, r.ratio) for r in L.utility(s, c).collect()}
    assert got == {"a": (2, 2, 1.0), "b": (1, 0, 0.0), "c": (1, 1, 1.0)}


def test_contract_breaks_both_ways(spark):
    touched = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (3, "b")], "commit_id long, file string")
    contracts = spark.createDataFrame([("a", "b", 0.9), ("a", "q", 0.1)], "trigger string, coupled string, confidence double")
    assert [r[:2] + r[3:] for r in rows(K.contract_breaks(touched, contracts))] == [(1, "contract", "a", "b"), (2, "contract", "b", "a")]


def test_statistics(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("g", None)], "g string, v double")
    assert rows(T.nearest_rank(df, ["g"], "v", [50, 95, 100])) == [("g", 100, 9.0), ("g", 50, 5.0), ("g", 95, 9.0)]
    w = T.wilson(df.filter("v is not null"), ["g"], F.col("v") >= 5).first()
    assert (w.n, w.rate) == (10, 50.0) and 23 < w.ci_lower < 24 and 76 < w.ci_upper < 77
    b = T.bootstrap(df.withColumn("k", F.monotonically_increasing_id()), "g", "k", "v", 400).first()
    assert b.n == 10 and b.mean == 4.5 and 2 < b.ci_lower < 4.5 < b.ci_upper < 7
    assert T.bootstrap_exact([1.0, 1.0, 1.0], 50) == (1.0, 1.0, 1.0)


def test_merging(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, t string")
    b = spark.createDataFrame([("x", "2"), ("w", "1"), ("z", None)], "k string, t string")
    assert rows(M.entity_diff(a, b, ["k"], "t")) == [("w", "ADD"), ("x", "MODIFY"), ("y", "REMOVE")]
    assert rows(M.conflicts(a, b, ["k"], "t")) == [("x", "conflict"), ("z", "commutes")]
    k = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k string")
    assert rows(M.three_way(k("a", "b", "c"), k("a", "b", "d"), k("a", "c", "d"), ["k"])) == [("a",), ("d",)]


def test_sections_and_signals(spark):
    df = spark.createDataFrame([(1, "intro\n# One\r\nx\ny\n## Two\n"), (2, None), (3, "")], "id long, t string")
    assert rows(X.markdown_sections(df, "id", "t")) == [(1, 0, "Introduction", 1), (1, 1, "One", 2), (1, 2, "Two", 1), (3, 0, "Introduction", 1)]
    code = spark.createDataFrame([(1, "x = 1  # TODO: later\n// warning keep\n# note")], "id long, t string")
    assert [(r.signal, r.priority) for r in X.signal_comments(code, "id", "t").orderBy("no").collect()] == [("TODO", 5), ("WARNING", 10), ("NOTE", 6)]


def test_line_chunks_stop_at_the_end(spark):
    df = spark.createDataFrame([(n, "\n".join("x" * 1 for _ in range(n))) for n in (1, 99, 100, 101, 190, 191)], "id long, t string")
    got = {}
    for r in X.line_chunks(df, "id", "t").collect():
        got.setdefault(r.id, []).append((r.first, r.n_lines))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 1)], 99: [(0, 99)], 100: [(0, 100)], 101: [(0, 100), (90, 11)], 190: [(0, 100), (90, 100)], 191: [(0, 100), (90, 100), (180, 11)]}
