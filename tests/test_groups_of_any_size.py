"""Operators that cut hot groups, against brute force over one group that holds nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import checks, graph, merging, network, retrieval, scopes
from skein.operators.globs import glob_regex
from skein.operators.prefix import running


@pytest.mark.parametrize("how", ["sum", "max", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_over_pieces(spark, how, inclusive):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, rng.randrange(50)]), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at int, v long, _value string").withColumnRenamed("_value", "more")
    got = {r["at"]: r["r"] for r in running(df, ["g"], [F.col("at")], F.col("v"), "r", how, inclusive, partitions=7).collect()}
    for g in ("hot", "a", None):
        seen = []
        for _, at, v, _ in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            before = list(seen)
            if v is not None:
                seen.append(v)
            use = seen if inclusive else before
            assert got[at] == ({"sum": sum, "max": max, "last": lambda x: x[-1]}[how](use) if use else None), (g, at)
    assert running(df.limit(0), ["g"], [F.col("at")], F.col("v"), "r", how).count() == 0


def test_overlapping_and_prefix_fill(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 9 else "b", a := rng.randrange(1000), a + rng.randrange(5)) for i in range(300)]
    rows = sorted(set(rows))
    got = {tuple(r) for r in merging.overlapping(spark.createDataFrame(rows, "k string, s int, e int"), ["k"], "s", "e").collect()}
    want = set()
    for k in ("hot", "b"):
        reach = None
        for r in sorted(x for x in rows if x[0] == k):
            if reach is not None and r[1] < reach:
                want.add(r)
            reach = r[2] if reach is None else max(reach, r[2])
    assert got == want
    files = spark.createDataFrame([("g", i, 7) for i in range(100)], "g string, i int, t int")
    assert {r.i for r in retrieval.prefix_fill(files, ["g"], [F.col("i")], "t", 50).collect()} == set(range(7))


def test_lock_conflicts_of_a_hot_file(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        start = rng.uniform(0, 1e5)
        rows.append((f"l{i:03d}", f"a{rng.randrange(5)}", start, start + rng.choice([0.0, 1.0, 59.0, 60.0, 3600.0, 90_000.0, 1e9]), ["hot"] if i % 3 else ["x", None], ["hot", "y"] if i % 3 == 0 else None))
    df = spark.createDataFrame(rows, "lock_id string, agent string, created_at double, expires_at double, exclusive_files array<string>, shared_files array<string>")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1] and a[3] > a[2] and b[3] > b[2] and a[2] < b[3] and b[2] < a[3]:
                fa, fb = ({f: x for x, side in ((0, r[5]), (1, r[4])) for f in side or [] if f} for r in (a, b))
                kinds = [fa[f] + fb[f] for f in fa.keys() & fb.keys()]
                if kinds and max(kinds) >= 1:
                    want[a[0], b[0]] = "hard" if max(kinds) == 2 else "soft"
    assert {(r.lock_a, r.lock_b): r.kind for r in checks.lock_conflicts(df).collect()} == want and want
    touched = spark.createDataFrame([(f"c{i}", "hot", rng.uniform(-10, 1.2e5)) for i in range(60)] + [("n", "hot", None)], "commit_id string, file string, ts double")
    got = {(r.commit_id, r.detail) for r in checks.locked_changes(touched, df).collect()}
    assert got == {(c.commit_id, r[0]) for c in touched.collect() for r in rows if c.ts is not None and "hot" in r[4] and r[2] <= c.ts < r[3]}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_jaccard_against_all_pairs(spark, threshold):
    rng = random.Random(5)
    sets = [(i, ["hot"] + rng.sample("abcdefgh", rng.randrange(0, 8)) + [None] * rng.randrange(2)) for i in range(80)] + [(90, []), (91, None), (92, ["q"]), (93, ["q", "q"])]
    got = {r.k: r.kept for r in scopes.jaccard_dedup(spark.createDataFrame(sets, "k int, s array<string>"), "k", "s", threshold).collect()}
    clean = {k: {x for x in s or [] if x} for k, s in sets}
    want = {k: not any(j != k and (len(t), -j) > (len(s), -k) and len(s | t) and len(s & t) / len(s | t) > threshold for j, t in clean.items()) for k, s in clean.items()}
    assert got == want


def test_reach_counts_both_ways(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)})
    e = spark.createDataFrame(edges, "src long, dst long")
    n = spark.createDataFrame([(i, f"m{i % 4}") for i in range(28)], "id long, module string")
    sent = {tuple(r) for r in graph.reach_counts(e, n, n).collect()}
    joined = {tuple(r) for r in graph.reach_counts(e, n, n, max_sent=1).collect()}
    want = set()
    for root in range(28):
        seen, ring = set(), {root}
        while ring:
            ring = {b for a, b in edges if a in ring} - seen
            seen |= ring
        if seen:
            known = [x for x in seen if x < 28]
            want.add((root, len(seen), len(known), len({x % 4 for x in known}), sum(x % 4 == root % 4 for x in known)))
    assert sent == joined == want
    assert graph.reach_counts(e.limit(0), n).count() == 0


def test_routes_in_blocks_match_the_same(spark):
    routes = spark.createDataFrame([(f"/api/v1/x{i}", "GET", f"h{i}", f"^/api/v1/x{i}$") for i in range(9)], "route string, pm string, handler string, rx string")
    calls = spark.createDataFrame([(f"/x{i}", "get") for i in range(9)] + [(f"/api/v1/x{i}", "ALL") for i in range(9)], "call string, cm string")
    pairs = lambda most: {(r.route, r.call, r.confidence) for r in network.match_routes(routes, calls, most).collect()}
    assert pairs(3) == pairs(100) and len(pairs(3)) == 18


def test_pattern_classes():
    import re

    for pattern, yes, no in (("[ab]*.py", "a.py", "c.py"), ("x[!0-9].c", "xa.c", "x1.c"), ("[]]", "]", "["), ("a[", "a[", "a"), ("[^z]", "a", "z"), ("[a&&b]", "&", "c")):
        assert re.match(glob_regex(pattern), yes) and not re.match(glob_regex(pattern), no), pattern


def test_unknown_sizes_and_joins_do_not_ask_for_partitions(spark, tmp_path):
    from skein.common import parts_for, shuffle_parts

    df = spark.createDataFrame([(i, "x" * 50) for i in range(500)], "i int, s string")
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    joined = read.join(read.withColumnRenamed("s", "t"), "i").join(df, "i")
    for x in (df, read, joined, joined.checkpoint(), df.limit(0), read.groupBy("s").count()):
        assert parts_for(x) == shuffle_parts(spark)
    assert parts_for(read, part_bytes=64) > 10
