"""GR08 by folders: the same modules as by all pairs of files, without these pairs."""

import random

import pytest

from skein.operators import graph as G
from skein.registry import core_queries, core_sql

FILES = "file_id long, repo string, path string, language string, content string, imports array<string>, recorded_at timestamp"


def brute(edges, module):
    """Modules reached from each module over edges of files, less those of a direct edge."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for root in module:
        seen, todo = set(), list(after.get(root, ()))
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out |= {(module[root], module[x]) for x in seen if module[root] != module[x]}
    return out - {(module[a], module[b]) for a, b in edges}


def test_query_sends_no_adjacency_and_makes_no_pairs(spark, tmp_path, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("adjacency or pairs of files")

    monkeypatch.setattr(G, "_sent", refused)
    monkeypatch.setattr(G, "closure", refused)
    rng = random.Random(3)
    rows = [(i, rng.choice("rs"), f"{rng.choice('mnopq')}/{rng.choice('abcdefghijkl')}/f{i}.ts", [f"import x from './{rng.choice('abcdefghijklz')}'"] * rng.choice([0, 1, 1])) for i in range(50)]
    rows += [(100, "r", "top.ts", ["import x from './a'"]), (101, "r", None, ["import x from './b'", None]), (102, None, "m/a/x.ts", ["import x from './a'"]), (103, "r", "lone/self/x.ts", ["import x from './self'"])]
    spark.createDataFrame([(i, repo, path, None, None, imports, None) for i, repo, path, imports in rows], FILES).write.parquet(str(tmp_path / "file_analyses.parquet"))
    word = {i: {w.split("./")[1][:-1] for w in imports if w} for i, _, _, imports in rows}
    lies = {i: path.split("/")[-2] if path and "/" in path else None for i, _, path, _ in rows}
    repo = {i: r for i, r, _, _ in rows}
    edges = [(a, b) for a in word for b in word if a != b and repo[a] is not None and repo[a] == repo[b] and lies[b] in word[a]]
    module = {i: f"{r}/{path.split('/')[0] if path and '/' in path else ''}" for i, r, path, _ in rows if r is not None}
    want = {}
    for m, dep in sorted(brute(edges, module)):
        want.setdefault(m, []).append(dep)
    got = {tuple(r) for r in core_queries()["GR08_deep_dependencies"](spark, str(tmp_path)).collect()}
    assert got == {(m, dep) for m, deps in want.items() for dep in deps[:5]} and len(got) > 3


@pytest.mark.parametrize("every", [2, 100])
def test_long_chain_and_cycle(spark, every):
    chain = [(f"m{i}", f"v{i}", f"v{i + 1}") for i in range(9)] + [("m9", "v9", None), ("x", "v0", "nowhere"), (None, "v2", "v3"), ("y", None, "v8"), ("z", "v1", "v1")]
    got = {tuple(r) for r in G.deep_modules(spark.createDataFrame(chain + chain, "module string, via string, next string"), every).collect()}
    far = {(f"m{i}", f"m{j}") for i in range(9) for j in range(i + 2, 10)}
    assert got == far | {("y", "m9")} | {("z", f"m{j}") for j in range(2, 10)}
    assert G.deep_modules(spark.createDataFrame(chain, "module string, via string, next string").limit(0), every).count() == 0


def test_query_gives_more_than_five(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, "r", f"m{i}/v{i}/x.ts", None, None, [f"import x from './v{i + 1}'"], None) for i in range(9)]
    spark.createDataFrame(rows, FILES).write.parquet(str(tmp_path / "file_analyses.parquet"))
    got = {tuple(r) for r in core_queries()["GR08_deep_dependencies"](spark, str(tmp_path)).collect()}
    assert got == {(f"r/m{i}", f"r/m{j}") for i in range(9) for j in range(i + 2, 9)} and sum(m == "r/m0" for m, _ in got) == 7
    con = duckdb.connect()
    con.execute(f"create view file_analyses as select *, null as exports, null as node_count, null as docstring, null as is_entry_point from '{tmp_path}/file_analyses.parquet/*.parquet'")
    assert got == set(con.sql(core_sql()["GR08_deep_dependencies"]).fetchall())
