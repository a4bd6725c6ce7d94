import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.operators import chunks as Y
from skein.operators import context as X
from skein.operators import structure as U
from skein.operators.globs import exclude_paths, include_paths
from skein.sources import config, repo, sinks


def test_yaml_round_trip():
    text = 'description: Auth # note\nincludes:\n  - src/auth/\n  - "a: b"\nexcludes: []\ncontext: |\n  ## One\n  keep: this\n\n  more\nmeta:\n  owner: x\n'
    got = config.parse_yaml(text)
    assert got == {"description": "Auth", "includes": ["src/auth/", "a: b"], "excludes": [], "context": "## One\nkeep: this\n\nmore", "meta": {"owner": "x"}}
    assert config.parse_yaml(config.to_yaml(got)) == got
    assert config.parse_yaml("") == {} and config.parse_yaml("# only\n") == {}
    with pytest.raises(ValueError, match="line 1"):
        config.parse_yaml("not yaml at all\n")


def test_scope_files(spark):
    got = config.scopes_frame(spark, {"a/.scope": "description: A\nincludes:\n  - x/\n", "b/.scope": "description: B\nincludes: y\n"}).collect()
    assert [(r.path, r.description, r.includes, r.excludes) for r in got] == [("a/.scope", "A", ["x/"], []), ("b/.scope", "B", ["y"], [])]


def test_walk_and_decode(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_bytes(b"\xef\xbb\xbfx = 1")
    (tmp_path / "b.py").write_bytes("ü".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.encoding, r.used_replacement) for r in repo.decode_bytes(repo.walk(spark, str(tmp_path), "*.py")).collect()}
    assert got == {"a.py": ("x = 1", "utf-8-sig", False), "b.py": ("�", "utf-8", True)}


def test_numstat(spark, tmp_path):
    log = "abcdef1|2025-01-02T03:04:05+00:00|fix | it\n\n3\t1\tsrc/a.py\n-\t-\tlogo.png\nabcdef2|2025-01-01T00:00:00+00:00|first\n\n10\t0\tb.py\n"
    (tmp_path / "log").write_text(log)
    got = {(r.hash, r.path): (r.ins, r.dels, r.message) for r in repo.git_numstat(spark, str(tmp_path / "log")).collect()}
    assert got == {("abcdef1", "src/a.py"): (3, 1, "fix | it"), ("abcdef1", "logo.png"): (0, 0, "fix | it"), ("abcdef2", "b.py"): (10, 0, "first")}
    assert repo.git_numstat(spark, str(tmp_path / "log"), 1).select("hash").distinct().count() == 1


def test_name_status(spark):
    df = spark.createDataFrame([(1, "M\ta.py\nA\tb.py\r\nD\tc.py\nR090\told.py\tnew.py\nnoise\n"), (2, None)], "k long, t string")
    assert [(r.change, r.path, r.old) for r in repo.name_status(df, "k", "t").collect()] == [("changed", "a.py", None), ("added", "b.py", None), ("deleted", "c.py", None), ("renamed", "new.py", "old.py")]


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in repo.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id long").collect()) == [1, 2]
    assert repo.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id long", bad="keep").count() == 3


def test_globs(spark):
    df = spark.createDataFrame([("a/b.py",), ("vendor/x.go",), ("a/gen/c.ts",), ("z.min.js",), (None,)], "path string")
    assert sorted(r.path or "" for r in exclude_paths(df, "path", ["vendor/", "**/gen/*", "*.min.js"]).collect()) == ["", "a/b.py"]
    assert {(r.path, r.ord) for r in include_paths(df, ["path"], "path", ["*.py", "a"]).collect()} == {("a/b.py", 0), ("a/gen/c.ts", 1)}


def test_versions_upsert_and_json(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    sinks.write_version(a, str(tmp_path))
    sinks.write_version(sinks.upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], a.schema), ["k"]), str(tmp_path))
    assert sorted(tuple(r) for r in sinks.read_version(spark, str(tmp_path)).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(r.value for r in sinks.as_json(a).collect()) == ['{"k":1,"v":"x"}', '{"k":2,"v":null}']
    assert sinks.markdown_table(a, ["k"]).splitlines()[2] == "| 1 | x |"
    sinks.append_log(a, str(tmp_path / "log"))
    sinks.append_log(a, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_chunks_cover_the_text():
    text = ";".join(f"var v{i}={i}" for i in range(900))
    spans = Y.char_chunks(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[1] > a[1] and a[1] - a[0] <= 1500 for a, b in zip(spans, spans[1:]))
    assert Y.char_chunks("") == [] and Y.char_chunks(" " * 10) == []
    code = "import a\nimport b\n\n@x\ndef f():\n    pass\n\nclass C:\n    y = 1\n\nz = 2\n"
    assert Y.definition_chunks(code) == [(1, 2, "imports"), (4, 6, "function"), (8, 9, "class"), (11, 11, "block")]
    assert Y.definition_chunks("def f(:\n") == [(1, 2, "block")]


def test_chunk_frame(spark):
    df = spark.createDataFrame([(1, "a.py", "x = 1"), (2, "b.js", "a;" * 2000), (3, "c.go", "x\n" * 150), (4, "d.py", None), (5, None, "")], "id long, p string, c string")
    got = {(r.id, r.kind) for r in Y.chunk_files(df, "id", "p", "c").collect()}
    assert got == {(1, "block"), (2, "chars"), (3, "lines")}


def test_structure_and_imports(spark):
    df = spark.createDataFrame(
        [("r", "a/x.py", "import os\nfrom .y import f\nclass A:\n    @p.q\n    def m(self):\n        if a: pass\n"), ("r", "a/y.py", "def f(:"), ("r", "w/z.ts", "import { a } from './q';\nexport class B {}\nconst g = (x) => x;"), ("r", "n.txt", "x"), ("r", "m.rs", None)],
        "repo string, path string, content string",
    )
    got = {r.path: r for r in U.file_structure(df, ["path"], "path", "content").collect()}
    assert got["a/x.py"].imports == ["os", ".y"] and got["a/x.py"].classes == ["A"] and got["a/x.py"].decorators == ["p.q"] and got["a/x.py"].complexity == 1
    assert not got["a/y.py"].parsed and not got["n.txt"].parsed and not got["m.rs"].parsed
    assert got["w/z.ts"].imports == ["./q"] and got["w/z.ts"].classes == ["B"] and got["w/z.ts"].functions == ["g"]
    files = spark.createDataFrame([("r", "a/y.py"), ("r", "w/q/index.ts"), ("r", "w/q.js"), ("r", "lib/k/__init__.py")], "repo string, path string")
    imports = spark.createDataFrame([("r", "a/x.py", ".y"), ("r", "w/z.ts", "./q"), ("r", "w/e/f.ts", "../q"), ("r", "a/x.py", "lib.k"), ("r", "a/x.py", "gone")], "repo string, path string, import string")
    resolved = {(r.path, r["import"]): r.target for r in U.resolve_imports(imports, files, "repo").collect()}
    assert resolved == {("a/x.py", ".y"): "a/y.py", ("w/z.ts", "./q"): "w/q.js", ("w/e/f.ts", "../q"): "w/q.js", ("a/x.py", "lib.k"): "lib/k/__init__.py"}


def test_context(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, hit string, rank int")
    one = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 9.0), ("a", "b", 5.0)], "hit string, file string, weight double")
    two = spark.createDataFrame([("b", "y", 1.0), ("b", "z", 2.0)], "hit string, file string, weight double")
    got = sorted(tuple(r) for r in X.expand_hits(hits, [one, two], 1).collect())
    assert got == [("q", "a", "x", 0), ("q", "b", "z", 1)]
    pairs = X.warning_pairs(spark.createDataFrame([(1, "Never call .delete(), use .deactivate() here\nnothing")], "k long, t string"), "k", "t")
    assert [tuple(r) for r in pairs.collect()] == [(1, "delete", "deactivate")]
    diffs = spark.createDataFrame([(1, "+ x.Deactivate(y)")], "k long, diff string")
    assert X.near_misses(pairs, diffs, "k").count() == 1
    docs = spark.createDataFrame([(1, "## History\nnever touch this file\n# Other\nalways run it twice\nshort"), (2, None)], "k long, t string")
    assert [(r.source, r.hint) for r in X.hint_lines(docs, "k", "t").orderBy("no").collect()] == [("git_history", "never touch this file"), ("hand_authored", "always run it twice")]


def test_streams(spark, tmp_path):
    from skein.streaming import stateful as R

    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    rows = [("f", "a", "claim", t(0), 600.0), ("f", "b", "claim", t(1), 600.0), ("f", "b", "claim", t(2), 600.0), ("f", "a", "renew", t(5), 600.0), ("f", "a", "release", t(6), 0.0), ("f", "b", "claim", t(7), 60.0), ("f", "a", "claim", t(9), 60.0)]
    spark.createDataFrame(rows, "file string, agent string, action string, at timestamp, ttl_s double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, agent string, action string, at timestamp, ttl_s double").parquet(str(tmp_path / "in"))
    got = [(r.agent, r.decision) for r in R.drained(R.lock_decisions(stream)).orderBy("at").collect()]
    assert got == [("a", "granted"), ("b", "refused"), ("b", "escalated"), ("a", "renewed"), ("a", "released"), ("b", "granted"), ("a", "granted")]
    bursts = R.drained(R.debounced(stream, "at", "90 seconds", ["file"], "agent")).orderBy("first").collect()
    assert [(r.n, r["items"]) for r in bursts] == [(3, ["a", "b"])] * 2  # the last burst is still open
    query = R.versioned(stream, str(tmp_path / "v"), lambda df: df.groupBy("agent").agg(F.count("*").alias("n")))
    query.awaitTermination()
    assert {r.agent: r.n for r in R.current_version(spark, str(tmp_path / "v")).collect()} == {"a": 4, "b": 3}
    jobs = spark.createDataFrame([(1, "r", "s"), (2, "r", None), (3, "q", "s"), (4, "q", "s"), (5, "r", "t")], "seq long, repo string, scope string")
    assert sorted(tuple(r) for r in R.coalesced_jobs(jobs, "seq", "repo", "scope").collect()) == [(2, "r", None), (3, "q", "s")]
