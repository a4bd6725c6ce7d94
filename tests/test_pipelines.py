"""Sources of whole repositories, structure beyond patterns, and the pipelines over small made-up repositories."""

import json

import pytest
from pyspark.sql import functions as F

from skein.operators import assertions, feedback, ingest, retrieval, structure
from skein.sources import config, repo, sinks
from skein.streaming import stateful


@pytest.fixture
def tree(tmp_path):
    texts = {
        ".gitignore": "*.log\n!keep.log\n/only_root.txt\nout/\n# note\n\na/**/z.py\n", "a/.gitignore": "local.py\n!inner/local.py\n", "x.log": "1", "keep.log": "1", "only_root.txt": "1", "a/only_root.txt": "1", "out/f.py": "1", "a/out/g.py": "1",
        "a/b/c/z.py": "1", "a/z.py": "1", "b/z.py": "1", "a/local.py": "1", "a/inner/local.py": "1", "b/local.py": "1", "node_modules/m.js": "1", "src/vendor/v.py": "1", "src/m.pyc": "1", ".git/config": "1", "src/m.py": "import os\n", "a/out.py": "1",
    }
    for name, text in texts.items():
        path = tmp_path / "r" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return f"file://{tmp_path}/r"


def test_walk_with_ignore_files(spark, tree):
    got = {r.path for r in repo.walk_repository(spark, tree).select("path").collect()}
    assert got == {".gitignore", "a/.gitignore", "keep.log", "a/only_root.txt", "b/z.py", "a/inner/local.py", "b/local.py", "src/m.py", "a/out.py"}
    assert {r.path for r in repo.walk_repository(spark, tree, below="src").collect()} == {"src/m.py"}


def test_logs_are_read_by_line(spark, tmp_path):
    h = [c * 40 for c in "abc"]
    (tmp_path / "n.txt").write_text(f"{h[0]}|2025-01-02T00:00:00+00:00|one|two\r\n\r\n3\t-\tx.py\r\n1\t2\ty.py\n{h[1]}|2025-01-01T00:00:00+00:00|second\n\n5\t5\tx.py\n")
    rows = repo.git_numstat(spark, str(tmp_path / "n.txt")).collect()
    assert {(r.hash[0], r.message, r.path, r.ins, r.dels) for r in rows} == {("a", "one|two", "x.py", 3, 0), ("a", "one|two", "y.py", 1, 2), ("b", "second", "x.py", 5, 5)}
    assert {r.hash[0] for r in repo.git_numstat(spark, str(tmp_path / "n.txt"), 1).collect()} == {"a"}
    (tmp_path / "f.txt").write_text(f"{h[0]}\tadd x\n\nz.py\na.py\n{h[1]}\t\n\nb.py\n{h[2]}\tempty\n")
    assert {(r.hash[0], r.message, tuple(r.files)) for r in repo.git_files(spark, str(tmp_path / "f.txt")).collect()} == {("a", "add x", ("z.py", "a.py")), ("b", "", ("b.py",))}
    (tmp_path / "s.txt").write_text(f"{h[0]}\n\nR090\told.py\tnew.py\nM\tx.py\n{h[1]}\n\nA\told.py\n")
    assert {(r.hash[0], r.change, r.path, r.old) for r in repo.git_renames(spark, str(tmp_path / "s.txt")).collect()} == {("a", "renamed", "new.py", "old.py"), ("a", "changed", "x.py", None), ("b", "added", "old.py", None)}


def test_json_lines_up_to_the_first_bad_one(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n{"a": 4}\n')
    read = lambda bad: [r.a for r in repo.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int", bad).collect()]
    assert sorted(read("stop")) == [1, 2] and sorted(read("skip")) == [1, 2, 4] and len(read("keep")) == 4


def test_saved_pages_and_watching(spark, tmp_path):
    page = [{"number": 1, "title": "x", "closed_at": "d", "merged_at": "d", "labels": [{"name": "Bug"}]}, {"number": 2, "title": "y", "closed_at": "d", "merged_at": None, "labels": [{"name": "bug"}]}, {"number": 3, "title": "z", "closed_at": "d", "merged_at": "d", "labels": []}]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/1.json").write_text(json.dumps(page))
    assert [r.number for r in repo.read_pull_pages(spark, str(tmp_path / "pages")).collect()] == [1]
    (tmp_path / "w").mkdir()
    for n in ("a.py", "b.txt", "c.rs"):
        (tmp_path / "w" / n).write_text("1")
    seen = repo.watch(spark, str(tmp_path / "w")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    seen.awaitTermination()
    assert {r.path.rsplit("/", 1)[1] for r in spark.table("seen").collect()} == {"a.py", "c.rs"}


def test_rule_files(spark):
    text = 'voice:\n  tone: terse\nintents:\n  - directive: freeze\n    modules: [core, "a b"]\n    reason: "no # change"\n  - directive: deprecate\n    files:\n      - x.py\n      - y.py\n    target: z.py\nconventions:\n  - name: handlers\n    match_file_path: _handler\n    rule_imports: [base]\nassertions:\n  - scope: core\n    ensure_includes: [core/a.py]\n  - ensure_context_contains: [Retry]\n    ensure_constraints: true\n'
    assert [tuple(r) for r in config.intents_frame(spark, text).collect()] == [("freeze", ["core", "a b"], [], None, "no # change"), ("deprecate", [], ["x.py", "y.py"], "z.py", None)]
    assert [tuple(r) for r in config.conventions_frame(spark, text).collect()] == [("handlers", {"file_path": "_handler"}, {"imports": "base"})]
    assert config.voice_config(text) == {"tone": "terse"} and config.parse_items("", "intents") == []
    rules = config.assertions_frame(spark, text)
    results = spark.createDataFrame([("core", "we RETRY", 0), ("x", None, None), ("y", "retry", 2)], "scope string, context string, n_constraints int")
    assert {tuple(r) for r in assertions.failed_assertions(results, rules).collect()} == {("core", "constraints", "no constraint"), ("x", "constraints", "no constraint"), ("x", "context", "Retry")}
    assert {tuple(r) for r in assertions.required_files(results, rules).collect()} == {("core", "core/a.py")}


def test_use_trees_comments_and_calls():
    assert structure.expand_use("a::{b, c::{self, d as e}, f::*}") == ["a::b", "a::c", "a::c::d", "a::f::*"]
    assert structure.expand_use(" std :: io ") == ["std::io"] and structure.expand_use("a::{b") == ["a::b"] and structure.expand_use("{a, a, b}}") == ["a", "b"] and structure.expand_use("") == []
    assert structure.without_comments('a("// no") // yes\n/* b */ c').split() == ['a("//', 'no")', "c"]
    assert structure.http_calls("fetch(`/a/${id}?q=1`, { method: 'put', body }); axios.post('/b'); x.get('/no'); api.get(\"/c\")") == [("PUT", "/a/{}"), ("POST", "/b"), ("GET", "/c")]
    assert structure.analyze("x.sol", 'import {A} from "./a.sol"; contract B is A { function f() public {} event E(); } // contract C')[:3] == (["./a.sol"], ["B"], ["f", "E"])
    assert structure.analyze("x.rs", "use a::{b, c};\n// use z::q;\nstruct S;")[:2] == (["a::b", "a::c"], ["S"])
    for path, text, want in (("a.cs", "using System.IO;\n", "System.IO"), ("a.rb", "require 'json'\n", "json"), ("a.cpp", '#include "x.h"\n', "x.h"), ("a.kt", "import a.b.C\n", "a.b.C"), ("a.swift", "import UIKit\n", "UIKit"), ("a.php", "require_once('x.php');", "x.php")):
        assert structure.analyze(path, text)[0] == [want], path


def test_relative_imports_by_guess(spark):
    files = spark.createDataFrame([("r", p) for p in ("a/x.ts", "a/y/index.js", "b/z.py", "b/z.rs", "c.go")], "repo string, path string")
    raw = [("a/m.js", "./x", "a/x.ts"), ("a/m.js", "./y", "a/y/index.js"), ("a/m.js", "../b/z", "b/z.py"), ("a/m.js", "../../c.go", "c.go"), ("a/m.js", "./none", "./none"), ("a/m.js", "react", "react")]
    got = structure.resolve_relative(spark.createDataFrame([("r", p, i) for p, i, _ in raw], "repo string, path string, import string"), files, "repo").collect()
    assert {(r.path, r["import"], r.target) for r in got} == set(raw)


def test_functions_of_a_diff(spark):
    diff = "def lost():\ndiff --git a/x.py b/x.py\n+++ b/def.py\n@@ -1,2 +3,4 @@ def old(a):\n+def new(b):\n+    def new(c):\n-def gone():\n def same():\ndiff --git a/y.py b/y.py\r\n+async def late():\n"
    df = spark.createDataFrame([(1, diff), (2, None), (3, "")], "id int, t string")
    got = structure.modified_functions(df, "id", "t")
    assert {(r.id, r.file, tuple(r.functions)) for r in got.collect()} == {(1, "x.py", ("old", "new")), (1, "y.py", ("late",))}
    broken = spark.createDataFrame([(1, "x.py", "z.py"), (1, "y.py", "z.py")], "commit_id int, file string, other string")
    pairs = spark.createDataFrame([("x.py", "new", "z.py", "g", 0.8), ("x.py", "old", "z.py", "h", 0.6)], "file string, function string, other string, section string, confidence double")
    out = structure.fix_proposals(broken, got.withColumnRenamed("id", "commit_id"), pairs).collect()
    assert {(r.file, tuple(r.sections), r.confidence) for r in out} == {("x.py", ("g", "h"), 0.7), ("y.py", (), 0.5)}


FILES = [
    ("r", "api/app.py", "import core.base\nfrom core.util import x\n# WARNING: keep the order\n", "The entry point of the service."), ("r", "api/views.py", "from . import app\nimport api.app\n", None), ("r", "core/base.py", "import core.util\n", "short"), ("r", "core/util.py", "x = 1\n", None), ("r", "main.py", "import api.app\n", None),
    ("r", "web/a.js", "import b from './b'\nimport c from '../core/c'\n", None), ("r", "web/b.js", "", None), ("q", "core/util.py", None, None),
]
DOCS = [("r", "README", "readme", "intro of the api\n# Core\nhow it works\n# Empty\n\n# Other\nabout nothing"), ("r", "D", "architecture", "# Web\n\nthe WEB part"), ("s", "E", "readme", "no files here")]


@pytest.fixture
def parts(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, content string, docstring string")
    docs = spark.createDataFrame(DOCS, "repo string, source string, kind string, text string")
    touched = [("r", f"c{i}", float(i), f) for i in range(6) for f in ("api/app.py", "core/util.py", *(["docs/x.md"] if i < 4 else []))] + [("r", "d1", 9.0, "web/a.js")]
    return files, docs, spark.createDataFrame(touched, "repo string, commit_id string, ts double, file string")


def test_graph_from_contents(spark, parts):
    out = ingest.build_graph(parts[0])
    edges = {(r.src, r.dst) for r in out["edges"].collect()}
    assert edges == {("api/app.py", "core/base.py"), ("api/app.py", "core/util.py"), ("api/views.py", "api/app.py"), ("core/base.py", "core/util.py"), ("main.py", "api/app.py"), ("web/a.js", "web/b.js")}
    assert {(r.repo, r.module): (r.n_files, r.internal, r.external, r.cohesion) for r in out["modules"].collect()} == {("r", "api"): (2, 1, 2, 0.333333), ("r", "core"): (2, 1, 0, 1.0), ("r", "_root"): (1, 0, 1, 0.0), ("r", "web"): (2, 1, 0, 1.0), ("q", "core"): (1, 0, 0, 1.0)}


def test_absorbed_documents(parts):
    got = {(r.module, r.kind, r.source, r.priority, r.content) for r in ingest.absorb(parts[1], parts[0]).collect()}
    assert got == {
        ("api", "readme", "README", 5, "Introduction:\nintro of the api"), ("core", "readme", "README", 5, "Core:\nhow it works"), ("_root", "readme", "README", 5, "Other:\nabout nothing"), ("web", "architecture", "D", 7, "Web:\nthe WEB part"),
        ("_root", "readme", "E", 5, "Introduction:\nno files here"), ("api", "docstring", "api/app.py", 4, "The entry point of the service."), ("api", "comment", "api/app.py", 10, "keep the order"),
    }
    assert {(r.module, r.n, r.chars) for r in ingest.context_of(ingest.absorb(parts[1], parts[0]).filter("repo = 'r' and module = 'api'"), 45).collect()} == {("api", 2, 44)}


def test_ingest_ends_with_scopes_that_cover_what_changes(spark, parts, tmp_path):
    out = ingest.ingest(*parts)
    scopes = {(r.repo, r.module): r for r in out["scopes"].collect()}
    assert scopes["r", "api"].includes == ["api/", "core/base.py", "core/util.py", "docs/x.md"]
    assert scopes["r", "api"].related == ["_root", "core"] and scopes["r", "api"].tags == ["api", "core"]
    assert "- api/app.py -> core/util.py" in scopes["r", "api"].context and "imports from: core" in scopes["r", "api"].context
    assert scopes["q", "core"].context == "core: 1 files"
    assert {(r.module, r.commits, r.recall) for r in out["backtest"].collect()} == {("api", 6, 1.0), ("web", 1, 1.0)}
    assert {r.module: r.keywords for r in out["index"].filter("repo = 'q'").collect()} == {"core": ["core", "files"]}
    names = ["edges", "scopes", "contracts"]
    sinks.write_caches(str(tmp_path), {n: out[n] for n in names})
    back = sinks.read_caches(spark, str(tmp_path), [*names, "never"])
    assert set(back) == set(names) and back["edges"].count() == 6
    empty = ingest.ingest(*(df.limit(0) for df in parts))
    assert empty["scopes"].count() == 0 and empty["backtest"].count() == 0


def test_one_module_alone(parts):
    files, _, touched = parts
    edges = ingest.build_graph(files)["edges"]
    out = ingest.lazy_module(files, edges, touched, "r", "api")
    assert {r.path for r in out["files"].collect()} == {"api/app.py", "api/views.py"}
    assert {(r.link, r.path) for r in out["neighbours"].collect()} == {("imports", "core/base.py"), ("imports", "core/util.py"), ("imported by", "main.py")}
    assert [(r.file, r.commits) for r in out["history"].collect()] == [("api/app.py", 6)]


def test_corpus_replay_and_gates(spark):
    commits = [("c1", "r", "fix it", ["a.py", "b.py", None, "a.py"]), ("c2", "r", " ", ["x/a.py", "y/b.py", "tests/t.py"]), ("c3", "r", "t", ["tests/a.py", "tests/b.py"]), ("c4", "r", "one", ["a.py"]), ("c5", "q", "none", None)]
    tasks = ingest.corpus(spark.createDataFrame(commits, "commit_id string, repo string, message string, files array<string>"))
    assert {(r.commit_id, r.task, len(r.expected_tests)) for r in tasks.collect()} == {("c1", "fix it", 0), ("c2", "change x, y", 1)}
    ranked = spark.createDataFrame([("r", "a.py", 60, 0.9), ("r", "x/a.py", 60, 0.5), ("r", "b.py", 40, 0.4)], "repo string, file string, tokens long, score double")
    got = {r.commit_id: (r.recall, r.precision, r.n_predicted, r.touched_not_predicted) for r in ingest.replay(tasks, ranked, 100).collect()}
    assert got == {"c1": (1.0, 1.0, 2, []), "c2": (0.0, 0.0, 2, ["x/a.py", "y/b.py", "tests/t.py"])}
    obs = lambda rows: spark.createDataFrame(rows, "g string, recall double, touched_not_predicted array<string>")
    timings = spark.createDataFrame([("resolve", 100.0), ("resolve", 900.0), ("check", 10.0)], "operation string, duration_ms double")
    rows = ingest.gates(obs([("a", 0.9, []), ("a", 0.7, ["x"]), ("b", 0.5, None)]), obs([("a", 0.83, ["x"])]), timings, "g")
    verdict = {(r.g, r.gate): (r.value, r.threshold, r.passed) for r in rows.collect()}
    assert verdict["a", "correctness"] == (0.8, 0.81, False) and verdict["a", "freshness"] == (0.5, 1.0, True) and verdict["b", "correctness"] == (0.5, -0.02, True) and verdict["b", "freshness"] == (0.0, 1.0, True)
    assert verdict["a", "resolve_latency"] == (860.0, 500.0, False) and verdict["b", "check_latency"] == (10.0, 1000.0, True) and len(verdict) == 12
    scores = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.5, 0.5)], "g string, primary double, secondary double")
    fine = rows.filter("gate <> 'resolve_latency'")
    assert {r.g: r.fitness for r in ingest.fitness(fine, scores, "g").collect()} == {"a": 0.0, "b": 0.505}


def test_checks_over_the_last_commits(spark):
    commits = spark.createDataFrame([("r", f"c{i}", float(i)) for i in range(5)], "repo string, commit_id string, ts double")
    found = spark.createDataFrame([("c4", "hold"), ("c4", "note"), ("c3", "nudge"), ("c0", "hold")], "commit_id string, severity string")
    out = ingest.check_backtest(found, commits, 3)
    assert [tuple(r) for r in out.collect()] == [("r", 3, 1, 1, 2)]
    assert [r.line for r in ingest.summary_lines(out).collect()] == ["1 of 3 commits clean, 2 note(s), 1 would have been held"]
    assert ingest.report({"Checks": out}, {"Checks": [F.col("repo")]}).startswith("## Checks\n\n| repo | commits |")


def test_index_answers_as_the_documents_do(spark, tmp_path):
    docs = spark.createDataFrame([(1, "retry the queue queue"), (2, "the ledger"), (3, None), (4, ""), (5, "retry ledger retry")], "id long, t string")
    retrieval.build_index(docs, "id", "t", str(tmp_path))
    for query in ("retry queue", "ledger ledger the", "none of it", ""):
        assert retrieval.search_index(spark, str(tmp_path), "id", query).collect() == retrieval.bm25(docs, "id", "t", query).collect()


def test_search_with_neighbours_in_a_budget(spark):
    docs = spark.createDataFrame([(i, 10, "stable", 400.0 if i == 1 else 1.0) for i in range(1, 8)], "k long, tokens long, stability string, age_days double")
    side = lambda rows: spark.createDataFrame(rows, "k long, score double")
    near = spark.createDataFrame([(2, 5, 3), (2, 1, 9), (3, 6, 2)], "hit long, file long, weight long")
    out = retrieval.search(side([(1, 9.0), (2, 8.0)]), side([(2, 0.9), (3, 0.8)]), docs, [near], "k", 45, hits=3).collect()
    assert [r.k for r in sorted(out, key=lambda r: r.used)] == [2, 3, 1, 5]


def test_waiting_for_a_refresh(spark):
    state = {"n": 3}

    def pending():
        state["n"] -= 1
        if state["n"] == 1:
            raise OSError
        return state["n"] > 0

    assert stateful.wait_for_refresh(pending, 2.0, 0.001) == "fresh"
    assert stateful.wait_for_refresh(lambda: True, 0.01, 0.001) == "stale"
    healed = []
    assert stateful.wait_for_refresh(lambda: not healed, 0.01, 0.001, lambda: healed.append(1)) == "healed"
    jobs = spark.createDataFrame([("r", "running"), ("q", "done")], "repo string, state string")
    assert stateful.pending_jobs(jobs, "r")() and not stateful.pending_jobs(jobs, "q")()


def test_stale_scopes(spark):
    changed = spark.createDataFrame([("a", 1e6), ("b", 1e6), ("c", 1e6), ("d", 1e6)], "k string, changed double")
    refreshed = spark.createDataFrame([("a", 1e5), ("b", 950_000.0), ("c", 1e6)], "k string, refreshed double")
    assert {r.k: r.stale for r in feedback.stale_scopes(changed, refreshed, ["k"], 2e6, quiet_s=5e5).collect()} == {"a": True, "b": False, "c": False}
    assert {r.k: r.stale for r in feedback.stale_scopes(changed, refreshed, ["k"], 5e5, quiet_s=4.5e5).collect()}["a"] is False
