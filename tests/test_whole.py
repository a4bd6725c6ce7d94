"""Composed queries over hand-made tables: every branch of the job must come out."""

import pytest
from pyspark.sql import functions as F

from skein.registry import core_queries

SCHEMAS = {
    "file_analyses": "file_id long, repo string, path string, language string, content string, imports array<string>, exports array<string>, is_init boolean, node_count long, docstring string, is_entry_point boolean",
    "session_logs": "session_id string, repo string, timestamp double, scope_expr string, task string, predicted_files array<string>, context_hash string, constraints_surfaced array<string>",
    "observation_logs": "commit_hash string, repo string, session_id string, actual_files_modified array<string>, predicted_not_touched array<string>, touched_not_predicted array<string>, recall double, precision double, timestamp double",
    "swarm_locks": "agent_id string, task_description string, primary_files array<string>, exclusive_files array<string>, shared_files array<string>, created_at double, expires_at double, lock_id string",
}


@pytest.fixture
def write(spark, tmp_path):
    def put(**tables):
        for name, kind in SCHEMAS.items():
            df = spark.createDataFrame(tables.get(name, []), kind).withColumn("recorded_at", F.lit("2025-01-01").cast("timestamp_ntz"))
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def file(i, path, imports=(), content="x\n"):
    return (i, "r", path, None, content, list(imports), [], False, None, None, False)


def commit(name, files, at, session=None):
    return (name, "r", session, files, [], [], 1.0, 1.0, at)


def lock(name, exclusive, shared, start, end, agent="a"):
    return (agent, None, [], exclusive, shared, start, end, name)


def test_preflight_counts_the_locks_that_are_alive(spark, write):
    d = write(
        observation_logs=[commit("c1", ["x/a"], 10.0), commit("c2", ["x/b"], 10.0), commit("c3", ["x/a"], 30.0), commit("c4", ["y/p.py"], 10.0), commit("c5", ["z/q"], 20.0)],
        swarm_locks=[lock("l1", ["x/a"], None, 5.0, 20.0), lock("l2", None, ["x/b", None], 5.0, 20.0), lock("l3", ["x/a"], [], 1.0, 11.0, "b"), lock("l4", ["z/q"], [], 5.0, 20.0)],
        file_analyses=[file(1, "y/p.py"), file(2, "y/p.ts")],
    )
    got = {r["claim"]: (r["n_partners"], r["n_consumers"], r["n_locks"], r["risk"]) for r in core_queries()["JN38_preflight_locks"](spark, d).collect()}
    assert got == {"c1": (0, 0, 1, "high"), "c2": (0, 0, 1, "high"), "c3": (0, 0, 0, "low"), "c4": (0, 1, 0, "medium"), "c5": (0, 0, 0, "low")}


def test_blast_radius_takes_partners_and_network_links(spark, write):
    pairs = [commit(f"c{i}", ["m/a.py", "n/b.py"], 1.0) for i in range(3)] + [commit(f"d{i}", ["k/other"], 1.0) for i in range(5)]
    d = write(
        observation_logs=pairs,
        file_analyses=[file(1, "m/a.py"), file(2, "n/b.py"), file(3, "u/b/user.js", ["import x from './n'"]), file(5, "s/p/c.go"), file(6, "s/p/c.ts")],
    )
    got = {(r["group"], r["id"], r["ring"]) for r in core_queries()["JN23_blast_radius_coupled"](spark, d).collect()}
    assert got == {("r/m", 2, "exclusive"), ("r/n", 1, "exclusive"), ("r/n", 3, "exclusive"), ("r/m", 3, "shared")}


def test_rebuild_gives_the_derived_tables(spark, write):
    d = write(
        session_logs=[(f"s{i}", "r", 1.0, None, None, ["m/a.py"], None, []) for i in range(3)],
        observation_logs=[(f"c{i}", "r", f"s{i}", ["n/b.py"], [], ["n/b.py"], 0.0, 0.0, 2.0) for i in range(3)],
        file_analyses=[file(1, "m/a.py"), file(2, "n/b.py")],
    )
    rows = core_queries()["PIPE15_rebuilt_state"](spark, d).collect()
    assert {(r["state"], r["file"], r["resolves"], r["touches"]) for r in rows if r["state"] == "utility"} == {("utility", "m/a.py", 3, 0), ("utility", "n/b.py", 0, 3)}
    assert {(r["trigger"], r["file"], r["n"]) for r in rows if r["state"] == "lesson"} == {("resolved_never_touched", "m/a.py", 3), ("touched_not_predicted", "n/b.py", 3)}
    assert {(r["src_module"], r["dst_module"]) for r in rows if r["state"] == "invariant"} == {("r/m", "r/n"), ("r/n", "r/m")}
