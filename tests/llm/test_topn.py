import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.llm.topn import _beaten_dropped, _best, _plan, _survivors, top_n_per_group

SCHEMA = "id long, g string, h string, s double, _score string, path string"


def brute(rows, n):
    by = {}
    for i, g, h, s, *_ in rows:
        if None not in (i, g, h, s) and not math.isnan(s):
            by.setdefault((g, h), []).append((-s, i))
    return {(g, h, i, -s) for (g, h), v in by.items() for s, i in sorted(v)[:n]}


def run(spark, rows, n, parts=4):
    got = [tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "s", "id", n, parts).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed,parts", [(0, 1), (1, 5), (2, 16)])
def test_against_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", rng.choice("ab"), rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), None, None) for i in range(4000)]
    assert run(spark, rows, 5, parts) == brute(rows, 5)


def test_all_scores_tie_over_many_files(spark):
    rows = [(i, "g", "h", 1.0, "x", "y") for i in range(3000)]
    assert {r[2] for r in run(spark, rows, 5, 8)} == {0, 1, 2, 3, 4}


def test_row_groups_are_skipped(spark):
    rows = [(i, "g", "h", float(i), None, None) for i in range(60_000)]
    assert {r[2] for r in run(spark, rows, 3, 2)} == {59_999, 59_998, 59_997}


def test_nulls_nan_empty_and_infinite(spark):
    rows = [(1, None, "h", 1.0, None, None), (2, "g", None, 1.0, None, None), (3, "g", "h", None, None, None), (4, "g", "h", math.nan, None, None), (None, "g", "h", 1.0, None, None)]
    assert run(spark, rows, 2) == set()
    assert run(spark, [], 2) == set()
    more = [(5, "", "h", math.inf, None, None), (6, "", "h", -math.inf, None, None), (7, "", "h", 0.0, None, None), (8, "", "h", -0.0, None, None)]
    assert {r[2] for r in run(spark, rows + more, 3)} == {5, 7, 8}


def test_groups_of_one_hash_and_skipped_row_groups():
    table = pa.table({"_g": [1, 1, 1, 1, 2], "_k0": ["a", "b", "a", "b", "a"], "_score": [5.0, 4.0, 3.0, 2.0, 1.0], "_tie": [1, 2, 3, 4, 5]})
    got = _best(table, ["_k0"], 1).to_pydict()
    assert (got["_k0"], got["_tie"]) == (["a", "b", "a"], [1, 2, 5])


def test_footers_drop_what_is_strictly_below(tmp_path):
    path = str(tmp_path / "x.parquet")
    rows = pa.table({"_g": [1] * 9 + [2] * 3, "_k0": ["a"] * 12, "_score": [9.0, 8.0, 7.0, 7.0, 7.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0], "_tie": list(range(12))})
    pq.write_table(rows, path, row_group_size=3)
    assert [k for k, _, _ in _plan(pq.ParquetFile(path).metadata, ["_k0"], 3)] == [0, 1, 3]  # 7 may tie with the third, 6 cannot
    batch = pa.RecordBatch.from_pydict({"path": [f"file://{path}"]})
    assert [t for b in _survivors(["_k0"], 3)(iter([batch])) for t in b.column("_tie").to_pylist()] == [0, 1, 2, 9, 10, 11]


def test_beaten_rows_never_leave_their_partition():
    rng = random.Random(1)
    rows = pa.table({"_g": [rng.randrange(50) for _ in range(20_000)], "_k0": ["x"] * 20_000, "_score": [rng.random() for _ in range(20_000)], "_tie": list(range(20_000))})
    out = list(_beaten_dropped(["_k0"], 5)(iter(rows.to_batches(max_chunksize=1000))))
    assert sum(b.num_rows for b in out) == 250
