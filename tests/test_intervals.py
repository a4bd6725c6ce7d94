import random

import pytest
from pyspark.sql import functions as F

from skein.operators.intervals import merge_intervals

SCHEMA = "who string, a long, b long, note string"


def brute(rows):
    out = set()
    by = {}
    for who, a, b, *_ in rows:
        if None not in (who, a, b) and b > a:
            by.setdefault(who, []).append((a, b))
    for who, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(who, "period", a, b) for a, b in merged}
        out |= {(who, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in merge_intervals(df, F.col("who"), F.col("a"), F.col("b"), F.xxhash64("note"), parts).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "b", "c"]), s := rng.randrange(400), s + rng.randrange(-2, 30), str(i)) for i in range(300)]
    assert run(spark, rows, 7) == brute(rows)


def test_one_interval_over_all_partitions(spark):
    rows = [("a", i, i + 2, str(i)) for i in range(200)] + [("a", 500, 501, "x")]
    assert run(spark, rows, 9) == {("a", "period", 0, 201), ("a", "gap", 201, 500), ("a", "period", 500, 501)}


def test_touching_nested_repeated_and_equal_rows(spark):
    rows = [("a", 0, 10, "1"), ("a", 10, 20, "2"), ("a", 3, 5, "3")] + [("a", 0, 10, "4")] * 50
    assert run(spark, rows, 5) == {("a", "period", 0, 20)}


def test_nulls_and_empty(spark):
    assert run(spark, [(None, 1, 2, "x"), ("a", None, 2, "x"), ("a", 1, None, "x"), ("a", 5, 5, "x"), ("a", 7, 3, None)], 3) == set()
    assert run(spark, [], 3) == set()


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 4, 9, "k")], "who string, start long, end long, pid long, kind string")
    got = merge_intervals(df, F.col("who"), F.col("start"), F.col("end")).collect()
    assert [tuple(r) for r in got] == [("a", "period", 1, 4)]
