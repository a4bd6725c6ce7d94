"""All of the clean table is learned from, however many rows it has."""

import pytest

from skein.llm.mojibake import LOANS, Knowledge, _told, find_garbled

LAST = "zz Die Größe der Prüfung für alle, 順序"


@pytest.fixture
def clean(spark):
    return spark.createDataFrame([(f"a {i}",) for i in range(10_000)] + [(LAST,), (None,), ("",), (LAST,)], "t string").repartition(3)


def test_last_rows_of_a_long_table_count(spark, clean):
    df = spark.createDataFrame([(1, "Größe der Pr³fung für alle", None), (2, "Größe der Prüfung für alle", None)], "id long, t string, recorded_at timestamp")
    got = {r.id: (r.garbled, r.restored, r.complete) for r in find_garbled(df, "id", "t", clean, "t").collect()}
    assert got == {1: (True, "Größe der Prüfung für alle", True), 2: (False, "Größe der Prüfung für alle", True)}


def test_facts_of_the_tasks_are_those_of_the_texts(spark, clean):
    texts = [r.t for r in clean.dropna().collect()]
    told, whole = Knowledge((), _told(clean, "t")), Knowledge(texts)
    assert (told.near, told.kanji, told.words) == (whole.near, whole.kanji, whole.words)
    assert {"順", "序"} <= told.kanji and "prüfung" in told.words
    assert Knowledge((), _told(clean.limit(0), "t")).words == Knowledge([LOANS]).words
