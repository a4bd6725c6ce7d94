"""Every core query with SQL against that SQL, over the smallest tables."""

import math
from pathlib import Path

import pytest

from skein.registry import core_queries, core_sql

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if v != int(v) else str(int(v))
    return str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, tables, name):
    df = core_queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted(tuple(map(canon, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name in core_sql():
        want = tables.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({core_sql()[name]})").fetchall()
        assert rows == sorted(tuple(map(canon, r)) for r in want)


def test_the_llm_part_is_optional(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "skein.llm.queries", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(core_queries()) and set(entry.oracle_sql()) == set(core_sql())


def test_nothing_imports_the_llm_part():
    root = Path(__file__).resolve().parent.parent / "skein"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
