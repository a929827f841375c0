"""Every query with SQL against DuckDB on the smallest tables; every other one for rows."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from readloom.plans import alignment_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(alignment_queries.queries()))
def test_query(spark, duck, name):
    got = alignment_queries.queries()[name](spark, DATA).toArrow()
    sql = alignment_queries.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in columns], strict=True)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_text_operators(tmp_path):
    """The subpackage, its tests and the pipeline may be deleted: the rest imports and keeps its queries."""
    home = Path(__file__).resolve().parent.parent
    shutil.copytree(home / "readloom", tmp_path / "readloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 25 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
