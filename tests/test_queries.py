"""Every query with SQL against DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from veilframe import queries as q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got
    if name in q.ORACLE:
        rel = duck.sql(q.ORACLE[name])
        assert sorted(rel.columns) == cols
        want = duck.sql(f"select {', '.join(cols)} from ({q.ORACLE[name]})").fetchall()
        assert Counter(got) == Counter(want)


def test_entry_without_llm(tmp_path):
    """The entry module imports and the other queries stand where the subpackage is gone."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "veilframe", tmp_path / "veilframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'leak_pairs' in e.queries() and not [k for k in e.queries() if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
