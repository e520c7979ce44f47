"""Every query against its SQL on the smallest tables, and the entry without the optional subpackage."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from scoreloom import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def same(a, b):
    return abs(a - b) <= 2e-4 * max(1, abs(b)) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in Q.SQL:
        assert df.columns
        return
    found = duck.execute(Q.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]

    def key(row):
        return [(v is None, str(type(v)), v if not isinstance(v, float) else round(v, 3)) if not isinstance(v, bool) else (False, "b", v) for v in row]

    assert len(rows) == len(want)
    for x, y in zip(sorted(rows, key=key), sorted(want, key=key)):
        assert all(map(same, x, y)), (x, y)


def test_entry_without_subpackage(tmp_path):
    """The entry imports where the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in (".git", "corpus_pipeline.py", "scoreloom", "__pycache__"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "scoreloom").mkdir()
    for name in os.listdir(f"{root}/scoreloom"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/scoreloom/{name}", tmp_path / "scoreloom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 45
