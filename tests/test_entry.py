"""Every query that has SQL gives what DuckDB gives."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "framelake", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "framelake").mkdir()
    for p in (ROOT / "framelake").iterdir():
        if p.name != "llm":
            (tmp_path / "framelake" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sorted(e.queries())[0], any(k.startswith('op1_') for k in {**e.queries(), **e.oracle_sql()}))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[-1] == "False", out.stderr


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_oracle(spark):
    import duckdb
    import pandas as pd

    from framelake import queries as own

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    queries, sql = own.queries(), own.oracle_sql()
    assert set(queries) == set(sql)
    for name in sql:
        a, b = queries[name](spark, SF).toPandas(), c.sql(sql[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, obj=name)
