"""Every registered query of the library proper against its SQL, on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from rastermill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


ALONE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
known = entry.queries()
assert not [k for k in known if k.startswith("op") and "_" in k and k[2].isdigit()] and "pipeline" not in known, sorted(known)
assert set(entry.oracle_sql()) <= set(known)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("queries", len(known), "rows", known["stored_bytes_by_user"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("gone", [("rastermill/llm", "tests/llm"), ("rastermill/llm", "tests/llm", "corpus_pipeline.py")])
def test_works_without_the_text_operators(tmp_path, gone):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(top, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        at = tmp_path / "repo" / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", ALONE], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    _, n, _, rows = done.stdout.split()
    assert int(n) >= 114 and int(rows) > 0
