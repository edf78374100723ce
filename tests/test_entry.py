"""The driver's contract: queries against DuckDB on the smallest tables, and life without the llm subpackage."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from stairlight.plans import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(rows):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = db.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.ORACLES[name]})").fetchall()
    assert norm(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == norm(expected)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "stairlight", tmp_path / "stairlight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'km_table' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
