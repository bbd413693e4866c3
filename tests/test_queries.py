"""Every query that has SQL, side by side with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no tables")


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def table(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(norm(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rows = df.collect()
    r = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert table(rows, df.columns, order) == table(r.fetchall(), columns, order)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_without_rows(spark, tmp_path):
    """No query needs rows."""
    for p in glob.glob(f"{DIR}/*.parquet"):
        spark.read.parquet(p).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{os.path.basename(p)}")
    for name in ("impact_by_region", "simple_paths", "cycles", "on_cycle", "graph_stats", "stitch_env_to_infra", "stitch_infra_to_infra", "node_diff", "risk", "findings", "extract_python", "extract_yaml", "extract_openlineage"):
        entry.queries()[name](spark, str(tmp_path)).collect()
