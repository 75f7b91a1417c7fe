"""Every registered heap query against its SQL, on the smallest tables."""

import math
import os

import pytest

from cairn.plans import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(FOLDER)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, tables, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    wanted = tables.sql(queries.ORACLES[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    got, want = rows(frame.columns, [tuple(r) for r in frame.collect()]), rows(wanted.columns, wanted.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_held_sums_in_the_order_of_the_files(spark, tmp_path):
    """0.1 + 0.2 + 0.7 is 1.0 in this order, but 0.1 + (0.2 + 0.7), as two tasks add it up, is less."""
    for part, prices in enumerate([[0.1], [0.2, 0.7]]):
        rows = spark.createDataFrame([(0, 0, "F", p, "1-URGENT") for p in prices], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{part}")
        (tmp_path / "orders.parquet").mkdir(exist_ok=True)
        next((tmp_path / str(part)).glob("*.parquet")).rename(tmp_path / "orders.parquet" / f"{part}.parquet")
    name = "spark.sql.files.maxPartitionBytes"
    size = spark.conf.get(name)
    spark.conf.set(name, "1k")  # a file is a task
    try:
        assert [(r.pointees, r.retained) for r in queries.QUERIES["fields_by_size"](spark, str(tmp_path)).collect()] == [(1, 1)]
    finally:
        spark.conf.set(name, size)
