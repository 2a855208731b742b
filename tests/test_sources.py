from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlet.operators.drift import ALERT_SCHEMA
from martlet.sources import catalog, readers, writers


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{tmp_path.name}".lower().replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_table_name_of_file():
    assert readers.table_name_of("/data/shop_order_items_dataset.csv") == "order_items"
    assert readers.table_name_of("shop_orders_2020.csv") == "orders"


def test_ingest_dir(spark, database, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "shop_orders_dataset.csv").write_text("order_id,price,at\na,1.5,2018-01-02 03:04:05\nb,2,2018-01-03 00:00:00\n")
    (source / "shop_order_items_dataset.csv").write_text("order_id,n\na,1\n")
    (source / "notes.txt").write_text("ignored")
    names = writers.ingest_dir(spark, str(source), database)
    assert sorted(names) == [f"{database}.order_items", f"{database}.orders"]
    orders = readers.scan_table(spark, f"{database}.orders")
    assert dict(orders.dtypes) == {"order_id": "string", "price": "double", "at": "timestamp"}
    assert orders.count() == 2


def test_overwrite_replaces_the_schema(spark, frame, database):
    writers.write_table(frame([(1,)], "a int"), f"{database}.t")
    writers.write_table(frame([("x", 2)], "b string, c int"), f"{database}.t")
    assert spark.table(f"{database}.t").columns == ["b", "c"]


def test_bucketed_tables_join_without_shuffle(spark, frame, database):
    rows = [(i, float(i)) for i in range(100)]
    writers.write_table(frame(rows, "k int, v double"), f"{database}.l", bucket_by=(4, "k"))
    writers.write_table(frame(rows, "k int, w double"), f"{database}.r", bucket_by=(4, "k"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(f"{database}.l").join(spark.table(f"{database}.r"), "k")
        assert joined.count() == 100
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_export_goes_on_after_a_failure(spark, frame, database):
    good = frame([(1, "x")], "`Order Id` int, `Name` string")
    bad = good.withColumn("oops", F.raise_error(F.lit("no such luck")))
    outcome = {r.table_name: r.exported for r in writers.export_model(spark, {"Bad One": bad, "Good One": good}, database).collect()}
    assert outcome == {"Bad_One": False, "Good_One": True}
    assert spark.table(f"{database}.Good_One").columns == ["Order_Id", "Name"]


def test_list_and_pending_tables(spark, frame, database):
    writers.write_table(frame([(1,)], "a int"), f"{database}.known")
    listed = catalog.list_tables(spark, database)
    assert listed.columns == ["Name", *catalog.METADATA_COLUMNS]
    wanted = frame([("known",), ("new",)], "Name string")
    assert [r.Name for r in catalog.pending_tables(wanted, listed).collect()] == ["new"]


def test_append_merges_columns(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    writers.append_path(frame([(1,)], "a int"), path)
    writers.append_path(frame([(2, "x")], "a int, b string"), path)
    rows = readers.scan_path(spark, path, merge_schema=True).orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(1, None), (2, "x")]


def test_snapshots_are_immutable(spark, frame, tmp_path):
    writers.write_snapshot(frame([(1,)], "a int"), str(tmp_path), "20240101")
    assert writers.read_snapshot(spark, str(tmp_path), "20240101").count() == 1
    with pytest.raises(Exception, match="already exists"):
        writers.write_snapshot(frame([(2,)], "a int"), str(tmp_path), "20240101")


def test_typed_alert_rows(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    row = ("rmse", 1.0, 0.5, 0.5, "sudden", "HIGH", now, "r2", 2, "abs_diff", "v2", "d2", "v1", "d1", "{}")
    for _ in range(2):
        writers.append_rows(spark, [row], ALERT_SCHEMA, str(tmp_path / "alerts"))
    assert readers.scan_path(spark, str(tmp_path / "alerts")).count() == 2


def test_millisecond_timestamps(frame):
    df = frame([(dt.datetime(2024, 1, 1, 1, 2, 3, 456789), 1)], "t timestamp_ntz, n int")
    assert readers.cast_timestamps(df).first().t == dt.datetime(2024, 1, 1, 1, 2, 3, 456000)


def test_milliseconds_in_the_hour_that_daylight_saving_skips(abroad, frame):
    df = frame([(dt.datetime(2024, 3, 10, 2, 30, 0, 1234), 1)], "t timestamp_ntz, n int")
    assert readers.cast_timestamps(df).first().t == dt.datetime(2024, 3, 10, 2, 30, 0, 1000)


def test_literal_table_keeps_types_and_nulls(spark):
    df = readers.literal_table(spark, [(1, None), (2, "x")], "a int, b string")
    assert df.dtypes == [("a", "int"), ("b", "string")]
    assert readers.literal_table(spark, [], "a int, b string").count() == 0


def test_replacing_a_table_keeps_the_old_rows_until_the_new_ones_are_there(spark, frame, database, tmp_path):
    name, folder = f"{database}.scores", str(tmp_path / "tables")
    first = writers.replace_table(frame([(1, 0.5), (2, None)], "id int, score double"), name, folder)
    reader = spark.table(name)
    broken = spark.range(100).select(F.when(F.col("id") == 57, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="lost"):
        writers.replace_table(broken, name, folder)
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, 0.5), (2, None)]
    assert len(list((tmp_path / "tables" / name).iterdir())) == 1
    writers.replace_table(frame([("a", 3)], "text string, n int"), name, folder)
    assert [tuple(r) for r in spark.table(name).collect()] == [("a", 3)]
    assert reader.count() == 2  # a query that began before
    writers.replace_table(frame([("b", 4)], "text string, n int"), name, folder)
    assert not (tmp_path / "tables" / name / first.rsplit("/", 1)[-1]).exists()


def test_a_table_may_be_replaced_from_itself_and_be_checked(spark, frame, database, tmp_path):
    name, folder = f"{database}.counts", str(tmp_path)
    writers.replace_table(frame([(1,), (2,)], "n int"), name, folder)
    writers.replace_table(spark.table(name).select((F.col("n") * 10).alias("n")), name, folder)
    with pytest.raises(ValueError, match="check"):
        writers.replace_table(spark.table(name).filter("n > 100"), name, folder, check=lambda df: not df.isEmpty())
    assert sorted(r.n for r in spark.table(name).collect()) == [10, 20]
    writers.write_table(frame([(1,)], "n int"), f"{database}.plain")
    with pytest.raises(ValueError, match="plain table"):
        writers.replace_table(frame([(2,)], "n int"), f"{database}.plain", folder)
