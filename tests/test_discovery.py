from __future__ import annotations

import shutil
from datetime import datetime

import pytest
from records import rows

from tracewell.plans import pipelines
from tracewell.sources import discovery
from tracewell.sources.log import read_log


@pytest.fixture()
def root(spark, path):
    spark.range(10).repartition(3).write.parquet(path("root/numbers"))
    deep = spark.createDataFrame([(1, "a")], "id long, name string").coalesce(1)
    deep.write.parquet(path("root/deep/year=1/month=2"))
    return path("root")


def test_one_row_per_dataset(spark, root):
    got = discovery.discover(spark, root + "/")
    assert rows(got, "dataset", "location", "files") == [
        ("deep", f"{root}/deep", 1), ("numbers", f"{root}/numbers", 3),
    ]
    assert all(row.bytes > 0 for row in got.collect())


def test_the_listing_reads_no_content(spark, root):
    plan = discovery.discover(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_columns_are_those_that_spark_reads(spark, root):
    got = discovery.discover_columns(spark, "file://" + root)
    assert rows(got, "dataset", "position", "column_name", "column_type") == [
        ("deep", 0, "id", "bigint"), ("deep", 1, "name", "string"), ("deep", 2, "year", "int"),
        ("deep", 3, "month", "int"), ("numbers", 0, "id", "bigint"),
    ]
    sf_dir = "/root/testdata/sf0.001"
    found = rows(discovery.discover_columns(spark, sf_dir), "dataset", "position", "column_name", "column_type")
    expected = [
        (dataset, i, field.name, field.dataType.simpleString())
        for dataset in {row[0] for row in found}
        for i, field in enumerate(spark.read.parquet(f"{sf_dir}/{dataset}.parquet").schema.fields)
    ]
    assert found == sorted(expected, key=repr)


def test_columns_of_files_that_changed(spark, path):
    for day, name in ((1, "x_old"), (2, "y_new")):
        spark.range(2).withColumnRenamed("id", name).write.parquet(f"{path('root')}/d/day={day}")
    got = discovery.discover_columns(spark, path("root"))
    assert rows(got, "position", "column_name") == [(0, "x_old"), (1, "y_new"), (2, "day")]


def test_discovered_dataset_to_files(spark, root, path):
    pipelines.discovered_to_files(spark, root, "numbers", path("dest"), "p3")
    assert spark.read.parquet(path("dest")).where("pipeline_id = 'p3'").count() == 10
    with pytest.raises(LookupError, match="no dataset nothing"):
        pipelines.discovered_to_files(spark, root, "nothing", path("dest"), "p3")


def test_a_second_crawl_reads_only_what_changed(spark, path, monkeypatch):
    root, store = path("root"), path("crawls")
    for name in ("a", "b", "c"):
        spark.range(3).write.parquet(f"{root}/{name}")
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS crawled LOCATION '{path('ns')}'")
    kind = pipelines.EntryKind("t", "k", "a")
    looked = []
    real = discovery._columns_of
    monkeypatch.setattr(discovery, "_columns_of", lambda spark, datasets: looked.append(datasets) or real(spark, datasets))

    def register():
        return pipelines.register_discovered(spark, root, store, "crawled", path("log"), kind)

    assert [name for name, _ in register().changed] == ["a", "b", "c"]
    assert register().changed == []
    spark.range(2).selectExpr("id", "id AS more").write.mode("overwrite").parquet(f"{root}/b")
    shutil.rmtree(f"{root}/c")
    spark.range(1).write.parquet(f"{root}/d")
    last = register()
    assert [name for name, _ in last.changed] == ["b", "d"] and [name for name, _ in last.removed] == ["c"]
    assert [[name for name, _ in datasets] for datasets in looked] == [["a", "b", "c"], [], ["b", "d"]]
    columns = sorted((row.dataset, row.column_name) for row in last.columns(spark).collect())
    assert columns == [("a", "id"), ("b", "id"), ("b", "more"), ("d", "id")]
    assert spark.table("crawled.b").columns == ["id", "more"] and spark.table("crawled.d").count() == 1
    assert sorted(row.tableName for row in spark.sql("SHOW TABLES IN crawled").collect()) == ["a", "b", "d"]
    entries = read_log(spark, path("log")).entries
    assert sorted(row.entry_id for row in entries.collect()) == [f"crawled.{name}" for name in "abcd"]


def test_which_files_changed(spark):
    schema = "path string, length long, modificationTime timestamp, dataset string, location string"
    at = datetime(2026, 1, 1)
    before = spark.createDataFrame([("a", 1, at, "d", "l"), ("b", 1, at, "d", "l"), ("c", 1, at, "d", "l")], schema)
    now = spark.createDataFrame([("a", 1, at, "d", "l"), ("b", 2, at, "d", "l"), ("e", 1, at, "d", "l")], schema)
    found = {row.path: row.change for row in discovery.file_changes(before, now).collect()}
    assert found == {"b": "changed", "c": "removed", "e": "added"}
