from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell import functions as N

EVENT = "projects/p/locations/us/processes/x/runs/r/lineageEvents/e"


def evaluate(spark, column_of, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    df = spark.createDataFrame([values], schema)
    return df.select(column_of(*[F.col(name) for name in df.columns])).first()[0]


@pytest.mark.parametrize(
    "path, expected",
    [("gs://a/b/", "gs://a/b"), ("gs://a/b", "gs://a/b"), ("a/b//", "a/b/"), ("/", ""), ("", "")],
)
def test_one_slash_is_stripped(spark, path, expected):
    assert evaluate(spark, N.strip_slash, path) == expected


@pytest.mark.parametrize(
    "path, expected",
    [("gs://b/dir/sub/", "gcs:b.dir.sub"), ("gs://b", "gcs:b"), ("gs://b/x//", "gcs:b.x.")],
)
def test_gcs_fqn(spark, path, expected):
    assert evaluate(spark, N.gcs_fqn, path) == expected


def test_other_names_from_a_path(spark):
    custom = evaluate(spark, lambda p: N.custom_fqn(F.lit("ns"), p), "gs://b/source/")
    assert custom == "custom:ns.b.source"
    assert evaluate(spark, N.system_resource, "gs://b/source/") == "//storage.googleapis.com/b/source"


def test_table_and_column_names(spark):
    table = evaluate(spark, N.table_fqn, "p", "ns", "t")
    assert table == "bigquery:p.ns.t"
    assert evaluate(spark, lambda f: N.column_fqn(f, F.lit("id")), table) == "bigquery:p.ns.t.id"
    assert evaluate(spark, N.parent_fqn, "bigquery:p.ns.t.id") == table
    assert evaluate(spark, N.parent_fqn, "plain") == "plain"
    assert evaluate(spark, N.table_fqn, "p", None, "t") is None


@pytest.mark.parametrize(
    "fqn, expected",
    [
        ("gcs:b.dir.sub", "gs://b/dir.sub"),
        ("gcs:b", "gs://b"),
        ("gcs:b.", "gs://b/"),
        ("gcs:.x", "gs:///x"),
        ("bigquery:p.d.t", "bigquery:p.d.t"),
        ("custom:n.b.x", "custom:n.b.x"),
        ("Unknown_Source", "Unknown_Source"),
    ],
)
def test_fqn_to_path(spark, fqn, expected):
    assert evaluate(spark, N.fqn_to_path, fqn) == expected


@pytest.mark.parametrize(
    "identifier, expected",
    [
        ("p.d.t", "bigquery:p.d.t"),
        ("bigquery:p.d.t", "bigquery:p.d.t"),
        ("custom:n.x", "custom:n.x"),
        ("gcs:b.x", "gcs:b.x"),
        ("GCS:b.x", "bigquery:GCS:b.x"),
    ],
)
def test_identifier_without_scheme_is_a_table(spark, identifier, expected):
    assert evaluate(spark, N.normalise_identifier, identifier) == expected


def test_parents_of_an_event(spark):
    assert evaluate(spark, N.run_of, EVENT) == "projects/p/locations/us/processes/x/runs/r"
    assert evaluate(spark, N.process_of, EVENT) == "projects/p/locations/us/processes/x"
    assert evaluate(spark, N.run_of, "short/name") == "short/name"


@pytest.mark.parametrize(
    "source, target, level",
    [
        ("bigquery:p.n.t.a", "bigquery:p.n.u.b", "column"),
        ("bigquery:p.n.t", "bigquery:p.n.u", "table"),
        ("gcs:b.x.y.z", "bigquery:p.n.u.b", "table"),
        (None, "bigquery:p.n.u.b", "table"),
    ],
)
def test_undeclared_level(spark, source, target, level):
    assert evaluate(spark, N.link_level, source, target) == level


def test_json_field_takes_the_top_level(spark):
    field = lambda text: N.json_field(text, "name")
    assert evaluate(spark, field, '{"origin": {"name": "inner"}, "name": "outer"}') == "outer"
    assert evaluate(spark, field, '{"origin": {"name": "inner"}}') is None
    assert evaluate(spark, field, "not json") is None


def test_required_json_field(spark):
    field = lambda text: N.required_json_field(text, "name")
    assert evaluate(spark, field, '{"name": "n"}') == "n"
    with pytest.raises(Exception, match="no field name in"):
        evaluate(spark, field, '{"other": 1}')


@pytest.mark.parametrize(
    "text", ["2026-01-02T03:04:05Z", "2026-01-02T05:04:05+02:00", "2026-01-02T03:04:05.000Z"]
)
def test_instant_is_utc_wall_clock(spark, text):
    assert evaluate(spark, N.instant, text) == datetime(2026, 1, 2, 3, 4, 5)


def test_instant_does_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, N.instant, "2026-07-02T03:04:05Z") == datetime(2026, 7, 2, 3, 4, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
