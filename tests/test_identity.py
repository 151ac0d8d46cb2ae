from __future__ import annotations

from datetime import timedelta

import pytest
from records import NOON, lineage_log, process, process_name, run, rows

from tracewell.operators import identity, inspect

APP = "nightly"
PROPERTIES = [
    {},
    {},
    {"spark.openlineage.appName": f"{APP}_V2"},
    {"spark.openlineage.namespace": "custom_namespace", "spark.openlineage.appName": "explicit"},
]


@pytest.fixture()
def phases(spark):
    """The same application run four times, each run posting a process of its own."""
    names = [f"phase{i}" for i in range(1, 5)]
    return lineage_log(
        spark,
        [process("us", name, f"batch-{name}", **{"spark.app.name": APP}, **given)
         for name, given in zip(names, PROPERTIES)],
        [run("us", name, "r", start=NOON + timedelta(hours=i)) for i, name in enumerate(names)],
    )


def test_four_runs_are_three_identities(phases):
    got = identity.process_identity(phases)
    assert rows(got, "namespace", "app_name", "processes", "runs") == [
        ("custom_namespace", "explicit", 1, 1),
        ("default", APP, 2, 2),
        ("default", f"{APP}_V2", 1, 1),
    ]


def test_on_a_cluster_the_project_is_the_namespace(phases):
    got = identity.process_identity(phases, identity.cluster_default())
    assert {row.namespace for row in got.collect()} == {"p", "custom_namespace"}


def test_verdicts(phases):
    got = identity.identity_verdicts(phases)
    assert rows(got, "app_name", "runs", "verdict") == [
        ("explicit", 1, "new_namespace"),
        (APP, 2, "consolidated"),
        (f"{APP}_V2", 1, "new_app_name"),
    ]


def test_members(phases):
    members = identity.identity_members(phases.processes)
    assert members.count() == 4
    assert members.select("namespace", "app_name").distinct().count() == 3


def test_processes_without_any_name_are_kept(spark):
    log = lineage_log(
        spark,
        [process("us", "a"), process("us", "b", **{"spark.openlineage.appName": "named"})],
        [run("us", "a", "r"), run("us", "b", "r", start=NOON + timedelta(hours=1))],
    )
    name = process_name("us", "a")
    assert rows(identity.process_identity(log), "app_name", "runs") == [("named", 1), (name, 1)]
    assert rows(identity.identity_verdicts(log), "app_name", "verdict") == [
        ("named", "consolidated"), (name, "consolidated"),
    ]


def test_unnamed_processes_are_not_one(spark):
    log = lineage_log(spark, [process("us", name) for name in "abc"])
    assert rows(identity.process_identity(log), "processes", "runs") == [(1, 0)] * 3


def test_a_process_delivered_twice_is_one(spark):
    posted = process("us", "a", **{"spark.app.name": APP})
    log = lineage_log(spark, [posted, posted], [run("us", "a", "r1"), run("us", "a", "r2")])
    assert rows(identity.process_identity(log), "processes", "runs") == [(1, 2)]
    assert inspect.runs_of_processes(log).count() == 2
