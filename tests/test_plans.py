"""Physical plans: what is read, what is shuffled, and where."""

from __future__ import annotations

import re

import pytest

from tracewell.operators import audit, graph, inspect, links
from tracewell.workload.derived_log import stored_log

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return stored_log(spark, SF_DIR)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_take_one_shuffle_and_no_join(log):
    plan = plan_of(links.edges_per_process(log.links))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan
    assert "partial_min" in plan


def test_edges_read_only_the_columns_they_use(log):
    plan = plan_of(links.table_edges(log.links))
    assert "end_time" not in plan.split("ReadSchema")[1]
    assert "start_time" not in plan.split("ReadSchema")[1]


def test_endpoints_are_counted_before_a_shuffled_join(log, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(audit.ghost_nodes(log))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("SortMergeJoin") < plan.index("HashAggregate") < plan.index("partial_count")


def test_no_plan_has_a_cross_join(log, spark):
    from tracewell.workload.derived_log import batches

    frames = [
        inspect.process_of_batches(log.processes, batches(spark, SF_DIR)),
        inspect.batch_status(log, batches(spark, SF_DIR)),
        inspect.gated_runs_by_source(log),
        audit.edge_visibility(log),
        graph.graph_nodes(log.links),
    ]
    for frame in frames:
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_a_purge_prunes_both_of_its_scans(log):
    plan = plan_of(audit.purge(log, ["us-east1"]).events)
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(filters) == 3
    assert all("us-east1" in each for each in filters)


def test_no_python_in_lineage_queries(log):
    frames = [links.edges_per_process(log.links), inspect.runs_by_source(log), audit.ghost_nodes(log)]
    assert not any("Python" in plan_of(frame) or "ArrowEval" in plan_of(frame) for frame in frames)
