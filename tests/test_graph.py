from __future__ import annotations

import random

import pytest
from records import event, lineage_log, rows

from tracewell.operators import graph, links
from tracewell.sources.workspace import materialise_buckets

CHAIN = [
    ("gcs:b.source", "bigquery:p.n.one"),
    ("bigquery:p.n.one", "bigquery:p.n.two"),
    ("bigquery:p.n.one.pipeline_id", "bigquery:p.n.two.processing_step", "column"),
]


@pytest.fixture()
def chain(spark):
    return lineage_log(spark, events=[event("us", "a", "r", "e", CHAIN + CHAIN[:1] + [(None, "gcs:b.source")])])


def test_nodes(chain):
    assert rows(graph.graph_nodes(chain.links), "fqn", "kind") == [
        ("bigquery:p.n.one", "table"),
        ("bigquery:p.n.one.pipeline_id", "column"),
        ("bigquery:p.n.two", "table"),
        ("bigquery:p.n.two.processing_step", "column"),
        ("gcs:b.source", "storage"),
    ]


def test_edges(chain):
    assert rows(graph.graph_edges(chain.links), "source_fqn", "target_fqn", "kind") == sorted(
        [(*pair[:2], pair[2] if len(pair) == 3 else "table") for pair in CHAIN]
        + [
            ("bigquery:p.n.one", "bigquery:p.n.one.pipeline_id", "contains"),
            ("bigquery:p.n.two", "bigquery:p.n.two.processing_step", "contains"),
        ],
        key=repr,
    )


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source_fqn string, target_fqn string")


def nodes(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "node string")


def test_chain_with_a_cycle(spark):
    pairs = [("gcs:a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("gcs:a", "d"), ("x", "y")]
    assert rows(graph.reach(edges(spark, pairs)), "node", "depth") == [
        ("b", 1), ("c", 2), ("d", 1), ("gcs:a", 0),
    ]
    assert rows(graph.reach(edges(spark, pairs), nodes(spark, "c", "x")), "node", "depth") == [
        ("b", 1), ("c", 0), ("d", 1), ("x", 0), ("y", 1),
    ]


def test_start_without_edges(spark):
    assert rows(graph.reach(edges(spark, [("a", "b")]), nodes(spark, "z")), "node") == [("z",)]


def test_long_chain_is_compacted_on_the_way(spark):
    length = graph.COMPACT_EVERY + 3
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(length)]
    got = rows(graph.reach(edges(spark, pairs), nodes(spark, "n00")), "node", "depth")
    assert got == [(f"n{i:02d}", i) for i in range(length + 1)]


def test_rounds_do_not_move_the_edges(spark):
    hops, forget = materialise_buckets(edges(spark, [(f"a{i}", f"b{i}") for i in range(50)]), "hops", "source_fqn")
    frontier = nodes(spark, "a1").withColumnRenamed("node", "source_fqn").hint("merge")
    plan = hops.join(frontier, "source_fqn", "left_semi")._jdf.queryExecution().executedPlan().toString()
    forget()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_reach_against_brute_force(spark):
    random.seed(3)
    pairs = [(f"n{random.randint(0, 60)}", f"n{random.randint(0, 60)}") for _ in range(90)]
    starts = ["n1", "n2"]
    depth = {node: 0 for node in starts}
    queue = list(starts)
    while queue:
        node = queue.pop(0)
        for source, target in pairs:
            if source == node and target not in depth:
                depth[target] = depth[node] + 1
                queue.append(target)
    got = rows(graph.reach(edges(spark, pairs), nodes(spark, *starts)), "node", "depth")
    assert got == sorted(depth.items(), key=repr)


def shortest(pairs, starts):
    depth, queue = dict.fromkeys(starts, 0), list(starts)
    while queue:
        node = queue.pop(0)
        for source, target in pairs:
            if source == node and target not in depth:
                depth[target] = depth[node] + 1
                queue.append(target)
    before = {}
    for source, target in pairs:
        if depth.get(target) == depth.get(source, -9) + 1:
            before[target] = min(source, before.get(target, source))
    return sorted(((n, d, before.get(n)) for n, d in depth.items()), key=repr)


@pytest.mark.parametrize("upstream", [False, True])
@pytest.mark.parametrize("seed, nodes_, n", [(3, 60, 90), (4, 200, 190), (5, 12, 40)])
def test_paths_against_brute_force(spark, upstream, seed, nodes_, n):
    """Sparse graphs have long stretches, self-links and circles, some of them with a start inside."""
    random.seed(seed)
    pairs = sorted({(f"n{random.randint(0, nodes_)}", f"n{random.randint(0, nodes_)}") for _ in range(n)})
    pairs += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("d1", "d2"), ("d2", "d1"), ("n1", "d1"), ("z", "z")]
    starts = ["n1", "n2", "c2", "nowhere"]
    got = rows(graph.reach_paths(edges(spark, pairs), nodes(spark, *starts), upstream), "node", "depth", "predecessor")
    turned = [(b, a) for a, b in pairs] if upstream else pairs
    assert got == shortest(turned, starts)


def test_a_chain_of_a_thousand_hops_takes_few_rounds(spark, monkeypatch):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(1000)] + [("n400", "n700"), ("n1000", "n400")]
    written = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: written.append(label) or real(df, label))
    got = rows(graph.reach_paths(edges(spark, pairs), nodes(spark, "n0")), "node", "depth", "predecessor")
    assert got == shortest(pairs, ["n0"])
    assert written.count("jumps") <= 24 and written.count("frontier") <= 8


def test_path_rounds_follow_edges_where_they_lie(spark, monkeypatch):
    """Edges that come again, some from a hot node, are shuffled once and lie in buckets."""
    pairs = [("hot", f"n{i % 7}") for i in range(40)] + [("n1", "n2"), ("n2", "z"), ("n3", "z"), ("z", "hot")] * 2
    monkeypatch.setattr(links, "HOT_SHARE", 1.0)
    monkeypatch.setattr(links, "HOT_ROWS", 20)
    plans = {}
    real = graph.materialise

    def materialise(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(graph, "materialise", materialise)
    got = rows(graph.reach_paths(edges(spark, pairs), nodes(spark, "hot")), "node", "depth", "predecessor")
    assert got == shortest(sorted(set(pairs)), ["hot"])
    assert "ways" not in plans
    assert all("Bucketed: true" in plan for plan in plans["frontier"])
