from __future__ import annotations

import random

from records import rows

from tracewell.operators import cycles as module
from tracewell.operators.cycles import cycles


def expected(pairs):
    """Nodes that reach themselves over another node, by plain search."""
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for node in out.get(todo.pop(), ()):
                if node not in seen:
                    seen.add(node)
                    todo.append(node)
        return seen

    ways = {node: reached(node) for node in {node for pair in pairs for node in pair}}
    on_cycle = [node for node in ways if node in ways[node]]
    return sorted((node, min(other for other in ways[node] if node in ways.get(other, ()))) for node in on_cycle)


def check(spark, pairs):
    edges = spark.createDataFrame(pairs, "source_fqn string, target_fqn string")
    assert rows(cycles(edges), "node", "component") == expected(pairs)


def test_kinds_of_cycles(spark):
    circle = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    # A long stretch that comes back to a node with further edges, and one between two components.
    back = [("h", "i1"), ("i1", "i2"), ("i2", "i3"), ("i3", "h"), ("h", "out"), ("in", "h"), ("in", "x")]
    two = [("p", "q"), ("q", "p"), ("q", "s1"), ("s1", "s2"), ("s2", "r"), ("r", "t"), ("t", "r"), ("r", "u"), ("u", "t")]
    tail = [("k", "k"), ("k", "l"), ("l", "m"), ("m", "c")]
    check(spark, circle + back + two + tail + circle[:3])


def test_random_graphs(spark):
    draw = random.Random(3)
    for nodes, edges in ((25, 30), (40, 55)):
        check(spark, [(f"n{draw.randrange(nodes):02d}", f"n{draw.randrange(nodes):02d}") for _ in range(edges)])


def test_no_cycles_and_no_edges(spark):
    check(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "c")])
    assert cycles(spark.createDataFrame([], "source_fqn string, target_fqn string")).count() == 0


def test_edges_off_all_cycles_are_never_written(spark, monkeypatch):
    """Links as a log has them, again and again; most lead from nodes that nothing enters to nodes that nothing leaves."""
    pairs = [(f"in{i}", f"c{i % 3}") for i in range(30)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0")]
    pairs += [(f"c{i % 3}", f"out{i}") for i in range(30)]
    written = []
    real = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: written.append(df.count()) or real(df, label))
    check(spark, pairs * 3)
    assert max(written) == 3
