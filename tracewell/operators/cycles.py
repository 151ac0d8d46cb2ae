"""Cycles of the lineage graph: which nodes lie on common cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.graph import inner_nodes, jumps
from tracewell.sources.workspace import materialise

#: Rounds of trimming in a row; whatever they leave is left to the colours.
TRIM_ROUNDS = 8


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes of all cycles over at least two nodes.

    `component` is the least node of the node's strongly connected component: nodes with
    the same one reach each other. Edges from a node to itself are left out.

    Edges, which may come more than once, are trimmed first of nodes without a way in or out, so that
    most are neither shuffled nor written. Stretches of nodes with one edge in and one out are jumped
    over then, as in `reach_paths`: their nodes are on a cycle if both ends are in one component, and circles
    of such nodes alone are told by doubling pointers. Of the rest, nodes without a way in or
    out are trimmed. Then each node takes the least node that reaches it as its colour, and
    those that reach their colour back along nodes of the colour are its component; edges
    that are left within a colour go on. A component is a row per node, never a list.
    """
    hops = edges.select(F.col("source_fqn").alias("a"), F.col("target_fqn").alias("b")).where("a <> b")
    hops = _trimmed(_between(hops).distinct())
    inner = inner_nodes(hops, hops.select(F.col("a").alias("node")).limit(0))
    pointers = hops.join(inner.select(F.col("node").alias("a")), "a", "left_semi").selectExpr("a AS node", "b AS at")
    backwards = hops.join(inner.select(F.col("node").alias("b")), "b", "left_semi").selectExpr("b AS node", "a AS at")
    onward, back = jumps(pointers, inner), jumps(backwards, inner)

    leaving = hops.join(inner.select(F.col("node").alias("a")), "a", "left_anti")
    over = leaving.join(onward.selectExpr("node AS b", "at"), "b", "left")
    ways = materialise(over.select("a", F.coalesce("at", "b").alias("b")).distinct(), "ways")
    members = materialise(_components(ways.where("a <> b")), "members")

    # A stretch lies in the component of its ends, or makes one with an end it comes back to.
    ends = back.selectExpr("node", "at AS a").join(onward.selectExpr("node", "at AS b"), "node")
    ends = ends.join(members.selectExpr("node AS a", "component AS a_in"), "a", "left")
    ends = ends.join(members.selectExpr("node AS b", "component AS b_in"), "b", "left")
    within = ends.select("node", F.coalesce("a_in", "a").alias("of"), F.coalesce("b_in", "b").alias("b_of")).where("of = b_of")
    turning = ways.where("a = b").select(F.col("a").alias("node")).join(members, "node", "left")
    turning = turning.select("node", F.coalesce("component", "node").alias("of"))
    placed = members.selectExpr("node", "component AS of").unionByName(turning).unionByName(within.select("node", "of"))
    placed = materialise(placed.distinct(), "placed")
    least = placed.groupBy("of").agg(F.min("node").alias("component"))
    found = placed.join(least, "of").select("node", "component")
    return found.unionByName(_circles(pointers.join(onward.select("node"), "node", "left_anti")))


def _between(hops: DataFrame) -> DataFrame:
    """The edges whose ends both have a way in and a way out; edges that come again are kept as often.

    Only nodes are shuffled before edges are dropped: the edges are read again, not written.
    """
    left = hops.select(F.col("a").alias("node")).distinct()
    both = materialise(left.join(hops.select(F.col("b").alias("node")).distinct(), "node", "left_semi"), "both")
    return hops.join(both.selectExpr("node AS a"), "a", "left_semi").join(both.selectExpr("node AS b"), "b", "left_semi")


def _circles(pointers: DataFrame) -> DataFrame:
    """(node, component) of circles, from a pointer per node to the next one."""
    ahead = materialise(pointers.select("node", "at", F.least("node", "at").alias("component")), "circles")
    nodes, passed = ahead.count(), 1
    while passed < nodes:
        next_one = ahead.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("component").alias("other"))
        ahead = ahead.join(next_one, "at").select("node", F.col("to").alias("at"), F.least("component", "other").alias("component"))
        ahead = materialise(ahead, "circles")
        passed *= 2
    return ahead.select("node", "component")


def _components(hops: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of at least two nodes."""
    found = hops.selectExpr("a AS node", "a AS component").limit(0)
    hops = _trimmed(hops)
    while not hops.isEmpty():
        colours = _least_reaching(hops)
        inside = hops.join(colours.selectExpr("node AS a", "least AS colour"), "a").join(
            colours.selectExpr("node AS b", "least AS b_colour"), "b"
        )
        inside = materialise(inside.where("colour = b_colour").select("a", "b", "colour"), "inside")
        members = _reaching_back(inside)
        found = found.unionByName(members)
        inside = inside.join(members.select(F.col("node").alias("a")), "a", "left_anti")
        hops = _trimmed(inside.join(members.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    return found


def _trimmed(hops: DataFrame) -> DataFrame:
    """The edges left when nodes without a way in or out go, again and again while that helps."""
    hops = materialise(hops, "trimmed")
    left = hops.count()
    for _ in range(TRIM_ROUNDS):
        entered = hops.select(F.col("b").alias("a")).distinct()
        left_again = hops.select(F.col("a").alias("b")).distinct()
        hops = materialise(hops.join(entered, "a", "left_semi").join(left_again, "b", "left_semi").select("a", "b"), "trimmed")
        still = hops.count()
        if still == left:
            break
        left = still
    return hops


def _least_reaching(hops: DataFrame) -> DataFrame:
    """(node, least): the least node from which each node is reached, itself included."""
    nodes = hops.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    colours = frontier = materialise(nodes.select("node", F.col("node").alias("least")), "colours")
    while not frontier.isEmpty():
        offers = hops.join(frontier.select(F.col("node").alias("a"), "least"), "a")
        offers = offers.groupBy(F.col("b").alias("node")).agg(F.min("least").alias("offer"))
        better = offers.join(colours, "node").where("offer < least")
        frontier = materialise(better.select("node", F.col("offer").alias("least")), "frontier")
        colours = colours.unionByName(frontier).groupBy("node").agg(F.min("least").alias("least"))
        colours = materialise(colours, "colours")
    return colours


def _reaching_back(inside: DataFrame) -> DataFrame:
    """(node, component): nodes that reach the node their colour is named by, along edges of the colour."""
    roots = inside.where("a = colour").selectExpr("a AS node", "colour AS component").distinct()
    members = frontier = materialise(roots, "members")
    while not frontier.isEmpty():
        back = inside.join(frontier.select(F.col("node").alias("b")), "b", "left_semi")
        back = back.select(F.col("a").alias("node"), F.col("colour").alias("component")).distinct()
        frontier = materialise(back.join(members.select("node"), "node", "left_anti"), "frontier")
        members = materialise(members.unionByName(frontier), "members")
    # A node that nothing of its colour leads back to is no cycle.
    several = members.groupBy("component").agg(F.count("*").alias("nodes")).where("nodes > 1")
    return materialise(members.join(several, "component", "left_semi").select("node", "component"), "members")
