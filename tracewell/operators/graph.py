"""The lineage graph: nodes, edges, and what is reachable along edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import parent_fqn
from tracewell.operators.links import declared_links, hot_hashes, without_self_links
from tracewell.sources.workspace import materialise, materialise_buckets

COMPACT_EVERY = 16


def graph_edges(links: DataFrame) -> DataFrame:
    """Distinct edges: table lineage, column lineage, and tables containing columns.

    A column link gives its own edge and the two that tie its ends to their
    tables, all in one pass before the one shuffle.
    """
    source, target = F.col("source_fqn"), F.col("target_fqn")

    def edge(start: Column, end: Column, kind: Column) -> Column:
        return F.struct(start.alias("source_fqn"), end.alias("target_fqn"), kind.alias("kind"))

    contains = F.lit("contains")
    declared = edge(source, target, F.col("level"))
    owned = [edge(parent_fqn(column), column, contains) for column in (source, target)]
    edges = F.when(_is_column(), F.array(declared, *owned)).otherwise(F.array(declared))
    moves = without_self_links(declared_links(links))
    return moves.select(F.explode(edges).alias("edge")).select("edge.*").distinct()


def graph_nodes(links: DataFrame) -> DataFrame:
    """Distinct endpoints with their kind; the table of a column is a node too."""
    fqn = F.col("fqn")

    def node(name: Column, kind: Column | str) -> Column:
        return F.struct(name.alias("fqn"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))

    table_kind = F.when(fqn.startswith(V.GCS), "storage").otherwise("table")
    nodes = F.when(
        _is_column(), F.array(node(fqn, "column"), node(parent_fqn(fqn), "table"))
    ).otherwise(F.array(node(fqn, table_kind)))
    return (
        declared_links(links)
        .select("level", F.explode(F.array("source_fqn", "target_fqn")).alias("fqn"))
        .where(fqn.isNotNull())
        .select(F.explode(nodes).alias("node"))
        .select("node.*")
        .distinct()
    )


def _is_column() -> Column:
    return F.col("level") == V.COLUMN_LEVEL


def storage_roots(edges: DataFrame) -> DataFrame:
    """Storage nodes that edges leave but none enters."""
    sources = edges.select(F.col("source_fqn").alias("node")).where(F.col("node").startswith(V.GCS))
    targets = edges.select(F.col("target_fqn").alias("node"))
    return sources.distinct().join(targets.distinct(), "node", "left_anti")


def reach(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from `starts` (column `node`) with the least number of hops.

    Without `starts` the walk begins at all storage roots. Breadth first over
    the whole start set: each round follows the edges of the nodes found in
    the round before and keeps those not seen yet, so cycles end and every
    edge is followed once. Edges are written once, in buckets by their source,
    and a round shuffles only the nodes it starts from to them. Edges and rounds
    lie in the shared folder, which bounds the plan and survives the loss of
    executors. The driver only learns whether a round found anything.
    """
    hops, forget = materialise_buckets(edges.select("source_fqn", "target_fqn").distinct(), "hops", "source_fqn")
    try:
        return _rounds(hops, storage_roots(hops) if starts is None else starts.select("node").distinct())
    finally:
        forget()


def _rounds(hops: DataFrame, starts: DataFrame) -> DataFrame:
    frontier = materialise(starts.withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        found = (
            hops.join(frontier.select(F.col("node").alias("source_fqn")), "source_fqn", "left_semi")
            .select(F.col("target_fqn").alias("node"))
            .distinct()
            .join(seen.select("node"), "node", "left_anti")
        )
        frontier = materialise(found.withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
        if depth % COMPACT_EVERY == 0:
            seen = materialise(seen, "seen")
    return seen


def reach_paths(edges: DataFrame, starts: DataFrame | None = None, upstream: bool = False) -> DataFrame:
    """Nodes reachable from `starts` with their least number of hops and the node before them on such a way.

    `predecessor` is null for starts; of several nodes that may come before one, it is that with
    the least name, so following predecessors gives one shortest path. With `upstream` edges are
    walked backwards, from what is read to what it is made of. Without `starts` the walk begins
    where `reach` begins, upstream at all nodes that edges enter but none leaves.

    Stretches of nodes with one edge in and one out are jumped over: pointers along them are doubled
    until they reach their ends, so rounds are about the logarithm of the longest stretch and the
    number of branchings on the longest way. All rounds lie in the shared folder.

    Edges, which may come more than once, are shuffled once and lie in buckets by the end they are
    followed from.
    """
    ends = [F.col("target_fqn"), F.col("source_fqn")] if upstream else [F.col("source_fqn"), F.col("target_fqn")]
    moves = edges.select(ends[0].alias("a"), ends[1].alias("b"))
    hops, forget = materialise_buckets(dealt_distinct(moves, "a"), "hops", "a", dealt=True)
    try:
        if starts is None and upstream:
            starts = hops.select(F.col("a").alias("node")).distinct().join(hops.selectExpr("b AS node"), "node", "left_anti")
        elif starts is None:
            starts = storage_roots(hops.selectExpr("a AS source_fqn", "b AS target_fqn"))
        starts = materialise(starts.select("node").distinct(), "starts")
        return _paths(hops, starts)
    finally:
        forget()


def _paths(hops: DataFrame, starts: DataFrame) -> DataFrame:
    inner = inner_nodes(hops, starts)
    onward = jumps(hops.join(inner.selectExpr("node AS a"), "a", "left_semi").selectExpr("a AS node", "b AS at"), inner)
    back = jumps(hops.join(inner.selectExpr("node AS b"), "b", "left_semi").selectExpr("b AS node", "a AS at"), inner)

    depths = _least_depths(hops, onward, starts)
    along = back.join(depths.selectExpr("node AS at", "depth"), "at").select("node", (F.col("depth") + F.col("hops")).alias("depth"))
    # Onward jumps that end nowhere stand for inner nodes all the same: they have a way in.
    found = materialise(depths.unionByName(along), "depths")
    # The least depth before a node is one less than its own, so it is told without asking for that along each edge.
    before = hops.join(found.selectExpr("node AS a", "depth AS a_depth"), "a").groupBy("b")
    before = before.agg(F.min(F.struct("a_depth", "a")).alias("first")).selectExpr("b AS node", "first.a AS before")
    found = found.join(before, "node", "left")
    return materialise(found.select("node", "depth", F.when(F.col("depth") > 0, F.col("before")).alias("predecessor")), "paths")


def dealt_distinct(rows: DataFrame, key: str) -> DataFrame:
    """Distinct rows, dealt by one key in a single shuffle into as many tasks as that has.

    Rows of hot keys collapse before their shuffle, so that what comes again does not meet in one
    task. A sample tells which keys these are, by hash: that decides on the way of a row only.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_hashes(rows, F.xxhash64(key))
    if hot.isEmpty():
        return rows.repartition(tasks, key).distinct()
    is_hot = F.xxhash64(key) == F.col("hot_hash")
    others = rows.join(hot, is_hot, "left_anti").repartition(tasks, key).distinct()
    return others.unionByName(rows.join(hot, is_hot, "left_semi").distinct().repartition(tasks, key))


def inner_nodes(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes with one edge in and one out, from and to other nodes, that no walk starts from."""
    ways_in = hops.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("ins"), F.max(F.expr("a = b")).alias("own"))
    ways_out = hops.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("outs"))
    found = ways_in.where("ins = 1 AND NOT own").join(ways_out.where("outs = 1"), "node")
    return materialise(found.select("node").join(starts, "node", "left_anti"), "inner")


def jumps(pointers: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, at, hops): for each inner node the first node along its pointers that is none, if there is one."""
    ahead = pointers.join(inner.select(F.col("node").alias("at"), F.lit(True).alias("on")), "at", "left")
    ahead = materialise(ahead.select("node", "at", F.lit(1).alias("hops"), F.coalesce("on", F.lit(False)).alias("on")), "jumps")
    left = ahead.where("on").count()
    while left:
        # A pointer to an inner node takes over where that one's pointer leads.
        further = ahead.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("on").alias("still"))
        on = ahead.where("on").drop("on").join(further, "at").selectExpr("node", "to AS at", "hops + more AS hops", "still AS on")
        ahead = materialise(ahead.where("NOT on").unionByName(on), "jumps")
        still = ahead.where("on").count()
        if still == left:
            # What is left runs in circles that nothing enters.
            break
        left = still
    return ahead.where("NOT on").drop("on")


def _least_depths(hops: DataFrame, onward: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth) of starts and of nodes that are not jumped over: taken up again where a shorter way is found.

    An edge to a node that is jumped over leads to where that one's jump does. Nodes are
    jumped from only by these, so a round follows the edges of nodes found before it where
    they lie and shuffles only nodes.
    """
    over = onward.select("node", "at", "hops")
    depths = frontier = materialise(starts.withColumn("depth", F.lit(0)), "depths")
    while not frontier.isEmpty():
        reached = hops.join(frontier.selectExpr("node AS a", "depth"), "a").select(
            F.col("b").alias("node"), (F.col("depth") + 1).alias("depth")
        )
        reached = reached.groupBy("node").agg(F.min("depth").alias("depth")).join(over, "node", "left").select(
            F.coalesce("at", "node").alias("node"), (F.col("depth") + F.coalesce("hops", F.lit(0))).alias("depth")
        )
        nearest = reached.groupBy("node").agg(F.min("depth").alias("depth"))
        known = depths.select("node", F.col("depth").alias("known"))
        better = nearest.join(known, "node", "left").where("known IS NULL OR depth < known").select("node", "depth")
        frontier = materialise(better, "frontier")
        depths = materialise(
            depths.unionByName(frontier).groupBy("node").agg(F.min("depth").alias("depth")), "depths"
        )
    return depths
