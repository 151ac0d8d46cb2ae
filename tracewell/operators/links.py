"""Links, and the edges they amount to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import fqn_to_path, process_of, run_of
from tracewell.sources.workspace import materialise

#: A key is hot if it has so many rows in a sample of this share of them.
HOT_SHARE, HOT_ROWS = 1 / 64, 2048
#: Events and links in a task that joins or sorts them, which it does in memory.
TASK_ROWS = 1 << 20
#: A run is hot if it has a quarter of a task's share of all rows, and at least so many.
HOT_RUN_ROWS = 1000
#: Rows of a sample that such a run has at least; half of them tell it, as samples vary.
HOT_RUN_SAMPLE = 64


def flatten_links(links: DataFrame) -> DataFrame:
    """The links of a log; a missing endpoint gets its default name.

    The ancestors of an event are part of its name, so telling the run and
    process of a link takes no join.
    """
    return links.select(
        "event",
        "start_time",
        "link_pos",
        F.coalesce("source", F.lit(V.UNKNOWN_SOURCE)).alias("source_fqn"),
        F.coalesce("target", F.lit(V.UNKNOWN_TARGET)).alias("target_fqn"),
        "level",
    )


def declared_links(links: DataFrame, *carried: str) -> DataFrame:
    """The links of a log as declared, missing endpoints left NULL.

    `carried` names further columns to keep.
    """
    return links.select(
        "event",
        *carried,
        "link_pos",
        F.col("source").alias("source_fqn"),
        F.col("target").alias("target_fqn"),
        "level",
    )


def without_self_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("source_fqn") != F.col("target_fqn"))


def table_edges(links: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct table-level edges between named endpoints.

    Operators that make edges distinct themselves take them as often as links have them.
    """
    named = without_self_links(declared_links(links)).where(F.col("level") == V.TABLE_LEVEL)
    edges = named.select("source_fqn", "target_fqn")
    return edges.distinct() if distinct else edges


def edges_per_process(links: DataFrame) -> DataFrame:
    """Distinct edges of each process, with the event that first showed them."""
    moves = without_self_links(flatten_links(links))
    return _first_seen(moves, flatten_links(links), by_process=True)


def edges_first_seen(links: DataFrame) -> DataFrame:
    """Distinct edges of the whole log, with the event that first showed them."""
    named = flatten_links(links)
    edges = _first_seen(without_self_links(named), named)
    return edges.withColumn("process", process_of(F.col("event")))


def _first_seen(links: DataFrame, logged: DataFrame, by_process: bool = False) -> DataFrame:
    """The earliest event per edge, by start time and then by name.

    Names are unique, so the order is total. An aggregate rather than a
    window; `collapsed` sees to busy edges and processes.
    """
    moves = links.select("source_fqn", "target_fqn", "start_time", "event")
    first = F.min(F.struct("start_time", "event")).alias("first")
    edges = collapsed(moves, ["source_fqn", "target_fqn"], first, by_process=by_process, logged=logged)
    return edges.withColumn("event", F.col("first.event")).drop("first").withColumns(
        {
            "run": run_of(F.col("event")),
            "source_path": fqn_to_path(F.col("source_fqn")),
            "target_path": fqn_to_path(F.col("target_fqn")),
        }
    )


def collapsed(
    rows: DataFrame, keys: list[str], *found: Column, by_process: bool = False, logged: DataFrame | None = None
) -> DataFrame:
    """`found`, aggregates that sort, of rows grouped by `keys`, which mostly have few rows.

    Rows are dealt before they are sorted, so that a task sorts its share of a shuffle once, and
    not all it reads before that. `by_process`, the process of `event` is a key too, and rows are
    dealt by it: a log is sorted by name, so they have most of their text in common with the row
    before, and are a good deal smaller than dealt by all keys, as those of busy processes are.
    Rows of hot keys collapse before they are shuffled. Samples tell what is busy or hot, by hash:
    that decides on the way of a row only. Names share long prefixes, so a hash is sorted by first.
    Rows are those of `logged` or part of them: that is what samples and the number of tasks are
    taken from, so that a join or filter before is not done once more for each.
    """
    logged = rows if logged is None else logged
    total = logged.count()
    process = process_of(F.col("event"))
    key = F.xxhash64(process, *keys) if by_process else F.xxhash64(*keys)
    if by_process:
        way = F.xxhash64(process)
        busy = busy_processes(logged)
        way = F.when(way.isin(*busy), key).otherwise(way) if busy else way
        dealt, grouped = [way], [way.alias("way"), process.alias("process"), *keys]
    else:
        dealt, grouped = keys, [F.xxhash64(keys[0]).alias("way"), *keys]

    def collapse(some: DataFrame) -> DataFrame:
        return some.groupBy(*grouped).agg(*found).drop("way")

    hot = hot_hashes(logged, key)
    if hot.isEmpty():
        return collapse(dealt_by(rows, total, *dealt))
    is_hot = key == F.col("hot_hash")
    others = collapse(dealt_by(rows.join(hot, is_hot, "left_anti"), total, *dealt))
    return others.unionByName(collapse(rows.join(hot, is_hot, "left_semi")))


def hot_hashes(rows: DataFrame, key: Column) -> DataFrame:
    """(hot_hash): the hashes that many sampled rows have."""
    return materialise(_sampled_hot(rows, key), "hot")


def busy_processes(rows: DataFrame) -> list[int]:
    """Hashes of the processes that many sampled rows with an `event` have; they come to the driver, one per 131072 rows at most."""
    return [row["hot_hash"] for row in _sampled_hot(rows, F.xxhash64(process_of(F.col("event")))).collect()]


def _sampled_hot(rows: DataFrame, key: Column) -> DataFrame:
    counted = rows.select(key.alias("hot_hash")).sample(HOT_SHARE, 1).groupBy("hot_hash").agg(F.count("*").alias("sampled"))
    return counted.where(F.col("sampled") >= HOT_ROWS).select("hot_hash")


def dealt_by(rows: DataFrame, total: int, *keys: Column | str) -> DataFrame:
    """`rows`, of which there are at most `total`, dealt by `keys`: a bounded number to a task, and no fewer tasks than a shuffle has."""
    spark = rows.sparkSession
    tasks = -(-total // TASK_ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        return rows.repartition(*keys)
    return rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


@dataclass(frozen=True)
class Dealing:
    """How events and links come to tasks: by their run, those of hot runs by event.

    Rows of a run have most of their text in common, so dealt together they are a fraction
    of the size that they have when dealt by event.
    """

    #: None: as many as a shuffle has.
    tasks: int | None
    #: Hashes of hot runs, a few per task at most.
    hot: tuple[int, ...]

    def is_hot(self) -> Column:
        return F.xxhash64(run_of(F.col("event"))).isin(*self.hot)

    def deal(self, rows: DataFrame, *keys: Column | str) -> DataFrame:
        return rows.repartition(self.tasks, *keys) if self.tasks else rows.repartition(*keys)


def dealing(events: DataFrame, links: DataFrame) -> Dealing:
    """How rows with the names in `event` come to tasks; hot runs are told by a sample and only go another way."""
    spark = links.sparkSession
    total = events.count() + links.count()
    tasks = -(-total // TASK_ROWS)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(HOT_RUN_ROWS, total // (4 * max(tasks, shuffled)))
    run = F.xxhash64(run_of(F.col("event"))).alias("run")
    names = events.select("event").unionByName(links.select("event")).where(F.col("event").isNotNull())
    sampled = names.sample(min(1.0, HOT_RUN_SAMPLE / most), 1).groupBy(run).agg(F.count("*").alias("sampled"))
    hot = sampled.where(F.col("sampled") >= HOT_RUN_SAMPLE // 2).select("run").collect()
    bounded = tasks > spark.sparkContext.defaultParallelism
    return Dealing(tasks if bounded else None, tuple(sorted(row["run"] for row in hot)))


def with_ends(links: DataFrame, ends: DataFrame, how: Dealing) -> list[DataFrame]:
    """Links joined with the ends (event, end_time) of their events, in frames that share no event.

    The first has a column `dealt` that its rows are dealt by. There, links and ends come to a task
    in one shuffle and meet in a window: a join by event would deal them by event. Those of
    hot runs are joined by event, so that an event with very many links may be split.
    """
    rows = links.withColumn("is_end", F.lit(False)).unionByName(
        ends.withColumn("is_end", F.lit(True)), allowMissingColumns=True
    ).where(F.col("event").isNotNull())
    way = F.xxhash64(run_of(F.col("event")))
    dealt = how.deal(rows.where(~how.is_hot()) if how.hot else rows, way).withColumn("dealt", way)
    event = Window.partitionBy("dealt", "event")
    met = dealt.withColumn("ends", F.collect_list(F.when(F.col("is_end"), F.struct("end_time"))).over(event))
    each = met.where(~F.col("is_end")).withColumn("end", F.explode("ends"))
    others = each.select("dealt", *links.columns, "end.end_time")
    if not how.hot:
        return [others]
    return [others, links.where(how.is_hot()).join(ends, "event").select(*links.columns, "end_time")]


def upstream_links(links: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Links by target FQN: what feeds each table, and how many links say so.

    `targets` (column `target_fqn`) narrows the answer to some tables.
    """
    named = flatten_links(links)
    if targets is not None:
        named = named.join(targets.select("target_fqn").distinct(), "target_fqn", "left_semi")
    return named.groupBy("target_fqn", "source_fqn").agg(F.count(F.lit(1)).alias("links"))
