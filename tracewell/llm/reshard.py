"""Resharding that moves the fewest bytes.

A layout is a folder of Parquet files in blocks: old shard by range of keys. From
the bytes of the old shards and the capacities of the new ones, a minimum-cost flow
says how many bytes go from where to where, at no cost for what stays. Each old
shard, in order of its keys, is cut where one transfer ends and the next begins, so
the whole plan is a short list of border keys. Only blocks from which something
moves are rewritten; all others are taken over as they are.

A text's size is its UTF-8 bytes plus 1, a null text's 1. Rows with equal keys go
together (so sizes are equal but for about a row per border); null keys come first;
an empty table gives an empty layout. Columns of the input are kept, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.batches import documents
from tracewell.llm.ranges import range_bounds, range_of
from tracewell.sources.workspace import fresh_path

#: Bytes of a range of keys, or more if there would be too many ranges. A block is what an old shard has in
#: one; one row per block comes to the driver.
RANGE_BYTES, MOST_RANGES = 64 << 20, 4096
OLD_SHARDS, NEW_SHARDS = 20, 16
_LEAST = -(1 << 63)


def minimum_cost_flow(
    supplies: Sequence[int], capacities: Sequence[int], costs: Sequence[Sequence[int]]
) -> list[list[int]]:
    """flow[i][j] of all supplies into the capacities at least cost, by shortest augmenting paths."""
    n, m = len(supplies), len(capacities)
    if sum(supplies) > sum(capacities):
        raise ValueError("the capacities do not hold what there is")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supplies), list(capacities)
    while any(left):
        # Shortest ways to each new shard from any old one with bytes left, back over flows too.
        reach_old = [0 if x else None for x in left]
        reach_new: list[int | None] = [None] * m
        from_new, from_old = [None] * n, [None] * m
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if reach_old[i] is None:
                    continue
                for j in range(m):
                    far = reach_old[i] + costs[i][j]
                    if reach_new[j] is None or far < reach_new[j]:
                        reach_new[j], from_old[j], changed = far, i, True
            for j in range(m):
                if reach_new[j] is None:
                    continue
                for i in range(n):
                    far = reach_new[j] - costs[i][j]
                    if flow[i][j] and (reach_old[i] is None or far < reach_old[i]):
                        reach_old[i], from_new[i], changed = far, j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (reach_new[j], j))
        path, j = [], end
        while True:
            i = from_old[j]
            path.append((i, j, 1))
            if from_new[i] is None or (left[i] and reach_old[i] == 0):
                break
            j = from_new[i]
            path.append((i, j, -1))
        amount = min([left[i], room[end], *(flow[a][b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a][b] += sign * amount
        left[i] -= amount
        room[end] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


@dataclass(frozen=True)
class Layout:
    """Blocks below `path`: rows with `row` (a struct), `key`, `size`, `block` and the shard they are in."""

    path: str
    bounds: tuple[int, ...]
    key: str
    text: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def write_layout(df: DataFrame, old_shard: Column, path: str, key: str = "doc_id", text: str = "text") -> Layout:
    """Put rows into their old shards, as blocks in files; nothing is shuffled."""
    rows = df.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("key"),
        row_size(F.col(text)).alias("size"),
        old_shard.cast("int").alias("old_shard"),
    )
    bounds = range_bounds(rows, F.col("key"), F.col("size"), RANGE_BYTES, MOST_RANGES)
    rows = rows.withColumn("block", range_of(F.col("key"), bounds))
    rows.write.partitionBy("old_shard", "block").parquet(path)
    return Layout(path, tuple(bounds), key, text)


@dataclass(frozen=True)
class Plan:
    """For each old shard, the new shards of its keys: from each border key on, to the next."""

    borders: dict[int, list[tuple[int, int]]]
    flow: list[list[int]]

    def shard(self, old_shard: Column, key: Column) -> Column:
        found = F.lit(None).cast("int")
        for old, cuts in self.borders.items():
            new = F.lit(cuts[0][1])
            for first, shard in cuts[1:]:
                new = F.when(key >= first, shard).otherwise(new)
            found = F.when(old_shard == old, new).otherwise(found)
        return found


def plan_transfers(blocks: DataFrame, capacities: Sequence[int] | int, old_shards: int) -> Plan:
    """The cheapest way from the layout's shards to shards of these capacities, or to so many equal ones."""
    cells = blocks.groupBy("old_shard", "block").agg(F.sum("size").alias("size")).toArrow().to_pylist()
    cells.sort(key=lambda c: (c["old_shard"], c["block"]))
    supplies = [0] * old_shards
    for cell in cells:
        cell["before"] = supplies[cell["old_shard"]]
        supplies[cell["old_shard"]] += cell["size"]
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(supplies), capacities)
    costs = [[int(i != j) for j in range(len(capacities))] for i in range(old_shards)]
    flow = minimum_cost_flow(supplies, capacities, costs)
    # Cuts in the bytes of each old shard: what stays comes first.
    cuts = []
    for i, parts in enumerate(flow):
        end = 0
        for j in sorted(range(len(parts)), key=lambda j: (j != i, j)):
            if parts[j]:
                cuts.append((i, end, j))
                end += parts[j]
    places = []
    for i, at, j in cuts:
        cell = next(c for c in reversed(cells) if c["old_shard"] == i and c["before"] <= at)
        places.append((i, cell["block"], at - cell["before"], j))
    return Plan(_border_keys(blocks, places), flow)


def _border_keys(blocks: DataFrame, places: list[tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The key at each byte of a block; only blocks with a border are looked at."""
    borders: dict[int, list[tuple[int, int]]] = {}
    if not places:
        return borders
    spark = blocks.sparkSession
    wanted = spark.createDataFrame(places, "old_shard int, block int, at long, shard int")
    rows = blocks.join(F.broadcast(wanted.select("old_shard", "block").distinct()), ["old_shard", "block"], "left_semi")
    sizes = rows.groupBy("old_shard", "block", "key").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("old_shard", "block").orderBy("key")
    sums = sizes.withColumn("before", F.sum("size").over(order) - F.col("size"))
    near = sums.join(F.broadcast(wanted), ["old_shard", "block"]).where("2 * before + size > 2 * at")
    found = near.groupBy("old_shard", "block", "at", "shard").agg(F.min("key").alias("key"))
    last = sizes.groupBy("old_shard", "block").agg(F.max("key").alias("last"))
    joined = wanted.join(last, ["old_shard", "block"]).join(found, ["old_shard", "block", "at", "shard"], "left")
    for row in joined.orderBy("old_shard", "block", "at").toArrow().to_pylist():
        key = row["last"] + 1 if row["key"] is None else row["key"]
        own = borders.setdefault(row["old_shard"], [])
        own.append((key if own else _LEAST, row["shard"]))
    return borders


@dataclass(frozen=True)
class Resharded:
    """Rows taken over in their blocks, and rewritten ones."""

    kept: DataFrame
    rewritten: DataFrame

    def rows(self) -> DataFrame:
        """(row, key, size, block, shard) of the new layout."""
        return self.kept.unionByName(self.rewritten)


def reshard(spark: SparkSession, layout: Layout, plan: Plan, path: str) -> Resharded:
    """Rewrite the blocks of which rows move, by shard, and leave the others where they are."""
    rows = layout.read(spark).withColumn("shard", plan.shard(F.col("old_shard"), F.col("key")))
    # What stays comes first, so blocks are touched from one on.
    moved = rows.where("shard <> old_shard").groupBy("old_shard").agg(F.min("block").alias("block"))
    affected = F.lit(False)
    for row in moved.toArrow().to_pylist():
        # On partition columns, so untouched files are not opened for this.
        affected = affected | ((F.col("old_shard") == row["old_shard"]) & (F.col("block") >= row["block"]))
    columns = ["row", "key", "size", "block", "shard"]
    rows.where(affected).select(columns).write.partitionBy("shard").parquet(path)
    schema = rows.select(columns).schema
    return Resharded(rows.where(~affected).select(columns), spark.read.schema(schema).parquet(path))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds `slot`: gapless from 0 within each shard, in order of block and key."""
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "block").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(within))
    joined = numbered.join(before, ["shard", "block"])
    return joined.withColumn("slot", (F.col("before") + F.col("number") - 1).cast("long"))


def op8_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that followed the source, with a hot one, become 16 of equal bytes."""
    root = fresh_path(spark, "shards")
    old_shard = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    layout = write_layout(documents(spark, sf_dir), old_shard, f"{root}/old")
    plan = plan_transfers(layout.read(spark).select("old_shard", "block", "key", "size"), NEW_SHARDS, OLD_SHARDS)
    rows = reshard(spark, layout, plan, f"{root}/new").rows()
    placed = rows.select(
        F.col("row.doc_id").alias("doc_id"),
        "key",
        "size",
        F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"),
        "block",
        "shard",
    )
    return with_slots(placed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
