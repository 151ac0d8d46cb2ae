r"""Exact duplicates by sorting texts by their content.

Texts are equal when they are identical after each run `[\x20\x09-\x0D]+` has become
one space. A sample of the rows gives splitters; each row goes to the range of its
content, and ranges are sorted externally, so equal texts come to lie side by side and
each row is compared, in full, with its neighbour. Of equal texts the row with the
smallest key stays.

The content order is by the first characters of the normalised text, then by its
SHA-256, then by the whole text and the key. Splitters hold the first two and the key,
so many copies of one text, or many texts with one beginning, are spread over ranges
of near equal bytes. Copies may so lie in several ranges that follow each other; only
the first and the last text of a range can go on outside, and these few are joined by
length and SHA-256.

DataFrame functions only. Null and empty texts are equal. A null key comes after all
others: its row stays only where all keys of its group are null. Of rows with equal
texts and keys one stays. An empty table gives an empty one. Other columns are looked
at only where they are asked for.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.batches import documents
from tracewell.sources.workspace import materialise

#: Characters of a text that splitters hold.
HEAD = 64
#: Bytes of texts in a range, unless that made more than `MOST_RANGES`.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 13
#: Rows sampled per range, about; that many short keys come to the driver.
SAMPLED = 48
#: What a row weighs beside its text.
ROW_BYTES = 100
BOUND = "struct<order_key:string,no_key:boolean,key:bigint>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _order_key(norm: Column) -> Column:
    """Sorts as the beginning of the text does; a sign below all others parts it from the digest."""
    return F.concat(F.left(norm, F.lit(HEAD)), F.lit("\x00"), F.sha2(norm, 256))


def splitters(df: DataFrame, key: Column, text: Column) -> list[dict]:
    """Order key, no key and key at which ranges of near equal bytes begin, from a sample of the rows."""
    rows = df.select(key.alias("key"), text.cast("string").alias("text"))
    known = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    size = (known["bytes"] or 0) + ROW_BYTES * known["n"]
    ranges = min(MOST_RANGES, -(-size // RANGE_BYTES))
    if ranges < 2:
        return []
    # A row is taken with a chance in proportion to its bytes, and stands for so many.
    each = size // (SAMPLED * ranges) + 1
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    sample = rows.withColumn("bytes", F.greatest(weight, F.lit(each))).where(F.rand(1) * each < weight)
    sample = sample.select(
        _order_key(normalised(F.col("text"))).alias("order_key"),
        F.col("key").isNull().alias("no_key"),
        "key",
        "bytes",
    )
    # Strings and longs in the order that Spark gives them; a null key is behind `no_key`.
    sampled = sample.orderBy("order_key", "no_key", "key").collect()
    share, filled, found = sum(row["bytes"] for row in sampled) / ranges, 0, []
    for row in sampled:
        if filled >= share * (len(found) + 1):
            found.append({"order_key": row["order_key"], "no_key": row["no_key"], "key": row["key"] or 0})
        filled += row["bytes"]
    return found


def _range_of(bounds: list[dict]) -> Column:
    """Number of bounds at or below a row, by binary search."""
    if not bounds:
        return F.lit(0)
    # Folded to a constant when the query is planned.
    literal = F.from_json(F.lit(json.dumps(bounds)), f"array<{BOUND}>")
    here = F.struct("order_key", "no_key", F.coalesce("key", F.lit(0)).alias("key"))
    strides = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, strides)),
        F.lit(0),
        lambda at, stride: at + F.when(F.get(literal, at + stride - 1) <= here, stride).otherwise(0),
    )


def exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """(key, keep, group_size, stays, text_sha256) of every row, with `row` where whole rows are asked for."""
    row = [F.struct("*").alias("row")] if whole_rows else []
    rows = df.select(F.col(key).cast("long").alias("key"), normalised(F.col(text)).alias("norm"), *row)
    rows = rows.withColumns({"order_key": _order_key(F.col("norm")), "no_key": F.col("key").isNull()})
    bounds = splitters(df, F.col(key).cast("long"), F.col(text))
    # The partition is the range, so the windows below need no further shuffle of texts.
    dealt = rows.withColumn("range", _range_of(bounds)).repartitionById(len(bounds) + 1, "range")

    sorted_ = Window.partitionBy("range").orderBy("order_key", "norm", "no_key", "key")
    differs = ~F.lag("norm").over(sorted_).eqNullSafe(F.col("norm"))
    carried = ["row"] if whole_rows else []
    marked = dealt.select(
        "range",
        "key",
        F.right("order_key", F.lit(64)).alias("text_sha256"),
        F.octet_length("norm").alias("bytes"),
        F.row_number().over(sorted_).alias("place"),
        differs.alias("first"),
        *carried,
    )
    runs = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("run", F.count_if("first").over(runs))
    run = Window.partitionBy("range", "run").orderBy("place")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = numbered.withColumns(
        {
            "keep": F.first("key").over(whole),
            "size": F.count("*").over(whole),
            "first": F.row_number().over(run) == 1,
        }
    )
    found = found.drop("place")
    if not bounds:
        result = found.withColumnsRenamed({"size": "group_size", "first": "stays"})
    else:
        # Without the texts, which are sorted once.
        result = _joined_at_edges(materialise(found, "runs"))
    return result.select("key", "keep", "group_size", "stays", "text_sha256", *carried)


def _joined_at_edges(found: DataFrame) -> DataFrame:
    """Runs at the ends of ranges, put together with those they go on in; two rows per range at most."""
    last = found.groupBy("range").agg(F.max("run").alias("last"))
    heads = found.where("first").select("range", "run", "text_sha256", "bytes", "keep", "size")
    edges = heads.join(last, "range").where("run = 1 OR run = last")
    rank = F.struct("range", "run")
    groups = edges.groupBy("text_sha256", "bytes").agg(
        F.count("*").alias("parts"),
        F.min(rank).alias("home"),
        F.min_by("keep", rank).alias("group_keep"),
        F.sum("size").alias("group_total"),
    )
    parts = edges.select("range", "run", "text_sha256", "bytes").join(
        groups.where("parts > 1"), ["text_sha256", "bytes"]
    )
    parts = parts.select("range", "run", "home", "group_keep", "group_total")
    joined = found.join(F.broadcast(parts), ["range", "run"], "left")
    inside = F.col("home").isNull()
    return joined.select(
        "*",
        F.when(inside, F.col("keep")).otherwise(F.col("group_keep")).alias("kept_key"),
        F.coalesce("group_total", "size").alias("group_size"),
        (F.col("first") & (inside | (F.col("home") == rank))).alias("stays"),
    ).drop("keep").withColumnRenamed("kept_key", "keep")


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return exact_copies(df, key, text, whole_rows=True).where("stays").select("row.*")


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_copies(documents(spark, sf_dir))
    return found.select(
        F.col("key").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        "group_size",
        F.col("stays").alias("kept"),
        "text_sha256",
    )


def exact_copies_sql(documents: str = "documents") -> str:
    """The same in SQL."""
    return rf"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM {documents}
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d"""
