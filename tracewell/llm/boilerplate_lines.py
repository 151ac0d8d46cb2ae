r"""Removal of lines that recur over many sites.

The spread of a line is the number of distinct sites whose texts hold it. Each
line hash gets a HyperLogLog sketch of its sites; sketches are merged by
aggregation, first within tasks. Lines whose estimate is clearly above or below the
threshold are decided by it; those near the threshold get an exact distinct count.
Every line of at least `min_sites` sites is then taken out of every text.

Lines are parted by \n and compared without white space at their ends; blank lines
are never removed. A line is known by a 64-bit hash and its length. Null and empty
texts stay as they are; a null site counts for no line; rows with equal keys and
different texts are treated apart, repeated rows alike; an empty table stays empty.
Other columns keep their values, whatever their names.

Copies of a document make all its lines widespread where they lie on enough sites.
With `copies`, texts of which widespread lines hold more than half the characters, each
line of a text counted once, are taken for such copies: only lines that the other texts
have on enough sites are taken out, of all texts. Sites can also be counted over other
rows than are cleaned, and texts that would keep no line with a word can be left as they
are.

Tasks put equal lines of a site together before anything is shuffled. Lines that make up
more than 1 / `HOT_PARTS` of what widespread lines occur are fewer than that; where texts
meet the set of widespread lines, each of these is dealt over `SALTS` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import documents
from tracewell.sources.workspace import materialise

MIN_SITES = 10
#: 2**LG_REGISTERS registers a sketch; estimates are off by 1.04 / sqrt of that, times the count.
LG_REGISTERS = 12
#: Standard errors about the threshold within which a line is counted exactly.
NEAR = 4
#: Which lines are hot, and over how many keys each is dealt.
HOT_PARTS, SALTS = 1000, 256

_SPACES = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """Null for a blank line."""
    bare = F.btrim(line, F.lit(_SPACES))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h"), F.length(bare).alias("n")))


def _distinct_lines(text: Column) -> Column:
    hashes = F.transform(_lines(text), _hash)
    return F.array_distinct(F.filter(hashes, lambda line: line.isNotNull()))


def line_sites(df: DataFrame, text: str, site: str) -> DataFrame:
    """(line, site) of every line with a word, once per text; line is a hash and a length."""
    lines = _distinct_lines(F.col(text).cast("string"))
    return df.select(F.col(site).cast("string").alias("site"), F.explode(lines).alias("line"))


def line_spread(lines: DataFrame, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(line, spread, rows): the estimated number of distinct sites of each line, and how many rows have it."""
    spread = F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_registers))
    return lines.groupBy("line").agg(spread.alias("spread"), F.count("*").alias("rows"))


def widespread(lines: DataFrame, min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(line, rows) of all lines with at least `min_sites` sites."""
    margin = max(1, round(NEAR * 1.04 / 2 ** (lg_registers / 2) * min_sites + 0.5))
    spread = line_spread(lines, lg_registers).where(F.col("spread") >= min_sites - margin)
    spread = materialise(spread, "spread")
    far = spread.where(F.col("spread") > min_sites + margin).select("line", "rows")
    near = spread.where(F.col("spread") <= min_sites + margin).select("line", "rows")
    # A hot line leaves a task with one row per site.
    exact = lines.distinct().join(near, "line").groupBy("line", "rows").agg(F.count("site").alias("sites"))
    return far.unionByName(exact.where(F.col("sites") >= min_sites).select("line", "rows"))


def _held(held: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of `held` whose line is in `lines`(line, rows)."""
    total = lines.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT_PARTS > total
    hot = lines.where(is_hot).select("line", F.lit(True).alias("hot"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    wanted = lines.select("line", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "text_hash"), F.lit(SALTS))).otherwise(0)
    # At most HOT_PARTS lines are hot.
    salted = held.join(F.broadcast(hot), "line", "left").withColumn("salt", salt.cast("int")).drop("hot")
    return salted.join(wanted, ["line", "salt"], "left_semi").drop("salt")


def _apart_from_copies(hits: DataFrame, min_sites: int) -> DataFrame:
    """(line) of those in `hits` that texts which do not consist of such lines have on enough sites."""
    texts = hits.select("key", "text_hash", "size", "line").distinct().groupBy("key", "text_hash", "size")
    copies = texts.agg(F.sum("line.n").alias("wide")).where(2 * F.col("wide") > F.col("size"))
    copies = copies.select(F.col("key").alias("copy_key"), F.col("text_hash").alias("copy_hash"))
    same = F.col("key").eqNullSafe(F.col("copy_key")) & (F.col("text_hash") == F.col("copy_hash"))
    others = hits.join(copies, same, "left_anti").select("line", "site").distinct()
    sites = others.groupBy("line").agg(F.count("site").alias("sites"))
    return sites.where(F.col("sites") >= min_sites).select("line")


def remove_widespread(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    counted: DataFrame | None = None,
    whole: bool = False,
    copies: bool = False,
) -> DataFrame:
    """(row, cleaned, n_lines, n_removed): each input row, its text without widespread lines, and counts.

    Sites are counted over `counted`, else over all rows, with `copies` over those that
    are not copies; with `whole`, a text stays as it is if no line with a word would be left.
    """
    rows = df.select(
        F.struct("*").alias("row"),
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.col(site).cast("string").alias("site"),
        F.xxhash64(F.col(text)).alias("text_hash"),
    )
    if counted is None:
        sites = line_sites(df, text, site)
    else:
        # Written, since it is read twice.
        sites = materialise(line_sites(counted, text, site), "sites")
    # Written, so that Spark knows its size: where it is small it is broadcast, and no line is shuffled again.
    lines = materialise(widespread(sites, min_sites), "lines")
    split = rows.select("key", "text_hash", "site", _distinct_lines(F.col("text")).alias("lines"))
    size = F.aggregate("lines", F.lit(0).cast("long"), lambda total, line: total + line["n"])
    held = split.select("key", "text_hash", "site", size.alias("size"), F.explode("lines").alias("line"))
    if copies:
        hits = materialise(_held(held, lines).select("key", "text_hash", "site", "size", "line"), "hits")
        hits = hits.join(materialise(_apart_from_copies(hits, min_sites), "lines"), "line", "left_semi")
    else:
        hits = _held(held.drop("site", "size"), lines)
    # The lines to remove from one text are no more than its distinct lines.
    found = hits.groupBy("key", "text_hash").agg(F.collect_set("line").alias("gone"))
    found = found.select(F.col("key").alias("found_key"), F.col("text_hash").alias("found_hash"), "gone")
    joined = rows.join(
        found, F.col("key").eqNullSafe(F.col("found_key")) & (F.col("text_hash") == F.col("found_hash")), "left"
    )
    left = F.filter(_lines(F.col("text")), lambda line: ~F.coalesce(F.array_contains("gone", _hash(line)), F.lit(False)))
    cleaned = joined.select("row", "text", F.when(F.col("gone").isNotNull(), left).alias("left"))
    if whole:
        some = F.exists("left", lambda line: _hash(line).isNotNull())
        cleaned = cleaned.withColumn("left", F.when(some, F.col("left")))
    n_lines = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long")
    return cleaned.select(
        "row",
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("cleaned"),
        F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"),
        F.when(F.col("left").isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size("left")).alias("n_removed"),
    )


def without_widespread(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    size: str | None = "n_chars",
    min_sites: int = MIN_SITES,
    counted: DataFrame | None = None,
    whole: bool = False,
    copies: bool = False,
) -> DataFrame:
    """The rows with their texts cleaned; `size`, if named, is the length of a text that changed."""
    found = remove_widespread(df, key, text, site, min_sites, counted, whole, copies)
    columns = {name: F.col(f"row.`{name}`") for name in df.columns}
    columns[text] = F.col("cleaned")
    if size:
        length = F.length("cleaned").cast(df.schema[size].dataType)
        columns[size] = F.when(F.col("n_removed") > 0, length).otherwise(columns[size])
    return found.select(*[column.alias(name) for name, column in columns.items()])


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_widespread(documents(spark, sf_dir))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("kept_sha256"),
    )


def line_spread_sql(documents: str = "documents", min_sites: int = MIN_SITES) -> str:
    """The same with exact counts in SQL."""
    bare = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM {documents}),
l AS (
    SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS i
    FROM d
),
b AS (SELECT *, {bare} AS bare FROM l),
wide AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT b.*, wide.bare IS NOT NULL AS gone FROM b LEFT JOIN wide USING (bare)),
s AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
    FROM m GROUP BY r
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)"""
