r"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has one 8-bit symbol per hash function. Documents as similar as asked
for differ in at most t symbols, but for a chance below one in a million (`Scheme`).
Symbols are split into m chunks with 2 m > t, so in one chunk at least two such
signatures differ in one symbol or none: under the keys of a chunk, each with one
symbol left out, they meet. All pairs within distance t are found so.

Documents with equal shingle sets are one class and are compared once. Classes that
meet under a key are first laid beside one of them only, the hub, on the full sets, and
most links of a group are found so. Two sets differ where exactly one of them differs
from the hub, so how similar any two of a group are follows from their differences. Only
classes left outside the hub's component are laid beside others in this way, dealt over
tasks where the group is large. Every link is confirmed on the full sets, as sorted
64-bit hashes of shingles. Components come from label propagation with shortcuts.

Words are `[^\x20\x09-\x0D]+`, A-Z as a-z. A document's set has its distinct
shingles of n words, or its whole sequence if it has fewer words. Null and empty
texts have empty sets and are linked with nothing. Repeated rows are alike. A null
key is never a component's name unless all its documents have null keys. An empty
table gives an empty one. Columns of the input keep their values, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, documents, keyed_texts, map_batches, record_batch, slices
from tracewell.llm.words import Splitter, Words, mix, odd_numbers
from tracewell.sources.workspace import materialise

#: Words of a shingle, and least similarity in hundredths.
SHINGLE, SIMILARITY = 3, 85
#: Symbols of a chunk; one of them may differ.
CHUNK = 5
#: Chance that a pair exactly at the similarity differs in more symbols than allowed for, at most.
LOST = 1e-6
#: Classes of a hub that one task lays beside those of other components.
GROUP_ROWS = 512
#: 64-bit words of the filter by which texts are looked up again, at most (8 MB).
FILTER_WORDS = 1 << 20

_ROWS = pa.schema(
    [
        ("key", pa.int64()),
        ("text_hash", pa.int64()),
        ("n", pa.int64()),
        ("digest", pa.binary()),
        ("signature", pa.binary()),
    ]
)
_KEYS = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])
_SETS = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])
_COMPARED = pa.schema(
    [
        ("a", pa.int64()),
        ("b", pa.int64()),
        ("common", pa.int64()),
        ("linked", pa.bool_()),
        ("differs", pa.list_(pa.int64())),
    ]
)


def more_than(most: int, n: int, chance: float) -> float:
    """Chance that more than `most` of n symbols differ, each by `chance`."""
    if chance == 0:
        return 0.0
    differ, agree = math.log(chance), math.log1p(-chance)
    ways = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(n + 1)]
    return sum(math.exp(ways[i] + i * differ + (n - i) * agree) for i in range(most + 1, n + 1))


@dataclass(frozen=True)
class Scheme:
    """How long signatures are for a similarity, and how far linked ones may differ."""

    shingle: int = SHINGLE
    similarity: int = SIMILARITY
    chunk: int = CHUNK

    @property
    def chunks(self) -> int:
        miss, m = 1 - self.similarity / 100, 1
        while more_than(2 * m - 1, m * self.chunk, miss) > LOST:
            m += 1
        return m

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


# Sets and signatures


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    words = Splitter(fold=True)(texts)
    hashes, whole = words.windows(shingle)
    counts = words.counts
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes, owner = [hashes[whole]], [owner[whole]]
    for n in range(1, shingle):
        at = words.bounds[:-1][counts == n]
        hashes.append(_short(words, at, n))
        owner.append(np.flatnonzero(counts == n))
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _short(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, told apart from longer shingles."""
    weights = odd_numbers(n + 1, n)
    return mix(sum((words.hashes[at + i] * weights[i] for i in range(n)), np.zeros(len(at), np.uint64)) + weights[n])


def signatures(hashes: np.ndarray, bounds: np.ndarray, symbols: int) -> np.ndarray:
    """A row of symbols per text; those of empty sets mean nothing."""
    found = np.zeros((len(bounds) - 1, symbols), np.uint8)
    used = np.diff(bounds) > 0
    if used.any():
        factors, starts = odd_numbers(symbols, 7), bounds[:-1][used]
        for j in range(symbols):
            least = np.minimum.reduceat(hashes * factors[j], starts)
            found[used, j] = (least ^ (least >> np.uint64(23))).astype(np.uint8)
    return found


def _binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _digest(set_: np.ndarray) -> bytes:
    return hashlib.blake2b(set_.tobytes(), digest_size=16).digest()


def signed(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, text_hash, n, digest, signature) of every row of (key, text)."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            hashes, bounds = shingle_sets(batch.column("text"), scheme.shingle)
            found = signatures(hashes, bounds, scheme.symbols)
            digests = [_digest(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = np.diff(bounds), _binaries(digests), _binaries([s.tobytes() for s in found])
            yield record_batch(_ROWS, batch.column("key"), batch.column("text_hash"), *columns)

    rows = texts.withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, run, "key long, text_hash long, n long, digest binary, signature binary")


# Candidates


def bucket_keys(found: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Keys of each signature: for each chunk, and each of its symbols left out."""
    chunks = found.reshape(len(found), scheme.chunks, scheme.chunk).astype(np.uint64)
    weights = odd_numbers(scheme.chunk, 21)
    salts = odd_numbers(scheme.symbols, 22).reshape(scheme.chunks, scheme.chunk)
    keys = np.zeros(chunks.shape, np.uint64)
    whole = ((chunks + np.uint64(1)) * weights).sum(axis=2)
    for out in range(scheme.chunk):
        keys[:, :, out] = mix(mix(whole - (chunks[:, :, out] + np.uint64(1)) * weights[out]) + salts[:, out])
    return keys.reshape(len(found), -1)


def _signatures_of(column: pa.Array, scheme: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), scheme.symbols)


def buckets(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(bucket, node): every class under all its keys."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                keys = bucket_keys(_signatures_of(part.column("signature"), scheme), scheme)
                nodes = np.repeat(part.column("node").to_numpy(), keys.shape[1])
                yield record_batch(_KEYS, keys.ravel().view(np.int64), nodes)

    return map_batches(classes.select("node", "signature"), run, "bucket long, node long")


def shared_buckets(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(bucket, node) of keys that several classes have."""
    found = buckets(classes, scheme)
    several = found.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    return found.join(several.where("low < high").select("bucket"), "bucket", "left_semi")


def _hubs(members: DataFrame, shareable: DataFrame) -> DataFrame:
    """(bucket, hub): the class of each bucket that shares most of its own set."""
    rank = F.struct((F.col("most") / F.col("n")).alias("share"), "node")
    hubs = members.join(shareable, "node").groupBy("bucket").agg(F.max(rank).alias("hub"))
    return hubs.select("bucket", F.col("hub.node").alias("hub"))


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their component, in buckets that have several."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    found = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = found.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return found.join(several.where("low < high").select("bucket"), "bucket", "left_semi")


def _shareable(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, most): of how many shingles each set is, and how many of them another set has too.

    Two sets have no more in common than the smaller of these numbers, which rules
    out copies with too many changes of their own before they are paired.
    """

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, "shingles"):
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(x) for x in parts])
            yield record_batch(_KEYS, np.concatenate(parts), nodes)

    rows = map_batches(sets.select("node", "shingles"), run, "bucket long, node long")
    once = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = once.groupBy("node").agg(F.count("*").alias("own"))
    found = classes.select("node", "n").join(sets.select("node"), "node", "left_semi").join(own, "node", "left")
    return found.select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))


def _across(open_: DataFrame, hubs: DataFrame, beside: DataFrame, shareable: DataFrame, similarity: int) -> DataFrame:
    """All linked pairs of classes that share a bucket and not a component.

    Classes of one bucket have the same hub. With D the shingles in which a class differs from
    it, two classes differ in |D| + |D'| - 2 |D and D'| shingles, and they are linked where that
    is at most (1 - similarity) / (1 + similarity) of their sizes. Pairs inside the hub's component
    need no look, and the others are few, as links were made with the hub first.
    """
    labels = open_.select("node", "label").distinct()
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    group = open_.join(hubs, "bucket").select("hub", "node", "label").distinct()
    differs = beside.selectExpr("a AS hub", "b AS node", "differs")
    # A hub differs from itself in nothing.
    group = group.join(of_hub, "hub").join(shareable, "node").join(differs, ["hub", "node"], "left")
    group = group.select(
        "hub",
        "node",
        "label",
        (F.col("label") != F.col("hub_label")).alias("other"),
        "n",
        "most",
        F.coalesce("differs", F.array().cast("array<long>")).alias("differs"),
    )
    # Written, since it is read several times.
    group = materialise(group, "group")
    sizes = group.groupBy("hub").agg(F.count("*").alias("rows"), F.count_if("other").alias("others"))
    parts = F.ceil(F.col("rows") / GROUP_ROWS).cast("int")
    sizes = sizes.where("others > 0").select(F.col("hub").alias("of_hub"), parts.alias("parts"))
    group = group.join(sizes, F.col("hub") == F.col("of_hub")).drop("of_hub")
    columns = ("node", "label", "n", "most", "differs")
    others = group.where("other").select(
        "hub", F.explode(F.sequence(F.lit(1), "parts")).alias("part"), *[F.col(c).alias(f"x_{c}") for c in columns]
    )
    group = group.withColumn("part", (F.pmod(F.xxhash64("node"), F.col("parts")) + 1).cast("int"))
    size, apart = F.col("n") + F.col("x_n"), F.size("differs") + F.size("x_differs")
    # 2 |D and D'| is at least this where the two are linked.
    needed = (100 + similarity) * apart - (100 - similarity) * size
    common = F.least("most", "x_most")
    may = (
        (F.col("label") != F.col("x_label"))
        & (~F.col("other") | (F.col("label") < F.col("x_label")))
        & (100 * common >= similarity * (size - common))
        & (2 * (100 + similarity) * F.least(F.size("differs"), F.size("x_differs")) >= needed)
    )
    both = F.size(F.array_intersect("differs", "x_differs"))
    pairs = group.join(others, ["hub", "part"]).where(may & (2 * (100 + similarity) * both >= needed))
    return pairs.select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct()


# Links


def within_distance(pairs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose signatures differ in no more symbols than linked ones may."""
    side = classes.select("node", "signature")
    joined = pairs.join(side.selectExpr("node AS a", "signature AS left"), "a")
    joined = joined.join(side.selectExpr("node AS b", "signature AS right"), "b").select("a", "b", "left", "right")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            left, right = (_signatures_of(batch.column(c), scheme) for c in ("left", "right"))
            near = (left != right).sum(axis=1) <= scheme.distance
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return map_batches(joined, run, "a long, b long")


def _wanted(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of hashed keys: bounded, with false hits but no misses."""
    n = keys.count()
    words = min(FILTER_WORDS, 1 << max(6, (n // 4).bit_length()))
    bit = F.expr("shiftleft(1L, CAST(pmod(shiftright(hash, 32), 64) AS INT))")
    rows = keys.select(F.pmod("hash", F.lit(words)).alias("word"), bit.alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    packed = np.zeros(words, np.int64)
    packed[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return packed, words


def sets_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, shingles) of some classes, made again from the texts of their first documents."""
    hashed = F.xxhash64(F.coalesce("key", F.lit(-1)))
    known = classes.join(nodes, "node", "left_semi").select("node", "key", "digest")
    shared = texts.sparkSession.sparkContext.broadcast(_wanted(known.select(hashed.alias("hash"))))

    def run(batches: Batches) -> Batches:
        packed, words = shared.value
        for batch in batches:
            hashes = batch.column("hash").to_numpy()
            hit = packed[hashes % words] >> ((hashes >> 32) % 64) & 1 > 0
            for part in slices(iter([batch.filter(pa.array(hit))])):
                found, bounds = shingle_sets(part.column("text"), scheme.shingle)
                sets = [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = _binaries([_digest(s) for s in sets]), _binaries([s.tobytes() for s in sets])
                yield record_batch(_SETS, part.column("key"), *columns)

    found = map_batches(texts.withColumn("hash", hashed), run, "key long, digest binary, shingles binary")
    found = found.withColumnRenamed("key", "found_key").withColumnRenamed("digest", "found_digest")
    same = F.col("key").eqNullSafe(F.col("found_key")) & (F.col("digest") == F.col("found_digest"))
    return known.join(found, same).select("node", "shingles").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b, common, linked, differs) of each pair.

    These are the number of shingles in common, whether 100 * intersection is at least
    similarity * union, and the shingles that one of them has and the other has not.
    """
    joined = pairs.join(sets.selectExpr("node AS a", "shingles AS left"), "a")
    joined = joined.join(sets.selectExpr("node AS b", "shingles AS right"), "b").select("a", "b", "left", "right")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            commons, linked, differs = [], [], []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (left, right))
                one = np.setxor1d(x, y, assume_unique=True)
                common = (len(x) + len(y) - len(one)) // 2
                commons.append(common)
                linked.append(100 * common >= similarity * (common + len(one)))
                differs.append(one.view(np.int64))
            yield record_batch(_COMPARED, batch.column("a"), batch.column("b"), commons, linked, differs)

    return map_batches(joined, run, "a long, b long, common long, linked boolean, differs array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for all nodes with a link."""
    ways = links.selectExpr("a AS node", "b AS other").unionByName(links.selectExpr("b AS node", "a AS other"))
    ways = materialise(ways.distinct(), "ways")
    labels = materialise(ways.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = ways.join(labels.selectExpr("node AS other", "label"), "other")
        least = near.groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(least, "node").select("node", "label", F.least("label", "near").alias("next"))
        # A label is a node itself, and may take its own label's place.
        jump = labels.selectExpr("node AS next", "label AS further")
        after = step.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("further", "next")).alias("label"), F.col("label").alias("was")
        )
        after = materialise(after, "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def linked_classes(classes: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame | None:
    """(node, label) of all classes that are linked with another; None if there are none."""
    members = materialise(shared_buckets(classes, scheme), "members")
    nodes = members.select("node").distinct()
    sets = materialise(sets_of(nodes, classes, texts, scheme), "sets")
    shareable = materialise(_shareable(sets, classes), "shareable")

    hubs = materialise(_hubs(members, shareable), "hubs")

    def compare(pairs: DataFrame) -> DataFrame:
        return materialise(compared(pairs, sets, scheme.similarity), "compared")

    first = members.join(hubs, "bucket").where("node <> hub").selectExpr("hub AS a", "node AS b").distinct()
    beside = compare(first)
    links = beside.where("linked").select("a", "b")
    labels = None if links.isEmpty() else components(links)
    open_ = materialise(_open(members, labels), "open")
    pairs = _across(open_, hubs, beside, shareable, scheme.similarity)
    more = compare(within_distance(pairs, classes, scheme)).where("linked").select("a", "b")
    if more.isEmpty():
        return labels
    return components(links.unionByName(more))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme | None = None
) -> DataFrame:
    """(key, n_shingles, component_id, text_hash, label) of every row.

    component_id is the smallest key reachable; label tells components apart and is
    null for empty sets.
    """
    scheme = scheme or Scheme()
    texts = keyed_texts(df, key, text)
    rows = materialise(signed(texts, scheme), "signatures")
    classes = rows.where("n > 0").groupBy("digest").agg(
        F.min("key").alias("key"), F.max("n").alias("n"), F.max("signature").alias("signature")
    )
    # Written once, so that the numbers stay.
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = linked_classes(classes, texts, scheme)
    named = classes.select("digest", "node", "key")
    if labels is None:
        named = named.select("digest", F.col("node").alias("label"), F.col("key").alias("component_id"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = named.groupBy("label").agg(F.min("key").alias("component_id"))
        named = named.join(least, "label").select("digest", "label", "component_id")
    found = rows.join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return found.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        "text_hash",
        "label",
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """The rows without near copies: of each component the row with the smallest key, and all rows with empty sets."""
    found = near_duplicates(df, key, text, scheme).withColumnRenamed(key, "key").where("label IS NOT NULL")
    found = materialise(found.groupBy("key", "text_hash", "label").agg(F.count("*").alias("n")), "found")
    # Null keys come last.
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")
    first = found.groupBy("label").agg(F.min(rank).alias("first"))
    marked = found.join(first, "label").withColumn(
        "stays", F.col("key").eqNullSafe(F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))
    )
    rows = df.select(
        F.struct("*").alias("row"),
        F.col(key).cast("long").alias("row_key"),
        F.xxhash64(F.col(text).cast("string")).alias("row_hash"),
    )

    def same(other: DataFrame):
        return F.col("row_key").eqNullSafe(other["key"]) & (F.col("row_hash") == other["text_hash"])

    gone = marked.where(~F.col("stays")).select("key", "text_hash")
    kept = rows.join(gone, same(gone), "left_anti")
    repeated = marked.where(F.col("stays") & (F.col("n") > 1)).select("key", "text_hash")
    if not repeated.isEmpty():
        once = kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["row_key", "row_hash"])
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(once)
    return kept.select("row.*")


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def near_duplicates_sql(documents: str = "documents", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> str:
    """The same in SQL, by comparing all documents that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws
    FROM {documents}
),
s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + {shingle - 1}], ' ') AS k
    FROM (
        SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {shingle - 2}, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i
        FROM w
    )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM s AS x JOIN s AS y ON x.k = y.k AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id
),
e AS (
    SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b
    WHERE 100 * c >= {similarity} * (na.n + nb.n - c)
),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS c FROM g UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id,
    coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
