r"""A Merkle manifest of a table: a digest per row, roots per group and one root of all.

A row's leaf is the SHA-256 of its fields, each `-` if null, else its UTF-8 byte count,
`:` and its value. In each group, leaves ascend by key; every `fanout` consecutive nodes
become the SHA-256 of their concatenated hex digests until one node is left, the
group's root. The roots of the groups, ordered by name, make the last tree likewise.

A tree is built some levels at a time. Conditional aggregates spread the nodes below
one ancestor into slot columns, one per place; nodes between are digests of
concatenated columns. Going down again, the columns of a run without the own slot are a
node's siblings, before and after it; a row's siblings of all levels are its proof. Leaves
are slim and are range-sorted by group, key and digest, so a hot group or key lies on
many tasks. A node is known by its group and place, so no join has a hot key.

A group may be null and comes first; other names follow in the order of their bytes. Null
keys come before others, and rows with equal keys are ordered by their leaves. Null and
empty fields have different leaves. Repeated rows are leaves each. A group of one row
has its leaf as root, and an empty table gives an empty one. Only the named columns
are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.batches import documents
from tracewell.sources.workspace import materialise

FANOUT = 2
#: Slot columns that one pass spreads nodes into, about.
SLOTS = 16
#: Rows of leaves in a sorted range, unless that made more than `MOST_RANGES`.
RANGE_ROWS, MOST_RANGES = 1 << 16, 1 << 13

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node beside its ancestors: what is concatenated before and after it.
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def _group(name: Column) -> Column:
    """A name that is never null and sorts as the group does."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


# Places


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with `pos`, their place in the order within their group from 0 on, and `n`, the group's size."""
    ranges = max(1, min(MOST_RANGES, -(-rows.count() // RANGE_ROWS)))
    sorted_ = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    # Ids count the rows of each sorted range; the range is in their upper bits.
    kept = materialise(sorted_.withColumn("id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("id", 33).alias("part")
    counts = kept.groupBy(group, part).agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))
    before = Window.partitionBy(group).orderBy("part")
    # Written, so that Spark knows that it is small.
    offsets = counts.select(
        F.col(group).alias("offset_group"),
        F.col("part").alias("offset_part"),
        (F.sum("rows").over(before) - F.col("rows") - F.col("first_id")).alias("shift"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n"),
    )
    offsets = materialise(offsets, "offsets")
    here = (F.col(group) == F.col("offset_group")) & (F.shiftright("id", 33) == F.col("offset_part"))
    placed = kept.join(offsets, here).withColumn("pos", F.col("id") + F.col("shift"))
    return placed.drop("id", "offset_group", "offset_part", "shift")


# Trees


class Forest:
    """Trees over the rows of `nodes`: (tree string, pos long, n long, hash string, and `carried` columns).

    `pos` is a node's place in its tree and `n` the number of the tree's leaves.
    """

    def __init__(self, nodes: DataFrame, carried: list[str], fanout: int = FANOUT):
        self.fanout, self.carried = fanout, carried
        self.steps = 1
        while fanout ** (self.steps + 1) <= SLOTS:
            self.steps += 1
        self.width = fanout**self.steps
        most = nodes.agg(F.max("n")).first()[0] or 0
        self.passes = [materialise(self._spread(nodes, carried), "slots")]
        while most > self.width:
            most = -(-most // self.width)
            self.passes.append(materialise(self._spread(self._parents(self.passes[-1]), []), "slots"))

    def _spread(self, nodes: DataFrame, carried: list[str]) -> DataFrame:
        """(tree, block, n, s0, s1, ...): the nodes of each block of places, a column for each place."""
        slot = F.pmod("pos", F.lit(self.width))
        node = F.struct("hash", *carried)
        places = [F.max(F.when(slot == i, node)).alias(f"s{i}") for i in range(self.width)]
        block = ((F.col("pos") - slot) / self.width).cast("long")
        return nodes.groupBy("tree", block.alias("block"), "n").agg(*places)

    def _fewer(self, n: Column) -> Column:
        return F.floor((n + self.fanout - 1) / self.fanout).cast("long")

    def _with_levels(self, slots: DataFrame) -> DataFrame:
        """The nodes above the slots as columns, each computed once from those below it."""
        found, count = slots.withColumn("n0", F.col("n")), self.width
        for level in range(self.steps):
            below = [F.col(f"s{i}.hash") if level == 0 else F.col(f"h{level}_{i}") for i in range(count)]
            made = {}
            for first in range(0, count, self.fanout):
                run = below[first : first + self.fanout]
                joined = digest(*[F.coalesce(node, F.lit("")) for node in run])
                made[f"h{level + 1}_{first // self.fanout}"] = F.when(
                    run[0].isNotNull(), F.when(F.col(f"n{level}") > 1, joined).otherwise(run[0])
                )
            made[f"n{level + 1}"] = self._fewer(F.col(f"n{level}"))
            found = found.withColumns(made)
            count //= self.fanout
        return found

    def _parents(self, slots: DataFrame) -> DataFrame:
        top = self._with_levels(slots)
        return top.select(
            "tree", F.col("block").alias("pos"), F.col(f"n{self.steps}").alias("n"), F.col(f"h{self.steps}_0").alias("hash")
        )

    def roots(self) -> DataFrame:
        """(tree, root)."""
        return self._parents(self.passes[-1]).select("tree", F.col("hash").alias("root"))

    def _beside(self, slot: int) -> Column:
        """Steps from a slot to the top of its block."""
        steps = []
        for level in range(self.steps):
            at = slot // self.fanout**level
            first = at - at % self.fanout
            nodes = [
                F.coalesce(F.col(f"s{i}.hash") if level == 0 else F.col(f"h{level}_{i}"), F.lit(""))
                for i in range(first, first + self.fanout)
            ]
            before, after = nodes[: at - first], nodes[at - first + 1 :]
            step = F.struct(
                (F.concat(*before) if before else F.lit("")).alias("before"),
                (F.concat(*after) if after else F.lit("")).alias("after"),
            )
            steps.append(F.when(F.col(f"n{level}") > 1, step))
        return F.array_compact(F.array(*steps))

    def leaves(self, above: DataFrame, kept: list[str]) -> DataFrame:
        """Every leaf: (tree, pos, hash, carried columns, steps, kept columns).

        `steps` is what lies beside a leaf and its ancestors up to the root and beyond it;
        `above` has the latter per tree: (tree, steps, and the columns to keep).
        """
        paths = above.select("tree", F.lit(0).cast("long").alias("block"), F.col("steps").alias("above"), *kept)
        for number in reversed(range(len(self.passes))):
            carried = self.carried if number == 0 else []
            rows = self._with_levels(self.passes[number].join(paths, ["tree", "block"]))
            slots = [
                F.struct(
                    (F.col("block") * self.width + i).alias("pos"),
                    F.col(f"s{i}").alias("node"),
                    F.concat(self._beside(i), F.col("above")).alias("steps"),
                )
                for i in range(self.width)
            ]
            spread = rows.select("tree", *kept, F.explode(F.array(*slots)).alias("leaf")).where("leaf.node IS NOT NULL")
            if number == 0:
                columns = [F.col(f"leaf.node.{name}").alias(name) for name in ("hash", *carried)]
                return spread.select("tree", "leaf.pos", *columns, "leaf.steps", *kept)
            paths = spread.select("tree", F.col("leaf.pos").alias("block"), F.col("leaf.steps").alias("above"), *kept)


def proof(steps: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(node: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, node, lambda below, s: F.sha2(F.concat(s["before"], below, s["after"]), 256))


def manifest(
    df: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    carry: dict[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Every row's place in the manifest: (key, leaf, subroot, root, steps) and further columns of the rows.

    `steps` has the siblings of a leaf and its ancestors, (before, after) from the leaf up;
    `proof` and `folded` work on it. `carry` computes the further columns from the row.
    """
    carry = carry or {}
    carried = {f"carried_{i}": column for i, column in enumerate(carry.values())}
    leaves = df.select(
        _group(F.col(group)).alias("tree"),
        F.col(key).alias("key"),
        leaf([F.col(name) for name in fields]).alias("hash"),
        *[column.alias(name) for name, column in carried.items()],
    )
    groups = Forest(numbered(leaves, "tree", "key", "hash"), ["key", *carried], fanout)
    roots = materialise(groups.roots(), "roots")
    named = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("hash")), "tree", "name")
    top = Forest(named, ["name"], fanout)
    root = top.roots().select(F.lit("").alias("tree"), F.array().cast(STEP).alias("steps"), "root")
    above = top.leaves(root, ["root"]).select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", "steps")
    found = groups.leaves(above, ["subroot", "root"])
    names = [F.col(name).alias(given) for name, given in zip(carried, carry, strict=True)]
    return found.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "steps", *names)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, of which some have been tampered with."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    fields = [F.col(name) for name in FIELDS]
    fields[FIELDS.index("n_chars")] = F.col("n_chars").cast("long") + 1
    found = manifest(documents(spark, sf_dir), carry={"tampered": F.when(altered, leaf(fields))})
    given = F.coalesce("tampered", "leaf")
    found = found.withColumn("folded_root", folded(given, F.col("steps")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof(F.col("steps")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def manifest_sql(documents: str = "documents") -> str:
    """The same in SQL: one level after the other, and a fold per row."""
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text"]

    def leaf_sql(values: list[str]) -> str:
        parts = [f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values]
        return f"sha256({' || '.join(parts)})"

    tampered = [*fields[:3], "(n_chars + 1)::VARCHAR", fields[4]]
    bit = "lambda c, i: xor(c >> 1, (c & 1) * 3988292384::BIGINT)"
    byte = f"lambda c, b: list_reduce(range(8), {bit}, xor(c, b))"
    crc = f"xor(list_reduce([ascii(x) for x in string_split(doc_id::VARCHAR, '')], {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf_sql(fields)} AS leaf,
        CASE WHEN {crc} % 7 = 0 THEN {leaf_sql(tampered)} END AS tampered
    FROM {documents}
),
placed AS (
    SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS r,
        row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY g) AS n
    FROM d
),
tree AS (
    SELECT g, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM tree WHERE n > 1 GROUP BY g, level, pos // 2, n
),
subroot AS (
    SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
    FROM tree WHERE n = 1
),
top AS (
    SELECT 0 AS level, pos, n, subroot AS h FROM subroot
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM top WHERE n > 1 GROUP BY level, pos // 2, n
),
beside AS (
    SELECT r, own.level, own.pos, coalesce(other.h, '') AS h
    FROM placed JOIN tree AS own ON own.g = placed.g AND own.pos = placed.pos >> own.level AND own.n > 1
    LEFT JOIN tree AS other ON other.g = own.g AND other.level = own.level AND other.pos = xor(own.pos, 1)
    UNION ALL
    SELECT r, 1000 + own.level, own.pos, coalesce(other.h, '') AS h
    FROM placed JOIN subroot USING (g) JOIN top AS own ON own.pos = subroot.pos >> own.level AND own.n > 1
    LEFT JOIN top AS other ON other.level = own.level AND other.pos = xor(own.pos, 1)
),
steps AS (
    SELECT r, string_agg(h, '' ORDER BY level) AS siblings,
        list({{'node': '', 'before': if(pos % 2 = 1, h, ''), 'after': if(pos % 2 = 0, h, '')}} ORDER BY level) AS steps
    FROM beside GROUP BY r
),
found AS (
    SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
        list_reduce(
            coalesce(steps, []),
            lambda x, s: {{'node': sha256(s.before || x.node || s.after), 'before': '', 'after': ''}},
            {{'node': coalesce(tampered, leaf), 'before': '', 'after': ''}}
        ).node AS folded_root
    FROM placed JOIN subroot USING (g) LEFT JOIN steps USING (r)
)
SELECT *, folded_root = root AS verified FROM found"""
