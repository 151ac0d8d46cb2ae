"""The whole pipeline against plain Python on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from test_decontaminate import brute as contaminated
from test_minhash_dedup import brute as groups
from test_quality import repeated

import corpus_pipeline
from tracewell.llm.boilerplate_lines import MIN_SITES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n, chars = len(words), sum(map(len, words))

    def count(signs):
        return len(re.findall(signs, text))

    return not (
        n < 10
        or 100 * repeated(words) > 20 * n
        or 5 * count(r"[#*$%&|<>]") > n
        or not 2 * n <= chars <= 15 * n
        or 100 * count("[A-Z]") > 45 * len(text)
        or count("!") > n
        or 100 * count("[0-9]") > 50 * len(text)
        or 100 * (len(lines) - len(set(lines))) > 45 * len(lines)
    )


def bare_lines(text):
    return {bare for line in (text or "").split("\n") if (bare := line.strip(" \t\x0b\x0c\r"))}


def wide_lines(rows):
    sites = {}
    for row in rows:
        for line in bare_lines(row["text"]):
            sites.setdefault(line, set()).add(row["source"])
    return {line for line, held in sites.items() if len(held - {None}) >= MIN_SITES}


def without_wide_lines(rows):
    """Lines of many sites go, sites counted over texts that do not mostly consist of such lines."""
    wide = wide_lines(rows)

    def is_copy(text):
        lines = bare_lines(text)
        return 2 * sum(map(len, lines & wide)) > sum(map(len, lines))

    wide = wide_lines([row for row in rows if not is_copy(row["text"])])
    for row in rows:
        lines = (row["text"] or "").split("\n")
        left = [line for line in lines if line.strip(" \t\x0b\x0c\r") not in wide]
        if len(left) < len(lines) and bare_lines("\n".join(left)):
            row["text"] = "\n".join(left)
            row["n_chars"] = len(row["text"])
    return rows


@pytest.fixture(scope="module")
def expected(docs, spark, sf_dir):
    rows = [row.asDict() for row in docs.collect() if good(row.text or "")]
    rows = without_wide_lines(rows)
    _, group = groups([(row["doc_id"], row["text"]) for row in rows], 5, 80)
    first = {}
    for row, g in sorted(zip(rows, group, strict=True), key=lambda pair: pair[0]["doc_id"]):
        first.setdefault(g, row["doc_id"])
    rows = [row for row in rows if row["doc_id"] in set(first.values())]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {key for key, _ in contaminated([(row["doc_id"], row["text"]) for row in rows], items)}
    return [row for row in rows if row["doc_id"] not in bad]


def test_stages_one_by_one(spark, docs, sf_dir, expected):
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
        assert left.columns == COLUMNS
    found = sorted((row.asDict() for row in left.collect()), key=lambda row: row["doc_id"])
    assert found == sorted(expected, key=lambda row: row["doc_id"])
    assert 0 < len(found) < docs.count()


def test_run(spark, sf_dir, expected):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {row.doc_id: row for row in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(found) == {row["doc_id"] for row in expected}
    for row in expected:
        ids = library.encode(row["text"]) + [2]
        got = found[row["doc_id"]]
        assert (got.ids, got.n_tokens) == (ids, len(ids))
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_copies_on_many_sites_keep_one_text(spark, sf_dir):
    rng = random.Random(5)

    def lines(n):
        return [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(12)) for _ in range(n)]

    exact, near, footer = lines(20), lines(40), "a footer that many sites have"
    rows = [(i, "\n".join([*exact, footer]), f"s{i}") for i in range(MIN_SITES + 2)]
    for i in range(MIN_SITES + 2):
        changed = [*near]
        changed[3 * i] = f"{near[3 * i]} changed{'x' * i}"
        rows.append((100 + i, "\n".join([*changed, footer]), f"s{i}"))
    own = {200 + i: "\n".join(lines(5)) for i in range(MIN_SITES)}
    rows += [(key, f"{text}\n{footer}", f"s{key}") for key, text in own.items()]
    rows += [(300 + i, f"{footer}\n", f"s{i}") for i in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    df = spark.createDataFrame([(key, text, "en", site, len(text)) for key, text, site in rows], schema)
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_copies):
        df = stage(spark, df, sf_dir)
    found = {row.doc_id: row.text for row in df.collect()}
    assert set(found) == {0, 100, 300, *own}
    assert found[0] == "\n".join(exact)
    assert found[100] == "\n".join([f"{near[0]} changed", *near[1:]])
    assert {key: found[key] for key in own} == own


def test_lines_of_copies_and_of_many_sites(spark):
    """The rule of the stage in plain Python, on near copies, a shared block and a line in every row."""
    rng = random.Random(8)

    def line():
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(12))

    block, rows = [line() for _ in range(3)], []
    for group in range(4):
        near = [line() for _ in range(12)]
        for i in range(8 * group + 2):
            changed = [*near]
            changed[rng.randrange(12)] = line()
            rows.append(changed + (block if i % 2 else []))
    rows += [[line() for _ in range(rng.randint(4, 9))] + block[: rng.randint(0, 3)] for _ in range(60)]
    rows += [block, block, [], [""]]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    dicts = []
    for i, lines in enumerate(rows):
        text = "\n".join([*lines, "every row has this"])
        dicts.append({"doc_id": i, "text": text, "lang": "en", "source": f"s{i % 25}", "n_chars": len(text)})
    dicts.append({"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None})
    df = spark.createDataFrame([tuple(d.values()) for d in dicts], schema).repartition(5)
    found = sorted((row.asDict() for row in corpus_pipeline.lines(spark, df, "").collect()), key=repr)
    changed = sum(row["text"] != d["text"] for row, d in zip(without_wide_lines([dict(d) for d in dicts]), dicts))
    assert found == sorted(without_wide_lines(dicts), key=repr)
    assert changed > 100


def test_odd_rows_pass_all_stages(spark, odd, sf_dir):
    df = odd.withColumnRenamed("n_tokens", "n_chars")
    rows = sorted(df.collect(), key=repr)
    assert [row.doc_id for row in corpus_pipeline.quality(spark, df, sf_dir).collect()] == [
        row.doc_id for row in rows if good(row.text or "")
    ]
    for stage in (corpus_pipeline.lines, corpus_pipeline.benchmark):
        assert sorted(stage(spark, df, sf_dir).collect(), key=repr) == rows
    kept = sorted(corpus_pipeline.near_copies(spark, df, sf_dir).collect(), key=repr)
    assert kept == sorted(set(rows), key=repr) and len(kept) == len(rows) - 1
    encoded = corpus_pipeline.pieces(spark, df, sf_dir).collect()
    assert sorted((row.doc_id for row in encoded), key=repr) == sorted((row.doc_id for row in rows), key=repr)
    assert {row.n_tokens for row in encoded if row.doc_id in (None, 1)} == {1}
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
