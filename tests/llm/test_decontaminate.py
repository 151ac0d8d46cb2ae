from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from conftest import TEXTS

from tracewell.llm import decontaminate as d


def test_masks_bear_any_two_replaced_words():
    for gone in itertools.combinations(range(d.MIN_WORDS), 2):
        assert any(
            all(start + i not in gone for i, kept in enumerate(mask) if kept == "1")
            for mask in d.MASKS
            for start in range(d.MIN_WORDS - len(mask) + 1)
        )


def test_masks_bear_all_that_the_rule_accepts():
    kept = [(sum(1 << i for i, k in enumerate(mask) if k == "1"), len(mask)) for mask in d.MASKS]
    for size in range(d.MIN_WORDS, 2 * d.MIN_WORDS):
        gone = np.array([sum(1 << i for i in at) for at in itertools.combinations(range(size), size // 5)])
        hit = np.zeros(len(gone), bool)
        for bits, span in kept:
            for start in range(size - span + 1):
                hit |= gone & (bits << start) == 0
        assert hit.all(), size


def test_replaced_words_of_longer_items():
    text = [f"w{i}" for i in range(25)]
    missed = []
    for size, number in ((15, 3), (16, 3), (20, 4), (25, 5)):
        for at in itertools.combinations(range(1, size - 1), number):
            if not any(
                all(start + i not in at for i, k in enumerate(mask) if k == "1")
                for mask in ("11110001011", "11011111", "101111011")
                for start in range(size - len(mask) + 1)
            ):
                missed.append((size, at))
    assert {size for size, _ in missed} == {15, 16, 20, 25}
    index = d.Index([1], [" ".join(text)])
    for size, at in missed:
        doc = " ".join("x" if i in at else word for i, word in enumerate(text[:size]))
        words_ = d._words(pa.array([doc]))
        assert [(m[4], m[5]) for m in d.matches_in(index, words_.hashes, words_.bounds)] == [(size, size - len(at))]


def stretches(equal):
    for i in range(len(equal)):
        for j in range(i + 1, len(equal) + 1):
            if equal[i] and equal[j - 1] and 5 * sum(equal[i:j]) >= 4 * (j - i):
                yield j - i, -i, j


def test_longest_stretch():
    rng = random.Random(1)
    for _ in range(400):
        equal = np.array([rng.random() < 0.75 for _ in range(rng.randint(0, 35))], bool)
        start, end = d.longest_stretch(equal)
        assert end - start == max((s[0] for s in stretches(equal)), default=0)


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """Pairs with a stretch along some diagonal that has two words in a row in common, at least."""
    found = set()
    for item, item_text in items:
        b = words(item_text)
        places = {}
        for i, word in enumerate(b):
            places.setdefault(word, []).append(i)
        for key, text in docs:
            a = words(text)
            shifts = {i - j for i, word in enumerate(a) for j in places.get(word, ())}
            for shift in shifts:
                start, end = max(0, shift), min(len(a), shift + len(b))
                equal = [a[i] == b[i - shift] for i in range(start, end)]
                if sum(equal) < 10:
                    continue
                longest = max(stretches(equal), default=(0,))[0]
                if longest >= d.MIN_WORDS:
                    found.add((key, item))
    return found


def test_all_of_the_table(spark, docs, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = d.find_matches(docs, benchmark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    expected = brute(rows, items)
    assert expected and {(r.doc_id, r.item_id) for r in found.collect()} == expected
    in_blocks = d.find_matches(docs, benchmark, block_words=500)
    assert sorted(in_blocks.collect()) == sorted(found.collect())
    left = d.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {key for key, _ in expected}


ITEM = "One two, three four five six seven eight nine ten Éleven twelve thirteen fourteen fifteen."


def test_replaced_words_cases_and_short_items(spark):
    plain = [w.strip(",.").lower() for w in ITEM.split()]
    replaced = [*plain]
    replaced[3], replaced[9] = "x", "y"
    far = [w if i % 3 else "z" for i, w in enumerate(plain)]
    texts = {
        1: "before " + " ".join(plain) + " after",
        2: "\n".join(replaced).upper(),
        3: " ".join(far),
        4: " ".join(plain[:12]),
        5: "see: alpha beta; gamma delta epsilon zeta!",
        6: "alpha beta gamma delta epsilon other",
        7: "tiny item",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = [(10, ITEM), (11, "Alpha beta gamma delta epsilon zeta"), (12, "tiny item"), (None, None), (13, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = d.find_matches(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 10), (2, 10), (5, 11)}
    assert {r.doc_id: (r.doc_start, r.n_words, r.n_equal) for r in rows} == {
        1: (1, 15, 15), 2: (0, 15, 13), 5: (1, 6, 6),
    }


def test_odd_rows(spark, odd):
    benchmark = spark.createDataFrame([(1, "word " * 20)], "item_id long, text string")
    found = {r.doc_id for r in d.find_matches(odd, benchmark).collect()}
    assert found == {TEXTS.index("word " * 3000)}
    assert d.drop_contaminated(odd, benchmark).count() == len(TEXTS) - 1
    assert d.find_matches(odd.limit(0), benchmark).count() == 0
    assert d.find_matches(odd, benchmark.limit(0)).count() == 0
    assert d.drop_contaminated(odd, benchmark.limit(0)).count() == len(TEXTS)
