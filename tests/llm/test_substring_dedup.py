from __future__ import annotations

import numpy as np
import pytest
from compare import raw_tables, spark_rows, sql_rows

from tracewell.llm import substring_dedup as s


@pytest.fixture(scope="module")
def expected(sf_dir):
    return sql_rows(raw_tables(sf_dir), s.repeated_sql())


def rows_of(df):
    return spark_rows(df.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256"))


def test_same_as_sql(spark, sf_dir, expected):
    assert spark_rows(s.op6_countmin_windows(spark, sf_dir)) == expected


def test_a_full_sketch_loses_nothing(docs, expected):
    assert rows_of(s.remove_repeated(docs, bits=10)) == expected


@pytest.mark.parametrize("classes, task_windows", [(0, 0), (3, 40), (1 << 17, 1 << 17)])
def test_any_number_of_classes_and_kept_windows(docs, expected, monkeypatch, classes, task_windows):
    monkeypatch.setattr(s.copies, "__defaults__", (s.WINDOW, classes))
    monkeypatch.setattr(s, "TASK_WINDOWS", task_windows)
    assert rows_of(s.remove_repeated(docs.repartition(3))) == expected


def brute(rows, n=s.WINDOW):
    words = [(text or "").split() for _, text in rows]
    first = {}
    for (key, _), ws in zip(rows, words, strict=True):
        for i in range(len(ws) - n + 1):
            window = tuple(ws[i : i + n])
            first[window] = min(first.get(window, key), key)
    found = []
    for (key, _), ws in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(ws) - n + 1) if first[tuple(ws[i : i + n])] < key for j in range(n)}
        found.append((key, " ".join(w for i, w in enumerate(ws) if i not in gone), len(ws), len(gone)))
    return sorted(found)


def test_a_text_copied_by_a_third_of_the_rows(spark):
    """Exact and near copies: far more hot windows, and groups, than a task's rows of one window."""
    rng = np.random.RandomState(4)
    long = [f"w{i}" for i in rng.randint(0, 10**6, 600)]
    rows = []
    for i in range(300):
        words = [f"o{j}" for j in rng.randint(0, 10**6, 30)]
        if i % 3 == 0:
            words = list(long)
        elif i % 3 == 1:
            words = list(long)
            words[rng.randint(0, 600)] = f"changed{i}"
        rows.append((int(rng.permutation(1000)[0]) * 1000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = s.remove_repeated(df).select("doc_id", "kept", "n_words", "n_removed")
    assert sorted(map(tuple, found.collect())) == brute(rows)
    texts = s.keyed_texts(df, "doc_id", "text")
    known = s.copies(texts)
    assert len(known.first) == 1
    left = s.candidates(texts, s.WINDOW, None, known).where("NOT repeats")
    # Of the hundred near copies and the first copy, tasks send few to the group of a window.
    assert max(row["count"] for row in left.groupBy("k1").count().collect()) <= 4 * 12


def test_only_texts_that_lose_words_are_joined(spark, docs):
    texts = s.hashed(s.keyed_texts(docs, "doc_id", "text"), "key")
    lose = s.remove_repeated(docs).where("n_removed > 0 AND n_removed < n_words").select("doc_id")
    shared = spark.sparkContext.broadcast((None, s.key_filter(lose, "doc_id")))
    kept = s.map_batches(texts, s._touched(shared), "key long, text string")
    assert lose.join(kept, lose.doc_id == kept.key, "left_anti").count() == 0
    assert lose.count() <= kept.count() < docs.count()


@pytest.mark.parametrize("row", range(s.ROWS))
def test_estimates_are_never_below_the_count(row):
    rng = np.random.RandomState(3)
    hashes = np.unique(rng.randint(0, 1 << 62, 4000).astype(np.uint64))
    twice = np.concatenate((hashes, hashes[:500]))
    merged = []
    for part in (twice[:2300], twice[2300:]):
        found, counts = np.unique(part, return_counts=True)
        once, more = s.counted(found, counts > 1, row, 16)
        at = np.sort(np.repeat(s._counter(found, row, 16), counts))
        assert once.tolist() == sorted(set(at.tolist()))
        assert more.tolist() == sorted(set(at[1:][at[1:] == at[:-1]].tolist()))
        assert (np.diff(once) > 0).all() and np.isin(more, once).all()
        merged.append([s._unpacked(s._packed(at), 1 << 13) for at in (once, more)])
    more = merged[0][1] | merged[1][1] | (merged[0][0] & merged[1][0])
    assert s._get(more, s._counter(hashes[:500], row, 16)).all()
    assert not s._get(more, s._counter(hashes[500:], row, 16)).all()


def test_packed_places_come_back():
    for at in ([], [0], [0, 3, 255, 256, 510, 31999], [31000]):
        bitmap = s._unpacked(s._packed(np.array(at, np.int64)), 4000)
        assert np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).tolist() == at


def test_parts_of_a_sketch_give_the_same(docs, expected, monkeypatch):
    monkeypatch.setattr(s, "PART_WINDOWS", 1000)
    assert rows_of(s.remove_repeated(docs)) == expected


def test_odd_rows(spark, odd):
    found = s.remove_repeated(odd)
    assert found.count() == odd.count() and found.agg({"n_removed": "sum"}).first()[0] == 0
    assert s.remove_repeated(odd.limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (1, text), (1, text), (2, f"x\n{text}\ty"), (3, " ".join(text.split()[2:14]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, s.remove_repeated(df).collect()), key=repr)
    assert got == sorted(
        [(None, text, 20, 0), (1, text, 20, 0), (1, text, 20, 0), (2, "x y", 22, 20), (3, rows[-1][1], 12, 0)], key=repr
    )
