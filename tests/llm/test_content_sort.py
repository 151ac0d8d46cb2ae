from __future__ import annotations

import hashlib
import re

import pytest
from compare import raw_tables, spark_rows, sql_rows

from tracewell.llm import content_sort as c


def brute(rows):
    """(key, keep, size, stays, digest) of each row of (key, text), sorted."""
    norms = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    found, first = [], {}
    for i in order:
        first.setdefault(norms[i], i)
    for i, (key, _) in enumerate(rows):
        home = first[norms[i]]
        digest = hashlib.sha256(norms[i].encode()).hexdigest()
        found.append((key, rows[home][0], norms.count(norms[i]), i == home, digest))
    return sorted(found, key=repr)


def result(df, **options):
    found = c.exact_copies(df, **options).select("key", "keep", "group_size", "stays", "text_sha256")
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [64 << 20, 5000])
def test_same_as_sql(spark, sf_dir, monkeypatch, range_bytes):
    monkeypatch.setattr(c, "RANGE_BYTES", range_bytes)
    expected = sql_rows(raw_tables(sf_dir), c.exact_copies_sql())
    assert spark_rows(c.op13_content_sort(spark, sf_dir)) == expected


def counted(found):
    """Rows with equal keys and texts are alike, so only how many of them stay is fixed."""
    return sorted(map(repr, found))


@pytest.mark.parametrize("range_bytes", [64 << 20, 300])
def test_odd_texts(spark, odd, monkeypatch, range_bytes):
    monkeypatch.setattr(c, "RANGE_BYTES", range_bytes)
    rows = [(row.doc_id, row.text) for row in odd.collect()]
    assert counted(result(odd)) == counted(brute(rows))
    assert result(odd.limit(0)) == []


def test_copies_over_many_ranges(spark, monkeypatch):
    """Half of the rows are one text, and all others begin like it."""
    monkeypatch.setattr(c, "RANGE_BYTES", 3000)
    same = "the very same beginning of a text that goes on and on for more than the head of it "
    rows = [(i, f"{same} \t and ends" if i % 2 else f"{same}{i % 70}") for i in range(400)]
    rows += [(None, same + "and ends"), (None, "no key"), (None, "no  key"), (1, "x"), (1, "x\n"), (1, "x ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bounds = c.splitters(df, df["doc_id"], df["text"])
    assert len(bounds) > 8
    assert counted(result(df)) == counted(brute(rows))


def test_rows_that_stay_keep_their_columns(spark, odd):
    kept = c.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", row.text or "") for row in odd.collect()]
    found = [re.sub(r"[\x20\x09-\x0D]+", " ", row.text or "") for row in kept.collect()]
    assert sorted(found) == sorted(set(texts))


def test_texts_are_shuffled_once(spark, docs, monkeypatch):
    monkeypatch.setattr(c, "RANGE_BYTES", 64 << 20)
    plan = c.exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "ArrowEval" not in plan and "Python" not in plan
