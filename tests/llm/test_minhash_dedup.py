from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from compare import raw_tables, spark_rows, sql_rows
from conftest import by_key

from tracewell.llm import minhash_dedup as m


@pytest.mark.parametrize("scheme", [m.Scheme(), m.Scheme(5, 80)])
def test_signatures_within_the_distance_meet(scheme):
    rng = np.random.RandomState(2)
    a = rng.randint(0, 256, (300, scheme.symbols)).astype(np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(scheme.symbols, scheme.distance, replace=False)
        row[at] += rng.randint(1, 256, len(at)).astype(np.uint8)
    for x, y in zip(m.bucket_keys(a, scheme), m.bucket_keys(b, scheme), strict=True):
        assert set(x.tolist()) & set(y.tolist())


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda x: x[0].lower(), text or ""))
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, similarity):
    """Components as lists of row numbers, by comparing all pairs."""
    sets = [shingles(text, n) for _, text in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= similarity * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def test_same_as_sql(spark, sf_dir):
    names, rows = spark_rows(m.op4_minhash_hamming(spark, sf_dir))
    assert (names, rows) == sql_rows(raw_tables(sf_dir), m.near_duplicates_sql())


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_families_and_chains_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for family in range(4):
        words = [f"w{family}-{rng.randint(0, 400)}" for _ in range(150)]
        # A chain: each text is close to the one before and in the end far from the first.
        for _ in range(12):
            text = edited(rng, words, rng.randint(0, 4))
            words = text.split()
            rows.append((len(rows), text))
        rows += [(len(rows) + i, edited(rng, words, rng.randint(1, 12))) for i in range(10)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, group = brute(rows, 3, 85)
    found = by_key(m.near_duplicates(df))
    for (key, _), set_, g in zip(rows, sets, group, strict=True):
        assert found[key].n_shingles == len(set_)
        assert found[key].component_id == min(k for (k, _), h in zip(rows, group, strict=True) if h == g)


def test_components_of_a_long_chain(spark):
    n = 70
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 102), (100, 102)]
    found = m.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100, 102: 100}


def test_odd_rows(spark, odd):
    found = m.near_duplicates(odd).select("doc_id", "n_shingles", "component_id").collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((r.n_shingles for r in found)) == sorted(len(shingles(t, 3)) for _, t in rows)
    assert all(r.component_id == r.doc_id for r in found)
    kept = m.keep_one(odd)
    assert kept.columns == odd.columns
    # Of the row given twice one stays.
    assert kept.count() == len(rows) - 1
    assert m.near_duplicates(odd.limit(0)).count() == m.keep_one(odd.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50", "other")
    rows = [(None, text), (7, text), (3, near), (3, "short"), (9, "SHORT"), (4, ""), (5, None), (6, "a b"), (8, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in m.keep_one(df, scheme=m.Scheme(5, 80)).collect()}
    assert left == {(3, near), (3, "short"), (4, ""), (5, None), (6, "a b"), (8, "b a")}
    found = {(r.doc_id, r.component_id) for r in m.near_duplicates(df, scheme=m.Scheme(5, 80)).collect()}
    assert found == {(None, 3), (7, 3), (3, 3), (9, 3), (4, 4), (5, 5), (6, 6), (8, 8)}


@pytest.mark.parametrize("similarity", [70, 80, 85, 90, 95])
def test_chance_to_lose_a_pair(similarity):
    scheme = m.Scheme(similarity=similarity)
    n, miss = scheme.symbols, 1 - similarity / 100
    assert sum(math.comb(n, i) * miss**i * (1 - miss) ** (n - i) for i in range(scheme.distance + 1, n + 1)) <= 1e-6


@pytest.mark.parametrize("stray", [-1, 10**6])
@pytest.mark.parametrize("group_rows", [7, 512])
def test_one_stray_beside_a_large_group(spark, monkeypatch, stray, group_rows):
    """Whether its label is below or above the group's, only the stray is laid beside the others."""
    monkeypatch.setattr(m, "GROUP_ROWS", group_rows)
    rng = np.random.RandomState(6)
    hub = set(range(1000))
    sets = {0: hub}
    for node in range(1, 60):
        sets[node] = hub - set(rng.choice(1000, 5, False).tolist()) | {10**4 + node}
    gone = list(range(130))
    # Similar to one member of the group only, which is itself linked with the hub.
    sets[7] = hub - set(gone[:100])
    sets[stray] = hub - set(gone)
    nodes = sorted(sets)
    open_ = spark.createDataFrame([(1, n, n if n == stray else 0) for n in nodes], "bucket long, node long, label long")
    hubs = spark.createDataFrame([(1, 0)], "bucket long, hub long")
    shareable = spark.createDataFrame([(n, len(sets[n]), len(sets[n] & hub)) for n in nodes], "node long, n long, most long")
    beside = [(0, n, sorted(sets[n] ^ hub)) for n in nodes if n]
    beside = spark.createDataFrame(beside, "a long, b long, differs array<long>")
    found = m._across(open_, hubs, beside, shareable, 88).collect()
    expected = {
        (min(a, stray), max(a, stray))
        for a in nodes
        if a != stray and 100 * len(sets[a] & sets[stray]) >= 88 * len(sets[a] | sets[stray])
    }
    assert {(r.a, r.b) for r in found} == expected == {(min(7, stray), max(7, stray))}
