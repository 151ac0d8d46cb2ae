from __future__ import annotations

import math

import numpy as np
import pytest

from tracewell.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, key long, component int, n int"


def usable(vector):
    return vector is not None and len(vector) and all(c is not None and math.isfinite(c) for c in vector)


def brute(rows, components=16):
    """{(key, x): (n, deviation, whitened, explained)} of rows (key, vector)."""
    scaled = [(key, tuple(math.floor(64 * c) + 1000000 for c in v)) for key, v in rows if usable(v)]
    fit = sorted({x for _, x in scaled})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(dims)]
    cov = np.array(
        [
            [sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) / n**3 for j in range(dims)]
            for i in range(dims)
        ]
    )
    values, directions = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-values)[:components] if values[i] > 1e-9 * values.max()]
    found = {}
    for key, x in scaled:
        deviations = [n * a - s for a, s in zip(x, sums, strict=True)]
        projected = np.array([d / n for d in deviations]) @ directions[:, order] / np.sqrt(values[order])
        found[key, x] = n, sum(d * d for d in deviations), projected, values[order] / np.trace(cov)
    return found


def check(spark, rows, components=16):
    df = spark.createDataFrame([(key, v, 1, 2, 3) for key, v in rows], SCHEMA).repartition(3)
    found = {}
    for row in w.whiten(df, components=components).collect():
        found.setdefault(row.vec_id, []).append(row)
    expected = brute(rows, components)
    assert set(found) == {key for key, _ in expected}
    signs = None
    for (key, _), (n, deviation, projected, explained) in expected.items():
        got = sorted(found[key], key=lambda row: row.component)
        repeats = sum(k == key and usable(v) for k, v in rows)
        assert [row.component for row in got] == sorted(list(range(1, len(projected) + 1)) * repeats)
        got = got[::repeats]
        assert {(row.n, int(row.deviation)) for row in got} == {(n, deviation)}
        assert np.allclose([row.explained for row in got], explained, rtol=1e-9)
        values = np.array([row.whitened for row in got])
        if signs is None and np.all(np.abs(projected) > 1e-3):
            signs = np.sign(values * projected)
        assert np.allclose(np.abs(values), np.abs(projected), atol=1e-6)
        if signs is not None:
            assert np.allclose(values * signs, projected, atol=1e-6)
        assert all(row.identity_error < 1e-8 for row in got)


def test_with_copies_and_unusable_rows(spark):
    rng = np.random.RandomState(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(100)]
    rows += [(5000, None), (5001, [1.0, None, 2.0, 3.0, 4.0]), (5002, [math.nan] * 5), (5003, [math.inf, 1.0, 1.0, 1.0, 1.0])]
    rows += [(5004, []), (5005, [1.0, 2.0]), (None, [0.1, 0.2, 0.3, 0.4, 0.5])]
    usable_rows = [row for row in rows if row[0] not in (5004, 5005)]
    df = spark.createDataFrame([(key, v, 1, 2, 3) for key, v in rows], SCHEMA)
    assert w.whiten(df, components=3).where("vec_id IN (5000, 5001, 5002, 5003, 5004, 5005)").count() == 0
    check(spark, usable_rows, 3)


@pytest.mark.parametrize("reach", [1e3, 1e9, 1e14])
def test_wide_entries(spark, reach):
    """More digits than 64 bits hold in products and squares."""
    rng = np.random.RandomState(2)
    check(spark, [(i, (rng.normal(size=4) * reach).tolist()) for i in range(70)])


def test_fewer_vectors_than_dimensions(spark):
    rng = np.random.RandomState(3)
    check(spark, [(i, rng.normal(size=8).tolist()) for i in range(4)])


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], SCHEMA)
    assert w.whiten(df).collect() == []


def test_blocks_of_planes_give_the_same_sums(spark, sf_dir, monkeypatch):
    rows = w.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    fit = w.fit_list(rows).cache()
    scaled = w._unpacked(fit.select("packed").toArrow().combine_chunks().to_batches()[0], 64)
    found = w.statistics(fit, 64)
    shifted = (scaled - scaled.min(axis=0)).astype(object)
    assert found.sums == shifted.sum(axis=0).tolist()
    products = shifted.T @ shifted
    assert all(found.products[i, j] == products[i, j] for i in range(64) for j in range(i, 64))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = brute(rows)
    found = w.op12_bit_sliced_whitening(spark, sf_dir)
    by_key = {}
    for row in found.collect():
        by_key.setdefault(row.vec_id, {})[row.component] = row
    assert found.schema["deviation"].dataType.simpleString() == "bigint"
    for (key, _), (n, deviation, projected, _) in expected.items():
        got = by_key[key]
        assert (got[1].n, got[1].deviation) == (n, deviation)
        assert np.allclose([abs(got[i + 1].whitened) for i in range(16)], np.abs(projected), atol=1e-8)
