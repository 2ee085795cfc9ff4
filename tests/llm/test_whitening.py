"""Whitening against an eigendecomposition of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctables.llm import whitening
from doctables.llm.queries import QUERIES

DDL = "vec_id long, embedding array<float>"


def wholes(vectors):
    return np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000


def covariance(x):
    """Exact until the last division."""
    n, sums = len(x), [int(s) for s in x.sum(0)]
    y = [[n * int(v) - s for v, s in zip(row, sums)] for row in x.tolist()]
    dims = len(sums)
    products = [[sum(r[i] * r[j] for r in y) for j in range(dims)] for i in range(dims)]
    return np.array([[float(Fraction(p, n**3)) for p in row] for row in products])


def check(rows, x, components=32):
    """Rows of (key, component, ...) of the vectors ``x`` in order of their keys."""
    values, axes = np.linalg.eigh(v := covariance(x))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > values[0] * 1e-11).sum()))
    sums = x.sum(0)
    assert len(rows) == len(x) * k
    got = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]).reshape(len(x), k)
    want = ((x - 1_000_000) - (sums - 1_000_000 * len(x)) / len(x)) @ axes[:, :k] / np.sqrt(values[:k])
    got *= np.sign((got * want).sum(0))
    assert np.abs(got - want).max() < 1e-7 * np.abs(want).max()
    exact = [int((((len(x) * r.astype(object)) - sums.astype(object)) ** 2).sum()) for r in x]
    ids = sorted({r.vec_id for r in rows})
    for r in rows:
        assert r.n == len(x) and r.deviation == exact[ids.index(r.vec_id)]
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-9
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("dims", [1, 2, 7, 40])
def test_rank_one_updates(dims):
    rng = np.random.default_rng(dims)
    d = np.sort(rng.random(dims) * 10.0 ** rng.integers(-8, 8, dims))
    d[: dims // 2] = d[0]
    q, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    for i in range(60):
        v = (rng.normal(size=dims), 2 * q[:, 0], np.eye(dims)[i % dims], np.zeros(dims))[i % 4] * 10.0 ** rng.integers(-6, 3)
        whole = (q * d) @ q.T + 1.5 * np.outer(v, v)
        d, q = whitening.rank_one(d, q, v, 1.5)
        assert np.abs((q * d) @ q.T - whole).max() <= 1e-12 * np.abs(whole).max()
        assert np.abs(q.T @ q - np.eye(dims)).max() < 1e-10 and (np.diff(d) >= 0).all()


def test_spectra_are_combined_exactly_enough():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)) * 100).astype(np.int64) + 1_000_000
    parts = []
    for rows in np.array_split(x, 40):  # more and fewer rows than dimensions
        parts.append(whitening.Spectrum(12))
        parts[-1].add(rows[: len(rows) // 2])
        parts[-1].add(rows[len(rows) // 2 :])
    total = parts[0]
    for other in parts[1:]:
        total.combine(whitening.Spectrum.of(other.row(0)))
    scatter = covariance(x) * len(x)
    assert total.n == 900 and total.sums == [int(s) for s in x.sum(0)]
    assert np.abs((total.vectors * total.values) @ total.vectors.T - scatter).max() < 1e-11 * np.abs(scatter).max()


@pytest.mark.parametrize("parts", [1, 40])
def test_vectors_over_many_tasks(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(parts)
    vectors = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + [0, 5, -9, 1000, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], DDL).repartition(parts)
    check(whitening.whitened(df, whitening.fit(df)).collect(), wholes(vectors))


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = rng.normal(size=(30, 3)).tolist()
    good += [good[0]] * 20  # a vector that many rows hold
    rows = [(i, v) for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    df = spark.createDataFrame(rows + [(100 + i, v) for i, v in enumerate(bad)], DDL)
    df = df.withColumns({c: F.lit("x") for c in ("vector", "part", "n", "component", "key", "whitened")}).repartition(3)
    check(whitening.whitened(df, whitening.fit(df)).collect(), wholes(good))
    # A row without an id has its own rows.
    extra = df.select("vec_id", "embedding").union(spark.createDataFrame([(None, good[0])], DDL))
    assert extra.filter("vec_id is null").count() and whitening.whitened(extra, whitening.fit(extra)).filter("vec_id is null").count() == 3


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], DDL)
    model = whitening.fit(same)
    assert model.n == 2 and not len(model.eigenvalues) and whitening.whitened(same, model).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], DDL)
    check(whitening.whitened(flat, whitening.fit(flat)).collect(), wholes([[float(i), 2.0 * i, 0.0] for i in range(5)]))
    for none in (same.limit(0), spark.createDataFrame([(1, None), (2, [None])], DDL)):
        assert whitening.fit(none) is None and whitening.whitened(none, None).collect() == []


def test_deviation_that_no_long_holds(spark):
    df = spark.createDataFrame([(1, [-1e8, 0.0]), (2, [1e8, 1.0]), (3, [3.0, 1.0])], DDL)
    got = {r.vec_id: r.deviation for r in whitening.whitened(df, whitening.fit(df)).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op13_whitening"](spark, sf).collect()
    check(rows, wholes([r.embedding for r in vectors]))
    assert {r.component for r in rows} == set(range(1, 33))
