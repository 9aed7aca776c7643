"""Whitening against a dense eigensolver on the same integers."""

import math

import numpy as np
import pytest
from fixtures import vectors
from pyspark.sql import functions as F

from kinprofile.llm import whitening

SF = "/root/testdata/sf0.001"


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 50, 40), np.geomspace(1e-6, 1e6, 40), np.r_[np.full(20, 7.0), np.arange(20)], np.r_[np.zeros(30), 3.0, 3.0 + 1e-9],
    np.r_[-np.arange(5.0), 4.0, 4.0, 4.0, 9.0], np.array([2.0]), np.full(12, 5.0), np.zeros(6),
])
def test_inertia_and_largest_equal_a_dense_solver(values):
    a = spectrum(values)
    true, scale = np.linalg.eigvalsh(a), max(1e-300, np.abs(values).max())
    for shift in np.r_[(true[1:] + true[:-1]) / 2 + 1e-7 * scale, true.min() - 1, true.max() + 1]:
        if np.abs(true - shift).min() > 1e-12 * scale:
            assert whitening.below(a, shift) == (true < shift).sum()
    found, own = whitening.largest(a, 16)
    if scale > 1e-300:
        assert len(found) == min(16, len(a))
        assert np.allclose(found, np.sort(true)[::-1][:16], rtol=0, atol=1e-13 * scale * len(a))
        assert np.allclose(own.T @ own, np.eye(len(found)), atol=1e-13)
        assert np.allclose(a @ own, own * found, atol=1e-12 * scale)


def expected(rows, components=16):
    usable = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(v) for _, v in usable}:
        own = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in usable if len(v) == d]
        fit = sorted({tuple(x) for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array(fit, float) - np.array(sums) / n
        cov = centred.T @ centred / n
        e, u = np.linalg.eigh(cov)
        for k, x in own:
            dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            for c in range(min(components, d)):
                if e[-1 - c] > 1e-9 * max(1, e[-1]):
                    white = (np.array(x) - np.array(sums) / n) @ u[:, -1 - c] / math.sqrt(e[-1 - c])
                    out.setdefault((k, c + 1), []).append((n, dev, abs(white), e[-1 - c] / cov.trace()))
    return out


def check(found, want):
    got = {}
    for r in found:
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
    assert got.keys() == want.keys()
    for k, rows in want.items():
        assert np.allclose(sorted(got[k]), sorted(rows), rtol=1e-7, atol=1e-8), k


def test_given_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(whitening.whiten(df.repartition(5)).collect(), expected(rows))


def test_one_sign_per_component(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200)
    found = whitening.whiten(df).groupBy("component").agg(F.avg("whitened").alias("m"), F.avg(F.col("whitened") * F.col("whitened")).alias("v")).collect()
    for r in found:
        assert abs(r["m"]) < 1e-6 and abs(r["v"] - 1) < 1e-6


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(100, rows[0][1]), (100, rows[1][1]), (None, rows[2][1]), (101, None), (102, []), (103, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(104, [math.nan] * 5), (105, [math.inf, 0.0, 0.0, 0.0, 0.0]), (106, [0.0] * 5), (107, [1.0, 2.0]), (108, [3.0, 4.0])]
    rows += [(109, [3e38] * 5)]
    want = expected([r for r in rows if r[0] != 109])
    check(whitening.whiten(vectors(spark, rows).selectExpr("*", "1 AS component", "'a' AS x")).collect(), want)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0
