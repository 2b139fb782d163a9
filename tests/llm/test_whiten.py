"""Operator 11 against exact sums and a dense eigensolver."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import queries, whiten


def trial(v: np.ndarray, k: int = 8):
    passes = []
    values, vectors, residuals = whiten.jacobi_davidson(lambda q: passes.append(q.shape[1]) or v @ q, len(v), k, float(np.trace(v)))
    return values, vectors, residuals, len(passes)


@pytest.mark.parametrize("name", ["isotropic", "slope", "wide", "ties", "low rank", "unit", "one"])
def test_jacobi_davidson_equals_a_dense_solver(name):
    rng = np.random.default_rng(3)
    sample = lambda n, d: rng.normal(size=(n, d))
    v = {
        "isotropic": lambda: np.cov(sample(900, 64).T), "slope": lambda: np.cov((sample(900, 64) * np.linspace(3, 0.1, 64)).T),
        "wide": lambda: np.cov((sample(900, 300) * np.geomspace(1, 0.01, 300)).T), "ties": lambda: np.diag([5.0] * 5 + [1.0] * 30),
        "low rank": lambda: (lambda a: a @ a.T)(sample(30, 3)), "unit": lambda: np.eye(20), "one": lambda: np.array([[2.0]]),
    }[name]()
    values, vectors, residuals, passes = trial(v)
    true = np.linalg.eigvalsh(v)[::-1]
    rank = min(8, int((true > 1e-12 * true[0]).sum()))
    assert len(values) == rank and np.abs(values - true[:rank]).max() < 1e-13 * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-13
    assert residuals.max() < 1e-13 * math.sqrt(true[0] * true.sum()) and passes < 200


def test_minres_solves_every_column():
    rng = np.random.default_rng(5)
    a = np.diag(rng.uniform(-3, -1, 30)) + np.diag(rng.uniform(2, 4, 30) * (np.arange(30) < 4))  # indefinite
    b = np.column_stack([rng.normal(size=(30, 3)), np.zeros(30)])
    x = whiten.minres(lambda q: a @ q, b, 60, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-9 and not x[:, 3].any()


def plain(rows: list[tuple]) -> tuple[dict, np.ndarray]:
    """Integers by row and their covariance, with exact sums."""
    fit = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(fit), len(fit[0][1])
    s = [sum(x[j] for _, x in fit) for j in range(dim)]
    centred = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(dim)] for _, x in fit])
    deviation = [sum((n * x[j] - s[j]) ** 2 for j in range(dim)) for _, x in fit]
    return {"n": n, "ids": [i for i, _ in fit], "centred": centred, "deviation": deviation}, centred.T @ centred / n


def check(got: list, rows: list[tuple], k: int) -> None:
    want, v = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = want["centred"] @ vectors / np.sqrt(values)
    assert len(got) == want["n"] * k
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == want["n"] and abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-10 and r["identity_error"] < 1e-9
    for c in range(k):
        mine = np.array([by[c + 1][i, d][0]["whitened"] for i, d in zip(want["ids"], want["deviation"])])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-8


def test_whitening_of_a_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, "/root/testdata/sf0.001").collect(), rows, 8)


def test_whitening_of_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [1.0, float("-inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 5), (3, rows[3][1]), (104, [])]
    out = tmp_path / "embeddings.parquet"
    df = spark.createDataFrame([(i, v, "x") for i, v in [*rows, *odd]], "vec_id long, embedding array<double>, v string").repartition(4)
    df.write.parquet(str(out))
    got = queries.op11_whitening(spark, str(tmp_path)).collect()
    check(got, [*rows, *odd], 5)
    flat = df.withColumn("embedding", F.transform("embedding", lambda x: F.lit(0.25)))
    model = whiten.fit(flat)
    assert model.n == 65 and not len(model.values) and {len(r["whitened"]) for r in whiten.whitened(flat, model).collect()} == {0}
    none = df.limit(0)
    assert whiten.whitened(none, whiten.fit(none)).count() == 0
    huge = spark.createDataFrame([(i, [1e12 * (i % 3), float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    model = whiten.fit(huge)
    exact = {r["id"]: int(r["deviation"]) for r in whiten.whitened(huge, model).collect()}
    x = [[math.floor(1024 * 1e12 * (i % 3)), 1024 * i] for i in range(9)]
    assert exact == {i: sum((9 * x[i][j] - sum(r[j] for r in x)) ** 2 for j in range(2)) for i in range(9)}
