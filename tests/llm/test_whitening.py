"""Whitening against whole-number arithmetic and numpy on the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteaudit.llm import whitening as W
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    """x as Python numbers, V and its eigenvalues."""
    x = {k: [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for k, v in vectors.items()}
    m = np.array(list(x.values()), float)
    centred = m - m.mean(axis=0)
    cov = centred.T @ centred / len(m)
    return x, cov, np.linalg.eigvalsh(cov)[::-1]


def test_embeddings_agree_with_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    x, cov, values = plain(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    got = W.whiten(rows).toPandas()
    assert len(got) == n * 8 and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    dev = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in x.items()}
    assert (got["deviation"] == got["vec_id"].map(dev)).all() and (got["n"] == n).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    m = np.array([x[k] for k in wide.index], float)
    m -= m.mean(axis=0)
    _, vectors = np.linalg.eigh(cov)
    expected = m @ vectors[:, ::-1][:, :8] / np.sqrt(values[:8])
    sign = np.sign((expected * wide.to_numpy()).sum(axis=0))
    assert np.allclose(expected * sign, wide.to_numpy(), atol=1e-6)
    assert np.allclose(got.groupby("component")["explained"].first(), values[:8] / values.sum(), rtol=1e-9)


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [1e30, 0.0, 0.0])]
    rows = spark.createDataFrame(good + bad + [good[0], (None, good[1][1])], SCHEMA).withColumn("key", F.lit("k")).withColumn("x0", F.lit(1)).withColumn("v", F.lit(2))
    got = W.whiten(rows).toPandas()
    assert len(got) == 32 * 3 and set(got["vec_id"].dropna()) == set(range(30)) and got["vec_id"].isna().sum() == 3 and (got["n"] == 32).all()
    assert got["identity_error"][0] < 1e-9


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], SCHEMA)
    out = W.whiten(same).collect()
    assert len(out) == 8 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], SCHEMA)
    out = W.whiten(line).collect()
    assert {r["component"] for r in out if r["whitened"] is not None} == {1} and out[0]["identity_error"] < 1e-9
    for empty in (same.limit(0), same.select("vec_id", F.lit(None).cast("array<float>").alias("embedding")), same.select("vec_id", F.array().cast("array<float>").alias("embedding"))):
        none = W.whiten(empty)
        assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("size", [1.0, 1e9, 1e14])
def test_numbers_of_any_size(spark, size):
    rng = np.random.default_rng(4)
    vectors = {i: (rng.normal(size=4) * size).astype(np.float32).tolist() for i in range(40)}
    rows = spark.createDataFrame(list(vectors.items()), SCHEMA)
    x, _, values = plain(vectors)
    n, sums = 40, [sum(c) for c in zip(*x.values(), strict=True)]
    for r in W.whiten(rows, components=2).collect():
        dev = sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (dev if dev < 2**63 else None)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-6) and r["identity_error"] < 1e-6


def test_pairs_in_several_aggregations(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    x, d = W.whole_columns(rows)
    once = W.fit(x, d)
    monkeypatch.setattr(W, "PAIRS", 333)
    parted = W.fit(x.repartition(7), d)
    assert (once.covariance == parted.covariance).all() and once.sums == parted.sums
