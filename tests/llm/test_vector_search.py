"""The search as a whole, against brute force, on vectors that the quantiser has to tell apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteaudit.llm import vector_search as V


@pytest.fixture(scope="module")
def unlike(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 48))
    x[::7] = 0.8 * x[::7] + 0.6 * x[3]  # some structure
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), x


@pytest.mark.parametrize("measure", ["ip", "l2"])
def test_recall_through_search(unlike, measure):
    """Several chunks and several blocks of queries; of each slice the shortlist is a twenty-fifth."""
    rows, x = unlike
    got = V.search(rows, rows.where(F.col("vec_id") % 250 == 0), measure=measure, chunk=9000, block=30).collect()
    hits = 0
    for q in range(0, len(x), 250):
        exact = x @ x[q] if measure == "ip" else -((x - x[q]) ** 2).sum(1)
        exact[q] = -np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert np.allclose([r.score for r in own], exact[[r.vec_id for r in own]])
        hits += len({r.vec_id for r in own} & set(np.argsort(-exact)[:20].tolist()))
    assert hits >= 0.9 * 20 * 80


def test_the_sample_is_bounded(unlike):
    rows, _ = unlike
    assert V.bounded_sample(rows, 100, 20_000).shape == (100, 48)
    assert V.bounded_sample(rows, 100, 20_000).tolist() == V.bounded_sample(rows.repartition(3), 100, 20_000).tolist()
    assert V.bounded_sample(rows.limit(0), 100, 0).size == 0


def test_the_plan_does_not_grow_with_the_queries(spark, unlike):
    rows, _ = unlike
    plans = [V.search(rows.limit(300), rows.limit(n), k=3, block=b)._jdf.queryExecution().optimizedPlan().toString() for n, b in ((5, 50), (200, 10))]
    assert abs(len(plans[0].splitlines()) - len(plans[1].splitlines())) <= 1


def test_what_is_shuffled_a_row(spark, unlike):
    """Vectors go to each block once and to each chunk once: at ten times the rows they are sent so many times more."""
    assert V.dealt(51_282, 2565, 24) == (7, 1) and V.dealt(100, 5, 24) == (1, 1) and V.dealt(0, 0, 24) == (1, 1)
    for rows in (10**7, 10**8, 10**9):
        chunks, blocks = V.dealt(rows, rows // 20, 4000)
        copies = (blocks * rows + chunks * rows // 20) / rows
        assert copies < 1.3 * rows / 20 / 65_536 + 0.05 * rows / 131_072 + 40
    floats = unlike[0].withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert V.usable(floats).schema["embedding"].dataType.simpleString() == "array<float>"
    some = floats.limit(3000).withColumn("embedding", F.col("embedding"))
    double = some.withColumn("embedding", F.col("embedding").cast("array<double>"))
    one, two = (sorted(tuple(r) for r in V.search(t, t.where("vec_id % 250 = 0"), k=5).collect()) for t in (some, double))
    assert one == two
