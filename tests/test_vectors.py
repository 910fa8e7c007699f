import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from foliospark.functions import vectors
from foliospark.operators import retrieval


@pytest.fixture
def index(spark):
    data = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8]), (4, [-1.0, 0.0]), (5, None), (6, [1.0, 0.0, 0.0])]
    return spark.createDataFrame(data, "id bigint, v array<float>")


def test_unit_norm(spark, index):
    lengths = [r[0] for r in index.where("v is not null").select(vectors.norm(vectors.unit(F.col("v")))).collect()]
    assert all(abs(x - 1) < 1e-6 for x in lengths)
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.unit(F.col("v"))).first()[0] is None


def test_top_k_breaks_ties_by_key(index):
    assert [r.id for r in retrieval.top_k(index, "id", "v", [0.6, 0.8], 3).collect()] == [2, 3, 1]


def test_top_k_more_than_rows(index):
    assert retrieval.top_k(index, "id", "v", [1.0, 0.0], 50).count() == 4


def test_vector_of_missing(index):
    with pytest.raises(LookupError):
        retrieval.vector_of(index, "id", "v", 99)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_batch_equals_single(spark, block):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.standard_normal((60, 8)))]
    df = spark.createDataFrame(data, "id bigint, v array<float>").repartition(5)
    found = rows(retrieval.top_k_batch(df, df.where("id % 20 = 0"), "id", "v", 4, block=block).select("query_id", "rank", "id"))
    x = np.round(np.array([v for _, v in data], np.float32).astype(np.float64) @ np.array([v for _, v in data], np.float32).astype(np.float64).T, 6)
    expected = sorted((q, r + 1, int(i)) for q in (0, 20, 40) for r, i in enumerate(np.lexsort((np.arange(60), -x[q]))[:4]))
    assert sorted(found) == expected


def test_batch_without_queries(index):
    assert retrieval.top_k_batch(index, index.where("id = 99"), "id", "v").count() == 0


def test_centroids_and_assignment(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [9.0, 9.0], 1), (4, [5.0, 4.5], None)], "id bigint, v array<float>, g int")
    means = retrieval.centroids(df, "g", "v")
    assert rows(means) == [(0, 1, 1.0), (0, 2, 0.0), (1, 1, 9.0), (1, 2, 9.0)]
    assert rows(retrieval.assign_nearest(df, "id", "v", means, "g")) == [(1, 0), (2, 0), (3, 1), (4, 0)]  # the last is equally near


def test_many_groups_in_several_passes(spark):
    df = spark.createDataFrame([(i, [float(i // 2)], i) for i in range(7)] + [(7, None, None), (8, [1.0, 2.0], None)], "id bigint, v array<float>, g int")
    means = retrieval.centroids(df.where("g is not null"), "g", "v")
    for most in (2, 3, 100):
        got = rows(retrieval.assign_nearest(df, "id", "v", means, "g", most_groups=most))
        assert got == [(i, i // 2 * 2) for i in range(7)] + [(7, None), (8, None)]
