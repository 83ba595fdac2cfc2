import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions.columns import cosine_distance
from marketloom.operators import vectors


def _plain(queries, rows, k, *by):
    """Every pair, by expressions alone."""
    met = rows.crossJoin(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))).where("vec_id <> query_id")
    found = met.select("query_id", "vec_id", *by, F.round(cosine_distance(F.col("embedding"), F.col("_q")), 6).alias("distance")).where("distance is not null")
    w = Window.partitionBy("query_id", *by).orderBy("distance", "vec_id")
    return {tuple(map(str, r)) for r in found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k").collect()}


def test_nearest_equals_all_pairs_on_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "CHUNK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(200)]
    # copies, ties in the sixth decimal, no direction, nulls, other lengths, no numbers, sums that overflow
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0], i % 2) for i in range(90)] + [(300 + i, [1.0, 2.0, 3.0, 4.0 + i * 1e-4], 1) for i in range(30)]
    rows += [(400, [0.0] * 4, 0), (401, None, 1), (402, [], 1), (403, [1.0, None, 2.0, 3.0], 2), (404, [1.0, 2.0], 0), (405, [2.0, 1.0], 0), (406, [float("nan"), 1.0, 1.0, 1.0], 0), (407, [1e200, 1e200, 1.0, 1.0], 2), (408, [float("inf"), 1.0, 0.0, 0.0], 1), (409, [1e-170, 2e-170, 1e-170, 0.0], 1), (410, [-1e-170, 2e-100, 1e-170, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = table.where("vec_id % 40 = 0 or vec_id >= 400 or vec_id in (210, 310)")
    for by in ((), ("label",)):
        got = [tuple(map(str, r)) for r in vectors.nearest(asked, table, 4, *by).collect()]
        assert len(got) == len(set(got)) and set(got) == _plain(asked, table, 4, *by)


def test_few_pairs_are_measured_by_expressions():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # a third are copies of one vector: none of their ties is kept beyond the smallest ids
    v[:1000] = v[0]
    q, r = vectors._likely(1 - v[:50] @ v.T, np.arange(3000), np.arange(50), 10)
    assert len(q) <= 50 * 11 and set(r[q == 20].tolist()) == set(range(10))
