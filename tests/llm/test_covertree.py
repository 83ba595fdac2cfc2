"""Hard negatives from cover trees against brute force in whole numbers, and against SQL."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import covertree, queries

POINTS = "vec_id long, label int, point array<long>, row string, part string, lane string, w string, query string"
VECTORS = "vec_id long, embedding array<float>, label int, row string, block string"


def brute(rows, is_anchor, positives=5, negatives=10):
    """rows: (vec_id, label, whole numbers), each for itself."""
    out = []
    for i, (a, label, x) in enumerate(rows):
        if not is_anchor(a):
            continue
        score = {j: sum(u * v for u, v in zip(x, y, strict=True)) for j, (_, _, y) in enumerate(rows) if j != i}
        first = sorted((j for j in score if rows[j][1] == label), key=lambda j: (-score[j], rows[j][0]))[:positives]
        for p in first:
            fit = [j for j in score if rows[j][1] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]]
            fit = sorted(fit, key=lambda j: (-score[j], rows[j][0]))[:negatives]
            out += [(a, rows[p][0], k, rows[j][0], score[p], score[j]) for k, j in enumerate(fit, 1)]
    return sorted(out)


def points(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, dim)) * 60
    return [(i * 3, int(i % 6), [int(v) for v in centers[i % 6] * 0.6 + centers[0] * 0.5 + rng.standard_normal(dim) * spread]) for i in range(n)]


def framed(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], POINTS).repartition(3)


@pytest.mark.parametrize("dim,spread,block", [(3, 30, 64), (16, 40, 4096), (24, 2, 50)])
def test_against_brute_force(spark, dim, spread, block):
    rows = points(dim, 400, dim, spread)
    got = covertree.mine(framed(spark, rows), F.col("vec_id") % 30 == 0, block=block, query_block=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 30 == 0)


def test_ties_repeats_small_labels_and_rows_that_take_no_part(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice([0, 0, 0, 1, 2]), [rng.randrange(-2, 4) for _ in range(3)]) for _ in range(150)]
    rows += [(0, 7, [1, 1, 1]), (100, 8, [0, 0, 0]), (10, 9, [-1, -1, -1])]
    bad = [(None, 1, [1, 1, 1]), (20, None, [1, 1, 1]), (20, 1, None), (20, 1, [1, None, 1]), (20, 1, [1, 1]), (20, 1, [2**40, 0, 0]), (20, 1, [])]
    got = sorted(map(tuple, covertree.mine(framed(spark, rows + bad), F.col("vec_id") % 10 == 0, block=20, query_block=2).collect()))
    want = brute(rows, lambda i: i % 10 == 0)
    # equal rows have equal ids and scores, whichever of them comes first
    assert got == want
    assert covertree.mine(framed(spark, []), F.lit(True)).count() == 0
    assert covertree.mine(framed(spark, bad[:1]), F.lit(True)).count() == 0


def test_products_near_the_limit_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.randrange(-(2**29), 2**29) for _ in range(4)]) for i in range(120)]
    got = covertree.mine(framed(spark, rows), F.col("vec_id") % 20 == 0, block=40)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0)


def test_a_tree_covers_and_prunes():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((100, 8)) * 20 + rng.standard_normal(8) * 400 for _ in range(20)]).astype(np.int64)
    tree = covertree.build(x, np.arange(len(x)), np.arange(len(x)))
    assert sorted(tree.rows.tolist()) == list(range(len(x)))
    q = x[5]
    scale = tree.reach * float(np.linalg.norm(q))

    def under(node):
        child, n, start, end = tree.links[node]
        return np.concatenate([under(c) for c in range(child, child + n)]) if n else np.arange(start, end)

    for node in range(len(tree.links)):
        below = tree.points[under(node)] @ q
        low, high = tree.bounds(np.array([node]), q, scale)
        assert low[0] <= below.min() and below.max() <= high[0]
    seen = []
    plain, covertree.Tree.bounds = covertree.Tree.bounds, lambda self, nodes, *a: (seen.append(len(nodes)), plain(self, nodes, *a))[1]
    try:
        ((places, scores),) = covertree.descend(tree, q, np.array([covertree.LEAST]), np.array([covertree.MOST]), np.array([covertree.LEAST]), 5)
    finally:
        covertree.Tree.bounds = plain
    assert scores.tolist() == sorted((x @ q).tolist())[::-1][:5] and sum(seen) < 0.7 * len(tree.links)


def test_the_query_and_its_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.2 * (i % 10 == d), 0.12) for d in range(10)], i % 10) for i in range(700)]
    rows += [(705, None, 1), (707, [0.0] * 10, 3), (800, [float("nan")] * 10, 1), (900, [0.1] * 10, None), (1000, [None] + [0.1] * 9, 2), (1100, [float("inf")] * 10, 2), (None, None, None)]
    spark.createDataFrame([(*r, "a", "b") for r in rows], VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in queries.op12_hard_negatives(spark, str(tmp_path)).collect())
    single = [(i, [float(np.float32(v)) if v is not None else None for v in x] if x else x, c) for i, x, c in rows]
    whole = [(i, (c + 1) % 10 if i % 7 == 0 else c, [math.floor(256 * v) for v in x]) for i, x, c in single if c is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    assert got == brute(whole, lambda i: i % 100 == 0) and len(got) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert sorted(con.execute(f"SELECT {names} FROM ({queries.OP12_SQL})").fetchall()) == got


def test_blocks_and_trees_are_merged_and_not_broadcast(spark, monkeypatch):
    frame = framed(spark, points(3, 300, 4, 30))
    plans, plain = [], type(frame).mapInPandas

    def told(self, *a, **more):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *a, **more)

    monkeypatch.setattr(type(frame), "mapInPandas", told)
    covertree.mine(frame, F.col("vec_id") % 30 == 0, block=20)
    # the last join of each search; Spark takes exploded blocks for small
    assert [re.search(r"\w+Join", p).group() for p in plans] == ["SortMergeJoin"] * 2
