"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is normalised, set off from its list's centroid, padded with zeros to ``EXPAND``
times its length, turned by a random orthogonal matrix and reduced to the signs of its
components: one bit for each turned component, packed, plus three scalars (length of the offset, inner
product of the offset's direction with its own code, inner product with the centroid). A query's
turned components are rounded to four bits, so that its inner product with a code is a few
counts of common bits. From that and the scalars comes an estimate of the cosine with a query
and a bound on its error that holds with high probability.

1. The scan reads codes and scalars alone. Vectors and queries meet list by list in blocks: a
   list's codes are dealt to parts and cut into blocks of at most ``block`` rows, a list's queries
   into blocks of at most ``query_block``, and blocks of one list and part are joined. A list
   that holds a third of all vectors is many blocks, dealt to many tasks.
2. A first scan of each query's very nearest lists gives the ``first`` rows with the best estimates;
   they are compared exactly, by a join to the original vectors, and the k-th best cosine found
   so is the query's bar.
3. A second scan of all lists that the query looks into gives the rows whose upper bound reaches
   the bar (and the k-th best lower bound met in the task), which are compared exactly.

The index is fitted on at most ``sample`` vectors (centroids; k-means) but holds every
vector.

Defined results: null vectors, zero vectors, vectors with null or non-finite components, those of
another length than most, and rows with a null id take no part, neither as queries nor
as candidates. Each row stands for itself: a repeated id is another candidate, also of the other
rows with that id, and each query row gets its own ranks from 1, so that an id that two query
rows share has each rank twice. Ties go to the smaller id. Columns other than the two named are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, sampled, written

#: Widths of the error bound, in its standard deviations.
EPSILON = 1.9

#: Components of a turned vector for each of the original one.
EXPAND = 8

INDEX = "row long, list int, part int, bits binary, offset float, align float, along float"
FOUND = "query long, row long, estimate float"


@dataclass
class Model:
    """Centroids (lists, dim) and the rows of an orthogonal matrix that a padded vector meets (dim, width)."""

    centroids: np.ndarray
    rotation: np.ndarray

    @property
    def width(self) -> int:
        return self.rotation.shape[1]


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, lists: int, total: int, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> Model:
    """Centroids from the ``sample`` of ``total`` vectors with the smallest keyed hash of their row."""
    rows = sampled(vectors.select("row", "embedding"), sample, total, seed, "row").select("embedding").toPandas()
    x = _unit(np.stack(rows["embedding"].to_numpy()))
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    centers = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        filled = np.bincount(nearest, minlength=lists) > 0
        centers[filled] = sums[filled] / np.maximum(np.linalg.norm(sums[filled], axis=1, keepdims=True), 1e-12)
    width = -(-EXPAND * x.shape[1] // 64) * 64
    rotation, upper = np.linalg.qr(rng.standard_normal((width, width)))
    return Model(centers, (rotation * np.sign(np.diag(upper)))[: x.shape[1]])


def build_index(vectors: DataFrame, model: Model, parts: int = 1) -> DataFrame:
    """Every vector's row number with its list, packed code and scalars."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            if batch.empty:
                continue
            x = _unit(np.stack(batch["embedding"].to_numpy()))
            where = (x @ m.centroids.T).argmax(axis=1)
            c = m.centroids[where]
            turned = (x - c) @ m.rotation
            size = np.linalg.norm(turned, axis=1)
            safe = np.where(size > 1e-12, size, 1.0)
            align = np.abs(turned).sum(axis=1) / (np.sqrt(m.width) * safe)
            yield pd.DataFrame(
                {
                    "row": batch["row"].to_numpy(), "list": where.astype("int32"), "part": batch["part"].to_numpy(),
                    "bits": [row.tobytes() for row in np.packbits(turned > 0, axis=1)], "offset": size.astype("f4"),
                    "align": np.where(size > 1e-12, align, 1.0).astype("f4"), "along": (x * c).sum(axis=1).astype("f4"),
                }
            )

    rows = vectors.select("row", "embedding", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    return rows.mapInPandas(run, INDEX)


def _blocks(rows: DataFrame, keys: list[str], size: int, columns: list[str], number: str) -> DataFrame:
    """Rows gathered into arrays of at most ``size``, dealt by ``keys``."""
    w = Window.partitionBy(*keys).orderBy("row")
    cut = rows.withColumn(number, F.floor((F.row_number().over(w) - 1) / size))
    return cut.groupBy(*keys, number).agg(F.collect_list(F.struct(*columns)).alias(f"{number}_rows"))


def probe(queries: DataFrame, model: Model, probes: int, sizes: np.ndarray, k: int) -> DataFrame:
    """Each query (row, embedding, bar) with the ``probes`` lists whose centroids are nearest, and with as many
    further ones, nearest first, as it takes to hold ``k`` other rows (all, if there are fewer).

    ``sizes`` are the lists' numbers of rows.
    """
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            if batch.empty:
                continue
            near = _unit(np.stack(batch["embedding"].to_numpy())) @ m.centroids.T
            order = np.argsort(-near, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            n = np.maximum(probes, (held <= k).sum(axis=1) + 1)  # the query's own row is one of those held
            n = np.minimum(n, near.shape[1])
            lists = order[np.arange(order.shape[1]) < n[:, None]]
            yield pd.DataFrame({"row": np.repeat(batch["row"].to_numpy(), n), "list": lists.astype("int32"), "embedding": np.repeat(batch["embedding"].to_numpy(), n), "bar": np.repeat(batch["bar"].astype("Float64").to_numpy(), n)})

    return queries.select("row", "embedding", "bar").mapInPandas(run, "row long, list int, embedding array<float>, bar double")


def common_bits(turned: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of turned queries (Q, width), rounded to four bits a component, with the
    codes' signs / sqrt(width), for packed codes (n, width / 64); and each query's rounding step."""
    width = turned.shape[1]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-12)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float32)
    total = low * width + step * levels.sum(axis=1, dtype=np.int64)
    out = np.empty((len(turned), len(codes)), dtype=np.float32)
    for i, level in enumerate(levels):
        planes = np.packbits((level[None, :] >> np.arange(4, dtype=np.uint8)[:, None]) & 1, axis=1).view(np.uint64)
        counts = sum(np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int32) << j for j, plane in enumerate(planes))
        out[i] = (2 * (low[i] * ones + step[i] * counts) - total[i]) / np.sqrt(width)
    return out, step


def _scan(model_of, k: int, first: int | None = None):
    """Rows whose upper bound reaches their query's bar, or each block's ``first`` best estimates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model_of.value
        floor: dict[int, float] = {}  # each query's k-th best lower bound so far in this task
        for batch in batches:
            for here, qs, vs in zip(batch["list"], batch["q_rows"], batch["v_rows"], strict=True):
                q_rows, q = np.array([r["row"] for r in qs]), np.stack([r["embedding"] for r in qs]).astype(np.float64)
                rows = np.array([r["row"] for r in vs])
                offset, align, along = (np.array([r[x] for r in vs], dtype=np.float32) for x in ("offset", "align", "along"))
                codes = np.frombuffer(b"".join(r["bits"] for r in vs), np.uint64).reshape(len(rows), -1)
                c, unit = m.centroids[here], _unit(q)
                rest = (unit - c) @ m.rotation
                products, step = common_bits(rest, codes)
                # <x, q> = <x, c> + <x - c, q - c> + <c, q - c>
                estimate = products / align * offset + along + (unit @ c - c @ c).astype(np.float32)[:, None]
                spread = offset * np.sqrt(np.maximum(1 - align**2, 0)) / align * (EPSILON / np.sqrt(m.width - 1))
                rounding = (EPSILON / np.sqrt(12) * step).astype(np.float32)[:, None] * (offset / align)
                slack = np.linalg.norm(rest, axis=1).astype(np.float32)[:, None] * spread + rounding + np.float32(1e-5)
                own = q_rows[:, None] == rows
                if first is not None:
                    estimate[own] = -np.inf
                    i = np.repeat(np.arange(len(q)), n := min(first, len(rows)))
                    j = np.argpartition(-estimate, n - 1, axis=1)[:, :n].ravel()
                    i, j = i[good := np.isfinite(estimate[i, j])], j[good]
                    yield pd.DataFrame({"query": q_rows[i], "row": rows[j], "estimate": estimate[i, j]})
                    continue
                low = np.where(own, np.float32(-np.inf), estimate - slack)
                bar = np.partition(low, -k, axis=1)[:, -k] if len(rows) >= k else np.full(len(q), -np.inf)
                asked = np.array([-np.inf if r["bar"] is None else r["bar"] for r in qs])
                bar = np.maximum.reduce([bar, asked, [floor.get(i, -np.inf) for i in q_rows.tolist()]])
                floor.update(zip(q_rows.tolist(), bar.tolist(), strict=True))
                i, j = np.nonzero((estimate + slack >= bar[:, None]) & ~own)
                yield pd.DataFrame({"query": q_rows[i], "row": rows[j], "estimate": estimate[i, j]})

    return run


def compared(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs (query, row) of row numbers with their ids and cosine, in double precision.

    The sums run in the order of the components, so that equal vectors get equal scores.
    """
    one = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), F.col("norm").alias("_qn"))
    found = pairs.select("query", "row").join(vectors.select("row", "vec_id", "embedding", "norm"), "row").join(one, "query")
    score = F.aggregate(F.zip_with("embedding", "_q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) / (F.col("norm") * F.col("_qn"))
    return found.select("query", "row", "query_id", "vec_id", score.alias("score"))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, lists: int | None = None, probed: float = 0.75, first: int = 20, block: int = 4096, query_block: int = 256
) -> DataFrame:
    """The k nearest by cosine of every query row among all other rows:
    query_id, rank, vec_id, score.

    ``lists`` defaults to a number that grows with the square root of the rows;
    each query looks into the share ``probed`` of them, and into a seventh of those first, but always into enough to
    hold ``k`` other rows. A list's rows are dealt to as
    many parts as keep the largest possible list at about ``lists`` blocks a part.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usual = vectors.select("vec_id", "embedding", is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    dim = usual.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    numbered = usual.where(F.size("embedding") == dim["dim"]).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", norm.alias("norm"), "asks")
    rows = written(numbered, "vectors")  # row numbers are fixed from here on
    n, asked_n = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    lists = lists or int(min(1024, max(1, n**0.5 / 3.5)))
    model = fit(rows, lists, n)
    lists = len(model.centroids)
    probes = max(1, round(lists * probed))
    v_parts, q_parts = max(1, n * 8 // (lists * block)), max(1, asked_n * probes // (lists * query_block))
    index = written(build_index(rows, model, v_parts), "codes")
    sizes = np.zeros(lists, np.int64)  # at most 1,024 rows, one a list
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    v = _blocks(index, ["list", "part"], block, ["row", "bits", "offset", "align", "along"], "v")
    shared, asked = spark.sparkContext.broadcast(model), rows.where("asks")

    def scanned(queries: DataFrame, probes: int, first: int | None = None) -> DataFrame:
        near = probe(queries, model, probes, sizes, k).withColumn("q_part", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(q_parts)))
        q = _blocks(near, ["list", "q_part"], query_block, ["row", "embedding", "bar"], "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(v_parts - 1))))
        return q.join(v, ["list", "part"]).select("list", "q_rows", "v_rows").mapInPandas(_scan(shared, k, first), FOUND)

    best = lambda rows, n, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= n)
    begun = scanned(asked.withColumn("bar", F.lit(None).cast("double")), -(-probes // 7), first)
    tried = written(compared(best(begun, first, F.desc("estimate"), "row"), rows, asked), "tried")
    # a whisker below the exact score, as bounds are single precision
    bars = best(tried, k, F.desc("score"), "vec_id", "row").groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) == k, F.min("score") - 1e-6).alias("bar"))
    found = scanned(asked.join(bars, "row", "left"), probes).join(tried.select("query", "row"), ["query", "row"], "left_anti")
    every = tried.unionByName(compared(found, rows, asked))
    return best(every, k, F.desc("score"), "vec_id", "row").select("query_id", "rank", "vec_id", "score")
