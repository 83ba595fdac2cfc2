"""Nearest vectors of a set of query rows, exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import cosine_distance

#: Query rows that one block holds and rows that one chunk holds, about.
BLOCK, CHUNK = 4096, 8192
#: Distances that are worked out at once, and by how much they may be off (some 1e-13 for a thousand components).
AT_ONCE, OFF = 1 << 21, 1e-10


def _units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: places of the vectors that have so many, and their unit vectors.

    NaN where a component is null or not finite, or squares leave the range of doubles; zero vectors stay."""
    column = vectors.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for size in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(at), size)
        with np.errstate(all="ignore"):
            length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
            unit = np.where((length > 1e-140) & (length < 1e140), flat / length, np.where((flat == 0).all(axis=1, keepdims=True), 0.0, np.nan))
        out[size] = at, unit
    return out


def _likely(distance: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of all pairs that can be among the ``k`` least, by distance in six decimals and then by id,
    of their query. Pairs that are surely beaten by ``k`` others or infinitely far are left out; those without a number stay."""
    other = (ids[None, :] != own[:, None]) & (distance != np.inf)
    unknown = np.isnan(distance)
    least = np.where(other & ~unknown, distance, np.inf)
    bound = np.partition(least, k - 1, axis=1)[:, k - 1] if k < least.shape[1] else np.full(len(least), np.inf)
    q, r = np.nonzero(other & (unknown | (least <= bound[:, None] + 2e-6)))
    place = distance[q, r] * 1e6 + 0.5
    near = np.floor(place)
    # within OFF of a rounding's edge the sixth decimal is not known yet
    sure = np.abs(place - np.rint(place)) > OFF * 1e6
    order = np.lexsort((ids[r], near, ~sure, q))
    q, r, sure = q[order], r[order], sure[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = ~sure | (rank < k)
    return q[keep], r[keep]


def nearest(queries: DataFrame, rows: DataFrame, k: int, *by: str) -> DataFrame:
    """query_id, vec_id, ``by`` and distance of the ``k`` rows nearest to each query, within each group of ``by``.

    ``queries`` and ``rows`` hold (vec_id, embedding). Every query meets every row but its own, a block of queries and a
    chunk of rows in a task at a time, as a product of matrices. That leaves out pairs which surely have ``k`` nearer ones
    in their chunk; the others are measured exactly. Vectors without a direction take no part; ties go to the smaller vec_id.
    """
    blocks, chunks = (-(-df.count() // n) or 1 for df, n in ((queries, BLOCK), (rows, CHUNK)))
    cell = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    known = "embedding is not null and vec_id is not null"
    q = queries.where(known).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), cell(blocks).alias("_block"), all_of(chunks).alias("_chunk"))
    r = rows.where(known).select("vec_id", *by, "embedding", cell(chunks).alias("_chunk"), all_of(blocks).alias("_block"))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, own = (np.asarray(c.to_numpy()) for c in (held["vec_id"], asked["query_id"]))
        group = np.zeros(len(ids), dtype=int)
        for c in by:
            codes = held[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            group = np.unique(np.stack([group, codes]), axis=1, return_inverse=True)[1].reshape(-1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        mine, theirs = _units(asked["_q"]), _units(held["embedding"])
        # vectors of other lengths have no distance
        for size in mine.keys() & theirs.keys():
            (at, u), (there, v) = mine[size], theirs[size]
            for g in np.unique(group[there]):
                some = np.flatnonzero(group[there] == g)
                step = max(1, AT_ONCE // len(some))
                for a in range(0, len(at), step):
                    with np.errstate(all="ignore"):
                        distance = 1 - u[a : a + step] @ v[some].T
                        # zero vectors have a distance only to what is no number
                        zero = ~u[a : a + step].any(axis=1)[:, None] | ~v[some].any(axis=1)[None, :]
                        distance[zero & ~np.isnan(distance)] = np.inf
                    x, y = _likely(distance, ids[there[some]], own[at[a : a + step]], k)
                    found.append((at[a + x], there[some[y]]))
        left, right = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in (0, 1))
        columns = [asked.select(["query_id", "_q"]).take(pa.array(left)), held.select(["vec_id", *by, "embedding"]).take(pa.array(right))]
        return pa.table({n: t[n] for t in columns for n in t.column_names})

    fields = [q.schema["query_id"], q.schema["_q"], *(r.schema[c] for c in ("vec_id", *by, "embedding"))]
    met = q.groupBy("_chunk", "_block").cogroup(r.groupBy("_chunk", "_block")).applyInArrow(meet, T.StructType(fields))
    found = met.select("query_id", "vec_id", *by, F.round(cosine_distance(F.col("embedding"), F.col("_q")), 6).alias("distance")).where("distance is not null")
    w = Window.partitionBy("query_id", *by).orderBy("distance", "vec_id")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
