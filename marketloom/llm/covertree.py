"""Hard negatives by inner product, from cover trees over norm-augmented candidates.

Vectors hold whole numbers. A candidate x of a tree gets one more component, sqrt(M^2 - |x|^2), where M is
the greatest norm in the tree, so that all candidates lie on a sphere of radius M and a query's inner
product with one is M |q| times the cosine of the angle between them. A tree's levels have covering radii that
shrink by ``BASE``: a node covers the candidates under it within its level's radius, its children cover them
within the next level's, children's centers lie further apart than that, and the first child
has its parent's center. The angle that a node's radius spans bounds the inner products of everything under it
from above and below.

1. Candidates are dealt to trees of about ``block`` rows of one label; each is built in one task
   and written as a row of packed arrays. A label that holds a third of all rows is many trees.
2. Anchors are gathered in packed blocks of about ``query_block``. A block meets every tree of its label and takes each
   anchor's best rows there: the first ``positives`` of all are its positives.
3. Blocks meet the trees of other labels with a window of scores for each positive. A block goes down a tree as a whole: nodes
   with the best bounds come first, nodes that lie outside all windows or below what the block has already found
   for them are left out, and leaves are compared as products of matrices, in whole numbers: as doubles where
   no sum can reach 2^53, else in 64 bits.

Trees are dealt to lanes (``lanes``), and a block goes to each lane once. Both sides are dealt by lane and merged; neither is broadcast,
as Spark takes blocks for as small after the explode as before it. A task holds the trees of one lane and one block.

Bounds only leave out what can't be among the first, so the result is exact.

Defined results: rows with a null id, label or vector, with a null component, of another length than most, or
with a squared length beyond 2^62 (whose products would not fit) take no part. Each row stands for itself: a repeated
id is another candidate, also of the other rows with that id, and each anchor row gets its own
positives. Ties go to the smaller id. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, let_go, written

#: Ratio of the covering radii of neighbouring levels.
BASE = 1.5
#: Candidates of a node that is not divided further.
LEAF = 24
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Sums of products of vectors whose lengths' product is less are exact as doubles, in any order.
EXACT = 2.0**52
#: Lanes that trees are dealt to at least, if there are as many trees.
LANES = 32

TREES = "label long, part int, lane int, points binary, rows binary, ids binary, centers binary, radii binary, links binary, reach double"
BLOCK = "own binary, labels binary, queries binary, low binary, high binary"
FOUND = "query long, w int, row long, vec_id long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Tree:
    """Candidates in the order of leaves, and nodes level by level: place of the center, covering radius and
    ``links`` (first child, number of children, first candidate, end of candidates); ``reach`` is M."""

    points: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    links: np.ndarray
    reach: float

    @staticmethod
    def packed(r) -> Tree:
        long = lambda name: np.frombuffer(r[name], np.int64)
        rows, points = long("rows"), long("points")
        return Tree(points.reshape(len(rows), len(points) // len(rows)), rows, long("ids"), long("centers"), np.frombuffer(r["radii"], np.float64), long("links").reshape(-1, 4), r["reach"])

    @cached_property
    def doubles(self) -> np.ndarray:
        return self.points.astype(np.float64)

    def bounds(self, nodes: np.ndarray, q: np.ndarray, scale: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product with ``q`` under each node; scale is M |q|. Several queries are
        rows of ``q``, and their scales a column."""
        slack = 1e-7 * scale + 1
        cos = np.clip((q @ self.doubles[self.centers[nodes]].T) / np.maximum(scale, 1e-300), -1, 1)
        span = np.clip(1 - self.radii[nodes] ** 2 / max(2 * self.reach**2, 1e-300), -1, 1)
        along, across = cos * span, np.sqrt((1 - cos**2) * (1 - span**2))
        high = np.where(cos >= span, 1.0, along + across)
        low = np.where(cos <= -span, -1.0, along - across)
        return low * scale - slack, high * scale + slack


@dataclass
class Block:
    """Queries: row (``own``), label, vector, and windows [low, high] of scores, a row each; unused windows are [MOST, LEAST]."""

    own: np.ndarray
    labels: np.ndarray
    queries: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def packed(r) -> Block:
        own, labels, *wide = (np.frombuffer(r[name], np.int64) for name in ("own", "labels", "queries", "low", "high"))
        return Block(own, labels, *(a.reshape(len(own), len(a) // len(own)) for a in wide))


def _divided(center: int, members: np.ndarray, far: np.ndarray, within: float, away) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Children (center, members, their distances from it) that hold all ``members`` within ``within`` of a center."""
    out = []
    while True:
        near = far <= within
        out.append((center, members[near], far[near]))
        members = members[~near]
        if not len(members):
            return out
        center = int(members[0])
        far = away(center, members)


def build(points: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> Tree:
    """A cover tree over points (n, dim), level by level."""
    x = points.astype(np.float64)
    squares = (x * x).sum(axis=1)
    reach = float(np.sqrt(squares.max()))
    x = np.hstack([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]])
    least = max(reach, 1.0) * 2**-20  # the radius of the lowest level

    def away(center: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[members] - x[center]) ** 2).sum(axis=1))

    leaves: list[np.ndarray] = []
    centers, radii, links = [], [], []
    every, made = np.arange(len(x)), 0
    level = [(0, every, away(0, every))]
    while level:
        below = []
        for center, members, far in level:
            radius = far.max()
            centers.append(center)
            radii.append(radius)
            if len(members) <= LEAF or radius <= least:
                links.append((0, 0, made, made + len(members)))
                leaves.append(members)
                made += len(members)
            else:
                within = least * BASE ** (np.ceil(np.log(radius / least) / np.log(BASE)) - 1)
                below.append((len(links), _divided(center, members, far, within, away)))
                links.append((0, 0, 0, 0))
        level = []
        for node, children in below:
            links[node] = (len(centers) + len(level), len(children), 0, 0)
            level += children
    order = np.concatenate(leaves)
    place = np.empty(len(order), np.int64)
    place[order] = every
    return Tree(points[order], rows[order], ids[order], place[np.array(centers)], np.array(radii), np.array(links, np.int64), reach)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    if not len(starts):
        return np.empty(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _first(k: int, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The places of the k first of each group, groups and their members in order."""
    at = np.lexsort((*reversed(order), group))
    starts = np.flatnonzero(np.diff(group[at], prepend=-1))
    return at[np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at))) < k]


def _hits(s: np.ndarray, floor: np.ndarray, high: np.ndarray, not_its_own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores ``s`` (queries, candidates) those in each query's [floor, high], its k best at most (ties: the earlier): places in ``s``, and their
    numbers a query."""
    hit = (s >= floor[:, None]) & (s <= high[:, None])
    hit[not_its_own] = False
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
    if len(many):
        v = np.where(hit[many], s[many], s.dtype.type(LEAST))
        kth = np.partition(v, -k, axis=1)[:, -k, None]
        above, tie = v > kth, v == kth
        hit[many] = above | tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True))
    return *np.nonzero(hit), np.count_nonzero(hit, axis=1)


def descend_all(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each query, a row of ``q``, and each of its windows [low, high] (queries, windows), the k best candidates in it
    (ties by id, then row) as arrays: query, window, place, score; its row ``own`` is left out.

    ``best`` (queries, windows, k) holds the best scores met so far in rising order. Only candidates that reach the k-th of them are
    given, and theirs are added.
    """
    x = q.astype(np.float64)
    scale = tree.reach * np.sqrt((x * x).sum(axis=1))[:, None]
    q, points = (x, tree.doubles) if scale.max() < EXACT else (q, tree.points)
    top, found = high.max(axis=1)[:, None], [np.empty((4, 0), np.int64)]
    nodes = np.zeros(1, np.int64)
    least, most = tree.bounds(nodes, x, scale)
    taken = 8
    while True:
        floor = np.maximum(low, best[:, :, 0])
        useful = (most >= floor.min(axis=1)[:, None]) & (least <= top)
        kept = useful.any(axis=0)
        nodes, least, most, useful = nodes[kept], least[:, kept], most[:, kept], useful[:, kept]
        if not len(nodes):
            break
        goal = np.where(useful, np.minimum(most, top), -np.inf).max(axis=0)
        first = np.argpartition(-goal, taken - 1)[:taken] if len(nodes) > taken else np.arange(len(nodes))
        child, n, start, end = tree.links[nodes[first]].T
        asking = np.flatnonzero(useful[:, first[n == 0]].any(axis=1))
        nodes, least, most = np.delete(nodes, first), np.delete(least, first, axis=1), np.delete(most, first, axis=1)
        if len(asking):
            here = _ranges(start[n == 0], (end - start)[n == 0])
            here = here[np.lexsort((tree.rows[here], tree.ids[here]))]
            s = q[asking] @ points[here].T
            known = np.flatnonzero(np.isin(tree.rows[here], own[asking]))
            mine, at = np.nonzero(own[asking][:, None] == tree.rows[here[known]])
            for w in range(low.shape[1]):
                one, place, counts = _hits(s, floor[asking, w], high[asking, w], (mine, known[at]), k)
                if len(one):
                    scores = s[one, place].astype(np.int64)
                    found.append(np.array([asking[one], np.full(len(one), w), here[place], scores]))
                    fresh = np.full((len(asking), k), LEAST)
                    fresh[one, np.arange(len(one)) - np.repeat(np.cumsum(counts) - counts, counts)] = scores
                    got = np.flatnonzero(counts)
                    best[asking[got], w] = np.sort(np.hstack([best[asking[got], w], fresh[got]]), axis=1)[:, -k:]
        more = _ranges(child[n > 0], n[n > 0])
        if len(more):
            lo, hi = tree.bounds(more, x, scale)
            nodes, least, most = np.concatenate([nodes, more]), np.hstack([least, lo]), np.hstack([most, hi])
        taken *= 2
    query, window, place, score = np.hstack(found)
    first = np.flatnonzero(score >= best[query, window, 0])
    first = first[_first(k, (query * low.shape[1] + window)[first], -score[first], tree.ids[place[first]], tree.rows[place[first]])]
    return query[first], window[first], place[first], score[first]


def descend(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, own: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
    """``descend_all`` for one query: places and scores for each window, of candidates that reach the window's ``floor``."""
    best = np.full((1, len(low), k), LEAST)
    _, window, place, score = descend_all(tree, q[None], np.maximum(low, floor)[None], high[None], best, k, np.array([own]))
    return [(place[window == w], score[window == w]) for w in range(len(low))]


def trees(rows: DataFrame) -> DataFrame:
    """A packed tree for each (label, part, lane) of rows (label, part, lane, row, vec_id, point)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        let_go()
        t = build(np.stack(group["point"].to_numpy()).astype(np.int64), group["row"].to_numpy(np.int64), group["vec_id"].to_numpy(np.int64))
        packed = {name: [getattr(t, name).tobytes()] for name in ("points", "rows", "ids", "centers", "radii", "links")}
        return pd.DataFrame({"label": [key[0]], "part": [key[1]], "lane": [key[2]]} | packed | {"reach": [t.reach]})

    return rows.select("label", "part", "lane", "row", "vec_id", "point").groupBy("label", "part", "lane").applyInPandas(run, TREES)


def packed_blocks(rows: DataFrame, keys: str, n: int, window) -> DataFrame:
    """A packed block for each of ``keys`` (names and types) of rows (the keys, row, label, point, scores); ``window`` gives the window
    of a score, and there are ``n`` of them at most."""
    names = [key.split()[0] for key in keys.split(", ")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        let_go()
        sides = np.full((2, len(group), n), LEAST)
        sides[0] = MOST
        for i, scores in enumerate(group["scores"]):
            for w, score in enumerate(scores):
                low, high = (min(max(side, LEAST), MOST) for side in window(score))
                if low <= high:
                    sides[:, i, w] = low, high
        parts = (group["row"].to_numpy(np.int64), group["label"].to_numpy(np.int64), np.stack(group["point"].to_numpy()).astype(np.int64), *sides)
        return pd.DataFrame({k: [v] for k, v in zip(names, key, strict=True)} | {k.split()[0]: [a.tobytes()] for k, a in zip(BLOCK.split(", "), parts, strict=True)})

    return rows.select(*dict.fromkeys([*names, "row", "label", "point", "scores"])).groupBy(*names).applyInPandas(run, f"{keys}, {BLOCK}")


def lanes(parts: Column) -> Column:
    """The lanes of so many trees: a block goes to each lane, which holds some sqrt(trees) / 2 trees at most."""
    return F.least(parts, F.greatest(F.lit(LANES), F.ceil(2 * F.sqrt(parts)))).cast("int")


def _search(k: int, same_label: bool):
    """Descents of blocks in trees; the k-th best scores that a block has met in a lane are its floors."""

    def told(block: Block, rows: list[np.ndarray]) -> pd.DataFrame:
        query, w, row, vec_id, score = np.hstack(rows)
        first = _first(k, query * block.low.shape[1] + w, -score, vec_id, row)
        return pd.DataFrame({"query": block.own[query[first]], "w": w[first], "row": row[first], "vec_id": vec_id[first], "score": score[first]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        block, raw, best, rows = None, None, None, []
        for batch in batches:
            for r in batch.to_dict("records"):
                if r["own"] != raw:
                    if rows:
                        yield told(block, rows)
                    block, raw, rows = Block.packed(r), r["own"], []
                    best = np.full((*block.low.shape, k), LEAST)
                tree = Tree.packed(r)
                mine = np.arange(len(block.own)) if same_label else np.flatnonzero(block.labels != r["label"])
                mine = mine[(block.low[mine] <= block.high[mine]).any(axis=1)]
                if len(mine):
                    near = best[mine]
                    query, w, place, score = descend_all(tree, block.queries[mine], block.low[mine], block.high[mine], near, k, block.own[mine])
                    best[mine] = near
                    if len(query):
                        rows.append(np.array([mine[query], w, tree.rows[place], tree.ids[place], score]))
        if rows:
            yield told(block, rows)

    return run


def _met(blocks: DataFrame, forest: DataFrame, n: int, *on: str) -> DataFrame:
    """Blocks beside the trees of their lane, in ``n`` partitions. The trees are the side that a merge holds, a lane at a time."""
    return blocks.repartition(n, *on).hint("merge").join(forest.repartition(n, *on), [*on])


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 4096, query_block: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for ``vectors``
    (vec_id, label, point array<long>): of rows of other labels, the first whose score is ``low`` to
    ``high`` percent of the positive's."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    usual = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "point", is_anchor.alias("anchor"))
    square = F.aggregate("point", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usual = usual.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("point").isNotNull() & (square < 2.0**62))
    dim = usual.groupBy(F.size("point").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return spark.createDataFrame([], MINED)
    rows = written(usual.where(F.size("point") == dim["dim"]).withColumn("row", F.monotonically_increasing_id()), "vectors")
    cut = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).select("label", cut("n", block).alias("parts"), cut("a", query_block).alias("blocks"))
    labels = labels.withColumn("lanes", lanes(F.col("parts")))
    sums = labels.agg(lanes(F.sum("parts")).alias("lanes"), F.sum("blocks").alias("blocks")).first()
    tasks = 2 * sums["lanes"]
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("lane")
    dealt = lambda parts, seed: F.pmod(F.xxhash64("row", F.lit(seed)), parts).cast("int")
    placed = rows.join(labels, "label")
    grown = placed.withColumn("part", dealt(F.col("parts"), 1)).withColumn("lane", F.col("part") % F.col("lanes"))
    forest = written(trees(grown.repartition(tasks, "label", "part", "lane")), "trees")

    asked = placed.where("anchor").withColumn("block", dealt(F.col("blocks"), 2)).withColumn("scores", F.array(F.lit(0).cast("long")))
    blocks = packed_blocks(asked.repartition(tasks, "label", "lanes", "block"), "label long, lanes int, block int", 1, lambda score: (LEAST, MOST))
    packed = [k.split()[0] for k in BLOCK.split(", ")]
    met = _met(blocks.select("label", *packed, each(F.col("lanes"))), forest, tasks, "label", "lane")
    near = met.mapInPandas(_search(positives, True), FOUND)
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    near = written(near.withColumn("w", first).where(F.col("w") <= positives), "positives")

    window = lambda score: (-(-low * int(score) // 100), high * int(score) // 100)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("w", "score"))), lambda p: p["score"])
    asks = near.groupBy("query").agg(scores.alias("scores")).hint("merge").join(rows.where("anchor").select(F.col("row").alias("query"), "label", "point"), "query").withColumnRenamed("query", "row")
    asks = asks.withColumn("block", dealt(F.lit(sums["blocks"]), 3))
    blocks = written(packed_blocks(asks.repartition(tasks, "block"), "block int", positives, window), "anchors")
    met = _met(blocks.select(*packed, each(F.lit(sums["lanes"]))), forest.withColumn("lane", F.pmod(F.xxhash64("label", "part"), F.lit(sums["lanes"])).cast("int")), tasks, "lane")
    found = met.mapInPandas(_search(negatives, False), FOUND).withColumn("w", F.col("w") + 1)
    order = Window.partitionBy("query", "w").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("query", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("query", "w", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(named, ["query", "w"]).join(rows.where("anchor").select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
