"""Exact near-duplicate classes by n-gram Jaccard similarity: a grouped prefix join.

1. Tasks turn whole texts into sets of hashed word shingles (64 bits). Documents
   with one and the same set are collapsed into a class before anything is joined.
2. Prefix filter: two sets as similar as asked share a shingle among the first
   n - ceil(t n) + 1 of each, in any common order. Ordered by how many classes hold
   them, shingles held by one class come first; they can't be shared, and a class with
   as many of them as places can't be linked with anything. This is decided twice: first on
   the shingles in a fixed range of hashes, which rules out most classes cheaply, then
   with whole sets and exact counts among the classes that are left.
3. Classes with identical prefixes and size form a group; groups meet on a shared prefix
   shingle and adjacent size ranges; pairs of groups are filtered by size and by the places
   of the shingle (what follows them bounds the overlap), then expanded to their members
   and verified exactly.
4. All pairs of a large group are never formed. In each bucket (shingle, size range)
   members are first compared with one member, that with the fewest shingles of its own,
   then with one that a hash picks, and the members of one group with one of their own,
   as no bucket holds a prefix that only they have; links are turned into components; only pairs that
   are still in different components are formed, filtered and verified then. So every link
   between texts of different components has been looked for, and the components are exact.

A shingle's rows pass through one task as a stream, two numbers each; nothing is collected.

Defined results: a null or empty text, or one without words, has no shingles and is linked with
nothing; a text with fewer words than a shingle has its whole sequence as one. Rows with
a null id stand for themselves. Rows that repeat an id get a row each; texts that
share an id are compared like all others, and ``component_id`` is the smallest id of the
linked texts. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, let_go, parted, written

SETS = "node long, doc_id long, n long, hi long, lo long, m int, counted array<long>"

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted hashes (uint64) of a text's distinct k-word shingles."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = _mixed(out * _D + h[i : len(h) - k + 1 + i] + _A)
    return np.unique(out)


def _node(unique: bool) -> Column:
    return F.col("doc_id") if unique else F.xxhash64("doc_id", "text")


def shingled(docs: DataFrame, k: int, percent: int, unique: bool) -> DataFrame:
    """A row per document: size, 128-bit digest, and the shingles in the counted range."""
    share = min(1.0, (100 - percent) / 100 + 0.1)
    cut = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        let_go()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text or "", k)
                raw = s.tobytes()
                digest = np.array([xxhash.xxh3_64_intdigest(raw, seed) for seed in (1, 2)], np.uint64).view(np.int64).tolist()
                m = int(np.searchsorted(s, cut))
                rows.append((len(s), *digest, m, s[:m].view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "hi", "lo", "m", "counted"])
            for name in ("doc_id", "node"):
                out.insert(0, name, batch[name].astype("Int64").to_numpy(dtype=object))
            yield out

    return docs.select(_node(unique).alias("node"), "doc_id", "text").mapInPandas(run, SETS)


def places(percent: int) -> Column:
    """Length of a class's prefix."""
    return F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("long") + 1


def shared_shingles(tokens: DataFrame) -> DataFrame:
    """(node, token, df) of the shingles that two or more classes hold.

    Rows are dealt by shingle once; counts and rows both read that one exchange.
    """
    dealt = tokens.repartition("token")
    counts = dealt.groupBy("token").agg(F.count("node").alias("df")).where("df > 1")
    return dealt.join(counts.hint("merge"), "token")


def linkable(counted: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Nodes of classes whose counted shingles leave room for a shared one in the prefix.

    ``counted`` (node, counted) gives every class once; classes has (node, n, m).
    """
    shared = shared_shingles(counted.select("node", F.explode("counted").alias("token"))).groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    rows = classes.select("node", places(percent).alias("p"), "m").join(shared.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return rows.where(F.col("m") - F.coalesce("shared", F.lit(0)) < F.col("p")).select("node")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, own, prefix): size, number of shingles of its own, and the shareable
    shingles of the prefix, rarest first; classes without any are left out."""
    shared = shared_shingles(sets.select("node", F.explode("tokens").alias("token")))
    shared = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    rows = sets.select("node", F.size("tokens").cast("long").alias("n")).join(shared, "node")
    rows = rows.withColumn("own", F.col("n") - F.size("shared")).withColumn("left", (places(percent) - F.col("own")).cast("int"))
    return rows.where("left > 0").select("node", "n", "own", F.transform(F.slice("shared", F.lit(1), F.col("left")), lambda x: x["token"]).alias("prefix"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of (a, b).

    Each round takes the neighbours' smallest label, then the label of the label; each
    is written, so nothing is recomputed and lineage stays short.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), f"{name}-labels")
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        seen = state.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        up = state.select(F.col("node").alias("_up"), F.col("comp").alias("up"))
        state = written(seen.join(up, F.col("mid") == F.col("_up")).select("node", "old", F.least("mid", "up").alias("comp")), f"{name}-labels")
        moved = state.where("old <> comp").limit(1).count()
        state = state.select("node", "comp")
        if not moved:
            return state


def _with_comp(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Adds ``comp`` to rows of (node, ...); a node without links is its own."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    known = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    return rows.join(known, F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("_c", "node")).drop("_n", "_c")


def _sized(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes a and b can be as similar as asked."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)).cast("boolean")


def _reaches(n_a: str, n_b: str, at_a: str, at_b: str, percent: int) -> Column:
    """Whether sets that meet first at these places of their orders can still overlap enough:
    both rests must hold ceil(t / (1 + t) (n_a + n_b)) shingles."""
    need = percent * (F.col(n_a) + F.col(n_b))
    return ((100 + percent) * F.least(F.col(n_a) - F.col(at_a), F.col(n_b) - F.col(at_b)) >= need)


def likely(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` whose node is in ``nodes``, and a few others, without a shuffle; exact joins follow."""
    return parted(rows, nodes, "node")[1]


def without(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` whose node is not in ``nodes``; only rows that the filter suspects are shuffled."""
    clear, suspect = parted(rows, nodes, "node")
    return clear.unionByName(suspect.join(nodes, "node", "left_anti").select(*clear.columns))


def wanted_sets(docs: DataFrame, nodes: DataFrame, k: int, unique: bool) -> DataFrame:
    """(node, tokens) of the documents in ``nodes``, made from their texts again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"].to_numpy(), "tokens": [shingle_set(t or "", k).view(np.int64) for t in batch["text"]]})

    rows = docs.select(_node(unique).alias("node"), "text").where(F.col("node").isNotNull())
    return likely(rows, nodes).mapInPandas(run, "node long, tokens array<long>").join(nodes, "node", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are as similar as asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    one = likely(sets, pairs.select(F.col("a").alias("node"))).select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = likely(sets, pairs.select(F.col("b").alias("node"))).select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and n_links of every row of ``docs``.

    class_id: the smallest id with the same set. component_id: the smallest id that
    links reach. n_links: verified links of the class (each joins two different sets; pairs
    within a component that others already join need not be among them).
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("doc_id").isNull() | (F.col("k") > 1))
    unique = ids.limit(1).count() == 0
    made = shingled(docs, k, percent, unique)
    sets = written(made.drop("counted"), "shingles")
    key = ["hi", "lo", "n"]
    classes = written(sets.where("n > 0").groupBy(*key).agg(F.min("node").alias("node"), F.min("doc_id").alias("class_id"), F.first("m").alias("m")), "classes")
    counted = made.where("n > 0").groupBy(*key).agg(F.min("node").alias("node"), F.first("counted").alias("counted"))
    wanted = written(linkable(counted, classes, percent), "linkable")
    full = written(wanted_sets(docs, wanted, k, unique), "sets")
    found = prefixes(full, percent)
    # groups: classes with one and the same prefix and size; with shingles of its own a class is a group
    group = F.xxhash64("n", "prefix", F.when(F.col("own") > 0, F.col("node")))
    found = written(found.withColumn("group", group), "prefixes")
    members = found.select("node", "group", "n")
    heads = found.groupBy("group").agg(F.min("node").alias("head"), F.min(F.struct("n", "own", "prefix")).alias("x")).select("group", "head", "x.n", "x.own", "x.prefix")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    rows = heads.select("group", "head", "n", "own", band.alias("band"), F.posexplode("prefix").alias("at", "token")).withColumn("at", F.col("at") + F.col("own"))
    busy = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    sides = F.array(F.struct(F.col("band").alias("band"), F.lit(True).alias("same")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("same")))
    rows = rows.join(busy, "token").withColumn("b", F.explode(sides))
    rows = written(rows.select("group", "head", "n", "own", "at", "token", "b.band", "b.same"), "buckets")

    links: DataFrame | None = None
    comps: DataFrame | None = None

    def checked(pairs: DataFrame) -> None:
        nonlocal links, comps
        fresh = written(verified(written(pairs.distinct(), "pairs"), full, percent), "links")
        links = fresh if links is None else links.unionByName(fresh)
        comps = components(links, "near")

    def state() -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members with their components, bucket rows with their group's range of them, and
        the groups, in a bucket or not, whose members are in several."""
        now = written(_with_comp(members, comps), "members")
        span = now.groupBy("group").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
        return now, rows.join(span, "group"), span.where("least <> most").select("group")

    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    for seed in (0, 1):
        now, spread, mixed = state()
        order = F.struct((F.col("own") if seed == 0 else F.lit(0)).alias("o"), F.xxhash64("head", F.lit(seed)).alias("h"), "head", "n")
        stats = spread.groupBy("token", "band").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.min(F.when(F.col("same"), order)).alias("p")).where("lo <> hi").where(F.col("p").isNotNull())
        met = rows.join(stats.select("token", "band", "p"), ["token", "band"]).where(_sized("n", "p.n", percent))
        # each group tries the member that comes first among those it meets; its members are expanded
        tried = met.groupBy("group").agg(F.min("p").alias("p")).select("group", F.col("p.head").alias("other"))
        pairs = now.join(tried, "group").join(now.select(F.col("node").alias("other"), F.col("comp").alias("_oc")), "other").where(F.col("comp") != F.col("_oc"))
        several = now.join(mixed, "group", "left_semi")
        first = several.groupBy("group").agg(F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "comp")).alias("p"))
        within = several.join(first.select("group", F.col("p.node").alias("other"), F.col("p.comp").alias("_oc")), "group").where(F.col("comp") != F.col("_oc"))
        checked(pairs.select(*pair).unionByName(within.select(*pair)))
    now, spread, mixed = state()
    active = spread.groupBy("token", "band").agg(F.min("least").alias("lo"), F.max("most").alias("hi")).where("lo <> hi").select("token", "band")
    spread = spread.join(active, ["token", "band"])
    left = spread.where("same").select("token", "band", F.col("group").alias("g"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("least").alias("la"), F.col("most").alias("ma"))
    right = spread.select("token", "band", F.col("group").alias("h"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("least").alias("lb"), F.col("most").alias("mb"), "same")
    apart = (F.least("la", "lb") != F.greatest("ma", "mb")) & (~F.col("same") | (F.col("g") < F.col("h")))
    groups = left.join(right, ["token", "band"]).where(apart & _sized("na", "nb", percent) & _reaches("na", "nb", "pa", "pb", percent)).select("g", "h").distinct()
    groups = groups.unionByName(mixed.select(F.col("group").alias("g"), F.col("group").alias("h")))
    one = now.select(F.col("group").alias("g"), "node", F.col("comp").alias("_ac"))
    two = now.select(F.col("group").alias("h"), F.col("node").alias("other"), F.col("comp").alias("_bc"))
    pairs = groups.join(one, "g").join(two, "h").where((F.col("_ac") != F.col("_bc")) & ((F.col("g") != F.col("h")) | (F.col("node") < F.col("other"))))
    checked(pairs.select(*pair))

    links = links.distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    placed = _with_comp(classes.select("hi", "lo", "node", "class_id"), comps).join(degree.withColumnRenamed("node", "_d"), F.col("node") == F.col("_d"), "left")
    least = placed.groupBy("comp").agg(F.min("class_id").alias("component_id")).withColumnRenamed("comp", "_comp")
    placed = placed.join(least, F.col("comp") == F.col("_comp")).select(
        F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "class_id", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
    out = sets.select("doc_id", "n", "hi", "lo").join(placed, (F.col("n") > 0) & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
