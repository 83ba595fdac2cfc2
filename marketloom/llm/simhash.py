"""Exact near-duplicate classes of 64-bit similarity fingerprints by covering hashing.

A document's fingerprint holds the bits that are set in over half the hashes of its word shingles.
Documents with one and the same fingerprint are a class from the start; everything
after that works on distinct fingerprints, two numbers a row, in SQL functions alone.

Bits are given vectors of radius + 1 bits, and each non-zero vector v makes a mask: the
bits whose vectors have an odd number of ones in common with v. The vectors of at most ``radius``
differing bits do not span the whole space, so some v is orthogonal to all of them, and its
mask leaves all of them out: every pair within the radius agrees under one of the 2 ** (radius + 1) - 1
masks, whatever the bits (a covering code, not a matter of luck). Each mask is a table,
and fingerprints that agree under it share a bucket.

All pairs of a large bucket are never formed. Members are first compared with one that a hash
picks, then with another, and links are turned into components. Of a bucket that
still holds several components, the pairs of different components are formed if it has at most
``most`` members; a larger one is dealt anew under a further family of masks
(radius + 1 more bits, another order), whose buckets agree on about half of the
remaining bits too; the same argument holds within the bucket, so no pair is lost. It goes on until
no bucket is larger; one that agrees on all but b bits holds 2 ** b fingerprints at most.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked
like any other; a text with fewer words than a shingle has its whole sequence as one. Shingles that
repeat count as often as they stand. Rows that repeat an id, and rows with a null id, get a row each;
``component_id`` is the smallest id that links reach, null if none of these rows has one.
Columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, let_go, written
from .jaccard import components

BITS = 64
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str, k: int) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - k + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    of = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, COUNTED):
        h = np.array([of(joined[a:b], 42) for a, b in zip(starts[at : at + COUNTED], stops[at : at + COUNTED], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id and ``fp`` of every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": [fingerprint(t or "", k) for t in batch["text"]]})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def masks(radius: int, family: int = 0) -> list[int]:
    """The masks of a family as signed 64-bit numbers; family 0 gives bits their vectors in turn,
    others in an order of their own."""
    space = 1 << (radius + 1)
    order = np.arange(BITS) if family == 0 else np.random.default_rng(family).permutation(BITS)
    vectors = (order % (space - 1) + 1).tolist()
    bits = ([v.bit_count() & 1 for v in (x & m for m in vectors)] for x in range(1, space))
    return [int(np.packbits(np.array(b, np.uint8), bitorder="little").view("<i8")[0]) for b in bits]


def _tables(rows: DataFrame, radius: int, family: int) -> DataFrame:
    """Rows (fp, path, mask) under every mask of a family as well: (fp, path, mask, key)."""
    tables = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks(radius, family))))
    path = (F.col("path") * F.size(tables) + F.col("t.i")).alias("path")
    dealt = rows.withColumn("t", F.explode(tables)).select("fp", path, F.col("mask").bitwiseOR(F.col("t.m")).alias("mask"))
    return dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def apart(a: str | Column, b: str | Column) -> Column:
    """The number of bits in which two fingerprints differ."""
    side = lambda c: F.col(c) if isinstance(c, str) else c
    return F.bit_count(side(a).bitwiseXOR(side(b)))


class _State:
    """Fingerprints' components so far; those without links are not held."""

    def __init__(self) -> None:
        self.comps: DataFrame | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` (fp, ...) with ``comp``."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("fp"))
        known = self.comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        return rows.join(known, F.col("fp") == F.col("_n"), "left").withColumn("comp", F.coalesce("_c", "fp")).drop("_n", "_c")

    def link(self, pairs: DataFrame) -> None:
        """Takes links (a, b, of fingerprints; ca, cb, their components so far).

        Only components are linked anew, so that later rounds work on what is still apart.
        """
        links = written(pairs.select("a", "b", "ca", "cb").distinct(), "simhash-links")
        if not links.limit(1).count():
            return
        merged = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "simhash").select(F.col("node").alias("_from"), F.col("comp").alias("_to"))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("comp")), F.struct(F.col("b").alias("node"), F.col("cb").alias("comp")))).alias("e"))
        known = ends.select("e.*")
        if self.comps is not None:
            known = known.unionByName(self.comps)
        known = known.distinct().join(merged, F.col("comp") == F.col("_from"), "left")
        self.comps = written(known.select("node", F.coalesce("_to", "comp").alias("comp")), "simhash-components")


def near_duplicates(docs: DataFrame, radius: int = 4, k: int = 4, most: int = 64, rounds: int = 2) -> DataFrame:
    """doc_id, fp long, component_id and ``copies`` (rows with this fingerprint) of every row of ``docs``,
    linked where fingerprints differ in ``radius`` bits or fewer."""
    prints = written(fingerprints(docs, k), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "fingerprint-classes")
    state, family = _State(), 0
    rows = classes.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"))
    bucket = ["path", "key"]
    while rows is not None:
        dealt = _tables(rows, radius, family)
        shared = dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*bucket)
        # merged: Spark takes rows after an explode for as few as before it, and would broadcast them all
        dealt = written(dealt.join(shared.hint("merge"), bucket), "buckets")
        if not dealt.limit(1).count():
            break
        for seed in range(rounds):
            now = state.of(dealt)
            picked = now.groupBy(*bucket).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("fp", F.lit(seed)).alias("h"), "fp", "comp")).alias("p"))
            picked = picked.where("lo <> hi").select(*bucket, F.col("p.fp").alias("b"), F.col("p.comp").alias("cb"))
            met = now.join(picked, bucket).where((F.col("comp") != F.col("cb")) & (apart("fp", "b") <= radius))
            state.link(met.select(F.col("fp").alias("a"), "b", F.col("comp").alias("ca"), "cb"))
        now = written(state.of(dealt), "buckets-components")
        left = now.groupBy(*bucket).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
        left = written(left.select(*bucket, "n"), "buckets-left")
        small = now.join(left.where(F.col("n") <= most).select(*bucket), bucket)
        one = small.select(*bucket, F.col("fp").alias("a"), F.col("comp").alias("ca"))
        two = small.select(*bucket, F.col("fp").alias("b"), F.col("comp").alias("cb"))
        met = one.join(two, bucket).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (apart("a", "b") <= radius))
        state.link(met)
        large = left.where(F.col("n") > most).select(*bucket)
        family += 1
        rows = now.join(large, bucket).select("fp", "path", "mask") if large.limit(1).count() else None

    placed = state.of(classes)
    least = placed.groupBy("comp").agg(F.min("class_id").alias("component_id")).withColumnRenamed("comp", "_comp")
    found = placed.join(least, F.col("comp") == F.col("_comp")).select(F.col("fp").alias("_fp"), "component_id", "copies")
    return prints.join(found, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id", "copies")
