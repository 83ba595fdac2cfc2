"""Best-fit packing of token sequences into fixed-capacity training sequences.

Method: large-item matching. Pieces above a third of the capacity can share a
sequence at most two at a time, so they are matched greedily, largest first, each
with the largest partner that still fits; smaller pieces then go, largest first,
to the fullest sequence that still holds them (best fit).

Lengths are integers from 1 to the capacity, so the plan needs only how many
pieces there are of each length: at most ``capacity`` rows, whatever the input.
The driver plans on that histogram and gets *runs*: "pieces of length L with rank
a to b among their like go to sequences s, s+1, ... at offset o". Executors give
every piece its rank and look the run up. There are at most
``capacity * 3 * log2(capacity)`` runs (every run but the last of a length empties
a group of equal gaps, and a group's gap at least halves each time), so that they can be
broadcast.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BoundedCache, bounded_batches, held, written

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
PLACED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

#: Bytes of the words that a worker process keeps, unless told otherwise.
CACHE_BYTES = 80 << 20
#: Pieces of one length that share a salt: so many, or this share of all pieces if that is more.
SALTED, SALTS = 512, 4096


class WordCache:
    """Token ids of words, as little-endian 32-bit integers.

    The tokenizer's pre-tokenizer never joins text across white space, so a text's
    ids are the ids of its words one after another. Texts that hold a special
    token's string are encoded whole.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = BoundedCache(cache_bytes)
        self.sentinel = self.special[0] if self.special else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encodes words in one call, parted by a special token."""
        if self.sentinel is None:
            return {w: self._ids(w.decode()).tobytes() for w in words}
        ids = self._ids(self.sentinel.join(w.decode() for w in words))
        mark = self.tokenizer.token_to_id(self.sentinel)
        cuts = np.flatnonzero(ids == mark)
        starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        out = {w: ids[a:b].tobytes() for w, a, b in zip(words, starts, ends, strict=True)}
        for w, ids in out.items():
            self.known.offer(w, ids, len(ids))
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._ids(text).tobytes()
        words = text.encode().split()
        parts = list(map(self.known.get, words))
        if None in parts:
            new = self._learn(list({w for w, p in zip(words, parts, strict=True) if p is None}))
            parts = [new[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty and gives one piece that holds ``end_id`` alone.
    Only documents longer than ``capacity`` are cut; repeated rows give repeated
    pieces; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, end, step = held((WordCache, tokenizer_path, cache_bytes), lambda: WordCache(tokenizer_path, cache_bytes)), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = cache.encode(text or "") + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=[f.name for f in PIECES.fields])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs for a histogram of lengths, as rows of int64:
    length, first rank, count, first sequence, pieces in each sequence, offset.

    ``groups[gap]`` lists ranges of equal sequences (first, count) that have ``gap``
    tokens free. Taking the smallest gap that holds a piece is best fit; for pieces
    above a third it matches each with the largest item that leaves it room.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, count))

    def fill(length: int, rank: int, left: int, gap: int, first: int, count: int, each: int) -> int:
        """Puts up to ``left`` pieces into sequences with ``gap`` free; how many went."""
        full = min(count, left // each)
        if full:
            runs.append((length, rank, full * each, first, each, capacity - gap))
            put(gap - each * length, first, full)
        rest = left - full * each
        if rest and full < count:
            rest = min(rest, each)
            runs.append((length, rank + full * each, rest, first + full, rest, capacity - gap))
            put(gap - rest * length, first + full, 1)
            put(gap, first + full + 1, count - full - 1)
            return full * each + rest
        put(gap, first + full, count - full)
        return full * each

    lengths = sorted((n for n in counts if counts[n] > 0), reverse=True)
    large = [n for n in lengths if 3 * n > capacity]
    # Large items, greedily: the largest left takes the largest partner that fits.
    left = {n: counts[n] for n in large}
    used = dict.fromkeys(large, 0)
    ascending = sorted(large)
    for n in large:
        while left[n]:
            at = bisect_left(ascending, capacity - n + 1) - 1
            while at >= 0 and (left[ascending[at]] == 0 or ascending[at] > n):
                at -= 1
            m = ascending[at] if at >= 0 else 0
            pairs = 0 if not m else left[n] // 2 if m == n else min(left[n], left[m])
            if pairs and m == n:
                runs.append((n, used[n], 2 * pairs, opened, 2, 0))
                used[n], left[n] = used[n] + 2 * pairs, left[n] - 2 * pairs
            elif pairs:
                runs.append((n, used[n], pairs, opened, 1, 0))
                runs.append((m, used[m], pairs, opened, 1, n))
                used[n], left[n] = used[n] + pairs, left[n] - pairs
                used[m], left[m] = used[m] + pairs, left[m] - pairs
            if pairs:
                put(capacity - n - m, opened, pairs)
                opened += pairs
                continue
            # one left of its kind that only its own kind would fit: try smaller partners
            at = bisect_left(ascending, min(n, capacity - n + 1)) - 1
            while at >= 0 and left[ascending[at]] == 0:
                at -= 1
            if m == n and at >= 0:
                m = ascending[at]
                runs += [(n, used[n], 1, opened, 1, 0), (m, used[m], 1, opened, 1, n)]
                used[n], left[n], used[m], left[m] = used[n] + 1, left[n] - 1, used[m] + 1, left[m] - 1
                put(capacity - n - m, opened, 1)
                opened += 1
            else:
                runs.append((n, used[n], left[n], opened, 1, 0))
                put(capacity - n, opened, left[n])
                opened, used[n], left[n] = opened + left[n], used[n] + left[n], 0
    for n in (x for x in lengths if 3 * x <= capacity):
        rank, more = 0, counts[n]
        while more:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                need = -(-more // per)
                rank += fill(n, rank, more, capacity, opened, need, per)
                opened, more = opened + need, 0
                continue
            gap = gaps[at]
            first, count = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            done = fill(n, rank, more, gap, first, count, gap // n)
            rank, more = rank + done, more - done
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)


def lower_salts(counts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For counts (length, salt, pieces): the sorted keys (length << 24) + salt, and for each the number of
    pieces of its length in lower salts."""
    counts = sorted(counts)
    before: dict[int, int] = {}
    keys, lower = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
    for i, (length, salt, n) in enumerate(counts):
        keys[i], lower[i] = (length << 24) + salt, before.get(length, 0)
        before[length] = lower[i] + n
    return keys, lower


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Gives every piece (doc_id, piece, start, length, ids_crc32) a sequence_id and
    an offset. ``pieces`` is read three times and should be a written table.

    A piece's rank among its like is the number of like pieces in lower salts plus
    its place in its own salt. A length gets as many salts as keep each to SALTED pieces, or to
    one in SALTS of all pieces if that is more, so that a length shared by a third of all
    pieces is dealt to many partitions. Repeated rows get ranks of their
    own. An empty input gives an empty result.
    """
    spark = pieces.sparkSession
    # at most capacity rows
    totals = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    each = max(SALTED, sum(totals.values()) // SALTS)
    salts = {n: -(-k // each) for n, k in totals.items()}
    several = spark.createDataFrame([(n, k) for n, k in salts.items() if k > 1], "_length long, _salts int")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = pieces.join(F.broadcast(several), F.col("length") == F.col("_length"), "left").withColumn("_salt", salt).drop("_length", "_salts")
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    # at most capacity + SALTS rows
    base = lower_salts([(r["length"], r["_salt"], r["n"]) for r in counts.collect()])
    runs = plan(totals, capacity)
    shared = spark.sparkContext.broadcast((runs, base))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, (dealt, lower) = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length = batch["length"].to_numpy(np.int64)
            rank = batch["_rank"].to_numpy(np.int64) - 1 + lower[np.searchsorted(dealt, (length << 24) + batch["_salt"].to_numpy(np.int64))]
            r = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            within = rank - r[:, 1]
            batch["sequence_id"] = r[:, 3] + within // r[:, 4]
            batch["offset"] = r[:, 5] + (within % r[:, 4]) * length
            yield batch[[f.name for f in PLACED.fields]]

    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    return salted.withColumn("_rank", F.row_number().over(w)).mapInPandas(run, PLACED)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text) into sequences of at most
    ``capacity`` tokens; one row per piece with its place (see ``token_pieces`` and
    ``place``). Worker processes keep ``cache_bytes`` of words."""
    return place(written(token_pieces(docs, tokenizer_path, capacity, end_id, cache_bytes), "pieces"), capacity)
