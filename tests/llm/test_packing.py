import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, offset string, length string"


def unfold(runs):
    """Every piece's (length, sequence, offset)."""
    return [(n, first + i // each, at + (i % each) * n) for n, _, count, first, each, at in runs.tolist() for i in range(count)]


def check_sequences(placed, capacity):
    by = defaultdict(list)
    for length, sequence, offset in placed:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_all_and_is_near_the_least(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 97, 1000])
    top = rng.choice([capacity, capacity // 2, capacity // 3 + 1])
    counts = {n: rng.choice([1, 1, 2, 5, 1000]) for n in rng.sample(range(1, top + 1), min(top, 30))}
    runs = packing.plan(counts, capacity)
    placed = unfold(runs)
    got = defaultdict(int)
    for n, _, _ in placed:
        got[n] += 1
    assert got == counts
    for n in counts:  # a length's runs cover its ranks without a gap
        own = sorted((r[1], r[2]) for r in runs.tolist() if r[0] == n)
        assert [a for a, _ in own] == [0, *np.cumsum([c for _, c in own])[:-1].tolist()]
    bins = check_sequences(placed, capacity)
    least = max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
    assert bins <= 1.23 * least + 1


def test_large_items_pair_at_most_twice():
    runs = packing.plan({60: 3, 45: 2, 40: 4, 5: 10}, 100)
    by = defaultdict(list)
    for n, sequence, _ in unfold(runs):
        by[sequence].append(n)
    assert all(sum(3 * n > 100 for n in parts) <= 2 for parts in by.values())


def test_every_document_as_the_tokenizer_gives_it(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = [None, "", " \n\t", "Hello, World's  end! x", "ÀÉ é Σίσυφος ΟΔΟΣ \x1c y", "a<|endoftext|> b", "word " * 300, "ab1 2 cd\x0b..", "Hello, World's  end! x"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "null id", None, None), (3, texts[3], "x", "y")]
    capacity = 64
    got = packing.best_fit_packing(spark.createDataFrame(rows, DOCS), PATH, capacity).collect()
    want = defaultdict(int)
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    assert check_sequences([(r.length, r.sequence_id, r.offset) for r in got], capacity) <= 7


def test_empty_table(spark):
    out = packing.best_fit_packing(spark.createDataFrame([], DOCS), PATH)
    assert out.count() == 0 and out.columns == [f.name for f in packing.PLACED.fields]


def test_one_length_over_many_salts(spark):
    pieces = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(30).cast("long").alias("length"), F.col("id").alias("ids_crc32")
    )
    rows = packing.place(pieces, 100).collect()
    assert check_sequences([(r.length, r.sequence_id, r.offset) for r in rows], 100) == 1667


def test_lower_salts_hold_a_number_for_each_filled_cell():
    counts = [(4096, s, 3 + s % 2) for s in range(4000)] + [(5, 0, 7), (9, 1, 2), (9, 0, 4)]
    keys, lower = packing.lower_salts(counts)
    assert keys.nbytes + lower.nbytes == 16 * len(counts)
    at = lambda n, s: int(lower[keys.searchsorted((n << 24) + s)])
    assert (at(5, 0), at(9, 0), at(9, 1), at(4096, 0), at(4096, 2)) == (0, 0, 4, 0, 7)
