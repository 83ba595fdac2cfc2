"""Covering hashing of similarity fingerprints against brute force."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import queries, simhash

DOCS = "doc_id long, text string, fp string, key string, comp string, path string, mask string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], DOCS).repartition(3)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_print(text, k=4):
    words, word = [], ""
    for c in lowered(text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] if word else words, ""
        else:
            word += c
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def classes(ids_prints, radius=4):
    """The smallest id reachable, for every row, in order."""
    comp = list(range(len(ids_prints)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(ids_prints)), 2):
        if (ids_prints[i][1] ^ ids_prints[j][1]).bit_count() <= radius:
            comp[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(ids_prints):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return [least.get(top(i)) for i in range(len(ids_prints))]


def test_masks_leave_out_every_set_of_radius_bits():
    rng = random.Random(3)
    for family in (0, 1, 2):
        for radius in (1, 2, 4):
            found = [m & (2**64 - 1) for m in simhash.masks(radius, family)]
            assert len(found) == 2 ** (radius + 1) - 1 and all(24 <= m.bit_count() <= 44 for m in found)
            sets = [rng.sample(range(64), radius) for _ in range(3000)] + [[0, 31, 62, 1][:radius]]
            assert all(any(not any(m >> i & 1 for i in s) for m in found) for s in sets)


def test_fingerprints(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["The", "Étude", "ab", "ß", "x1"]) for _ in range(n))
    texts = [None, "", " \n\t ", "One", "two Words", "a b c", "a b c d", words(5), words(60).replace(" ", "\x0b\n"), words(300), words(70_000), "a b c d e f"]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs(spark, list(enumerate(texts)))).collect()}
    assert got[0] == got[1] == got[2] == 0
    for i, t in enumerate(texts):
        if i != 10:
            assert got[i] & (2**64 - 1) == plain_print(t), i
    assert simhash.fingerprint(texts[10], 4) == got[10] != 0


def test_the_jvm_gives_the_same_hash(spark):
    row = spark.createDataFrame([("to be or not",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row.h == simhash.fingerprint("To be OR not", 4)


@pytest.mark.parametrize("most", [64, 4])
def test_components_against_brute_force(spark, monkeypatch, most):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, 1, 3, 31, 0b11111]
    for _ in range(500):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 5, 5, 6])):
            x ^= 1 << b
        prints.append(x)
    # a crowded bucket: many that agree on half the bits and are far from each other
    free = [b for b in range(64) if not simhash.masks(4)[0] >> b & 1]
    prints += [sum(1 << b for b in free if rng.random() < 0.5) for _ in range(200)]
    rows = [(None if i % 97 == 5 else i // 2 if i % 50 == 1 else i, p) for i, p in enumerate(prints)]
    signed = lambda p: p - 2**64 if p >> 63 else p
    monkeypatch.setattr(simhash, "fingerprints", lambda d, k: d.select("doc_id", F.col("fp").cast("long").alias("fp")))
    frame = spark.createDataFrame([(i, "", str(signed(p)), "", "", "", "") for i, p in rows], DOCS)
    got = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.near_duplicates(frame, most=most).collect())
    want = classes(rows)
    assert got == sorted((str(i), signed(p), str(c)) for (i, p), c in zip(rows, want, strict=True))
    assert len(set(want)) > 100


def test_the_query_over_a_table(spark, tmp_path):
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefghij") * 2 + rng.choice("xyz") for _ in range(rng.choice([1, 2, 5, 80, 200]))) for _ in range(60)]
    rows = []
    for i in range(160):
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = "new"
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, " "), (7, rows[7][1]), (902, rows[3][1].upper())]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op13_simhash(spark, str(tmp_path)).collect())
    prints = [(i, plain_print(t)) for i, t in rows]
    assert got == sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, classes(prints), strict=True))
    assert len({c for *_, c in got}) < len(rows) - 60


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_buckets_are_merged_and_not_broadcast(spark, monkeypatch):
    plans, plain = [], simhash.written

    def told(df, name):
        if name == "buckets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(simhash, "written", told)
    simhash.near_duplicates(docs(spark, [(i, f"some words that stand in text {i % 7}") for i in range(20)])).count()
    # 31 rows of each fingerprint; Spark takes them for one
    assert plans and all(re.search(r"\w+Join", p).group() == "SortMergeJoin" for p in plans)
