"""The audit of sources against a plain version in Python's whole numbers, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from marketloom.llm import divergence, queries

DOCS = "doc_id long, text string, lang string, source string, term string, part string, n string, side string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(3)


def plain(rows, min_docs, top):
    count, found, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for w in words:
            count[lang, source, w] += 1
        for w in set(words):
            found[lang, w] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = [w for (x, w), n in found.items() if x == lang and n >= min_docs]
        mine = [s for x, s in groups if x == lang]
        use = {s: {w: count[lang, s, w] for w in kept} for s in mine}
        use[None] = {w: sum(use[s][w] for s in mine) for w in kept}
        p = {s: {w: 1 + 10**9 * (u[w] + 5) // (sum(u.values()) + 5 * len(kept)) for w in kept} for s, u in use.items()}
        for s in mine:
            pair = sorted((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode()) for t in mine if t != s)
            term = sorted((p[None][w] - p[s][w], w.encode()) for w in kept if use[s][w] and p[s][w] > p[None][w])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, found_ in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(found_, 1)]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [rng.choice(["a", "é", "Zz", "ß", "\U0001f600", "Ab", "￿"]) + rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(150)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "é", "z", None])
        text = rng.choice([" ", "-", "1"]).join(rng.choice(words[: 60 if source == "s2" else 150]) for _ in range(rng.randrange(40)))
        rows.append((i, text, lang, source))
    rows += [(1, rows[1][1], "en", "s1"), (None, None, "xx", "only"), (None, "", "yy", "one"), (5, "rare words here", "yy", "two"), (6, "ab " * 50_000, "en", "z")]
    return rows


def test_against_plain_version(spark):
    rows = corpus(1)
    want = plain(rows, 5, 7)
    for block, sources in ((1024, 256), (16, 2)):
        got = sorted(tuple(r) for r in divergence.audit(docs(spark, rows), min_docs=5, top=7, block=block, sources=sources).collect())
        assert got == want
    assert ("yy", "one", "pair", "two", 0, 1) in want


def test_tasks_that_hand_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    monkeypatch.setattr(divergence, "HELD_ROWS", 20)
    rows = corpus(2, 150)
    got = sorted(tuple(r) for r in divergence.audit(docs(spark, rows), min_docs=3, top=50).collect())
    assert got == plain(rows, 3, 50)


def test_skyband_against_all_pairs():
    rng = np.random.default_rng(3)
    for k, high in ((1, 4), (5, 12), (50, 300)):
        n, common = rng.integers(1, high, 900), rng.integers(1, high, 900)
        term = np.array([str(x).encode() for x in rng.permutation(900)], dtype=object)
        beaten = [sum(n[j] >= n[i] and common[j] <= common[i] and term[j] < term[i] for j in range(900)) for i in range(900)]
        for step in (7, 512):
            assert sorted(divergence.skyband(n, common, term, k, step)) == [i for i in range(900) if beaten[i] < k]


def test_shares_of_large_counts(spark):
    n, total, kept = 9 * 10**15, 8 * 10**17, 12345
    row = spark.range(1).select(*(divergence.F.lit(x).cast("long").alias(c) for c, x in (("n", n), ("t", total), ("v", kept))))
    assert row.select(divergence.share(row.n, row.t, row.v).alias("p")).first().p == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_the_query_and_its_sql(spark, tmp_path):
    rows = [(i, t, lang, s) for i, t, lang, s in corpus(4, 900)]
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in queries.op11_divergence(spark, str(tmp_path)).collect())
    assert got == plain(rows, 30, 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP11_SQL})").fetchall()) == got


def test_empty_table(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
