"""The verdict of the quality rules against a brute-force version, and what moves it."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import quality

DOCS = "doc_id long, text string, lang string, source string, cutoffs string, measure string, n_words string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)


def text(rng, n=80, length=(3, 8), symbol=0.0, again=0.0, lines=12):
    """``lines`` lines of words; a share of words holds a symbol, a share of lines is an earlier one."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(*length))) + ("#" if rng.random() < symbol else "")
    out = []
    for _ in range(lines):
        out.append(rng.choice(out) if out and rng.random() < again else " ".join(word() for _ in range(n // lines)))
    return "\n".join(out)


def corpus(seed):
    rng, rows = random.Random(seed), []
    for i in range(900):
        lang, source = ("aa", "s1") if i % 3 == 0 else ("aa", "s2") if i % 3 == 1 else ("bb", "s1")
        long = (6, 14) if lang == "bb" else (3, 8)
        # s2 has symbols and repeated lines as a rule, the others seldom
        rows.append((i, text(rng, 84, long, 0.1 if source == "s2" else 0.002, 0.2 if source == "s2" else 0.005), lang, source))
    return rng, rows


def quantile(pairs, q):
    """Of (value, weight), the value up to which a share q of the weight lies."""
    pairs, below = sorted(pairs), 0.0
    need = q * sum(w for _, w in pairs)
    for v, w in pairs:
        below += w
        if below >= need - 1e-9:
            return v
    return pairs[-1][0]


def brute(rows):
    """(lang, source), measure -> (low, high), from the values themselves, with the rule as the README states it."""
    groups = defaultdict(list)
    for _, t, lang, source in rows:
        n_words, word_chars, n_symbols, n_lines, n_dup, n_rep = quality.measure(t or "")
        if n_words >= 50 and 100 * n_rep <= 50 * n_words:
            for key in ((lang, source), (lang,), ()):
                groups[key].append({"word_length": (word_chars, n_words), "symbols": (n_symbols, word_chars), "repeated_lines": (n_dup, n_lines), "repeated_words": (n_rep, n_words)})

    def own(key, m, event):
        if not event:
            values = [(c[m][0] / c[m][1], 1) for c in groups[key]]
            low, mid, high = (quantile(values, q) for q in (0.25, 0.5, 0.75))
            return mid - 21 * (mid - low), mid + 21 * (high - mid)
        step, total = event / quantile([(c[m][1], 1) for c in groups[key]], 0.5), len(groups[key])
        merged = Counter(c[m][0] / c[m][1] for c in groups[key])
        places, stretches = sorted(merged), []
        for i, x in enumerate(places):
            between, above = 0, sum(merged[v] for v in places[i + 1 :])
            for y in places[i + 1 :]:
                if above <= 0.2 * total and between <= 0.001 * total:
                    stretches.append(((y + step) / (x + step), ((y + step) * (x + step)) ** 0.5 - step))
                between += merged[y]
        if stretches and max(stretches)[0] >= 3.4:
            return None, max(stretches)[1]
        some = [(v, n) for v, n in merged.items() if v > 0]
        mid, high = (quantile(some, q) for q in (0.5, 0.99)) if some else (0, float("inf"))
        return None, mid + 3 * (high - mid) if high > mid else 3 * high

    def drawn(key, m, event):
        low, high = own(key, m, event)
        if not key:
            return low, high
        above, n = drawn(key[:-1], m, event), len(groups[key])
        high = above[1] if high == float("inf") else math.exp((math.log(high) * n + math.log(above[1]) * 100) / (n + 100))
        return None if low is None else (low * n + above[0] * 100) / (n + 100), high

    events = {"word_length": None, "symbols": 1, "repeated_lines": 1, "repeated_words": 6}
    return {(key, m): drawn(key, m, event) for key in groups if len(key) == 2 for m, event in events.items()}


def test_cutoffs_and_verdict_against_exact_quantiles(spark):
    rng, rows = corpus(7)
    rows += [(2000 + i, text(rng, 84, (3, 8), 0.02 * i, 0.02 * i), "aa", "s1") for i in range(40)] + [(3000, None, None, None), (3001, "", "cc", "s9"), (3002, text(rng), None, "s1")]
    want = brute(rows)
    stats = quality.measured(docs(spark, rows)).where((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")))
    found = {(r.lang, r.source): r.cutoffs for r in quality.cutoffs(stats).collect()}
    assert {(k, m) for k in found for m in quality.MEASURES} == set(want)
    for (key, m), (low, high) in want.items():
        mine = found[key][m]
        # values are known to within a bucket, and word lengths' distances are multiplied by the fence
        slack = 2 * (1 + quality.FENCE) * quality.ACCURACY if m == "word_length" else 4 * quality.ACCURACY
        assert mine["high"] == pytest.approx(high, rel=slack, abs=0.002), (key, m)
        assert (mine["low"] is None) == (low is None) and (low is None or abs(mine["low"] - low) < slack * high)
    for r in quality.judge(docs(spark, rows)).where("not base_failed").collect():
        ratio = lambda m: quality.measure(next(t for i, t, *_ in rows if i == r.doc_id) or "")  # noqa: E731, B023
        n_words, word_chars, n_symbols, n_lines, n_dup, n_rep = ratio("")
        values = {"word_length": word_chars / n_words, "symbols": n_symbols / word_chars, "repeated_lines": n_dup / n_lines, "repeated_words": n_rep / n_words}
        cut = found[r.lang, r.source]
        outside = {m for m, v in values.items() if v > cut[m]["high"] * (1 + quality.ACCURACY) or (cut[m]["low"] is not None and v < cut[m]["low"] * (1 - quality.ACCURACY))}
        assert set(r.outside) == outside and r.kept == (not outside)


def test_each_measure_can_drop_and_the_group_decides(spark):
    rng, rows = corpus(8)
    long_words, symbols = text(rng, 84, (24, 40)), text(rng, 84, (3, 8), 0.25)
    repeated = text(rng, 84, (3, 8), 0.002, 0.0, 6) + "\n" + "\n".join(["b c"] * 30)
    planted = [long_words, symbols, repeated]
    rows += [(5000 + k, t, "aa", "s1") for k, t in enumerate(planted)] + [(6000, symbols, "aa", "s2"), (6001, text(rng, 84, (3, 4)), "bb", "s1")]
    by = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    assert len(by) == len(rows)
    for k, m in enumerate(("word_length", "symbols", "repeated_lines")):
        assert m in by[5000 + k].outside and not by[5000 + k].kept and not by[5000 + k].base_failed, m
    assert by[6000].kept  # what is unusual in one source is usual in another
    assert by[6001].outside == ["word_length"] and not by[6001].kept  # below, in a language of long words
    usual = [by[i].kept or by[i].base_failed for i in range(900)]
    assert sum(usual) >= 890
    phrase = text(rng, 18, (3, 8), 0, 0, 1)
    words = "\n".join([text(rng, 60), phrase + " " + phrase, text(rng, 30)])
    plain = [(i, text(rng), "aa", f"s{i % 2}") for i in range(300)]
    by = {r.doc_id: r for r in quality.judge(docs(spark, [*plain, (5003, words, "aa", "s1")])).collect()}
    assert by[5003].outside == ["repeated_words"] and all(by[i].kept for i in range(300))


def test_a_moved_group_moves_its_cutoff(spark):
    _, rows = corpus(9)
    cut = lambda rows: {(r.lang, r.source): r.cutoffs for r in quality.cutoffs(quality.measured(docs(spark, rows))).collect()}
    before = cut(rows)
    after = cut([(i, t.replace(" ", "xx ") if (lang, s) == ("aa", "s1") else t, lang, s) for i, t, lang, s in rows])
    assert after["aa", "s1"]["word_length"]["high"] > before["aa", "s1"]["word_length"]["high"] + 1
    moved = lambda group: abs(after[group]["word_length"]["high"] - before[group]["word_length"]["high"])
    assert moved(("bb", "s1")) < moved(("aa", "s1"))


def test_mostly_zero_symbols_get_the_cutoffs_of_their_sketches(spark):
    """Nine texts in ten hold no symbol; what else a source holds decides where its cutoff lies."""
    rng, rows = random.Random(10), []
    plain = lambda: text(rng, 240, (3, 8))
    marked = lambda n: plain() + " " + " ".join("x#" for _ in range(n))
    for i in range(600):
        rows.append((i, marked(60) if i % 20 == 0 else plain(), "aa", "s1"))
        rows.append((1000 + i, marked(rng.randrange(2, 12)) if i % 12 == 0 else marked(230) if i % 40 == 1 else plain(), "bb", "s2"))
    by = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    stats = quality.measured(docs(spark, rows))
    cut = {r.lang: r.cutoffs["symbols"]["high"] for r in quality.cutoffs(stats).collect()}
    assert 3 * cut["aa"] < cut["bb"]
    assert {i for i, r in by.items() if "symbols" in r.outside} == {i for i, t, *_ in rows if t.count("#") in (60, 230)}
    zeros = sum("#" not in t for _, t, *_ in rows) / len(rows)
    assert zeros > 0.9


def test_emptiest_stretch():
    values, weights = quality.np.array([0.0, 0.001, 0.002, 0.05, 0.06]), quality.np.array([900.0, 40, 20, 30, 10])
    assert 0.002 < quality.emptiest(values, weights, 0.001) < 0.05
    assert quality.emptiest(values[:1], weights[:1], 0.001) == float("inf")
    # a tail that is no tail is kept
    assert quality.emptiest(values, quality.np.array([600.0, 40, 20, 330, 10]), 0.001) > 0.06
