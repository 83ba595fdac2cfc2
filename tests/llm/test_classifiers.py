import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import langid, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, label string, toxic string, n_words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "a", "b", "c", "d") for i, t, lang, source in rows], DOCS)


def brute_repeats(words):
    covered = set()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered.update((i, i + 1, i + 2))
    return len(covered)


def test_counts_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice([b"a", b"b", b"cc", b"d"]) for _ in range(rng.randrange(0, 30))]
        assert quality.repeated_words(words) == brute_repeats(words)
    assert quality.measure("a b c\n\n#x\n#x\n \n\x1c") == (5, 9, 2, 4, 1, 0)


def test_quality_keeps_the_usual_and_drops_outliers(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(80)), "en", "s" if i % 3 else "t") for i in range(600)]
    rows += [(1000, " ".join(word() + "#$%" for _ in range(80)), "en", "s"), (1001, None, None, None), (1002, "", "en", "s"), (1003, "same words here " * 40, "en", "s")]
    rows += [(1004, " ".join(word() * 12 for _ in range(80)), "en", "s"), (None, " ".join(word() for _ in range(80)), None, "s"), (1, rows[1][1], "en", "s"), (1005, "y" * 300_000, "en", "s")]
    got = quality.judge(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(600)) and by[None].kept
    assert not by[1000].kept and not by[1000].base_failed and not by[1004].kept
    assert by[1001].base_failed and by[1001].n_words == 0 and by[1003].base_failed and by[1005].base_failed
    assert quality.judge(docs(spark, [])).count() == 0


def test_sketches_merge(spark):
    stats = quality.measured(docs(spark, [(i, "word " * (i + 1), "en", f"s{i % 4}") for i in range(40)]))
    apart = quality.merge(quality.sketches(stats), ["lang"])
    whole = quality.sketches(stats.withColumn("source", F.lit("one"))).drop("source")
    key = lambda r: (r.lang, r.measure, r.bucket, r.n)
    assert sorted(map(key, apart.collect())) == sorted(map(key, whole.collect()))


def test_toxicity_learns_words_from_document_labels(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        sentences = [[rng.choice(common) for _ in range(8)] for _ in range(6)]
        if bad := i % 5 == 0:
            sentences[rng.randrange(6)][3] = rng.choice(["zut", "zounds"])
        rows.append((i, ". ".join(map(" ".join, sentences)) + ".", "en", "s"))
        labels.append((i, int(bad), "x"))
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (None, "zut alors zut", "en", "s"), (0, rows[0][1], "en", "s")]
    frame = docs(spark, rows)
    marks = spark.createDataFrame([*labels, (0, None, "x"), (None, 1, "x"), (1, 0, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(frame, marks.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))))
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.3) == (r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 150 and sum(held) / len(held) > 0.97
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001] == 0 and by[None] > 0.3
    found = toxicity.offending(frame, model).where("doc_id < 900").collect()
    assert all("zut" in r.text or "zounds" in r.text for r in found) and len(found) > 150
    empty = docs(spark, [])
    assert toxicity.score(empty, toxicity.train(empty, marks)).count() == 0


def test_gradients_by_finite_differences(monkeypatch):
    rng = np.random.default_rng(0)
    h = langid.HIDDEN
    model = langid.Model(["a", "b", "c"], rng.standard_normal((512, 3 * h)) * 0.5, rng.standard_normal((2, h, 3 * h)) * 0.5, rng.standard_normal((2, h, 3)), rng.standard_normal(3))
    x, lengths, y = rng.integers(0, 5, (4, 6)), np.array([6, 6, 3, 5]), np.array([0, 1, 2, 1])
    zeros = np.zeros
    monkeypatch.setattr(langid.np, "zeros", lambda shape, dtype=float: zeros(shape, float))
    empty = np.empty
    monkeypatch.setattr(langid.np, "empty", lambda shape, dtype=float: empty(shape, float))
    _, grads = langid.gradients(model, x, lengths, y)
    for weights, grad in zip((model.inputs, model.recurrent, model.output, model.bias), grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in weights.shape)
            if weights is model.inputs:
                at = (int(rng.integers(0, 5)) + 256 * int(rng.integers(0, 2)), at[1])
            old, e = weights[at], 1e-5
            weights[at] = old + e
            up = langid.gradients(model, x, lengths, y)[0]
            weights[at] = old - e
            down = langid.gradients(model, x, lengths, y)[0]
            weights[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 1e-4 + 1e-3 * abs(grad[at])


def test_language_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ba", "ka", "ti", "no"], "bb": ["scht", "ung", "ein", "ü"], "cc": ["eau", "è", "oi", "ment"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 60), lang, "s") for i in range(300) for lang in [rng.choice(sorted(syllables))]]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", None), (1002, "12 !? ²_", "bb", "s"), (None, text("bb", 50), None, "s"), (1003, text("cc", 20_000), None, "s"), (0, rows[0][1], None, "s")]
    frame = docs(spark, rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(frame.where(~held), steps=150, batch=96)
    got = langid.predict(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang, _ in rows[:300]}
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(judged) > 50 and np.mean(judged) > 0.97
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[None] == "bb" and by[1003] == "cc"
    nothing = langid.train(docs(spark, []))
    assert nothing is None and {r.lang_pred for r in langid.predict(frame, nothing).collect()} == {"und"}


def test_noisy_or_against_brute_force():
    rng = random.Random(6)
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, dtype=np.float32), -2.0)
    vocabulary = [f"w{i}" for i in range(30)] + ["#", "Long-word", "(Long-word)"]
    for w in vocabulary:
        for i in toxicity.word_features(w):
            model.weights[i] = rng.random() * 2
    scorer = toxicity.Scorer(model)
    for text in ["", " . ", "#", "w1 w1 w2. w3\n\nw4", *(". ".join(" ".join(rng.choices(vocabulary, k=5)) for _ in range(rng.randrange(1, 6))) for _ in range(50)), "w1 " * 50_000 + ". w2"]:
        clean, parts = 1.0, []
        for sentence in toxicity.SENTENCE.split(text):
            if words := set(sentence.split()):
                parts.append(1 / (1 + np.exp(-(sum(float(model.weights[i]) for w in words for i in toxicity.word_features(w)) - 2.0))))
                clean *= 1 - parts[-1]
        score, at, strongest = scorer.document(text)
        assert abs(score - (1 - clean)) < 1e-5
        assert (at, strongest) == (None, None) if not parts else abs(strongest - max(parts)) < 1e-5 and abs(parts[at] - max(parts)) < 1e-5


def test_forward_pass_against_a_plain_network():
    rng, h = np.random.default_rng(2), langid.HIDDEN
    model = langid.Model(["a", "b"], rng.standard_normal((512, 3 * h)), rng.standard_normal((2, h, 3 * h)), rng.standard_normal((2, h, 2)), rng.standard_normal(2))
    x = rng.integers(0, 256, (3, 9))
    sigmoid = lambda v: 1 / (1 + np.exp(-2 * v))  # noqa: E731  the gates' weights are halved
    want = np.zeros((9, 2, 3, h))
    for b in range(3):
        for direction in (0, 1):
            state = np.zeros(h)
            for t in range(9) if direction == 0 else reversed(range(9)):
                into, back = model.inputs[256 * direction + x[b, t]], state @ model.recurrent[direction]
                z, r = sigmoid(into[:h] + back[:h]), sigmoid(into[h : 2 * h] + back[h : 2 * h])
                state = (1 - z) * np.tanh(into[2 * h :] + r * back[2 * h :]) + z * state
                want[t, direction, b] = state
    assert np.abs(langid.forward(model, x) - want).max() < 1e-4


def test_one_text_an_id_is_learned_from(spark):
    from marketloom.llm.common import one_text_an_id

    rows = spark.createDataFrame([(1, t) for t in ["b", "a", None] * 50] + [(2, "c" * 20), (3, "d"), (None, "e")], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "doc_id long, toxic int")
    assert [tuple(r) for r in one_text_an_id(rows, ids, 10).collect()] == [(1, 0, "a")]
    assert {tuple(r) for r in one_text_an_id(rows, ids, 20).collect()} == {(1, 0, "a"), (2, 1, "c" * 20)}
