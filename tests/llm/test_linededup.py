import random
from collections import defaultdict

from marketloom.llm import linededup

DOCS = "doc_id long, text string, n_chars long, first string, hash string, keeper string, source string"


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, 0, "a", "b", "c", s) for i, t, s in rows], DOCS).repartition(3)
    return frame, linededup.dedup_lines(frame).collect()


def brute(rows, hashes):
    """Every run of two text lines that occurred before goes, with blank lines inside it; ``hashes`` gives a
    text's hash, which orders texts under one id."""
    texts = {}
    for i, t, *_ in rows:
        texts[i is not None, i or 0, hashes.get(t, 0)] = t
    some = {k: [n for n, x in enumerate((t or "").split("\n")) if any(not c.isspace() or c in "\x1c\x1d\x1e\x1f\x85\xa0" for c in x)] for k, t in texts.items()}
    met, out = set(), {}
    for k in sorted(texts):
        lines, gone = (texts[k] or "").split("\n"), set()
        for a, b in zip(some[k], some[k][1:], strict=False):
            if (lines[a], lines[b]) in met:
                gone.update(range(a, b + 1))
            met.add((lines[a], lines[b]))
        out[k[1] if k[0] else None, texts[k]] = (None if texts[k] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def hashes_of(spark, rows):
    frame = spark.createDataFrame([(t,) for t in {t for _, t, *_ in rows}], "text string").select("text", linededup.F.xxhash64("text").alias("h"))
    return {r.text: r.h for r in frame.collect()}


def test_against_brute_force_and_shift_resistance(spark):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice("abcdefghij") * 3 for _ in range(8))
    shared = [line() for _ in range(14)]
    rows = []
    for i in range(120):
        own = [line() for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (shared if i % 3 == 0 else []) + own[at:]), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "\n\n\n", "s"), (503, "\n \n\n", "s"), (None, rows[0][1], None), (3, rows[3][1], "s"), (504, "one\n" * 4000, "s"), (505, "x" * 200_000, None)]
    frame, got = run(spark, rows)
    want = brute(rows, hashes_of(spark, rows))
    have = sorted((str(r.doc_id), str(r.text), r.removed_lines) for r in got)
    assert have == sorted((str(i), str(want[i, t][0]), want[i, t][1]) for i, t, _ in rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    holding = [r for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 3 == 0]
    assert sum(r.removed_lines >= 14 for r in holding) == len(holding)  # found wherever they stand


def test_clean_documents_stay_and_order_of_columns(spark):
    frame, got = run(spark, [(1, "a b\nc d\ne f", "s"), (2, "a b\nx y\ne f", "t")])
    assert {r.text for r in got} == {"a b\nc d\ne f", "a b\nx y\ne f"}
    assert linededup.dedup_lines(frame).columns == [*frame.columns, "removed_lines"]
    assert run(spark, [])[1] == []


def test_short_passages_go_whole(spark):
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6)) for _ in range(8))
    rows, own = [], {}
    for k in range(80):
        passage = [line() for _ in range(2 + k % 6)]
        for i in (2 * k, 2 * k + 1):
            before, after = [line() for _ in range(rng.randrange(4))], [line() for _ in range(1, 4)]
            own[i] = "\n".join(before + (passage if i % 2 == 0 else []) + after)
            rows.append((i, "\n".join(before + passage + after), "s"))
    _, got = run(spark, rows)
    assert {r.doc_id: r.text for r in got} == own
    assert all(r.removed_lines == (2 + r.doc_id // 2 % 6 if r.doc_id % 2 else 0) for r in got)


def test_columns_that_clash_and_hashes_that_collide(spark, monkeypatch):
    names = ["_id", "_th", "th", "found", "_found", "gone", "_gone", "row", "node", "removed_lines", "place", "c.d"]
    rows = [(1, "a b\nc d\nx"), (2, "q\na b\nc d"), (3, "own\nline"), (None, "a b\nc d"), (3, "own\nline")]
    frame = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    want = {(1, "x", 2), (2, "q", 2), (3, "own\nline", 0), (None, "a b\nc d", 0)}
    got = linededup.dedup_lines(frame)
    assert sorted(got.columns) == sorted(frame.columns)
    for r in (found := got.collect()):
        assert [r[n] for n in names if n != "removed_lines"] == [k for k, n in enumerate(names) if n != "removed_lines"]
    assert len(found) == 5 and {(r.doc_id, r.text, r.removed_lines) for r in found} == want
    # with one hash for all, bytes alone tell chunks apart
    plain = frame.select("doc_id", "text")
    monkeypatch.setattr(linededup, "span_hash", lambda hashes: linededup.F.lit(7).cast("long"))
    assert {(r.doc_id, r.text, r.removed_lines) for r in linededup.dedup_lines(plain).collect()} == want


def test_single_lines_and_paragraph_breaks_stay(spark):
    rows = [(1, "alpha beta\n\nSame line\n\ngamma", "s"), (2, "other\n\nSame line\n\nthing", "s"), (3, "Same line\n \nSame line", "s")]
    _, got = run(spark, rows)
    assert {r.doc_id: r.text for r in got} == {i: t for i, t, _ in rows} and not any(r.removed_lines for r in got)
    # blank lines inside a repeated run go with it, those at its edges stay
    rows = [(1, "one two\n\nthree four\nfive", "s"), (2, "head\n\none two\n\n\nthree four\n\ntail", "s")]
    _, got = run(spark, rows)
    assert {r.doc_id: (r.text, r.removed_lines) for r in got} == {1: (rows[0][1], 0), 2: ("head\n\n\ntail", 4)}


def test_random_runs_against_brute_force(spark):
    rng = random.Random(21)
    lines = [f"line {k} " + "w" * (k % 5) for k in range(40)] + ["", "", " "]
    rows = [(rng.choice([i, i, i, None]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))), "s") for i in range(150)]
    rows += [(200 + i, "\n".join(f"long {j}" for j in range(i, i + 30)), "s") for i in range(6)]
    _, got = run(spark, rows)
    want = brute(rows, hashes_of(spark, rows))
    assert sorted((str(r.doc_id), r.text, r.removed_lines) for r in got) == sorted((str(i), *want[i, t]) for i, t, _ in rows)


def test_boundaries_come_from_the_lines_beside_them(spark):
    body = "\n".join(f"passage {k}" for k in range(60))
    frame = spark.createDataFrame([(1, body), (2, "x\n\ny\nz\n" + body + "\nend"), (3, body.replace("passage 30", "another"))], "doc_id long, text string")
    chunks = linededup.spans_of(frame).where("inner is not null").collect()
    by = {i: {r.hash for r in chunks if r.doc_id == i} for i in (1, 2, 3)}
    assert all(r.b - r.a >= 2 and len(r.inner) == r.b - r.a for r in chunks) and len(by[1]) >= 5
    assert len(by[1] - by[2]) <= 2 and len(by[1] - by[3]) <= 3  # a shift or an edit changes only the chunks it touches
    spans = linededup.repeated_spans(frame.where("doc_id < 3")).collect()
    assert len(spans) < 0.65 * 2 * 59  # chunks speak for most windows
