import random

import pytest

from marketloom.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string"
TEXTS = ["", " ", "   ", "Hello  world", "new\nline \n\n x ", "é😀 ▁ ▁▁x", "\x00a\x00", "<0x0A></s>", "ab" * 5000, "a\tb c  ", "Das ist ein längerer Satz, der über alles geht."]


def random_text(rng):
    return "".join(rng.choice(["the ", "tion", "ing", " ", "a", "e", "\n", "ü", "国", "th", ","]) for _ in range(rng.randrange(0, 60)))


def test_without_dropout_as_the_library(spark):
    import sentencepiece

    library, coder, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceCoder(PATH, 0.0), random.Random(5)
    for text in [t for t in TEXTS if "▁" not in t and "\0" not in t] + [random_text(rng) for _ in range(300)]:
        assert list(coder.encode(text)) == library.encode(text), text


def test_both_agendas_agree(monkeypatch):
    coder, rng = pieces.PieceCoder(PATH, 0.25, 4, 2), random.Random(8)
    units = [u for _ in range(200) for u in pieces.UNIT.findall(random_text(rng))] + ["internationalisation", "  ▁ab", " aaaaaaaaaa"]
    short = [coder.unit(u, v) for u in units for v in (0, 1)]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert short == [coder.unit(u, v) for u in units for v in (0, 1)]


def test_arrays_as_single_units(monkeypatch):
    coder, rng = pieces.PieceCoder(PATH, 0.25, 4), random.Random(18)
    units = [u for _ in range(400) for u in pieces.UNIT.findall(" " + random_text(rng))] + ["internationalisation", "  ▁ab", " aaaaaaaaaa", " " + "ab" * 40, "国", "\n", " "]
    masks = [rng.getrandbits(32) & rng.getrandbits(32) if rng.random() < 0.7 else 0 for _ in units]
    want = [coder._segmented(u, m) for u, m in zip(units, masks, strict=True)]
    assert coder._segment_all(units, masks) == want and coder._segment_all([], []) == []
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    assert coder._segment_all(units, masks) == want
    # texts worked on together, in slices of any size, give what each gives alone
    texts = [random_text(rng) * 5 for _ in range(80)] + TEXTS
    together = list(pieces.PieceCoder(PATH, 0.25, 4).encode_all(texts * 2, range(2 * len(texts))))
    assert together == [coder.encode(t, v) for v, t in enumerate(texts * 2)]


def test_dropout_varies_by_seed_and_decodes_losslessly():
    rng = random.Random(6)
    a, b, same = (pieces.PieceCoder(PATH, 0.3, seed, 3) for seed in (1, 2, 1))
    plain = pieces.PieceCoder(PATH, 0.0)
    texts = TEXTS + [random_text(rng) for _ in range(200)]
    for text in texts:
        for coder in (a, b):
            for variant in range(3):
                assert coder.decode(coder.encode(text, variant)) == text
        assert a.encode(text, 1) == same.encode(text, 1)
    total = lambda coder: sum(len(coder.encode(t)) for t in texts)
    assert any(a.encode(t) != b.encode(t) for t in texts) and any(a.encode(t, 0) != a.encode(t, 1) for t in texts)
    assert total(a) > total(plain)
    every = pieces.PieceCoder(PATH, 1.0)
    assert len(every.encode("abc def")) == 8


def test_jobs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", None), (50, None, None), (3, TEXTS[3], "x")]
    frame = spark.createDataFrame(rows, DOCS)
    back = pieces.decode(pieces.encode(frame, PATH, 0.2, 9), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    got = pieces.digests(frame, PATH, 0.2, 9).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[50] == 0
    assert pieces.encode(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_each_occurrence_has_its_own_dropout():
    coder, rng = pieces.PieceCoder(PATH, 0.1, 3), random.Random(9)
    cuts = lambda text, doc: tuple(coder.encode(text, coder.variant(doc)))
    assert len({cuts("internationalisation", doc) for doc in range(300)}) > 10
    once = pieces.PieceCoder(PATH, 0.0)
    pair = next(w for w in ("is", "in", "to") if len(once.encode("\n" + w)) == 3)
    n = 20_000
    whole = sum(len(coder.unit(pair, 5, at)) == 4 for at in range(n))
    assert abs(whole / n - 0.9) < 0.01
    units = pieces.UNIT.findall(" " + "internationalisation of the thing " * 400)
    assert len({coder.unit(u, 7, at) for at, u in enumerate(units) if "national" in u}) > 10
    # what is kept gives what a unit alone gives
    for text in [*TEXTS, "internationalisation of the thing " * 400, *[random_text(rng) for _ in range(100)]]:
        units = pieces.UNIT.findall(" " + text) if text else []
        assert coder.encode(text, 7).tobytes() == b"".join(coder.unit(u, 7, at) for at, u in enumerate(units))
