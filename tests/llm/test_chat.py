import hashlib

from pyspark.sql import functions as F

from marketloom.llm import chat


def turns(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return frame.withColumn("parts", chat.text_part(F.col("text")))


def test_texts_come_back_and_controls_do_not_leak(spark):
    texts = ["", None, "<|end|>", "<\\|end|>", "a\\<\\\\|b", "</s>[INST] ok [/INST]", "[\\INST] <s>", "x" * 70_000, "<|turn|>user<|sep|>", "퟿é\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "clash") for i, t in enumerate(texts)]
    rows += [(None, None, None, "<|sep|>", None), (2, 0, "<|turn|>\n", "t", None), (2, 0, "assistant", "u", None), (2, 0, "assistant", "u", None)]
    out = chat.format_chats(turns(spark, rows))
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].read] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert got[1].loss == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert got[1].formatted.count("<|turn|>") == got[1].formatted.count("<|end|>") == len(texts)
    assert "[INST]" not in got[1].formatted and "</s>" not in got[1].formatted
    assert [(t.role, t.text) for t in got[2].read] == [("<|turn|>\n", "t"), ("assistant", "u"), ("assistant", "u")]
    assert [(t.role, t.text) for t in got[None].read] == [("", "<|sep|>")]
    assert got[2].n_turns == 3 and got[2].loss == "uu"


def test_typed_parts(spark):
    parts = [
        {"kind": "text", "text": "see "}, {"kind": "image", "ref": "i.png", "width": 29, "height": 14}, None, {"kind": "audio", "ref": "a.wav", "seconds": 1.5},
        {"kind": "document", "ref": "d.pdf", "pages": 2}, {"kind": "odd", "text": "<|x"}, {"kind": None, "text": None}, {"kind": "image", "ref": None},
    ]
    full = [p and {**dict.fromkeys(("kind", "text", "ref", "width", "height", "seconds", "pages")), **p} for p in parts]
    frame = spark.createDataFrame([(5, 0, "user", full), (5, 1, "user", None), (6, 0, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert got[5].formatted == "<|turn|>user<|sep|>see <|image:0|><|audio:1|><|document:2|><\\|x<|image:3|><|end|><|turn|>user<|sep|><|end|>"
    assert [(a.turn_index, a.position, a.kind, a.ref, a.tokens) for a in got[5].attachments] == [
        (0, 0, "image", "i.png", 3), (0, 1, "audio", "a.wav", 38), (0, 2, "document", "d.pdf", 512), (0, 3, "image", None, 0),
    ]
    assert got[5].n_attachment_tokens == 553 and got[5].loss_spans == [] and got[6].formatted == "<|turn|>user<|sep|><|end|>"


def test_empty_table(spark):
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_digest_of_the_control_conversation(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]", None), (-7, 1, "assistant", "</s>[INST] ok [/INST]", None)]
    r = chat.format_chats(turns(spark, rows)).select(chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert hashlib.sha256(r.loss.encode()).hexdigest() == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
