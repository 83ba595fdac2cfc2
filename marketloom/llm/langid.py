"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes. Two gated recurrent units, one
from either end, read each window; every byte position gets a probability for each
language from both states, and a document's probabilities are the mean over all its
positions. The network is trained in numpy by backpropagation through time on
position labels, from at most ``per_lang`` documents a language (those with the smallest
keyed hash of their id) and at most ``windows`` windows of each.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
everything where nothing could be learned. Repeated rows get equal results. Columns
other than doc_id, text and lang are ignored, and lang serves training only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, let_go, one_text_an_id

WINDOW, HIDDEN, CHUNK = 64, 8, 2048


@dataclass
class Model:
    """Weights by direction: input rows (2 * 256, 3H), recurrent (2, H, 3H), output (2, H, C).

    Columns of the first two are update gate, reset gate, candidate; the gates'
    are halved, as sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    langs: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def _rows(x: np.ndarray) -> np.ndarray:
    """Input rows by step, direction and window, for windows x of shape (B, L)."""
    both = np.stack([x, x[:, ::-1] + np.int64(256)])  # (2, B, L)
    return np.ascontiguousarray(both.transpose(2, 0, 1))


def forward(model: Model, x: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States of shape (L, 2, B, H); the backward direction's are put in text order."""
    rows, h = _rows(x), np.zeros((2, len(x), HIDDEN), dtype=np.float32)
    states = np.empty((x.shape[1], *h.shape), dtype=np.float32)
    n2, last = 2 * HIDDEN, x.shape[1] - 1
    gate_in, cand_in = (np.ascontiguousarray(w) for w in (model.inputs[:, :n2], model.inputs[:, n2:]))
    gate_rec, cand_rec = (np.ascontiguousarray(w) for w in (model.recurrent[..., :n2], model.recurrent[..., n2:]))
    for t in range(x.shape[1]):
        gates = gate_in.take(rows[t], axis=0, mode="clip")
        gates += h @ gate_rec
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        c = h @ cand_rec
        n = cand_in.take(rows[t], axis=0, mode="clip")
        n += r * c
        np.tanh(n, out=n)
        if kept is not None:
            kept.append((h, z, r, n, c))
        h = h - n
        h *= z
        h += n
        states[t, 0], states[last - t, 1] = h[0], h[1]
    return states


def position_probs(model: Model, states: np.ndarray) -> np.ndarray:
    """Softmax over languages at every position: (L, B, C)."""
    logits = states[:, 0] @ model.output[0] + states[:, 1] @ model.output[1] + model.bias
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def gradients(model: Model, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
    kept: list = []
    states = forward(model, x, kept)
    p = position_probs(model, states)
    mask = (np.arange(x.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
    total = mask.sum()
    of_label = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*p.shape[:2], 1)), axis=2)[..., 0]
    loss = float(-(np.log(of_label + 1e-12) * mask).sum() / total)
    d = p * mask[..., None]
    np.put_along_axis(d, np.broadcast_to(y[None, :, None], (*p.shape[:2], 1)), ((of_label - 1) * mask)[..., None], axis=2)
    d /= total
    g_out = np.stack([np.einsum("lbh,lbc->hc", states[:, k], d) for k in (0, 1)])
    into = np.stack([d @ model.output[0].T, (d @ model.output[1].T)[::-1]], axis=1)  # (L, 2, B, H), each in its own time
    g_rec, g_in, dh = np.zeros_like(model.recurrent), np.zeros_like(model.inputs), np.zeros_like(kept[0][0])
    rows, eye = _rows(x), np.arange(512)
    for t in reversed(range(x.shape[1])):
        h, z, r, n, c = kept[t]
        dh = dh + into[t]
        dn = dh * (1 - z) * (1 - n * n)
        # the factor 2 undoes the halving: d sigmoid / d(half argument)
        da = np.concatenate([dh * (h - n) * z * (1 - z) * 2, dn * c * r * (1 - r) * 2, dn], axis=-1)
        dg = np.concatenate([da[..., : 2 * HIDDEN], dn * r], axis=-1)
        g_rec += h.transpose(0, 2, 1) @ dg
        flat = rows[t].ravel()
        g_in += (eye[:, None] == flat[None, :]).astype(np.float32) @ da.reshape(len(flat), -1)
        dh = dh * z + dg @ model.recurrent.transpose(0, 2, 1)
    return loss, [g_in, g_rec, g_out, d.sum(axis=(0, 1))]


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's bytes as rows of WINDOW bytes, the last one padded with 0, and lengths."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    lengths = np.full(n, WINDOW)
    if n:
        lengths[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), lengths


def sample_windows(docs: DataFrame, per_lang: int, windows: int, seed: int, langs: int, longest: int) -> pd.DataFrame:
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    w = Window.partitionBy("lang").orderBy(h, "doc_id")
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    totals = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()
    if not totals:
        return pd.DataFrame(columns=["doc_id", "k", "label", "window"])
    # rows are cut by their hash where they are read: about four times as many of each language as are
    # wanted are left to be ordered, so that no language fills a task
    cuts = F.create_map(*(F.lit(x) for r in totals for x in (r["lang"], int(min(1.0, (4 * per_lang + 100) / r["count"]) * (1 << 30)))))
    ids = ids.where(h <= F.try_element_at(cuts, F.col("lang")))
    few = ids.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_lang).select("doc_id", F.col("lang").alias("label")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                cut, lengths = windows_of((text or "").encode())
                if len(cut):
                    for k in sorted({int(i) for i in np.linspace(0, len(cut) - 1, windows)}):
                        rows.append((doc_id, k, label, cut[k, : lengths[k]].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "label", "window"])

    # at most per_lang narrow rows for each of at most ``langs`` languages
    bounded_batches(docs.sparkSession)
    chosen = one_text_an_id(docs, few, longest)
    return chosen.mapInPandas(run, "doc_id long, k int, label string, window binary").toPandas()


def train(docs: DataFrame, per_lang: int = 400, windows: int = 10, steps: int = 260, batch: int = 192, seed: int = 5, langs: int = 1000, longest: int = 1 << 22) -> Model | None:
    """``docs``: the documents that may be learned from (doc_id, text, lang). At most the ``langs``
    commonest languages are learned, and one text an id and language, of ``longest`` bytes at most."""
    rows = sample_windows(docs, per_lang, windows, seed, langs, longest).sort_values(["doc_id", "k"], kind="stable")
    labels = sorted(rows["label"].unique())
    if not labels:
        return None
    x = np.zeros((len(rows), WINDOW), dtype=np.int64)
    lengths = rows["window"].map(len).to_numpy()
    for i, data in enumerate(rows["window"]):
        x[i, : len(data)] = np.frombuffer(data, np.uint8)
    y = np.searchsorted(labels, rows["label"].to_numpy())
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = Model(labels, normal(512, 3 * HIDDEN, scale=0.4), normal(2, HIDDEN, 3 * HIDDEN, scale=0.3), normal(2, HIDDEN, len(labels), scale=0.3), np.zeros(len(labels), np.float32))
    weights = [model.inputs, model.recurrent, model.output, model.bias]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_label[k]) for k in rng.integers(0, len(labels), batch)])
        _, grads = gradients(model, x[pick], lengths[pick], y[pick])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return model


def verdicts(spark: SparkSession, model: Model | None) -> Callable[[Column], Column]:
    """A function of a text column that gives structs (lang_pred, score).

    Only the text goes to Python, so a filter on the verdict moves no other column.
    """
    shared = spark.sparkContext.broadcast(model)
    bounded_batches(spark)

    def judged(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
        data = [t.encode() if t and any(map(str.isalpha, t)) else b"" for t in texts]
        sizes = np.array([-(-len(d) // WINDOW) for d in data], dtype=np.int64)
        owner = np.repeat(np.arange(len(data)), sizes)
        buffer = b"".join(d.ljust(n * WINDOW, b"\0") for d, n in zip(data, sizes, strict=True))
        x = np.frombuffer(buffer, np.uint8).reshape(-1, WINDOW)
        lengths = np.full(len(x), WINDOW)
        if len(x):
            ends = np.cumsum(sizes)[sizes > 0] - 1
            lengths[ends] = [len(d) - (n - 1) * WINDOW for d, n in zip(data, sizes, strict=True) if n]
        pooled = np.zeros((len(data), len(model.langs)))
        for at in range(0, len(x), CHUNK):
            part, size = x[at : at + CHUNK].astype(np.int64), lengths[at : at + CHUNK]
            p = position_probs(model, forward(model, part))
            if (size < WINDOW).any():
                p *= np.arange(WINDOW)[:, None, None] < size[None, :, None]
            np.add.at(pooled, owner[at : at + CHUNK], p.sum(axis=0))
        best = pooled.argmax(axis=1)
        return [
            (model.langs[k], float(row[k] / max(row.sum(), 1e-12))) if len(d) else ("und", 0.0) for d, k, row in zip(data, best, pooled, strict=True)
        ]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        model = shared.value
        for batch in batches:
            found: list[tuple[str, float]] = []
            for at in range(0, len(batch), 256):
                part = list(batch.iloc[at : at + 256])
                found += judged(model, part) if model else [("und", 0.0)] * len(part)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    verdict = verdicts(docs.sparkSession, model)
    return docs.select("doc_id", verdict(F.col("text")).alias("v")).select("doc_id", "v.lang_pred", "v.score")
