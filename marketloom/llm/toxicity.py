"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its
words (hashed words and word beginnings); a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are needed to train it, by
gradient descent on the noisy-or's likelihood; afterwards the sentence scores show
where the offence is.

It is trained on at most ``per_class`` toxic and twice as many other labelled documents,
those with the smallest keyed hash of their id, the latter weighted up to their share of
all labels; tasks turn whole texts into hashed features first. Every whole text is
then scored.

Defined results: a null or empty text has no sentence (its number and score are null) and scores 0; repeated rows
score alike; a document with several labels counts as toxic if one says so; without
labelled documents every score is 0. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, bounded_batches, let_go, one_text_an_id, sampled

BITS = 20
SENTENCE = re.compile(r"[.?!\n]+")
_EDGES = "\"'()[]{}<>,;:*#$%&|=-_/\\"
#: Bytes of the words that a task keeps, and features that descent takes at a time.
CACHE_BYTES, BLOCK = 32 << 20, 1 << 19


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings; none for a word without letters or digits."""
    word = word.strip(_EDGES).lower()
    mask = (1 << BITS) - 1
    parts = (word, "4" + word[:4], "5" + word[:5]) if len(word) > 3 else (word,)
    return tuple(zlib.crc32(p.encode()) & mask for p in parts) if word else ()


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Scorer:
    """Scores texts; keeps the summed weights of words that it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, BoundedCache(CACHE_BYTES)

    def _weight(self, word: str) -> float:
        value = float(sum(self.model.weights[i] for i in word_features(word)))
        self.known.offer(word, value, 24)
        return value

    def sentences(self, text: str) -> list[float]:
        known, out = self.known, []
        for sentence in SENTENCE.split(text):
            if words := set(sentence.split()):
                values = list(map(known.get, words))
                if None in values:
                    values = [self._weight(w) if v is None else v for w, v in zip(words, values, strict=True)]
                out.append(sum(sorted(values)))
        return out

    def document(self, text: str) -> tuple[float, int | None, float | None]:
        """The noisy-or of the sentences, the number of the strongest sentence (the first, if
        several are) and its own score."""
        if not (logits := self.sentences(text)):
            return 0.0, None, None
        score = float(-np.expm1(-np.logaddexp(0, np.array(logits) + self.model.bias).sum()))
        worst = max(logits)
        return score, logits.index(worst), float(1 / (1 + np.exp(-(worst + self.model.bias))))


def _bags(sample: DataFrame) -> pd.DataFrame:
    """Feature hashes of sampled documents: doc_id, toxic, and as 32-bit integers the
    features of all sentences and each sentence's number of features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = lambda x: np.array(x, dtype="<i4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                bags = [sorted({i for w in set(s.split()) for i in word_features(w)}) for s in SENTENCE.split(text or "")]
                bags = [b for b in bags if b]
                rows.append((doc_id, toxic, packed([i for b in bags for i in b]), packed([len(b) for b in bags])))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "features", "lengths"])

    bounded_batches(sample.sparkSession)
    return sample.mapInPandas(run, "doc_id long, toxic int, features binary, lengths binary").toPandas()


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, steps: int = 120, prior: float = 20.0, seed: int = 11, longest: int = 1 << 20) -> Model:
    """``labels``: (doc_id, toxic), already limited to rows that may be learned from.

    A word's weight begins at its smoothed log odds between toxic and other
    documents; descent steps are scaled by how many sentences hold the word, plus
    ``prior``, so that rare words stay near 0. Weights are never negative: harmless
    words around an offence don't make up for it. One text an id is learned from, of ``longest`` bytes at most.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if len(totals) < 2:
        return Model(weights, -30.0)
    first = lambda y, n: sampled(known.where(F.col("toxic") == y), n, totals[y], seed, "doc_id")
    few = first(1, per_class).unionByName(first(0, 2 * per_class))
    bags = _bags(one_text_an_id(docs, few, longest).select("doc_id", "text", "toxic"))
    bags = bags[bags["lengths"].map(len) > 0].sort_values(["doc_id", "lengths"], kind="stable")
    y = bags["toxic"].to_numpy(dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Model(weights, -30.0)
    per_doc = bags["lengths"].map(len).to_numpy() // 4
    lengths = np.concatenate([np.frombuffer(x, "<i4") for x in bags["lengths"]])
    features = np.concatenate([np.frombuffer(x, "<i4") for x in bags["features"]])
    del bags
    # features of one or two sentences tell nothing that holds elsewhere
    common = sum(np.bincount(features[at : at + BLOCK], minlength=1 << BITS) for at in range(0, len(features), BLOCK)) >= 3
    index = np.full(1 << BITS, -1, dtype=np.int32)
    index[common] = np.arange(common.sum())
    size = int(common.sum())
    doc_of = np.repeat(np.arange(len(y)), per_doc)
    # blocks of whole documents: (first sentence, last, sentence of each feature, features)
    blocks, held, sentences = [], np.zeros((2, size)), np.concatenate([[0], np.cumsum(per_doc)])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    doc = 0
    while doc < len(y):
        last = max(doc + 1, int(np.searchsorted(ends[sentences], ends[sentences[doc]] + BLOCK, side="right")) - 1)
        s, e = sentences[doc], sentences[last]
        own, of = index[features[ends[s] : ends[e]]], np.repeat(np.arange(e - s, dtype=np.int32), lengths[s:e])
        of, own = of[own >= 0], own[own >= 0]
        seen = np.unique(own.astype(np.int64) * len(y) + doc_of[s + of])
        for k in (0, 1):
            held[k] += np.bincount((seen // len(y))[y[seen % len(y)] == k], minlength=size)
        blocks.append((s, e, of, own))
        doc = last
    del features
    share = y.mean()
    w = np.log((held[1] + prior * share) / share) - np.log((held[0] + prior * (1 - share)) / (1 - share))
    w = np.maximum(w - 1, 0)
    clean = max(1.0, totals[0] / totals[1] * y.sum() / (len(y) - y.sum()))
    b, pace = -6.0, 0.5 / (sum(np.bincount(own, minlength=size) for *_, own in blocks) + prior)
    mw, mb = np.zeros(size), 0.0
    logit = np.empty(len(lengths))
    for _ in range(steps):
        for s, e, of, own in blocks:
            logit[s:e] = np.bincount(of, weights=w[own], minlength=e - s) + b
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        log_clean = np.maximum(-np.bincount(doc_of, weights=np.logaddexp(0, logit), minlength=len(y)), -50.0)
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        grad = p * np.where(y == 1, -np.exp(log_clean) / toxic, clean)[doc_of]
        of_words = sum(np.bincount(own, weights=grad[s:e][of], minlength=size) for s, e, of, own in blocks)
        mw = 0.8 * mw - pace * (of_words + 0.02 * w + 0.1)
        mb = 0.8 * mb - 0.5 * grad.sum() / (len(lengths) ** 0.5 + prior)
        w, b = np.maximum(w + mw, 0), b + min(max(mb, -0.5), 0.5)
    weights[common] = w
    return Model(weights, float(b))


def scores(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column that gives structs (score, sentence, sentence_score): the
    document's score, and the place and score of its strongest sentence, null where there is
    none. Only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)
    bounded_batches(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in batches:
            out = pd.DataFrame([scorer.document(t or "") for t in batch], columns=["score", "sentence", "sentence_score"])
            yield out.astype({"sentence": "Int32"})

    return F.pandas_udf(run, "score double, sentence int, sentence_score double").asNondeterministic()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, sentence and sentence_score of every row of ``docs``."""
    found = docs.select("doc_id", scores(docs.sparkSession, model)(F.col("text")).alias("v"))
    return found.select("doc_id", "v.score", "v.sentence", "v.sentence_score")


def offending(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The sentences with a score of at least ``least``: doc_id, sentence, text, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                parts = [s for s in SENTENCE.split(text or "") if s.split()]
                found = 1 / (1 + np.exp(-(np.array(scorer.sentences(text or "")) + scorer.model.bias)))
                rows += [(doc_id, k, s.strip(), float(p)) for k, (s, p) in enumerate(zip(parts, found, strict=True)) if p >= least]
            out = pd.DataFrame(rows, columns=["doc_id", "sentence", "text", "score"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, sentence int, text string, score double")
