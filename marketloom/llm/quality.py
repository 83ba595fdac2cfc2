"""Quality rules whose cutoffs come from the corpus itself.

Every text is measured; every language and source gets a quantile sketch of each measure, and
a text is kept when its measures lie inside the cutoffs drawn from its own group's sketch.

A sketch is the count of values in geometric buckets (a value is known to within
``ACCURACY``) and the count of zeros, so sketches merge by adding counts: map-side, across sources, or across
days. A group's cutoffs are drawn towards those of its language, and a language's towards those of
everything, as if the parent had given ``PRIOR`` more texts: a large group goes its own way,
a small one follows its parent, without a size at which one turns into the other.

Word length, which every text has, is held against the quartiles: ``median + (1 + FENCE) * (quartile - median)``
on both sides. Measures that are zero in most texts have no spread around their median; their cutoff is where the
sketch itself is emptiest: on the scale of ``log(value + one event in a text of median size)``, which also has a place
for zero, the middle of the widest stretch that holds hardly a text (``EMPTY`` of the weight) and lies beyond the
bulk (``TAIL`` of the weight at most lies above it). A stretch counts if its ends are ``APART`` times apart; without one
nothing in the group stands off, and only values as far above the 0.99 quantile of the non-zero ones as
that lies above their median, and as much again, are cut.

Defined results: a null text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows are judged alike, each for itself; where no text
passes the base rule there are no cutoffs and nothing is kept.
Columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, let_go, written

#: Relative width of a bucket.
ACCURACY = 0.02

#: measure -> (numerator, denominator, occurrences that make the smallest event; none for a measure that every text has)
MEASURES = {
    "word_length": ("word_chars", "n_words", None),
    "symbols": ("n_symbols", "word_chars", 1),
    "repeated_lines": ("n_dup_lines", "n_lines", 1),
    "repeated_words": ("n_repeat_words", "n_words", 6),
}
SPARSE = [m for m, (*_, event) in MEASURES.items() if event]
#: Distances between median and quartile that word lengths may lie beyond the quartile.
FENCE = 20.0
#: Texts that a group's parent counts for in its cutoffs.
PRIOR = 100.0
#: Share of the weight that an empty stretch may hold, share that may lie above it, and ratio of its ends.
EMPTY, TAIL, APART = 0.001, 0.2, 3.4
#: The bucket of zeros.
ZERO = -(10**6)

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside any three-word window that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.translate(_SPACES):
            lines += 1
            seen.add(line)
    return len(words), len(text.translate(_SPACES)), len(_SYMBOL.findall(text)), lines, lines - len(seen), repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """The counts of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            counts = pd.DataFrame([measure(t or "") for t in batch["text"]], columns=["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"], dtype="int64")
            out = batch[["doc_id", "lang", "source"]].reset_index(drop=True)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield pd.concat([out, counts], axis=1)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text", "lang", "source").mapInPandas(run, STATS)


def _ratio(name: str) -> Column:
    top, bottom, _ = MEASURES[name]
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(0.0))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketch of each group's measures, and of
    the texts' sizes (``size of`` a measure is its denominator)."""
    bucket = lambda x: F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(1 + ACCURACY)))).otherwise(F.lit(ZERO)).cast("int")
    values = {m: _ratio(m) for m in MEASURES} | {f"size of {m}": F.col(MEASURES[m][1]).cast("double") for m in SPARSE}
    rows = stats.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(x).alias("bucket")) for m, x in values.items()))).alias("x"))
    return rows.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """A bucket's weight lies evenly along its width."""
    below = np.cumsum(weights)
    i = min(int(np.searchsorted(below, q * below[-1] * (1 - 1e-12))), len(values) - 1)
    return float(values[i] * (1 + ACCURACY) ** ((q * below[-1] - below[i]) / weights[i] + 0.5))


def emptiest(values: np.ndarray, weights: np.ndarray, event: float) -> float:
    """The cutoff of a sparse measure from its sketch: ascending values, zero among them, and their weights."""
    place = np.log(values + event)
    total, best, cut = weights.sum(), np.log(APART), None
    below = np.concatenate([[0], np.cumsum(weights)])
    for i in range(len(values) - 1):
        # the furthest value that leaves no more than EMPTY between
        j = int(np.searchsorted(below, below[i + 1] + EMPTY * total, side="right")) - 1
        j = min(max(j, i + 1), len(values) - 1)
        if below[i + 1] >= (1 - TAIL) * total and place[j] - place[i] >= best:
            best, cut = place[j] - place[i], np.exp((place[i] + place[j]) / 2) - event
    if cut is not None:
        return float(cut)
    some = values > 0
    if not some.any():
        return float("inf")
    median, high = (_quantile(values[some], weights[some], q) for q in (0.5, 0.99))
    return median + 3 * (high - median) if high > median else 3 * high


def _group_cutoffs(group: pd.DataFrame) -> dict[str, tuple[float | None, float]]:
    out, by = {}, {m: g.sort_values("bucket") for m, g in group.groupby("measure")}

    def sketch(m: str) -> tuple[np.ndarray, np.ndarray]:
        bucket = by[m]["bucket"].to_numpy(np.float64)
        return np.where(bucket > ZERO, (1 + ACCURACY) ** (np.maximum(bucket, -5000) - 0.5), 0.0), by[m]["n"].to_numpy(np.float64)

    for m, (_, _, event) in MEASURES.items():
        if event:
            out[m] = None, emptiest(*sketch(m), event / max(_quantile(*sketch(f"size of {m}"), 0.5), 1.0))
        else:
            low, mid, high = (_quantile(*sketch(m), q) for q in (0.25, 0.5, 0.75))
            out[m] = mid - (1 + FENCE) * (mid - low), mid + (1 + FENCE) * (high - mid)
    return out


def _level(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, measure, low, high) of each group's own sketch; a sketch is a bounded number of buckets, whatever its rows."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = _group_cutoffs(group)
        named = {k: [None if v is None or v != v else v] * len(found) for k, v in zip(keys, key, strict=True)}
        rows = float(group.loc[group["measure"] == "word_length", "n"].sum())
        return pd.DataFrame(named | {"rows": rows, "measure": list(found), "low": [x for x, _ in found.values()], "high": [x for _, x in found.values()]})

    schema = ", ".join([*(f"{k} string" for k in keys), "rows double, measure string, low double, high double"])
    return sketch.groupBy(*keys).applyInPandas(run, schema)


def drawn_to(own: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """A group's cutoffs with the parent's counted as PRIOR more texts, those above by their logarithms.

    ``keys`` are the parent's. What a group has no cutoff for, as no text of it holds any, is its parent's.
    """
    names = {k: f"_{k}" for k in (*keys, "rows", "measure", "low", "high")}
    met = F.col("measure") == F.col("_measure")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(names[k]))
    both = own.join(parent.withColumnsRenamed(names), met)
    mixed = lambda a, b: (a * F.col("rows") + b * PRIOR) / (F.col("rows") + PRIOR)
    high = F.when(F.col("high") == float("inf"), F.col("_high")).otherwise(F.exp(mixed(F.log("high"), F.log("_high"))))
    return both.withColumns({"low": mixed(F.col("low"), F.col("_low")), "high": high}).drop(*names.values())


def cutoffs(stats: DataFrame) -> DataFrame:
    """(lang, source, cutoffs): for each group a map from measure to (low, high)."""
    by_source = written(sketches(stats), "sketches")
    whole = _level(merge(by_source, []).withColumn("_all", F.lit("")), ["_all"]).drop("_all")
    by_lang = written(drawn_to(_level(merge(by_source, ["lang"]), ["lang"]), whole, []), "language-cutoffs")
    rows = drawn_to(_level(by_source, ["lang", "source"]), by_lang, ["lang"])
    entry = F.struct("measure", F.struct(F.when(~F.isnan("low"), F.col("low")).alias("low"), "high"))
    return rows.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(entry)).alias("cutoffs"))


def judge(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Counts, base rule and verdict of every document of ``docs``; ``outside`` lists the measures
    that lie beyond their cutoffs, of texts that pass the base rule."""
    stats = written(measured(docs), "quality")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    known = cutoffs(stats.where(~F.col("base_failed"))).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "cutoffs")
    found = stats.join(known, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    cut = F.col("cutoffs")
    # a bucket's values lie within ACCURACY of its middle
    beyond = [F.when((_ratio(m) > cut[m]["high"] * (1 + ACCURACY)) | F.coalesce(_ratio(m) < cut[m]["low"] * (1 - ACCURACY), F.lit(False)), F.lit(m)) for m in MEASURES]
    outside = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*beyond)))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(outside) == 0)).alias("kept"), outside.alias("outside"), "lang", "source",
    )
