"""How far the sources of a language differ in their use of terms, in exact integer arithmetic.

Terms are runs of letters (anything outside ASCII counts as one), of which A-Z are lower-cased. A
language keeps the terms of at least ``min_docs`` of its documents. A group (language and
source), and a language, gives each kept term the smoothed share
``1 + floor(10^9 (count + 5) / (total + 5 kept))``.

Part ``pair`` is the distance of each two sources of a language: the sum of the differences of their shares over
kept terms. Part ``term`` gives the ``top`` terms that a source overuses most.

1. Tasks count terms in bounded dictionaries, which are merged by language, source and term.
2. A term can only be among a group's first ``top`` if fewer than ``top`` others dominate it: have a
   count in the group as high, a count in the language as low, and come earlier in
   UTF-8, as such a term's difference is as large and it comes first in a tie. Each partition
   keeps its groups' terms that fewer than ``top`` of its terms dominate (a skyband), parts' skybands are merged
   in the same way, and what is left is ranked exactly.
3. Distances are summed in blocks of about ``block`` terms by ``sources`` sources a side: what a
   source has in a block are its few counted terms and one share for all others. No block grows with the data;
   blocks' sums are added.

Defined results: null text, lang and source are read as empty strings. Every row is a document,
also where ids repeat or are null. A group without kept terms gives each the same share; a language
without kept terms has distances of 0 and no terms; a language of one source has no
pairs. An empty table gives an empty result. Columns other than text, lang and source are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, let_go, written

#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 400_000
#: Rows of skybands that a task holds before it hands them on.
HELD_ROWS = 200_000

_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms(text: str) -> list[bytes]:
    """A text's terms in UTF-8: all other bytes become spaces."""
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) by group; a row with a null
    term for each group, also one without terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out() -> pa.RecordBatch:
            columns: list[list[pa.Array]] = [[], [], [], [], []]
            for (lang, source), (n, found) in counts.items():
                size = len(n) + 1
                names = pa.array([None, *n], pa.binary()).cast(pa.string())
                parts = (pa.repeat(lang, size), pa.repeat(source, size), names, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(found.__getitem__, n)], pa.int64()))
                for column, part in zip(columns, parts, strict=True):
                    column.append(part)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, found = counts[lang, source]
                words = terms(text)
                n.update(words)
                found.update(set(words))
            if sum(len(n) + 1 for n, _ in counts.values()) > HELD_TERMS:
                yield out()
        if counts:
            yield out()

    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact for any counts."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * wide(count + 5)
    return F.call_function("div", top, wide(total + 5 * kept)) + 1


def skyband(count: np.ndarray, common: np.ndarray, term: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate.

    In the order of (count down, common up, term up) a term comes after all that dominate it, and one that
    k terms dominate is dominated by k of the skyband: each run of ``step`` terms is held against the
    skyband of those before, then against itself.
    """
    place = np.empty(len(term), np.int64)
    place[np.argsort(term, kind="stable")] = np.arange(len(term))
    order = np.lexsort((place, common, -count))
    band = np.empty(0, np.int64)

    def dominated(by: np.ndarray, these: np.ndarray) -> np.ndarray:
        worse = (count[by][:, None] >= count[these]) & (common[by][:, None] <= common[these]) & (place[by][:, None] < place[these])
        return worse.sum(axis=0)

    for at in range(0, len(order), step):
        these = order[at : at + step]
        before = dominated(band, these)
        these, before = these[before < k], before[before < k]
        band = np.concatenate([band, these[before + dominated(these, these) < k]])
    return band


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (lang, source, term, n, common) of a partition that fewer than k others of their group in it dominate."""
    columns = ["lang", "source", "term", "n", "common"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        kept: dict[tuple[str, str], pd.DataFrame] = {}
        for batch in batches:
            for key, group in batch.groupby(["lang", "source"], sort=False):
                group = pd.concat([kept[key], group]) if key in kept else group
                by_utf8 = np.array([t.encode() for t in group["term"]], dtype=object)
                kept[key] = group.iloc[np.sort(skyband(group["n"].to_numpy(), group["common"].to_numpy(), by_utf8, k))]
            if sum(map(len, kept.values())) > HELD_ROWS:
                yield from kept.values()
                kept = {}
        yield from kept.values()

    return rows.select(*columns).mapInPandas(run, "lang string, source string, term string, n long, common long")


def overused(rows: DataFrame, top: int, salts: int = 16) -> DataFrame:
    """lang, source, item, value and rank of each group's first ``top`` overused terms, from rows
    (lang, source, term, n, common, total, lang_total, kept)."""
    sizes = rows.groupBy("lang", "source").agg(*(F.first(c).alias(c) for c in ("total", "lang_total", "kept")))
    found = skybands(rows.where("n > 0"), top)
    # partitions' skybands are merged in parts of a group, then ranked
    found = skybands(found.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(salts))), top)
    value = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("common"), F.col("lang_total"), F.col("kept"))
    ranked = found.join(sizes, ["lang", "source"]).withColumn("value", value).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def distances(rows: DataFrame, groups: DataFrame, block: int, sources: int) -> DataFrame:
    """lang, source, item and value: the summed difference of the shares of each two sources of a language.

    ``groups`` has (lang, source, total, kept, n_sources), all groups; ``rows`` their kept terms.
    """
    parts = F.greatest(F.ceil(F.col("kept") / block), F.lit(1)).cast("int")
    sides = F.ceil(F.col("n_sources") / sources).cast("int")
    side = F.pmod(F.xxhash64("source"), sides).cast("int")
    rest = share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    # a source without a row in a block still has its share of all terms there
    base = groups.where("n_sources > 1").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    base = base.select("lang", "source", "part", F.when(F.col("kept") > 0, rest).alias("p"), F.lit(None).cast("string").alias("term"), "kept", side.alias("side"), sides.alias("sides"))
    here = rows.where("n_sources > 1").select(
        "lang", "source", F.pmod(F.xxhash64("term"), parts).cast("int").alias("part"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "term", "kept", side.alias("side"), sides.alias("sides")
    )
    met = base.unionByName(here).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    met = met.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lang, part, low, high = (group[c].iloc[0] for c in ("lang", "part", "low", "high"))
        first = group[group["term"].isna()].sort_values(["side", "source"])
        names = {s: i for i, s in enumerate(first["source"])}
        rest = first["p"].fillna(0).to_numpy(np.int64)
        counted = group[group["term"].notna()]
        codes, seen = pd.factorize(counted["term"])
        shares = np.repeat(rest[:, None], len(seen), axis=1)
        shares[counted["source"].map(names).to_numpy(np.int64), codes] = counted["p"].to_numpy(np.int64)
        sides, labels, out = first["side"].to_numpy(), first["source"].to_numpy(), []
        for i in range(len(names)):
            j = np.arange(i + 1, len(names)) if low == high else np.flatnonzero(sides == high) if sides[i] == low else np.empty(0, np.int64)
            same = np.abs(rest[j] - rest[i])
            # all terms as if neither had them (once, in the first block), and what the block's terms change in that
            value = np.abs(shares[j] - shares[i]).sum(axis=1) - same * len(seen)
            if part == 0:
                value = value + same * int(first["kept"].iloc[0])
            out.append(pd.DataFrame({"lang": lang, "source": labels[i], "item": labels[j], "value": value}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})

    sums = met.groupBy("lang", "part", "low", "high").applyInPandas(run, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e")
    return sums.select("lang", "value", turned).select("lang", "e.source", "e.item", "value")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, block: int = 1024, sources: int = 256) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    counts = written(term_counts(docs), "term-counts")
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("common"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = written(kept.drop("docs"), "kept-terms")
    rows = written(counts.where(F.col("term").isNotNull()).select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "group-terms")
    langs = kept.groupBy("lang").agg(F.sum("common").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    per_lang = counts.where(F.col("term").isNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    groups = written(groups.join(per_lang, "lang").fillna(0, ["total", "lang_total", "kept"]), "groups")
    rows = rows.join(groups, ["lang", "source"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(rows, groups, block, sources).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    named = overused(rows, top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(named.select(*columns))
