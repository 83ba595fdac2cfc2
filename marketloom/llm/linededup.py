"""Removal of line chunks that repeat anywhere in the corpus.

Everything here is built from DataFrame functions.

Lines with something but white space are a text's lines; blank ones between them are passed over. Lines are
hashed, and a rolling hash over ``WINDOW_LINES`` line hashes runs along them. Where it is divisible
by ``DIVISOR`` a chunk ends: boundaries depend on the lines next to them alone, so a passage is cut alike
wherever it stands. Spans of two sizes are counted by (64-bit hash, length) over the corpus:
chunks, and the rolling hash's own windows, which also reach passages that hold no whole chunk.
A window that occurs no more often than a repeated chunk around it occurs only there, and the chunk speaks
for it. All other spans that occur twice or more are compared by their bytes, and all but the
first occurrence (smallest id, then text hash, then line) go. So every run of two text lines or more that
occurred before is removed from its first line to its last, with the blank lines inside it; blank lines at
its edges stay, and so does a single line that repeats. A removed line's text stays where it occurred first.

Plan: narrow passes over the documents hash lines and fill counts map-side; a bit filter of repeated spans
lets only these into a shuffle, as a few numbers each; their bytes are grouped with their first places
map-side; texts are shuffled only where they lose lines.

Defined results: a null text stays null. Rows with the same id and text are one document
twice and are cut alike. Different spans under one hash and length are told apart. Other
columns are carried through, whatever their names; ``n_chars``, if present, is set anew, and a
column ``removed_lines`` is replaced. Null ids are smaller than all others. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parted, written

#: Lines under the rolling hash.
WINDOW_LINES = 2
#: A chunk ends at one in so many lines.
DIVISOR = 4

#: A span: its first and last line in the text, and the same in text lines.
SPAN = ["first", "last", "a", "b", "hash", "length"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def span_hash(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_lines(lines: Column) -> Column:
    """(i, line) of the lines with something but white space."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: F.rlike(x["line"], F.lit(r"\S")))


def _numbers(first: int, past: Column) -> Column:
    """first .. past - 1, none if there are none."""
    return F.filter(F.sequence(F.lit(first), F.greatest(past, F.lit(first))), lambda j: j < past)


def _spans(some: Column) -> Column:
    """The windows and chunks of an array of text lines, each chunk with its windows (``inner``)."""

    def of(t: Column) -> Column:
        rolling = lambda j: F.xxhash64(t[j - 1]["h"], t[j]["h"])
        m = F.size(t)

        def span(a: Column, b: Column) -> Column:
            own = F.slice(t, a + 1, b - a + 1)
            length = F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x["n"])
            return F.struct(t[a]["i"].alias("first"), t[b]["i"].alias("last"), a.alias("a"), b.alias("b"), span_hash(F.transform(own, lambda x: x["h"])).alias("hash"), length.alias("length"))

        windows = F.transform(_numbers(WINDOW_LINES - 1, m), lambda j: span(j - (WINDOW_LINES - 1), j))
        ends = F.filter(_numbers(1, m), lambda j: (F.pmod(rolling(j), F.lit(DIVISOR)) == 0) | (j == m - 1))

        def chunks(e: Column) -> Column:
            pairs = F.transform(e, lambda j, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(e[k - 1] + 1).alias("a"), j.alias("b")))
            return F.transform(F.filter(pairs, lambda p: p["b"] - p["a"] >= WINDOW_LINES), lambda p: span(p["a"], p["b"]))

        return let(windows, lambda w: F.concat(
            F.transform(w, lambda x: F.struct(*(x[c].alias(c) for c in SPAN), F.lit(None).cast("array<struct<hash:bigint,length:bigint>>").alias("inner"))),
            F.transform(let(ends, chunks), lambda x: F.struct(*(x[c].alias(c) for c in SPAN), F.transform(F.slice(w, x["a"] + 1, x["b"] - x["a"] + 1 - (WINDOW_LINES - 1)), lambda y: F.struct(y["hash"].alias("hash"), y["length"].alias("length"))).alias("inner"))),
        ))

    return let(F.transform(some, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["line"]).alias("h"), F.octet_length(x["line"]).cast("long").alias("n"))), of)


def body_of(some: Column, span: Column) -> Column:
    return F.array_join(F.transform(F.slice(some, span["a"] + 1, span["b"] - span["a"] + 1), lambda x: x["line"]), "\n")


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash) and the spans of every row; nothing is shuffled."""
    spans = F.explode(_spans(text_lines(split_lines(F.col("text")))))
    return docs.select("doc_id", F.xxhash64("text").alias("th"), spans.alias("c")).select("doc_id", "th", "c.*")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, first, last, hash and length of the spans that occur twice or more, without the windows for
    which a chunk speaks."""
    key = ["hash", "length"]
    again = written(spans_of(docs).groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated")
    met = parted(spans_of(docs), again.select("hash"), "hash")[1].join(again, key)
    met = written(met.select("doc_id", "th", *SPAN[:2], *key, "k", "inner"), "places")
    chunks = met.where(F.col("inner").isNotNull()).groupBy(*key).agg(F.first("inner").alias("inner"), F.first("k").alias("k"))
    within = chunks.select("k", F.explode("inner").alias("w")).select("w.hash", "w.length", "k")
    spoken = within.join(again, [*key, "k"]).select(*key).distinct()
    return written(met.drop("k", "inner").join(spoken, key, "left_anti"), "spans")


def _covered(gone: Column) -> Column:
    """The lines of the spans ``gone`` (first, last), once each."""
    return F.array_distinct(F.flatten(F.transform(gone, lambda s: F.sequence(s["first"], s["last"]))))


def _cut(text: Column, gone: Column) -> Column:
    """``text`` without the lines of the spans ``gone`` (first, last)."""

    def of(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), _covered(gone))
        return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")

    return let(split_lines(text), of)


def _with(rows: DataFrame, found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, node, ...) surely without a row of ``found`` (doc_id, th, name), and the others
    with its column ``name``, null where there is none; only the latter are shuffled."""
    right = found.select(F.xxhash64("doc_id", "th").alias("node"), F.col("doc_id").alias("_id"), F.col("th").alias("_th"), name)
    clear, likely = parted(rows, right, "node")
    right = right.drop("node")
    return clear, likely.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").drop("_id", "_th")


def _keepers(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of equal bytes by (hash, length) with the place of their first: those whose hash and
    length no other bytes have, and the others, with their bytes."""
    groups = written(bodies.groupBy("hash", "length", "body").agg(F.min("place").alias("keeper")), "bodies")
    seen = groups.groupBy("hash", "length").agg(F.count(F.lit(1)).alias("k"), F.min("keeper").alias("keeper"))
    several = seen.where("k > 1").select("hash", "length")
    return seen.where("k = 1").select("hash", "length", "keeper"), written(groups.join(several, ["hash", "length"]), "keepers")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) without repeated chunks, plus
    ``removed_lines`` long, the number of lines taken out, in place of a column of that name."""
    columns = [c for c in docs.columns if c != "removed_lines"]
    # the input's columns travel in one struct, so that none can clash with those made here
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    rows = rows.withColumn("node", F.xxhash64("doc_id", "th"))
    plain = docs.select("doc_id", "text")
    spans = repeated_spans(plain)

    place = F.struct("doc_id", "th", "first")
    # bytes of spans whose hash is wanted, and of a few others, which occur in no row of ``spans``
    full = let(
        text_lines(split_lines(F.col("text"))),
        lambda some: F.transform(_spans(some), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), c["hash"].alias("hash"), c["length"].alias("length"), body_of(some, c).alias("body"))),
    )
    bodies = plain.select("doc_id", F.xxhash64("text").alias("th"), F.explode(full).alias("c")).select("doc_id", "th", "c.*")
    bodies = parted(bodies, spans.select("hash").distinct(), "hash")[1].withColumn("place", place)
    single, several = _keepers(bodies.select("hash", "length", "body", "place"))
    gone = spans.withColumn("place", place).join(single, ["hash", "length"]).where(~F.col("place").eqNullSafe(F.col("keeper"))).select("place", "last")
    if several.limit(1).count():
        more = bodies.join(several, ["hash", "length", "body"]).where(~F.col("place").eqNullSafe(F.col("keeper"))).select("place", "last")
        gone = gone.unionByName(more)
    gone = gone.groupBy("place.doc_id", "place.th").agg(F.collect_set(F.struct("place.first", "last")).alias("gone"))
    clear, likely = _with(rows, written(gone, "gone"), "gone")
    text = F.col("row.text")

    def out(rows: DataFrame, text: Column, removed: Column) -> DataFrame:
        new = {"text": text, "n_chars": F.char_length(text).cast("long")}
        return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns), removed.cast("long").alias("removed_lines"))

    gone = F.col("gone")
    cut = F.when(gone.isNotNull(), _cut(text, gone)).otherwise(text)
    same = out(clear.select("row"), text, F.lit(0))
    return same.unionByName(out(likely, cut, F.when(gone.isNotNull(), F.size(_covered(gone))).otherwise(0)))
