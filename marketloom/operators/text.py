"""Parsing and wording of report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced_json(text: Column) -> Column:
    """The body of the first fenced block; NULL where a fence opens and never closes, or none opens."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", body)


def braced_json(text: Column) -> Column:
    """From the first opening brace to the brace that closes it, strings not considered.

    Brace depth is a running count over the characters, folded once per text.
    """
    start = F.instr(text, "{")
    chars = F.split(F.substring(text, start, F.length(text)), "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = acc["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (c == "}") & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(chars, state, step)["end"]
    return F.when((start > 0) & (end > 0), F.substring(text, start, end))


def table_rows(text: Column) -> Column:
    """Rows of the first markdown table as maps from header to trimmed cell; of equal headers the first counts."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s.startswith("|") & s.endswith("|"))
    cells = F.transform(lines, lambda s: F.transform(F.split(F.substring(s, F.lit(2), F.length(s) - 2), r"\|"), lambda c: F.trim(F.regexp_replace(F.trim(c), r"[*|]+$", ""))))
    head = F.transform(F.get(cells, F.lit(0)), lambda c: F.lower(c))
    body = F.filter(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: ~F.forall(r, lambda c: F.rlike(c, F.lit(r"^:?-+:?$"))))
    own = lambda r: F.transform(head, lambda h, i: F.struct(h.alias("h"), r[i].alias("cell"), (F.array_position(head, h) == i + 1).alias("first")))
    entry = lambda r: F.transform(F.filter(own(r), lambda e: e["first"]), lambda e: F.struct(e["h"].alias("key"), e["cell"].alias("value")))
    return F.transform(F.filter(body, lambda r: F.size(r) == F.size(head)), lambda r: F.map_from_entries(entry(r)))


def anonymous_name(n: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 701 -> ZZ, 702 -> AAA, for any bigint from 0 on."""
    n, out, before = n.cast("long"), F.lit(None).cast("string"), 0
    for length in range(1, 15):  # no bigint needs more letters
        digit = lambda k, rest=n - before: F.char((F.call_function("div", rest, F.lit(26**k)) % 26 + 65).cast("long"))
        out = F.when(n >= before, F.concat(*(digit(k) for k in reversed(range(length))))).otherwise(out)
        before += 26**length
    return out


def put_back(text: Column, names: Column) -> Column:
    """``text`` with aliases replaced, ``names`` being an array of structs (alias, name): longest alias
    first, so that AA is not read as A twice; aliases count as whole words."""
    ordered = F.array_sort(names, lambda a, b: F.when(F.length(a["alias"]) != F.length(b["alias"]), F.length(b["alias"]) - F.length(a["alias"])).otherwise(F.when(a["alias"] < b["alias"], -1).when(a["alias"] > b["alias"], 1).otherwise(0)))
    return F.aggregate(ordered, text, lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"\b"), x["alias"], F.lit(r"\b")), x["name"]))


def version_hash(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("", *parts), 256), 1, 8))


def fnv_id(s: Column) -> Column:
    """FNV-1a of 64 bits over an ASCII text, without the sign bit.

    The state is kept as two halves of 32 bits, so that no product overflows: the prime is 2^40 + 435.
    """
    low32 = F.lit(0xFFFFFFFF)
    shift = lambda c, n: F.call_function("shiftleft" if n > 0 else "shiftright", c, F.lit(abs(n)))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        lo = h["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        carry = shift(lo * 435, -32)
        hi = (h["hi"] * 435 + carry + shift(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), (lo * 435).bitwiseAND(low32).alias("lo"))

    return F.aggregate(F.split(s, ""), start, step, lambda h: shift(h["hi"].bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(h["lo"]))


def pattern_label(base: Column) -> Column:
    """The name shown for a base type; the type itself where it is of no known kind."""
    kind = F.lower(base)
    has = lambda *words: F.rlike(kind, F.lit("|".join(words)))
    return (
        F.when(has("vcp", "contraction", "volatility"), "VCP (Volatility Contraction)").when(has("cup"), "Cup with Handle")
        .when(has("tight"), "Tight Base").when(has("flat"), "Flat Base").otherwise(base)
    )


def shortened_size(text: Column) -> Column:
    """Size guidance cut to seven tenths: a range of percents, else a single one, scaled and rounded; else the first
    Half becomes Third, or Full Two-thirds, within the text; else a note is put after it."""
    number = r"(\d+(?:\.\d+)?)"
    scaled = lambda pattern, g: F.round(F.regexp_extract(text, pattern, g).try_cast("double") * 0.7, 1)
    span, single = rf"{number}\s*-\s*{number}\s*%", rf"{number}\s*%"
    one = lambda x: F.format_string("%.1f", x)
    t = F.lower(text)
    first = lambda word, by: F.regexp_replace(text, F.lit(rf"(?s)^(.*?){word}"), F.lit(rf"$1{by}"))
    return (
        F.when(text == "", "").when(scaled(span, 1).isNotNull(), F.concat(one(scaled(span, 1)), F.lit("-"), one(scaled(span, 2)), F.lit("%")))
        .when(scaled(single, 1).isNotNull(), F.concat(one(scaled(single, 1)), F.lit("%"))).when(t.contains("half"), first("Half", "Third")).when(t.contains("full"), first("Full", "Two-thirds"))
        .otherwise(F.concat(text, F.lit(" (reduced 30%)")))
    )


def merge_preferring(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge by key; the left side's values win, the right's fill."""
    names = [c for c in left.columns if c != key]
    r = right.select(key, *(F.col(c).alias(f"_{c}") for c in names))
    return left.join(r, key, "full_outer").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in names))
