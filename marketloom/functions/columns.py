"""Column expressions used across operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(top: Column, bottom: Column) -> Column:
    """NULL where the divisor is 0 or missing (ANSI mode raises otherwise)."""
    return F.try_divide(top, bottom)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def min_max(x: Column, low: float, high: float) -> Column:
    """x scaled to 0..1 between low and high; 0 where the range is empty."""
    return clamp01((x - F.lit(low)) / F.lit(high - low)) if high > low else F.lit(0.0)


def ladder(x: Column, steps: list[tuple[float, object]], otherwise: object, strict: bool = False) -> Column:
    """First step whose bound x reaches (or exceeds, if strict)."""
    out = None
    for bound, value in steps:
        hit = x > bound if strict else x >= bound
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def lookup(x: Column, values: dict[str, object], otherwise: object) -> Column:
    """A small fixed table as a chain of conditions."""
    out = None
    for key, value in values.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; NULL for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - safe_div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the five-term rational approximation 26.2.17
    of Abramowitz and Stegun (error below 7.5e-8)."""
    coefficients = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    tail = F.lit(0.0)
    for c in reversed(coefficients):
        tail = (tail + F.lit(c)) * t
    tail = tail * F.lit(0.3989422804014327) * F.exp(F.lit(-0.5) * x * x)
    return F.when(x < 0, tail).otherwise(F.lit(1.0) - tail)


def breakeven_bps(gross: Column) -> Column:
    """Whole basis points; truncates toward zero after adding a half."""
    return (gross * 10000 + 0.5).cast("long").cast("double")


def regime_multiplier(label: Column) -> Column:
    values = {"strong_bull": 1.15, "bull": 1.05, "neutral": 1.0, "correction": 0.85, "bear": 0.7}
    return lookup(F.lower(label), values, 1.0)


def sector_multiplier(label: Column) -> Column:
    return lookup(F.upper(label), {"LEADING": 1.1, "STRONG": 1.05, "NEUTRAL": 1.0, "WEAK": 0.95, "LAGGING": 0.85}, 1.0)


def regime_segment(label: Column) -> Column:
    return F.when(label.isin("strong_bull", "bull"), "risk_on").when(label.isin("neutral", "correction", "bear"), "risk_off").otherwise("unknown")


def _shortened(x: Column, sign: str, steps: list[tuple[float, int, str]]) -> Column:
    """A number by the first step that it reaches: (least value, decimals, letter). Ties go to the even digit."""
    out = F.when(x.isNull(), "[DATA MISSING]")
    for least, digits, letter in steps:
        out = out.when(x >= least, F.format_string(f"{sign}%.{digits}f{letter}", F.bround(x / least, digits)))
    return out.otherwise(F.format_string(f"{sign}%.0f", x.cast("double")))


def human_number(x: Column) -> Column:
    """1234567 -> 1.2M; thousands whole, millions and billions with a decimal."""
    return _shortened(x, "", [(1e9, 1, "B"), (1e6, 1, "M"), (1e3, 0, "K")])


def human_volume(x: Column) -> Column:
    """A bar's volume: thousands whole, millions with a decimal."""
    return _shortened(x, "", [(1e6, 1, "M"), (1e3, 0, "K")])


def market_cap(x: Column) -> Column:
    return _shortened(x, "$", [(1e12, 1, "T"), (1e9, 1, "B"), (1e6, 0, "M")])


def revenue(x: Column) -> Column:
    return _shortened(x, "$", [(1e9, 1, "B"), (1e6, 0, "M")])


def parse_price(text: Column) -> Column:
    """The first number in a text, thousands separators removed; NULL for '-', N/A,
    texts that say insufficient, and texts without a number."""
    t = F.trim(text)
    found = F.regexp_extract(t, r"\$?([\d,]+\.?\d*)", 1)
    none = (t == "") | F.lower(t).contains("insufficient") | t.isin("-", "N/A")
    return F.when(~none, F.replace(found, F.lit(","), F.lit("")).try_cast("double"))


def parse_percent(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), "%$", "")).try_cast("double")


def parse_ratio(text: Column) -> Column:
    return F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double")


def entry_zone(text: Column) -> tuple[Column, Column]:
    """(low, high) of a price range; the first separator present, in a fixed order, splits it."""
    t = F.trim(text)
    low, high = parse_price(t), parse_price(t)
    for mark in (" to ", "-", "—", "–"):
        has = t.contains(mark)
        low = F.when(has, parse_price(F.substring_index(t, mark, 1))).otherwise(low)
        high = F.when(has, parse_price(F.substring(t, F.instr(t, mark) + F.lit(len(mark)), F.length(t)))).otherwise(high)
    return low, high
