"""Chart structure of a series: swing points, trendlines by base type, base tops and the levels drawn from them.

Everything is read from one sorted window a series and one row a series; the newest pair of swing points of a
kind is the largest by position, so nothing is gathered into lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.market import over

#: Bars that a chart needs for lines and tops, and the bars of flat lines and of a flat or generic top.
LEAST_BARS, FLAT_LINE, FLAT_TOP = 20, 15, 25
#: Base kinds in the order in which a base type's words are looked for.
LINE_KINDS = {"flat": ("tight", "flat"), "vcp": ("vcp", "contraction", "volatility"), "cup": ("cup",)}
TOP_KINDS = {"cup": ("cup",), "double": ("double", "bottom"), "flat": ("flat", "tight"), "vcp": ("vcp", "contraction")}
#: Levels as multiples of a base's top.
LEVELS = {"entry_low": 1.0, "entry_high": 1.05, "stop_loss": 0.95, "target1": 1.2, "target2": 1.25}


def kind_of(base: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    """The first kind one of whose words a base type holds; ``other`` if none."""
    found = F.lit("other")
    for kind, words in reversed(kinds.items()):
        found = F.when(F.rlike(F.lower(base), F.lit("|".join(words))), kind).otherwise(found)
    return found


def charted(bars: DataFrame, months: int = 6) -> DataFrame:
    """The bars of the last ``months`` calendar months up to each series' last one."""
    last = F.max("date").over(Window.partitionBy("ticker"))
    return bars.withColumn("_last", last).where(F.col("date") >= F.add_months("_last", -months)).drop("_last")


def structure(bars: DataFrame, k: int = 3) -> DataFrame:
    """One row a series of LEAST_BARS bars or more: where its swing points, extremes and ends lie.

    Points are structs (date, price). A swing point stands strictly beyond its ``k`` neighbours on both sides.
    """
    w, whole = over(), Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    past, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    full = (F.count(F.lit(1)).over(before) == k) & (F.count(F.lit(1)).over(after) == k)
    flagged = bars.select(
        "ticker", "date", "high", "low", "close", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(whole).alias("n"), F.max("high").over(past).alias("top_before"),
        F.coalesce(full & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)), F.lit(False)).alias("is_high"),
        F.coalesce(full & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)), F.lit(False)).alias("is_low"),
    ).where(F.col("n") >= LEAST_BARS)
    point = lambda price: F.struct("date", F.col(price).alias("price"))
    earlier = lambda flag, price: F.last(F.when(F.col(flag), point(price)), ignorenulls=True).over(past)
    rows = flagged.withColumns(
        {
            "prev_high": earlier("is_high", "high"), "prev_low": earlier("is_low", "low"), "lows": F.count_if("is_low").over(so_far), "all_lows": F.count_if("is_low").over(whole),
        }
    )
    newest = lambda value, where: F.max_by(F.when(where, value), F.when(where, F.col("i")))
    pair = lambda prev, price: F.struct(F.col(prev).alias("a"), point(price).alias("b"))
    high, low = F.col("is_high"), F.col("is_low")
    two_highs, two_lows = high & F.col("prev_high").isNotNull(), low & F.col("prev_low").isNotNull()
    between = (F.col("lows") == F.col("all_lows") - 1) & (F.col("all_lows") >= 2)  # from the last low but one to before the last
    recent = lambda f, c, bars: f(F.when(F.col("i") > F.col("n") - bars, F.col(c)))
    deepest = F.when(low, F.struct("low", "i"))
    return rows.groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("close", "i").alias("last_close"), F.count_if(low).alias("n_lows"),
        recent(F.min, "date", FLAT_LINE).alias("flat_date"), recent(F.max, "high", FLAT_LINE).alias("flat_high"), recent(F.min, "low", FLAT_LINE).alias("flat_low"),
        recent(F.max, "high", FLAT_TOP).alias("recent_high"), recent(F.min, "low", FLAT_TOP).alias("recent_low"),
        newest(pair("prev_high", "high"), two_highs).alias("highs"), newest(pair("prev_low", "low"), two_lows).alias("lows"),
        newest(pair("prev_high", "high"), two_highs & (F.col("high") < F.col("prev_high.price"))).alias("falling"),
        newest(pair("prev_low", "low"), two_lows & (F.col("low") > F.col("prev_low.price"))).alias("rising"),
        newest(point("high"), high).alias("last_high"), newest(point("low"), low).alias("last_low"),
        F.min_by(F.when(low, point("low")), deepest).alias("deepest"), F.min_by(F.when(low, F.col("top_before")), deepest).alias("lip"),
        F.max(F.when(between & high & ~low, F.col("high"))).alias("middle_swing"), F.max(F.when(between, F.col("high"))).alias("middle_high"),
    )


def _line(role: str, a: Column, b: Column, when: Column | None = None) -> Column:
    line = F.struct(F.lit(role).alias("role"), a["date"].alias("t1"), a["price"].alias("v1"), b["date"].alias("t2"), b["price"].alias("v2"))
    return F.when(a["price"].isNotNull() & b["price"].isNotNull() & (F.lit(True) if when is None else when), line)


def lines(kind: Column) -> Column:
    """The trendlines of a row of ``structure`` for a base kind, in order: (role, t1, v1, t2, v2)."""
    c = F.col
    at = lambda date, price: F.struct(c(date).alias("date"), c(price).alias("price"))
    pair = lambda role, name, when=None: _line(role, c(f"{name}.a"), c(f"{name}.b"), when)
    flat = F.array(_line("resistance", at("flat_date", "flat_high"), at("last_date", "flat_high")), _line("support", at("flat_date", "flat_low"), at("last_date", "flat_low")))
    # the last two lows stand in for whatever line is missing
    vcp = F.array(pair("resistance", "falling"), pair("support", "rising"), pair("support", "lows", c("falling").isNull() | c("rising").isNull()))
    cup = F.array(_line("resistance", at("first_date", "lip"), at("last_date", "lip"), c("lip") > 0), _line("support", c("deepest"), c("last_low"), c("deepest.date") != c("last_low.date")))
    other = F.array(pair("resistance", "highs"), pair("support", "lows"))
    return F.array_compact(F.when(kind == "flat", flat).when(kind == "vcp", vcp).when(kind == "cup", cup).otherwise(other))


def pivot_distance(found: Column) -> tuple[Column, Column]:
    """End of the first resistance among ``found`` lines and the last close's distance from it in percent, to one
    decimal; both null beyond 15 percent."""
    pivot = F.get(F.filter(found, lambda x: x["role"] == "resistance"), F.lit(0))["v2"]
    pct = F.when((pivot > 0) & (F.col("last_close") > 0), F.round((F.col("last_close") - pivot) / pivot * 100, 1))
    near = pct.between(-15, 15)
    return F.when(near, pivot), F.when(near, pct)


def base_top(kind: Column) -> Column:
    """The price at a base's top; null where a series has no such base."""
    c = F.col
    depth = lambda top, bottom: F.try_divide(top - bottom, top)
    cup = F.when(depth(c("lip"), c("deepest.price")).between(0.08, 0.5), c("lip"))
    double = F.when(c("last_high").isNotNull() & (c("n_lows") >= 2), F.coalesce("middle_swing", "middle_high"))
    flat = F.when(depth(c("recent_high"), c("recent_low")) <= 0.2, c("recent_high"))
    top = F.when(kind == "cup", cup).when(kind == "double", double).when(kind == "flat", flat).when(kind == "vcp", c("last_high.price")).otherwise(c("recent_high"))
    return F.when(top > 0, top)


def levels(top: str = "base_top") -> list[Column]:
    return [(F.col(top) * by).alias(name) for name, by in LEVELS.items()]
