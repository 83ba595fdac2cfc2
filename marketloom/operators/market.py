"""Regime, sectors, screens, ranking: per-row scoring over snapshot columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp01, ladder, lookup, min_max, regime_multiplier, sector_multiplier
from .indicators import percentile_rank

MAX_REGIME_POINTS = 12.0
LABEL_RANK = {"strong_bull": 4, "bull": 3, "neutral": 2, "correction": 1, "bear": 0}
REGIME_STEPS = [(0.8, "strong_bull"), (0.6, "bull"), (0.4, "neutral"), (0.2, "correction")]
SECTOR_STEPS = [(0.8, "LEADING"), (0.6, "STRONG"), (0.4, "NEUTRAL"), (0.2, "WEAK")]


def _distance_points(pct: Column, most: float) -> Column:
    return F.when(pct > 5, F.lit(most)).when(pct >= 0, F.lit(most / 2)).otherwise(F.lit(0.0))


def _at_most(x: Column, steps: list[tuple[float, float]]) -> Column:
    out = F.when(x <= steps[0][0], F.lit(steps[0][1]))
    for bound, points in steps[1:]:
        out = out.when(x <= bound, F.lit(points))
    return out.otherwise(F.lit(0.0))


def vix_points(level: Column, change: Column) -> Column:
    """0.5 where unknown; a jump of over 20 percent costs 0.25."""
    base = F.when(level < 15, 1.0).when(level < 20, 0.75).when(level < 25, 0.5).when(level < 30, 0.25).otherwise(0.0)
    return F.when(level.isNull() | change.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), base - F.when(change > 20, 0.25).otherwise(0.0)))


def tick_points(lowest: Column) -> Column:
    return F.when(lowest.isNull(), 0.25).when(lowest > -600, 0.5).when(lowest >= -900, 0.25).otherwise(0.0)


def velocity_points(v: Column) -> Column:
    return F.when(v > 5, 0.5).when(v > 1, 0.35).when(v >= -1, 0.25).when(v > -5, 0.1).otherwise(0.0)


def raw_bull_strength() -> Column:
    """Points of a market_inputs row over their maximum."""
    c = F.col
    yes = lambda cond, points: F.when(cond, F.lit(points)).otherwise(F.lit(0.0))
    points = (
        _distance_points(c("spy_pct_sma50"), 1.5) + _distance_points(c("spy_pct_sma200"), 1.5)
        + _distance_points(c("qqq_pct_sma50"), 1.0) + _distance_points(c("qqq_pct_sma200"), 1.0)
        + yes(c("spy_cross"), 0.5) + yes(c("qqq_cross"), 0.5)
        + _at_most(c("distribution_days"), [(2, 1.5), (4, 0.75), (6, 0.375)])
        + ladder(c("breadth50"), [(60, 0.75), (50, 0.375)], 0.0) + ladder(c("breadth200"), [(55, 0.75), (40, 0.375)], 0.0)
        + yes(c("qqq_rs") > 1.05, 0.5) + yes(c("iwm_rs") > 0.95, 0.5)
        + vix_points(c("vix_level"), c("vix_change")) + tick_points(c("tick_min")) + velocity_points(c("breadth_velocity"))
    )
    return points / MAX_REGIME_POINTS


def smooth(last: float | None, raw: float, alpha: float = 0.5, bypass: float = -0.25) -> float:
    """One step of the smoothing: a fall of more than ``bypass`` counts in full, and so does a first value."""
    return raw if last is None or raw - last < bypass else alpha * raw + (1 - alpha) * last


def smoothed(days: DataFrame, raw: str = "raw", alpha: float = 0.5, bypass: float = -0.25, *by: str) -> DataFrame:
    """Recursive smoothing of (date, raw) rows in date order, within each of the series ``by``.

    One value follows from the one before, so a series is one sorted pass: a few thousand days a series,
    two numbers a day, however many series there are.
    """
    keys = ", ".join(f"`{c}` {days.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date", kind="stable")
        last, out = None, []
        for value in group["raw"]:
            last = smooth(last, value, alpha, bypass)
            out.append(last)
        return group[[*by, "date", "raw"]].assign(smoothed=out)

    rows = days.select(*by, "date", F.col(raw).cast("double").alias("raw"))
    return rows.groupBy(*by).applyInPandas(run, ", ".join(x for x in (keys, "date date, raw double, smoothed double") if x))


def regime_label(strength: Column, drawdown: Column | None = None) -> Column:
    """Label of a strength, never more bullish than the drawdown allows."""
    label = ladder(strength, REGIME_STEPS, "bear")
    if drawdown is None:
        return label
    cap = F.when(drawdown < -30, 0).when(drawdown < -20, 1).otherwise(4)
    rank = F.least(lookup(label, LABEL_RANK, 0), cap)
    return lookup(rank, {v: k for k, v in LABEL_RANK.items()}, "bear")


def circuit_breaker(regime: Column, vix: Column) -> Column:
    """full, ep_only or halt; a missing regime halts, a missing volatility counts as 0."""
    r = F.lower(regime)
    calm = F.coalesce(vix, F.lit(0.0)) < 28
    return F.when(r.isNull() | (r == "bear"), "halt").when(r == "correction", F.when(calm, "ep_only").otherwise("halt")).otherwise("full")


def sector_scores(metrics: DataFrame, *by: str) -> DataFrame:
    """Score and label of (perf_1m, perf_3m, rs_3m, above50, above200) rows within each group."""
    trend = F.when(F.col("above50") & F.col("above200"), 1.0).when(F.col("above50"), 0.6).otherwise(0.0)
    rows = metrics.withColumn("trend", trend)
    score = 0.4 * percentile_rank("rs_3m", *by) + 0.25 * percentile_rank("perf_3m", *by) + 0.15 * percentile_rank("perf_1m", *by) + 0.2 * F.col("trend")
    rows = rows.withColumn("score", clamp01(score))
    return rows.withColumn("label", ladder(F.col("score"), SECTOR_STEPS, "LAGGING"))


# ranking -------------------------------------------------------------------------------

MOMENTUM_WEIGHTS = {"breakout": 0.30, "strength": 0.25, "volume": 0.10, "confirmation": 0.15, "trend": 0.20}


def momentum_factors(snaps: DataFrame) -> DataFrame:
    c = lambda name, default: F.coalesce(F.col(name), F.lit(float(default)))
    blend = 0.65 * c("perf_3m", 0) + 0.35 * c("perf_6m", 0)
    strength = (
        F.when(blend <= 0, min_max(blend, -20, 0) * 0.2).when(blend <= 30, 0.2 + min_max(blend, 0, 30) * 0.4).otherwise(0.6 + min_max(blend, 30, 100) * 0.4)
    )
    volume = min_max(c("relative_volume", 1), 0.5, 5)
    change = c("change_pct", 0)
    direction = F.when((change > 2) & (c("gap_pct", 0) > 0), 1.0).when(change > 0.5, 0.8).when(change >= -0.5, 0.5).when(change >= -2, 0.2).otherwise(0.0)
    rsi = c("rsi14", 50)
    rsi_score = F.when(rsi > 85, 0.7).when(rsi >= 60, 1.0).when(rsi >= 50, 0.6).when(rsi >= 40, 0.3).otherwise(0.1)
    near = c("distance_52w_high", -50)
    above = F.when((c("sma50", 0) > 0) & (c("close", 0) > 0), (F.col("close") - F.col("sma50")) / F.col("sma50") * 100).otherwise(F.lit(0.0))
    signals = (rsi > 75).cast("int") + (above > 15).cast("int") + (c("perf_3m", 0) > 25).cast("int")
    penalty = F.when(near < -5, 1.0).otherwise(lookup(signals, {3: 0.55, 2: 0.75, 1: 0.9}, 1.0))
    return snaps.withColumns(
        {
            "breakout": min_max(c("distance_52w_high", -100), -30, 0), "strength": strength, "volume_expansion": volume, "confirmation": volume * direction,
            "trend": 0.5 * rsi_score + 0.5 * min_max(near, -25, 0), "penalty": penalty,
        }
    )


def momentum_scores(factors: DataFrame, narrative: Column | None = None) -> DataFrame:
    """Scores of rows that also have regime, sector_label and in_leaders."""
    w = MOMENTUM_WEIGHTS
    boost = 1.0 + 0.1 * F.coalesce(narrative, F.lit(0.0)) if narrative is not None else F.lit(1.0)
    raw = (
        w["breakout"] * F.col("breakout") * boost + w["strength"] * F.col("strength") + w["volume"] * F.col("volume_expansion")
        + w["confirmation"] * F.col("confirmation") + w["trend"] * F.col("trend")
    ) * F.col("penalty")
    raw = clamp01(raw * F.when(F.col("in_leaders"), 1.05).otherwise(1.0))
    score = F.least(F.lit(100.0), raw * regime_multiplier(F.col("regime")) * sector_multiplier(F.col("sector_label")) * 100)
    return factors.withColumn("score", score)


def rank_candidates(snaps: DataFrame) -> DataFrame:
    """Price over 5 and ten million in average daily value."""
    value = F.coalesce(F.col("avg_volume_10d") * F.col("close"), F.lit(0.0))
    return snaps.where((F.coalesce("close", F.lit(0.0)) > 5) & (value >= 10_000_000))


def top_per(df: DataFrame, n: int, order: list[Column], *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Parts of a date's rows whose largest scores bound its top from below.
PARTS = 16


def likely_top(rows: DataFrame, n: int, scores: list[str], by: str = "date") -> DataFrame:
    """``rows`` (ticker, ``by``, ``scores``) with every score set to NULL that is surely not among the ``n`` largest of its
    ``by``, without the rows that keep none.

    The n-th largest of the largest scores of PARTS parts is no more than the n-th largest of all, so that ties with it
    stay too. This is one hashed aggregate of numbers; the bounds are a row a date, and nothing else is exchanged or sorted.
    """
    part = F.pmod(F.xxhash64("ticker"), F.lit(max(PARTS, 2 * n))).alias("_part")
    tops = rows.groupBy(by, part).agg(*(F.max(c).alias(c) for c in scores))
    nth = lambda c: F.get(F.sort_array(F.array_compact(F.collect_list(c)), asc=False), F.lit(n - 1)).alias(f"_{c}")
    bounds = tops.groupBy(F.col(by).alias("_by")).agg(*(nth(c) for c in scores)).where("_by is not null")
    near = rows.join(F.broadcast(bounds), F.col(by) == F.col("_by"), "left")
    kept = near.select("ticker", by, *(F.when(F.coalesce(F.col(c) >= F.col(f"_{c}"), F.lit(True)), F.col(c)).alias(c) for c in scores))
    return kept.where(F.coalesce(*scores).isNotNull())


# screens -------------------------------------------------------------------------------


def momentum_screen(s: DataFrame) -> DataFrame:
    """The price and trend conditions of the momentum screen on derived snapshots."""
    c = F.col
    stacked = c("sma150").isNull() | c("sma200").isNull() | ((c("sma50") > c("sma150")) & (c("sma150") > c("sma200")))
    limit = F.when(F.coalesce("atr", F.lit(0.0)) > 0, c("high_52w") + 2 * c("atr")).otherwise(1.05 * c("high_52w"))
    return s.where(
        (c("close") >= 10) & (c("close") > c("sma20")) & (c("close") > c("sma50")) & (c("sma200") > c("sma200_prev")) & (c("perf_1m") >= 5)
        & (c("perf_3m") >= 15) & (c("perf_6m") >= 20) & stacked & (c("close") * c("avg_volume_10d") >= 1e6) & (c("close") >= 0.75 * c("high_52w"))
        & (c("close") <= limit) & (c("atr").isNull() | (c("high") - c("low") <= 1.5 * c("atr")))
    )


def episodic_screen(s: DataFrame) -> DataFrame:
    c = F.col
    span = c("high") - c("low")
    return s.where(
        (c("close") >= 5) & (c("gap_pct") >= 3) & (c("change_pct") >= 5) & (c("close") > c("open")) & (c("relative_volume") >= 1)
        & (c("close") * c("volume") >= 1e6) & (span > 0) & (F.try_divide(c("close") - c("low"), span) >= 0.7)
    )


def leaders_screen(s: DataFrame) -> DataFrame:
    c = F.col
    stacked = c("sma150").isNull() | c("sma200").isNull() | ((c("close") > c("sma150")) & (c("sma150") > c("sma200")))
    return s.where((c("close") >= 20) & (c("rsi14") >= 50) & (c("close") > c("sma50")) & (c("perf_3m") > 0) & (c("perf_6m") > 0) & stacked & (c("close") >= 0.75 * c("high_52w")))


def mean150_proxy(s: DataFrame) -> DataFrame:
    """Where the whole column is missing, 1.05 times the 200-bar mean stands in for the 150-bar one."""
    known = s.agg(F.count("sma150").alias("_known"))
    return s.join(F.broadcast(known)).withColumn("sma150", F.when(F.col("_known") == 0, F.col("sma200") * 1.05).otherwise(F.col("sma150"))).drop("_known")


def stage1(s: DataFrame, screener: str) -> DataFrame:
    """First rule that applies: eliminated, flagged or passed, with the flags, which add to ``risk_flags`` that are there.

    Momentum and leaders look for climax tops and wide ranges, leaders (with columns ``eps_growth`` and ``revenue_growth``) also for
    earnings that outgrow hardly growing revenue, ep for exhausted gaps. ``metrics`` and ``reason`` tell why a row was
    eliminated and are NULL otherwise. A rule whose inputs are NULL does not apply.
    """
    c, no = F.col, F.lit(False)
    span = F.try_divide(c("high") - c("low"), F.when(c("atr") > 0, c("atr")))
    usable = span.isNotNull() & (c("high_52w_before") > 0) & c("close").isNotNull() if screener != "ep" else no
    climax = usable & (span >= 3) & (c("close") > c("high_52w_before")) & (c("perf_3m") > 50)
    wide = usable & (span >= 2) & (c("perf_3m") > 40)
    grown = screener == "leaders" and {"eps_growth", "revenue_growth"} <= set(s.columns)
    engineered = (c("revenue_growth") > 0) & (c("revenue_growth") < 5) & (c("eps_growth") > 3 * c("revenue_growth")) if grown else no
    tired = (c("gap_pct") > 30) & (c("perf_1m") > 50) if screener == "ep" else no
    true = lambda x: F.coalesce(x, no)
    rule = F.when(true(climax), "climax_top").when(true(wide), "WIDE_RANGE_WARNING").when(true(engineered), "FINANCIAL_ENGINEERING_RISK").when(true(tired), "EXHAUSTION_RISK")
    earlier = F.coalesce("risk_flags", F.array().cast("array<string>")) if "risk_flags" in s.columns else F.array().cast("array<string>")
    out = c("rule") == "climax_top"
    # ep has none of these columns to look at
    told = {"today_range": F.round(c("high") - c("low"), 2), "atr": F.round("atr", 2), "range_mult": F.round(span, 2), "close": c("close"), "price_52w_high": c("high_52w_before"), "perf_3m": c("perf_3m")} if screener != "ep" else {}
    metrics = F.create_map(*(x for k, v in told.items() for x in (F.lit(k), v.cast("double")))) if told else F.lit(None).cast("map<string,double>")
    shown = F.format_string("Climax top: range %.2f = %.1f×ATR, close %.2f above 52W high %.2f, perf_3m %.1f%%", *(x.cast("double") for x in (c("high") - c("low"), span, c("close"), c("high_52w_before"), c("perf_3m")))) if told else F.lit(None).cast("string")
    return s.withColumn("rule", rule).withColumns(
        {
            "status": F.when(out, "eliminated").when(c("rule").isNotNull(), "flagged").otherwise("passed"),
            "risk_flags": F.concat(earlier, F.array_compact(F.array(F.when(~out, c("rule"))))),
            "metrics": F.when(out, metrics), "reason": F.when(out, shown),
        }
    )


def row_errors(ranges: dict[str, tuple[float, float]]) -> Column:
    """All range errors of a row, in the order given; NaN and infinities count as missing."""
    def bad(name: str, low: float, high: float) -> Column:
        x = F.col(name)
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        return F.when((x < low) | (x > high), F.lit(f"{name} out of range"))

    return F.array_compact(F.array(*(bad(n, *r) for n, r in ranges.items())))
