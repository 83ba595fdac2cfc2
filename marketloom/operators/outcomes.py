"""What prices did after a signal: forward paths, exits, costs, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ladder, lookup
from ..sources.market import over

#: name, least price, least daily value, cost of a round trip, extra cost of a stop (bps)
TIERS = [
    ("leaders", 20.0, 50_000_000.0, 20.0, 15.0),
    ("momentum", 5.0, 10_000_000.0, 30.0, 25.0),
    ("ep_tier1", 5.0, 5_000_000.0, 50.0, 30.0),
    ("ep_tier2", 2.0, 2_000_000.0, 100.0, 40.0),
    ("default", 0.0, 0.0, 75.0, 30.0),
]
HORIZONS = (1, 2, 3, 4, 5, 10, 20)


def _marked(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """``bars`` (ticker, date, ...) of the tickers of ``signals``, with ``_signal`` where one of them is of that date.

    Each ticker's wanted dates meet its series, so that rows dealt by ticker are not dealt anew by date."""
    wanted = signals.groupBy("ticker").agg(F.collect_set("date").alias("_dates"))
    return bars.join(wanted, "ticker").withColumn("_signal", F.array_contains("_dates", F.col("date"))).drop("_dates")


def with_bars(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Inner join of ``signals`` with ``bars`` on ticker and date; only the wanted bars are exchanged."""
    return signals.join(_marked(bars, signals).where("_signal").drop("_signal"), ["ticker", "date"])


def _paths(bars: DataFrame, signals: DataFrame, columns: list[str], first: int, last: int, days: int) -> DataFrame:
    """``signals`` (ticker, date, ...) with the ``columns`` of their bars from ``first`` to ``last`` as an array ``path``.

    Only the bars that some path holds go on; windows over these gather at most a path's bars, and only the wanted
    dates' arrays are moved.
    """
    near = _marked(bars.select("ticker", *columns), signals).withColumn("_near", F.max("_signal").over(over().rowsBetween(-last, 0))).where("_near")
    path = F.filter(F.collect_list(F.struct(*columns)).over(over().rowsBetween(first, last)), lambda b: b["date"] <= F.date_add(F.col("date"), days))
    return signals.join(near.select("ticker", "date", "_signal", path.alias("path")).where("_signal").drop("_signal"), ["ticker", "date"])


def forward_paths(bars: DataFrame, signals: DataFrame, n: int = 20, span_days: int = 50) -> DataFrame:
    """Each signal (ticker, date, ...) with its next bars as an array ``path``, so that nothing is joined on a range."""
    return _paths(bars, signals, ["date", "open", "high", "low", "close"], 1, n, span_days)


def outcomes(paths: DataFrame) -> DataFrame:
    """Entry at the next open; returns at the horizons; run-up and drawdown."""
    entry = F.get("path", F.lit(0))["open"]
    value = lambda k: F.try_divide(F.get("path", F.lit(k - 1))["close"], F.col("entry_price")) - 1
    rows = paths.withColumns({"entry_price": entry, "evaluated_days": F.size("path")}).where(F.col("entry_price").isNotNull())
    best = F.array_max(F.transform("path", lambda b: b["high"]))
    worst = F.array_min(F.transform("path", lambda b: b["low"]))
    more = {f"return_{k}d": value(k) for k in HORIZONS} | {"max_runup": best / F.col("entry_price") - 1, "max_drawdown": worst / F.col("entry_price") - 1}
    return rows.withColumns(more).drop("path")


#: Columns of results and the sessions they look ahead.
LOOKS = {f"return_{k}d": k for k in HORIZONS} | {"max_runup": 20, "max_drawdown": 20}


def adjusted(rows: DataFrame, actions: DataFrame, bars: DataFrame, looks: dict[str, int] = LOOKS) -> DataFrame:
    """Results of signals with splits taken out, and ``corporate_action_count``, the most actions that a result met.

    ``rows`` (ticker, entry_date, the columns of ``looks``), ``actions`` (ticker, ex_date, action_type, ratio), ``bars`` (ticker, date,
    adjusted_close). A result that looks k sessions ahead meets the actions from its entry to 2k calendar days on, both ends
    included: a split divides it by its ratio, a reverse split multiplies it, other kinds and ratios that are not
    positive are counted only. A provider's adjusted close on any bar of that span leaves the result as it is, with no actions;
    so does a missing entry date. NULL results stay and meet none.

    The three tables meet as one series a ticker, and every span is a range frame over it: nothing is joined on a range.
    """
    ratio = F.when(F.col("ratio") > 0, F.col("ratio").cast("double"))
    factor = F.when(F.col("action_type") == "split", 1 / ratio).when(F.col("action_type") == "reverse_split", ratio)
    series = [
        rows.withColumns({"_day": F.unix_date("entry_date"), "_signal": F.lit(True)}),
        actions.select("ticker", F.unix_date("ex_date").alias("_day"), factor.alias("_factor"), F.lit(True).alias("_action")),
        bars.where("adjusted_close is not null").select("ticker", F.unix_date("date").alias("_day"), F.lit(True).alias("_given")),
    ]
    met, out = {}, {}
    for k in sorted(set(looks.values())):
        span = Window.partitionBy("ticker").orderBy("_day").rangeBetween(0, 2 * k)
        free = F.count("_given").over(span) == 0
        met |= {f"_n{k}": F.when(free, F.count("_action").over(span)).otherwise(0), f"_f{k}": F.when(free, F.product("_factor").over(span))}
    for c, k in looks.items():
        out[c] = F.when(F.col(f"_n{k}") > 0, F.col(c) * F.coalesce(f"_f{k}", F.lit(1.0))).otherwise(F.col(c))
    counts = [F.when(F.col(c).isNotNull(), F.col(f"_n{k}")).otherwise(0) for c, k in looks.items()]
    known = series[0].where("_day is not null and ticker is not null")
    joined = known.unionByName(series[1], allowMissingColumns=True).unionByName(series[2], allowMissingColumns=True).where("_day is not null and ticker is not null")
    # windows with many frames are worked out near signals alone
    near = F.count("_signal").over(Window.partitionBy("ticker").orderBy("_day").rangeBetween(-2 * max(looks.values()), 0)) > 0
    done = joined.withColumn("_near", near).where("_near").withColumns(met).where("_signal").select(*(out.get(c, F.col(c)).alias(c) for c in rows.columns), F.greatest(*counts, F.lit(0)).cast("long").alias("corporate_action_count"))
    return done.unionByName(rows.where("entry_date is null or ticker is null").withColumn("corporate_action_count", F.lit(0).cast("long")))


def implausible(r1: Column, r20: Column) -> Column:
    """Reason for quarantine, NULL if plausible."""
    return F.when(F.abs(r1) > 0.75, "one_day_return_exceeded").when(r20 > 2.0, "twenty_day_return_high").when(r20 < -0.7, "twenty_day_return_low")


def replay_exits(bars: DataFrame, trades: DataFrame, n: int = 20, include_signal_day: bool = True) -> DataFrame:
    """Exit of trades (ticker, date, entry, stop, t1, t2) over at most n bars.

    The first bar that reaches stop (which wins ties) or second target ends it; the first
    target is noted up to then; else the last bar's close. A NULL target is never hit.
    """
    ahead = 0 if include_signal_day else 1
    rows = _paths(bars, trades, ["date", "high", "low", "close"], ahead, n - 1 + ahead, 2 * n)
    first = lambda hit: F.array_min(F.transform("path", lambda b, i: F.when(F.coalesce(hit(b), F.lit(False)), i)))
    none = F.lit(1 << 20)
    rows = rows.withColumns(
        {
            "stop_at": F.coalesce(first(lambda b: b["low"] <= F.col("stop")), none),
            "t2_at": F.coalesce(first(lambda b: (b["high"] >= F.col("t2")) & (F.col("t2") > 0)), none),
            "t1_at": F.coalesce(first(lambda b: b["high"] >= F.col("t1")), none),
        }
    )
    end = F.least("stop_at", "t2_at", F.size("path") - 1)
    kind = F.when(F.size("path") == 0, "time").when((F.col("stop_at") < none) & (F.col("stop_at") <= F.col("t2_at")), "stop").when(F.col("t2_at") < none, "target_2").otherwise("time")
    rows = rows.withColumns({"exit_type": kind, "t1_hit": F.col("t1_at") <= end, "exit_date": F.get("path", end)["date"]})
    price = F.when(F.col("exit_type") == "stop", F.col("stop")).when(F.col("exit_type") == "target_2", F.col("t2")).otherwise(F.get("path", end)["close"])
    rows = rows.withColumn("exit_price", price)
    return rows.withColumn("actual_rr", F.coalesce(F.try_divide(F.col("exit_price") - F.col("entry"), F.col("entry") - F.col("stop")), F.lit(0.0))).drop("path", "stop_at", "t1_at", "t2_at")


def slippage_tier(price: Column, value: Column) -> Column:
    out = None
    for name, least_price, least_value, *_ in TIERS:
        hit = (price >= least_price) & (value >= least_value)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("default")


def net_return(gross: Column, tier: Column, exit_type: Column) -> Column:
    trip = lookup(tier, {t[0]: t[3] for t in TIERS}, 75.0)
    stop = F.when(F.coalesce(exit_type == "stop", F.lit(False)), lookup(tier, {t[0]: t[4] for t in TIERS}, 30.0)).otherwise(F.lit(0.0))
    return gross - trip / 10000 - stop / 10000


def capped_size(kelly_percent: Column, value: Column, portfolio: Column) -> Column:
    """Position in percent of the portfolio, at most 2 percent of the daily value."""
    limit = F.try_divide(value * 0.02, portfolio) * 100
    usable = (kelly_percent > 0) & (value > 0) & (portfolio > 0)
    return F.when(usable & (kelly_percent > limit), limit).otherwise(kelly_percent)


def level_error(entry_low: Column, entry_high: Column, stop: Column, t1: Column, t2: Column, setup: Column) -> Column:
    """First broken rule of a trade's levels, NULL if none."""
    s = F.upper(F.trim(setup))
    rr = F.try_divide(t1 - entry_high, entry_low - stop)
    least = F.when(s.isin("EP_TIER1", "EP_TIER2"), 2.5).when(s.isin("LEADERS", "MOMENTUM", "VCP", "TIGHT_BASE"), 3.0)
    return (
        F.when(stop >= entry_low, "stop_too_high").when(t1.isNull(), "no_target").when(t1 <= entry_high, "target_too_low")
        .when((t2 > 0) & (t2 <= t1), "second_below_first").when(rr < least, "reward_too_small")
    )


def adjust_for_splits(rows: DataFrame, actions: DataFrame, horizon: int, column: str) -> DataFrame:
    """Divides (split) or multiplies (reverse split) a return by the ratios of actions whose
    ex-date lies in [date, date + 2 horizons]."""
    a = actions.select(F.col("ticker").alias("_t"), "ex_date", F.when(F.col("action_type") == "split", F.try_divide(F.lit(1.0), F.col("ratio"))).otherwise(F.col("ratio")).alias("_f"))
    on = (F.col("ticker") == F.col("_t")) & F.col("ex_date").between(F.col("date"), F.date_add("date", 2 * horizon))
    keys = ["ticker", "date"]
    factors = rows.select(*keys).distinct().join(a, on).groupBy(*keys).agg(F.product("_f").alias("_factor"), F.count(F.lit(1)).alias("action_count"))
    joined = rows.join(factors, keys, "left")
    return joined.withColumns({column: F.col(column) * F.coalesce("_factor", F.lit(1.0)), "action_count": F.coalesce("action_count", F.lit(0))}).drop("_factor")


def primary_observations(signals: DataFrame, ordinals: DataFrame, sessions: int = 21) -> DataFrame:
    """A signal is primary unless its ticker and list had one within the last sessions."""
    rows = signals.join(ordinals.select("ticker", "date", "ordinal"), ["ticker", "date"])
    w = Window.partitionBy("ticker", "list_type").orderBy("date")
    gap = F.col("ordinal") - F.lag("ordinal").over(w)
    return rows.withColumns({"sessions_since": gap, "is_primary": F.coalesce(gap > sessions, F.lit(True))})


def cross_list_duplicates(signals: DataFrame) -> DataFrame:
    """On a date a ticker counts for one list: leaders before momentum before ep."""
    order = F.when(F.col("list_type") == "leaders", 1).when(F.col("list_type") == "momentum", 2).otherwise(3)
    w = Window.partitionBy("ticker", "date").orderBy(order)
    return signals.withColumn("cross_list_duplicate", F.row_number().over(w) > 1)


#: Least return of a badge, from the best down; below them all a pick counts as stopped out.
BADGES = [(0.05, "big winner"), (0.03, "strong winner"), (0.01, "winner"), (-0.01, "flat"), (-0.03, "small loss")]


def badge(r: Column) -> Column:
    return F.when(r.isNull(), "tracking").otherwise(ladder(r, BADGES, "stopped out"))


def phrase_5d(r: Column) -> Column:
    """One line of text about the first week."""
    pct = r * 100
    say = lambda text: F.format_string(text, pct)
    return (
        F.when(r.isNull(), "First week: still open.").when(pct >= 5, say("First week: exceptional, +%.1f%%.")).when(pct >= 3, say("First week: strong, +%.1f%%."))
        .when(pct >= 0, say("First week: up %.1f%%.")).when(pct >= -3, say("First week: normal pullback, %.1f%%.")).otherwise(say("First week: down, %.1f%%."))
    )


def phrases() -> list[Column]:
    """Lines of text about an outcome: two_weeks, whole, best, worst and tracked; empty where there is nothing to say."""
    r10, r20, up, down, days = (F.col(c) for c in ("return_10d", "return_20d", "max_runup", "max_drawdown", "evaluated_days"))
    say = lambda form, r: F.format_string(form, r * 100)
    either = lambda name, r: F.when(r.isNull(), "").when(r >= 0, say(f"{name}: up %.1f%%.", r)).otherwise(say(f"{name}: down %.1f%%.", r))
    best = F.when(up * 100 >= 10, say("Best: outstanding, +%.1f%%.", up)).when(up * 100 >= 5, say("Best: +%.1f%% before a pullback.", up)).when(up >= 0, say("Best: +%.1f%%.", up)).otherwise("")
    worst = F.when(down.isNull(), "").when(down * 100 >= -2, say("Worst: minimal, %.1f%%.", down)).when(down * 100 >= -5, say("Worst: controlled, %.1f%%.", down)).otherwise(say("Worst: %.1f%%.", down))
    tracked = F.when(days >= 20, "Fully tracked.").when(days >= 10, F.format_string("%d days, extended window.", days)).otherwise(F.format_string("%d days, in progress.", days))
    return [either("Two weeks", r10).alias("two_weeks"), either("Whole period", r20).alias("whole"), best.alias("best"), worst.alias("worst"), tracked.alias("tracked")]
