"""Registered queries over ranked lists and their outcomes, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import evaluation, learning, market, outcomes
from ..operators import indicators as ind
from ..sources import market as src
from ..sources import sinks
from .sql import BARS, LISTS, OUTCOMES, SNAPS, with_

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rank_lists(bars: DataFrame) -> DataFrame:
    """Top three tickers a date for each of three scores: date, list_type, rank, ticker, score."""
    w = src.over()
    back = lambda n: F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1
    scored = bars.select("ticker", "date", back(21).alias("momentum"), back(63).alias("leaders"), F.try_divide("volume", F.lag("volume").over(w)).alias("ep"))
    long = market.likely_top(scored, 3, ["momentum", "leaders", "ep"], "date").unpivot(["ticker", "date"], ["momentum", "leaders", "ep"], "list_type", "score").where("score is not null")
    return market.top_per(long, 3, [F.desc("score"), F.asc("ticker")], "date", "list_type")


def scored_lists(spark: SparkSession, d: str) -> DataFrame:
    bars = src.candles(spark, d)
    return outcomes.outcomes(outcomes.forward_paths(bars, rank_lists(bars)))


@register(with_(BARS, LISTS) + "SELECT date, list_type, rank, ticker, round(score, 6) AS score FROM rank_lists")
def e12_rank_lists(spark: SparkSession, d: str) -> DataFrame:
    return rank_lists(src.candles(spark, d)).select("date", "list_type", F.col("rank").cast("long").alias("rank"), "ticker", F.round("score", 6).alias("score"))


@register(with_(BARS, LISTS, OUTCOMES) + """SELECT list_type, ticker, date, evaluated_days, entry_price, round(return_1d, 6) AS return_1d, round(return_5d, 6) AS return_5d,
 round(return_10d, 6) AS return_10d, round(return_20d, 6) AS return_20d, round(max_runup, 6) AS max_runup, round(max_drawdown, 6) AS max_drawdown FROM outcomes""")
def l8_forward_outcomes(spark: SparkSession, d: str) -> DataFrame:
    values = ["return_1d", "return_5d", "return_10d", "return_20d", "max_runup", "max_drawdown"]
    return scored_lists(spark, d).select("list_type", "ticker", "date", "evaluated_days", "entry_price", *(F.round(v, 6).alias(v) for v in values))


@register(with_(BARS, LISTS, OUTCOMES) + """, q AS (SELECT CASE WHEN abs(return_1d) > 0.75 THEN 'one_day_return_exceeded' WHEN return_20d > 2.0 THEN 'twenty_day_return_high' WHEN return_20d < -0.7 THEN 'twenty_day_return_low' END AS reason FROM outcomes)
SELECT reason, count(*) AS n FROM q GROUP BY reason""")
def b16_l12_quarantine(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lists(spark, d).withColumn("reason", outcomes.implausible(F.col("return_1d"), F.col("return_20d")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register(with_(BARS, LISTS, OUTCOMES) + """SELECT list_type, count(*) AS n, round(avg(CASE WHEN return_5d > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate_null_loses,
 round(avg(CASE WHEN return_5d > 0 THEN 1.0 WHEN return_5d IS NOT NULL THEN 0.0 END), 6) AS win_rate, round(avg(return_5d), 6) AS mean_return, round(quantile_cont(return_5d, 0.5), 6) AS median_return
FROM outcomes GROUP BY list_type HAVING count(*) >= 10""")
def d6_d8_d12_outcome_stats(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.group_stats(scored_lists(spark, d), "return_5d", "list_type").where("n >= 10")
    return s.select("list_type", "n", *(F.round(c, 6).alias(c) for c in ("win_rate_null_loses", "win_rate", "mean_return", "median_return")))


@register(with_(BARS, LISTS, OUTCOMES) + """, v AS (SELECT *, date >= DATE '1998-01-01' AS b FROM outcomes WHERE return_5d IS NOT NULL), s AS (
 SELECT list_type, count(*) FILTER (WHERE NOT b) AS na, count(*) FILTER (WHERE NOT b AND return_5d > 0) AS wa, count(*) FILTER (WHERE b) AS nb, count(*) FILTER (WHERE b AND return_5d > 0) AS wb FROM v GROUP BY list_type),
z AS (SELECT *, (wb / nb - wa / na) / sqrt((wa + wb) / (na + nb) * (1 - (wa + wb) / (na + nb)) * (1.0 / na + 1.0 / nb)) AS z FROM (SELECT list_type, CAST(na AS DOUBLE) na, CAST(wa AS DOUBLE) wa, CAST(nb AS DOUBLE) nb, CAST(wb AS DOUBLE) wb FROM s)),
t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z)
SELECT list_type, CAST(na AS BIGINT) AS n_a, CAST(wa AS BIGINT) AS wins_a, CAST(nb AS BIGINT) AS n_b, CAST(wb AS BIGINT) AS wins_b, round(z, 6) AS z,
 round(2 * 0.3989422804014327 * exp(-0.5 * z * z) * (0.319381530 * t - 0.356563782 * t * t + 1.781477937 * t * t * t - 1.821255978 * t * t * t * t + 1.330274429 * t * t * t * t * t), 6) AS p_value FROM t""")
def i1_two_proportion_test(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lists(spark, d).where("return_5d is not null").withColumn("b", F.col("date") >= "1998-01-01")
    win = F.col("return_5d") > 0
    s = rows.groupBy("list_type").agg(F.count_if(~F.col("b")).alias("n_a"), F.count_if(~F.col("b") & win).alias("wins_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("b") & win).alias("wins_b"))
    z, p = evaluation.two_proportions(F.col("wins_a"), F.col("n_a"), F.col("wins_b"), F.col("n_b"))
    return s.select("*", F.round(z, 6).alias("z"), F.round(p, 6).alias("p_value"))


@register(with_(BARS, LISTS, OUTCOMES) + """, v AS (SELECT list_type, round(score, 3) AS s, CASE WHEN return_5d > 0 THEN 1 ELSE 0 END AS y FROM outcomes WHERE return_5d IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY list_type ORDER BY s) + (count(*) OVER (PARTITION BY list_type, s) - 1) / 2.0 AS r FROM v)
SELECT list_type, round(coalesce((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 0.5), 6) AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM r GROUP BY list_type""")
def i3_i4_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lists(spark, d).where("return_5d is not null").select("list_type", F.round("score", 3).alias("s"), (F.col("return_5d") > 0).cast("int").alias("y"))
    return evaluation.auc(rows, "y", "s", "list_type").select("list_type", F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


@register(with_(BARS, LISTS, OUTCOMES) + """, v AS (SELECT list_type AS setup, return_5d, CASE rank WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'STARTER' END AS c FROM outcomes WHERE evaluated_days >= 5),
s AS (SELECT setup, count(*) AS n, CAST(sum(CASE WHEN return_5d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, avg(CASE c WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 ELSE 1.0 END) AS a FROM v GROUP BY setup HAVING count(*) >= 10)
SELECT setup, n, wins, round(a, 6) AS avg_conviction, round(100.0 * wins / n, 6) AS win_rate_pct, round(a / 3 * 100 - 100.0 * wins / n, 6) AS gap_pp,
 CASE WHEN a / 3 * 100 - 100.0 * wins / n > 15 THEN 'OVERCONFIDENT' WHEN a / 3 * 100 - 100.0 * wins / n < -15 THEN 'UNDERCONFIDENT' ELSE 'OK' END AS flag FROM s""")
def d13_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lists(spark, d).where("evaluated_days >= 5").select(F.col("list_type").alias("setup"), "return_5d", fn.lookup(F.col("rank"), {1: "HIGH", 2: "MEDIUM"}, "STARTER").alias("conviction"))
    return evaluation.calibration(rows).select("setup", "n", "wins", *(F.round(c, 6).alias(c) for c in ("avg_conviction", "win_rate_pct", "gap_pp")), "flag")


_TRADES = """, t AS (SELECT r.list_type, r.ticker, r.date, c.close AS entry, c.close * 0.9 AS stop, c.close * 1.15 AS t1, c.close * 1.4 AS t2 FROM rank_lists r JOIN candles c USING (ticker, date)),
p AS (SELECT t.*, c.date AS d, c.high, c.low, c.close AS c, row_number() OVER (PARTITION BY t.list_type, t.ticker, t.date ORDER BY c.date) AS k FROM t JOIN candles c ON c.ticker = t.ticker AND c.date BETWEEN t.date AND t.date + 40),
h AS (SELECT *, min(CASE WHEN low <= stop THEN k END) OVER g AS sk, min(CASE WHEN high >= t2 THEN k END) OVER g AS tk, min(CASE WHEN high >= t1 THEN k END) OVER g AS ok, max(k) OVER g AS n FROM p WHERE k <= 20 WINDOW g AS (PARTITION BY list_type, ticker, date)),
e AS (SELECT list_type, ticker, date, entry, stop, t2, d AS exit_date, c, CASE WHEN sk IS NOT NULL AND sk <= coalesce(tk, 99) THEN 'stop' WHEN tk IS NOT NULL THEN 'target_2' ELSE 'time' END AS exit_type, coalesce(ok <= k, false) AS t1_hit
 FROM h WHERE k = least(coalesce(sk, 99), coalesce(tk, 99), n)),
x AS (SELECT *, CASE exit_type WHEN 'stop' THEN stop WHEN 'target_2' THEN t2 ELSE c END AS exit_price FROM e)"""


@register(with_(BARS, LISTS) + _TRADES + "SELECT list_type, ticker, date, exit_type, t1_hit, exit_date, exit_price, round((exit_price - entry) / (entry - stop), 6) AS actual_rr FROM x")
def l5_exit_replay(spark: SparkSession, d: str) -> DataFrame:
    x = exits(src.candles(spark, d))
    return x.select("list_type", "ticker", "date", "exit_type", "t1_hit", "exit_date", "exit_price", F.round("actual_rr", 6).alias("actual_rr"))


def exits(bars: DataFrame) -> DataFrame:
    c = F.col("entry")
    trades = outcomes.with_bars(rank_lists(bars), bars.select("ticker", "date", F.col("close").alias("entry"))).withColumns({"stop": c * 0.9, "t1": c * 1.15, "t2": c * 1.4})
    return outcomes.replay_exits(bars, trades)


@register(with_(BARS, LISTS, OUTCOMES, SNAPS) + _TRADES + """, n AS (SELECT o.*, x.exit_type, s.close AS price, s.avg_volume_10d * s.close AS adv FROM outcomes o JOIN x USING (list_type, ticker, date) JOIN snaps s USING (ticker, date)),
q AS (SELECT *, CASE WHEN price >= 20 AND adv >= 5e7 THEN 'leaders' WHEN price >= 5 AND adv >= 1e7 THEN 'momentum' WHEN price >= 5 AND adv >= 5e6 THEN 'ep_tier1' WHEN price >= 2 AND adv >= 2e6 THEN 'ep_tier2' ELSE 'default' END AS tier FROM n)
SELECT list_type, ticker, date, tier, round(return_5d - CASE tier WHEN 'leaders' THEN 20 WHEN 'momentum' THEN 30 WHEN 'ep_tier1' THEN 50 WHEN 'ep_tier2' THEN 100 ELSE 75 END / 10000.0
 - CASE WHEN exit_type = 'stop' THEN CASE tier WHEN 'leaders' THEN 15 WHEN 'momentum' THEN 25 WHEN 'ep_tier1' THEN 30 WHEN 'ep_tier2' THEN 40 ELSE 30 END / 10000.0 ELSE 0 END, 6) AS net_return_5d,
 round(CASE WHEN adv > 0 AND 5.0 > adv * 0.02 / 100000.0 * 100 THEN adv * 0.02 / 100000.0 * 100 ELSE 5.0 END, 6) AS size_pct FROM q""")
def l13_net_returns(spark: SparkSession, d: str) -> DataFrame:
    bars = src.candles(spark, d)
    snaps = src.snapshots(bars).select("ticker", "date", F.col("close").alias("price"), (F.col("avg_volume_10d") * F.col("close")).alias("adv"))
    rows = scored_lists(spark, d).join(exits(bars).select("list_type", "ticker", "date", "exit_type"), ["list_type", "ticker", "date"])
    rows = rows.join(outcomes.with_bars(rank_lists(bars).select("ticker", "date").distinct(), snaps), ["ticker", "date"])
    rows = rows.withColumn("tier", outcomes.slippage_tier(F.col("price"), F.coalesce("adv", F.lit(0.0))))
    size = outcomes.capped_size(F.lit(5.0), F.col("adv"), F.lit(100_000.0))
    return rows.select("list_type", "ticker", "date", "tier", F.round(outcomes.net_return(F.col("return_5d"), F.col("tier"), F.col("exit_type")), 6).alias("net_return_5d"), F.round(size, 6).alias("size_pct"))


@register(with_(BARS, LISTS) + """, o AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM candles),
g AS (SELECT list_type, ticker, date, n - lag(n) OVER (PARTITION BY ticker, list_type ORDER BY date) AS gap FROM rank_lists JOIN o USING (ticker, date))
SELECT list_type, ticker, date, CAST(gap AS BIGINT) AS sessions_since, coalesce(gap > 21, true) AS is_primary FROM g""")
def l10_primary_observations(spark: SparkSession, d: str) -> DataFrame:
    bars = src.candles(spark, d)
    p = outcomes.primary_observations(rank_lists(bars), bars.select("ticker", "date", ind.ordinal().alias("ordinal")))
    return p.select("list_type", "ticker", "date", F.col("sessions_since").cast("long").alias("sessions_since"), "is_primary")


@register(with_(BARS, LISTS) + """SELECT ticker, date, list_type, row_number() OVER (PARTITION BY ticker, date ORDER BY CASE list_type WHEN 'leaders' THEN 1 WHEN 'momentum' THEN 2 ELSE 3 END) > 1 AS cross_list_duplicate FROM rank_lists""")
def f5_cross_list_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.cross_list_duplicates(rank_lists(src.candles(spark, d))).select("ticker", "date", "list_type", "cross_list_duplicate")


@register(with_(BARS, LISTS) + """, o AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM candles), s AS (SELECT r.*, o.n FROM rank_lists r JOIN o USING (ticker, date))
SELECT a.ticker, a.list_type, a.date AS older, b.date AS newer, CAST(b.n - a.n AS BIGINT) AS sessions FROM s a JOIN s b ON a.ticker = b.ticker AND a.list_type = b.list_type AND b.n - a.n BETWEEN 1 AND 3""")
def l11_duplicate_signals(spark: SparkSession, d: str) -> DataFrame:
    bars = src.candles(spark, d)
    s = rank_lists(bars).join(bars.select("ticker", "date", ind.ordinal().alias("n")), ["ticker", "date"]).select("ticker", "list_type", "date", "n")
    older = s.select("ticker", "list_type", F.col("date").alias("older"), F.col("n").alias("m"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + 3)).alias("n"))
    return older.join(s.withColumnRenamed("date", "newer"), ["ticker", "list_type", "n"]).select("ticker", "list_type", "older", "newer", (F.col("n") - F.col("m")).cast("long").alias("sessions"))


_ACTIONS = """, a AS (SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS ex_date, CASE WHEN l_discount > 0.05 THEN 'split' ELSE 'reverse_split' END AS action_type,
 CASE WHEN l_discount > 0.05 THEN 2.0 ELSE 0.5 END AS ratio FROM lineitem WHERE l_tax = 0.08 AND l_quantity = 50)"""


@register(with_(BARS, LISTS, OUTCOMES) + _ACTIONS + """, f AS (SELECT o.list_type, o.ticker, o.date, product(CASE action_type WHEN 'split' THEN 1 / ratio ELSE ratio END) AS f, count(*) AS n
 FROM outcomes o JOIN a ON a.ticker = o.ticker AND a.ex_date BETWEEN o.date AND o.date + 10 GROUP BY ALL)
SELECT o.list_type, o.ticker, o.date, round(return_5d * coalesce(f, 1), 6) AS return_5d, coalesce(n, 0) AS action_count FROM outcomes o LEFT JOIN f USING (list_type, ticker, date)""")
def l9_c16_split_adjustment(spark: SparkSession, d: str) -> DataFrame:
    lines = src.table(spark, d, "lineitem").where("l_tax = 0.08 and l_quantity = 50")
    split = F.col("l_discount") > 0.05
    actions = lines.select(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("ex_date"),
        F.when(split, "split").otherwise("reverse_split").alias("action_type"), F.when(split, 2.0).otherwise(0.5).alias("ratio"),
    )
    rows = outcomes.adjust_for_splits(scored_lists(spark, d), actions, 5, "return_5d")
    return rows.select("list_type", "ticker", "date", F.round("return_5d", 6).alias("return_5d"), "action_count")


@register(with_(BARS, LISTS) + """, v AS (SELECT ticker, list_type, date, round(close * 0.98, 6) AS lo, close AS hi, round(close * (0.80 + rank * 0.06), 6) AS stop, CASE WHEN rank < 3 THEN round(close * 1.5, 6) END AS t1, round(close * 1.4, 6) AS t2,
 CASE list_type WHEN 'ep' THEN ' ep_tier1 ' ELSE upper(list_type) END AS setup FROM rank_lists JOIN candles USING (ticker, date))
SELECT ticker, list_type, date, CASE WHEN stop >= lo THEN 'stop_too_high' WHEN t1 IS NULL THEN 'no_target' WHEN t1 <= hi THEN 'target_too_low' WHEN t2 > 0 AND t2 <= t1 THEN 'second_below_first'
 WHEN (t1 - hi) / (lo - stop) < CASE WHEN upper(trim(setup)) LIKE 'EP%' THEN 2.5 ELSE 3.0 END THEN 'reward_too_small' END AS error FROM v""")
def b17_level_validation(spark: SparkSession, d: str) -> DataFrame:
    bars = src.candles(spark, d)
    c, rank = F.col("close"), F.col("rank")
    rows = outcomes.with_bars(rank_lists(bars), bars.select("ticker", "date", "close"))
    setup = F.when(F.col("list_type") == "ep", " ep_tier1 ").otherwise(F.upper("list_type"))
    error = outcomes.level_error(F.round(c * 0.98, 6), c, F.round(c * (F.lit(0.8) + rank * 0.06), 6), F.when(rank < 3, F.round(c * 1.5, 6)), F.round(c * 1.4, 6), setup)
    return rows.select("ticker", "list_type", "date", error.alias("error"))


_REGIME = """, w AS (SELECT date, close, lag(close) OVER o AS p, lag(volume) OVER o AS pv, volume, CASE WHEN count(*) OVER f50 >= 50 THEN avg(close) OVER f50 ELSE 0 END AS m50, CASE WHEN count(*) OVER f200 >= 200 THEN avg(close) OVER f200 ELSE 0 END AS m200,
 max(close) OVER f250 AS top, row_number() OVER o AS n FROM spy WINDOW o AS (ORDER BY date), f50 AS (ORDER BY date ROWS 49 PRECEDING), f200 AS (ORDER BY date ROWS 199 PRECEDING), f250 AS (ORDER BY date ROWS 249 PRECEDING)),
i AS (SELECT date, n, CASE WHEN m50 = 0 THEN 0 ELSE (close - m50) / m50 * 100 END AS a, CASE WHEN m200 = 0 THEN 0 ELSE (close - m200) / m200 * 100 END AS b, m50 > m200 AS x, (close / top - 1) * 100 AS dd,
 sum(CASE WHEN close < p AND volume > pv THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS 19 PRECEDING) AS dist FROM w),
r AS (SELECT date, n, dd, round(( CASE WHEN a > 5 THEN 2.5 WHEN a >= 0 THEN 1.25 ELSE 0 END + CASE WHEN b > 5 THEN 2.5 WHEN b >= 0 THEN 1.25 ELSE 0 END + CASE WHEN x THEN 1.0 ELSE 0 END
 + CASE WHEN dist <= 2 THEN 1.5 WHEN dist <= 4 THEN 0.75 WHEN dist <= 6 THEN 0.375 ELSE 0 END + 0.375 + 0.375 + 0.5 + 0.5 + 0.25 + 0.25) / 12.0, 9) AS raw FROM i)"""


def regime_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Index-only market inputs by date; the inputs that these tables lack are constants."""
    rows = ind.with_distribution_flag(src.benchmark(spark, d).withColumn("ticker", F.lit("SPY")))
    rows = rows.withColumns({"m50": ind.sma(50), "m200": ind.sma(200), "drawdown": ind.drawdown_percent(), "distribution_days": ind.distribution_days()})
    a, b, cross = ind.distance_percent(F.col("close"), F.col("m50")), ind.distance_percent(F.col("close"), F.col("m200")), F.col("m50") > F.col("m200")
    fixed = {"breadth50": F.lit(50.0), "breadth200": F.lit(40.0), "qqq_rs": F.lit(1.0), "iwm_rs": F.lit(1.0), "vix_level": F.lit(None).cast("double"), "vix_change": F.lit(None).cast("double"), "tick_min": F.lit(None).cast("double"), "breadth_velocity": F.lit(0.0)}
    return rows.withColumns({"spy_pct_sma50": a, "spy_pct_sma200": b, "qqq_pct_sma50": a, "qqq_pct_sma200": b, "spy_cross": cross, "qqq_cross": cross, **fixed})


@register("WITH RECURSIVE" + with_(BARS).removeprefix("WITH") + _REGIME + """, s AS (SELECT n, date, dd, raw, raw AS s FROM r WHERE n = 1
 UNION ALL SELECT r.n, r.date, r.dd, r.raw, CASE WHEN r.raw - s.s < -0.25 THEN r.raw ELSE 0.5 * r.raw + 0.5 * s.s END FROM s JOIN r ON r.n = s.n + 1),
l AS (SELECT *, CASE WHEN s >= 0.8 THEN 4 WHEN s >= 0.6 THEN 3 WHEN s >= 0.4 THEN 2 WHEN s >= 0.2 THEN 1 ELSE 0 END AS k FROM s)
SELECT date, round(raw, 6) AS raw, round(s, 6) AS smoothed, CASE least(k, CASE WHEN dd < -30 THEN 0 WHEN dd < -20 THEN 1 ELSE 4 END) WHEN 4 THEN 'strong_bull' WHEN 3 THEN 'bull' WHEN 2 THEN 'neutral' WHEN 1 THEN 'correction' ELSE 'bear' END AS label FROM l""")
def l2_j1_regime(spark: SparkSession, d: str) -> DataFrame:
    rows = regime_inputs(spark, d).withColumn("raw", F.round(market.raw_bull_strength(), 9))
    done = market.smoothed(rows.select("date", "raw")).join(rows.select("date", "drawdown"), "date")
    return done.select("date", F.round("raw", 6).alias("raw"), F.round("smoothed", 6).alias("smoothed"), market.regime_label(F.col("smoothed"), F.col("drawdown")).alias("label"))


@register(with_(BARS) + _REGIME + """SELECT date, CASE WHEN raw >= 0.4 THEN 'full' WHEN raw >= 0.2 THEN 'ep_only' ELSE 'halt' END AS gate FROM r""")
def l4_circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    label = market.regime_label(F.round(market.raw_bull_strength(), 9))
    return regime_inputs(spark, d).select("date", market.circuit_breaker(label, F.lit(None).cast("double")).alias("gate"))


_RANK = """, x AS (SELECT s.*, coalesce(distance_52w_high, -100) AS d1, coalesce(distance_52w_high, -50) AS d2, 0.65 * coalesce(perf_3m, 0) + 0.35 * coalesce(perf_6m, 0) AS bl, greatest(0, least(1, (coalesce(relative_volume, 1) - 0.5) / 4.5)) AS vol,
 coalesce(change_pct, 0) AS ch, coalesce(gap_pct, 0) AS gp, coalesce(rsi14, 50) AS rs FROM snaps s WHERE close > 5 AND coalesce(avg_volume_10d * close, 0) >= 1e6),
f AS (SELECT *, greatest(0, least(1, (d1 + 30) / 30)) AS breakout,
 CASE WHEN bl <= 0 THEN greatest(0, least(1, (bl + 20) / 20)) * 0.2 WHEN bl <= 30 THEN 0.2 + greatest(0, least(1, bl / 30)) * 0.4 ELSE 0.6 + greatest(0, least(1, (bl - 30) / 70)) * 0.4 END AS strength,
 vol * CASE WHEN ch > 2 AND gp > 0 THEN 1.0 WHEN ch > 0.5 THEN 0.8 WHEN ch >= -0.5 THEN 0.5 WHEN ch >= -2 THEN 0.2 ELSE 0 END AS confirmation,
 0.5 * CASE WHEN rs > 85 THEN 0.7 WHEN rs >= 60 THEN 1.0 WHEN rs >= 50 THEN 0.6 WHEN rs >= 40 THEN 0.3 ELSE 0.1 END + 0.5 * greatest(0, least(1, (d2 + 25) / 25)) AS trend,
 CASE WHEN d2 < -5 THEN 1.0 ELSE CASE CAST(rs > 75 AS INT) + CAST(CASE WHEN coalesce(sma50, 0) > 0 AND close > 0 THEN (close - sma50) / sma50 * 100 ELSE 0 END > 15 AS INT) + CAST(coalesce(perf_3m, 0) > 25 AS INT) WHEN 3 THEN 0.55 WHEN 2 THEN 0.75 WHEN 1 THEN 0.9 ELSE 1.0 END END AS penalty FROM x),
g AS (SELECT *, round(least(100, greatest(0, least(1, (0.3 * breakout + 0.25 * strength + 0.1 * vol + 0.15 * confirmation + 0.2 * trend) * penalty)) * 1.05 * 100), 6) AS score FROM f)"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Momentum scores of every snapshot under a fixed bull regime, neutral sectors and no leaders.

    Unit volumes here are small, so the least daily value is a million."""
    s = src.snapshots(src.candles(spark, d))
    s = s.where((F.col("close") > 5) & (F.coalesce(F.col("avg_volume_10d") * F.col("close"), F.lit(0.0)) >= 1e6))
    return market.momentum_scores(market.momentum_factors(s).withColumns({"regime": F.lit("bull"), "sector_label": F.lit("NEUTRAL"), "in_leaders": F.lit(False)}))


@register(with_(BARS, SNAPS) + _RANK + "SELECT ticker, date, score, CAST(rank AS BIGINT) AS rank FROM (SELECT ticker, date, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM g) WHERE rank <= 10")
def l7_momentum_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked(spark, d).withColumn("score", F.round("score", 6))
    return market.top_per(rows, 10, [F.desc("score"), F.asc("ticker")], "date").select("ticker", "date", "score", F.col("rank").cast("long").alias("rank"))


@register(with_(BARS, LISTS, OUTCOMES) + """, v AS (SELECT list_type, ticker, date, row_number() OVER (ORDER BY date, list_type, ticker) - 1 AS row, count(*) OVER () AS total FROM outcomes),
f AS (SELECT v.*, fold, total // 5 AS size FROM v, range(1, 5) t(fold)), s AS (SELECT *, CASE WHEN row < size * fold THEN 'train' WHEN row >= size * fold + 10 AND row < CASE WHEN fold < 4 THEN size * fold + 10 + size ELSE total END THEN 'valid' END AS side FROM f),
p AS (SELECT * FROM s WHERE side = 'valid' OR (side = 'train' AND NOT EXISTS (SELECT 1 FROM s z WHERE z.fold = s.fold AND z.side = 'valid' AND z.ticker = s.ticker)))
SELECT CAST(fold AS INT) AS fold, side, count(*) AS n, min(row) AS first_row, max(row) AS last_row FROM p GROUP BY fold, side""")
def i5_g6_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.walk_forward(scored_lists(spark, d).select("date", "list_type", "ticker"), ["date", "list_type", "ticker"], 4, 10, "ticker")
    return rows.groupBy("fold", "side").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


@register("")
def i2_i8_logistic_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lists(spark, d).where("return_5d is not null").select(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("score"))).alias("s"), (F.lit(4) - F.col("rank")).cast("double").alias("place"), (F.col("return_5d") > 0).cast("double").alias("y")
    ).cache()
    weights = learning.bounded_weights(rows, ["s", "place"], "y")
    names = spark.createDataFrame(list(zip(["s", "place"], weights, strict=True)), "feature string, weight double")
    return names.join(rows.agg(F.count(F.lit(1)).alias("samples")))


@register(with_(BARS, LISTS, OUTCOMES) + "SELECT count(*) AS n, count(*) FILTER (WHERE score IS NULL OR NOT isfinite(score)) AS not_finite, count(*) FILTER (WHERE (return_5d > 0) IS NULL) AS not_binary, count(*) >= 200 AND count(*) FILTER (WHERE score IS NULL OR NOT isfinite(score)) = 0 AS usable FROM outcomes WHERE return_5d IS NOT NULL")
def i9_input_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lists(spark, d).where("return_5d is not null").withColumn("won", (F.col("return_5d") > 0).cast("int"))
    return evaluation.input_problems(rows, ["score"], "won")


@register(with_(BARS, LISTS, OUTCOMES) + """SELECT list_type, ticker, date, CASE WHEN return_5d IS NULL THEN 'tracking' WHEN return_5d >= 0.05 THEN 'big winner' WHEN return_5d >= 0.03 THEN 'strong winner' WHEN return_5d >= 0.01 THEN 'winner' WHEN return_5d >= -0.01 THEN 'flat' WHEN return_5d >= -0.03 THEN 'small loss' ELSE 'stopped out' END AS badge,
 CAST(CAST(trunc(return_5d * 10000 + 0.5) AS BIGINT) AS DOUBLE) AS breakeven_bps, coalesce(return_20d, return_10d, return_5d, return_1d) IS NULL AS pending FROM outcomes""")
def h31_h14_badges(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("return_5d")
    return scored_lists(spark, d).select("list_type", "ticker", "date", outcomes.badge(r).alias("badge"), fn.breakeven_bps(r).alias("breakeven_bps"), F.coalesce("return_20d", "return_10d", "return_5d", "return_1d").isNull().alias("pending"))


@register(with_(BARS, LISTS) + """, n AS (SELECT date, list_type, ticker, rank, score + 1 AS score FROM rank_lists WHERE rank = 1), o AS (SELECT date, list_type, ticker, rank, score FROM rank_lists)
SELECT date, list_type, ticker, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.date = o.date AND n.list_type = o.list_type AND n.ticker = o.ticker) UNION ALL SELECT * FROM n)""")
def a13_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = rank_lists(src.candles(spark, d)).select("date", "list_type", "ticker", "rank", "score")
    new = old.where("rank = 1").withColumn("score", F.col("score") + 1)
    out = sinks.upsert(old, new, ["date", "list_type", "ticker"])
    return out.select("date", "list_type", "ticker", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register(with_(BARS, LISTS) + """, o AS (SELECT * FROM rank_lists WHERE rank < 3), n AS (SELECT * FROM rank_lists WHERE rank > 1)
SELECT date, list_type, CAST(rank AS BIGINT) AS rank, ticker FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.date = n.date AND o.list_type = n.list_type AND o.ticker = n.ticker))""")
def a14_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = rank_lists(src.candles(spark, d)).select("date", "list_type", F.col("rank").cast("long").alias("rank"), "ticker")
    return sinks.insert_if_absent(rows.where("rank < 3"), rows.where("rank > 1"), ["date", "list_type", "ticker"])


@register(with_(BARS, LISTS) + """, e AS (SELECT date, string_agg(ticker, ' | ' ORDER BY list_type, rank) AS memo, count(*) AS n FROM rank_lists GROUP BY date) SELECT date, memo, n FROM e""")
def l23_d22_memo(spark: SparkSession, d: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("list_type", "rank", "ticker")))
    return rank_lists(src.candles(spark, d)).groupBy("date").agg(F.array_join(F.transform(items, lambda x: x["ticker"]), " | ").alias("memo"), F.count(F.lit(1)).alias("n"))


@register(with_(BARS, LISTS) + "SELECT DISTINCT ticker FROM rank_lists WHERE date > (SELECT max(date) FROM rank_lists) - 30")
def g7_c9_recent_tickers(spark: SparkSession, d: str) -> DataFrame:
    rows = rank_lists(src.candles(spark, d)).select("date", "ticker")
    last = rows.agg(F.max("date").alias("last"))
    return rows.join(F.broadcast(last), F.col("date") > F.date_sub("last", 30)).select("ticker").distinct()


