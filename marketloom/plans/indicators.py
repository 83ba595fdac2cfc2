"""Registered queries over daily series, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import indicators as ind
from ..operators import market
from ..operators.asof import as_of
from ..sources import market as src
from .sql import BARS, SNAPS, with_

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or (name if isinstance(name, str) else "value"))


@register(with_(BARS) + "SELECT ticker, date, open, high, low, close, volume FROM candles")
def a10_candles(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d)


@register(with_(BARS) + """, last AS (
  SELECT ticker, close, avg(close) OVER w AS sma, count(*) OVER w AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k
  FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING))
SELECT count(*) AS tickers, round(100.0 * avg(CASE WHEN close > sma THEN 1.0 ELSE 0.0 END), 6) AS breadth FROM last WHERE k = 1 AND n >= 50""")
def d11_breadth_sma50(spark: SparkSession, d: str) -> DataFrame:
    rows = ind.last_bars(ind.with_sma(src.candles(spark, d), 50)).where("bars_50 >= 50")
    return rows.agg(F.count(F.lit(1)).alias("tickers"), F.round(ind.breadth(rows, 50), 6).alias("breadth"))


@register(with_(BARS) + """SELECT ticker, date, round(sma, 6) AS sma20 FROM (
  SELECT ticker, date, avg(close) OVER w AS sma, count(*) OVER w AS n FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) WHERE n = 20""")
def e3_sma_series(spark: SparkSession, d: str) -> DataFrame:
    rows = ind.with_sma(src.candles(spark, d), 20).where("bars_20 = 20")
    return rows.select("ticker", "date", F.round("sma_20", 6).alias("sma20"))


@register(with_(BARS) + """SELECT ticker, date, round(coalesce(close / nullif(lag(close, 21) OVER w, 0) - 1, 0), 6) AS r21,
  round(coalesce(close / nullif(lag(close, 63) OVER w, 0) - 1, 0), 6) AS r63 FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def e4_session_returns(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d).select("ticker", "date", F.round(ind.session_return(21), 6).alias("r21"), F.round(ind.session_return(63), 6).alias("r63"))


@register(with_(BARS) + """, f AS (
  SELECT ticker, date, close, CASE WHEN count(*) OVER w50 >= 50 THEN avg(close) OVER w50 ELSE 0 END AS m50 FROM candles WINDOW w50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING))
SELECT ticker, date, round(CASE WHEN m50 = 0 THEN 0 ELSE (close - m50) / m50 * 100 END, 6) AS pct_from_sma50 FROM f""")
def e5_distance_from_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = src.candles(spark, d).withColumn("m50", ind.sma(50))
    return rows.select("ticker", "date", F.round(ind.distance_percent(F.col("close"), F.col("m50")), 6).alias("pct_from_sma50"))


@register(with_(BARS) + """, f AS (SELECT ticker, date, CASE WHEN close < lag(close) OVER w AND volume > lag(volume) OVER w THEN 1 ELSE 0 END AS hit FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, CAST(sum(hit) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS BIGINT) AS distribution_days FROM f""")
def e6_distribution_days(spark: SparkSession, d: str) -> DataFrame:
    rows = ind.with_distribution_flag(src.candles(spark, d))
    return rows.select("ticker", "date", ind.distribution_days().alias("distribution_days"))


@register(with_(BARS) + """, v AS (SELECT date, ticker, volume FROM candles), r AS (
  SELECT date, ticker, volume, rank() OVER (PARTITION BY date ORDER BY volume) - 1 + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 AS o, count(*) OVER (PARTITION BY date) AS n FROM v)
SELECT date, ticker, round(CASE WHEN n = 1 THEN 1.0 ELSE o / (n - 1) END, 6) AS percentile FROM r""")
def e7_percentile_rank_ties(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d).select("date", "ticker", F.round(ind.percentile_rank("volume", "date"), 6).alias("percentile"))


@register(with_(BARS) + """, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles), f AS (
  SELECT *, avg(close) OVER w AS m, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING))
SELECT round(avg(CASE WHEN close > m THEN 100.0 ELSE 0.0 END) FILTER (WHERE k = 1 AND n >= 50) - avg(CASE WHEN close > m THEN 100.0 ELSE 0.0 END) FILTER (WHERE k = 6 AND n >= 50), 6) AS breadth_velocity FROM f""")
def e8_breadth_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Today's breadth less that without each ticker's last five bars."""
    rows = ind.with_sma(src.candles(spark, d), 50).withColumn("k", F.row_number().over(src.over(F.desc("date")))).where("k in (1, 6) and bars_50 >= 50")
    share = lambda k: F.avg(F.when(F.col("k") == k, F.when(F.col("close") > F.col("sma_50"), 100.0).otherwise(0.0)))
    return rows.agg(F.round(share(1) - share(6), 6).alias("breadth_velocity"))


@register(with_(BARS) + """, f AS (SELECT date, close, avg(close) OVER w AS m, count(*) OVER w AS n FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING)),
b AS (SELECT date, avg(CASE WHEN close > m THEN 100.0 ELSE 0.0 END) AS breadth FROM f WHERE n >= 50 GROUP BY date)
SELECT t.date, round(t.breadth, 6) AS breadth, round(coalesce(t.breadth - arg_max(p.breadth, p.date), 0), 6) AS breadth_change
FROM b t LEFT JOIN b p ON p.date BETWEEN t.date - 10 AND t.date - 7 GROUP BY t.date, t.breadth""")
def e9_breadth_offset(spark: SparkSession, d: str) -> DataFrame:
    """Breadth by date against the first available of seven to ten days before; an equi-join on the
    date that is so many days ahead, not a range join."""
    rows = ind.with_sma(src.candles(spark, d), 50).where("bars_50 >= 50")
    b = rows.groupBy("date").agg(F.avg(F.when(F.col("close") > F.col("sma_50"), 100.0).otherwise(0.0)).alias("breadth"))
    past = b.select(F.explode(F.array(*(F.struct(F.date_add("date", n).alias("date"), F.lit(n).alias("n")) for n in (7, 8, 9, 10)))).alias("x"), F.col("breadth").alias("past"))
    past = past.groupBy(F.col("x.date").alias("date")).agg(F.min_by("past", "x.n").alias("past"))
    out = b.join(past, "date", "left")
    return out.select("date", F.round("breadth", 6).alias("breadth"), F.round(F.coalesce(F.col("breadth") - F.col("past"), F.lit(0.0)), 6).alias("breadth_change"))


@register(with_(BARS) + """SELECT ticker, date, coalesce(high > hb AND high > ha, false) AS swing_high, coalesce(low < lb AND low < la, false) AS swing_low FROM (
  SELECT ticker, date, high, low, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la, count(*) OVER b AS nb, count(*) OVER a AS na
  FROM candles WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
WHERE nb = 3 AND na = 3 AND ((high > hb AND high > ha) OR (low < lb AND low < la))""")
def e13_swing_points(spark: SparkSession, d: str) -> DataFrame:
    return ind.swings(src.candles(spark, d)).select("ticker", "date", "swing_high", "swing_low")


@register(with_(BARS) + """, v AS (SELECT date, close, lag(close) OVER (ORDER BY date) AS p FROM spy) SELECT date, (close - p) / p * 100 AS change_pct FROM v WHERE p IS NOT NULL""")
def e10_rate_of_change(spark: SparkSession, d: str) -> DataFrame:
    b = src.benchmark(spark, d).withColumn("ticker", F.lit("SPY"))
    p = F.lag("close").over(src.over())
    return b.withColumn("p", p).where("p is not null").select("date", F.coalesce(F.try_divide(F.col("close") - F.col("p"), F.col("p")) * 100, F.lit(0.0)).alias("change_pct"))


@register(with_(BARS) + """, v AS (SELECT date, close, lag(close, 5) OVER w AS c5, lag(close, 10) OVER w AS c10, lag(close, 20) OVER w AS c20 FROM spy WINDOW w AS (ORDER BY date))
SELECT round(avg(CASE WHEN close > c5 THEN 1.0 WHEN c5 IS NOT NULL THEN 0.0 END), 6) AS win_5, round(avg(CASE WHEN close > c10 THEN 1.0 WHEN c10 IS NOT NULL THEN 0.0 END), 6) AS win_10,
 round(avg(CASE WHEN close > c20 THEN 1.0 WHEN c20 IS NOT NULL THEN 0.0 END), 6) AS win_20, round(median(close / c5 - 1), 6) AS median_5, round(median(close / c10 - 1), 6) AS median_10, round(median(close / c20 - 1), 6) AS median_20 FROM v""")
def l20_index_base_rates(spark: SparkSession, d: str) -> DataFrame:
    b, out = src.benchmark(spark, d).withColumn("ticker", F.lit("SPY")), []
    for n in (5, 10, 20):
        b = b.withColumn(f"r{n}", F.try_divide("close", F.lag("close", n).over(src.over())) - 1)
        out.append(F.round(F.avg(F.when(F.col(f"r{n}") > 0, 1.0).when(F.col(f"r{n}").isNotNull(), 0.0)), 6).alias(f"win_{n}"))
        out.append(F.round(F.percentile(f"r{n}", F.lit(0.5)), 6).alias(f"median_{n}"))
    return b.agg(*out)


@register(with_(BARS) + """, j AS (SELECT s.ticker, s.date, s.close, b.close AS base FROM sectors s JOIN spy b ON s.date = b.date)
SELECT ticker, date, round(close / first_value(close) OVER w / (base / first_value(base) OVER w), 6) AS rs FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def c15_relative_strength(spark: SparkSession, d: str) -> DataFrame:
    rs = ind.relative_strength(src.sector_series(spark, d), src.benchmark(spark, d))
    return rs.select("ticker", "date", F.round("rs", 6).alias("rs"))


@register(with_(BARS) + """, a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM sectors), b AS (SELECT close AS base, row_number() OVER (ORDER BY date) AS k FROM spy)
SELECT ticker, date, round(close / nullif(base, 0), 6) AS ratio FROM a JOIN b USING (k)""")
def c15_relative_strength_by_position(spark: SparkSession, d: str) -> DataFrame:
    rs = ind.relative_strength_by_position(src.sector_series(spark, d), src.benchmark(spark, d))
    return rs.select("ticker", "date", F.round("ratio", 6).alias("ratio"))


@register(with_(BARS) + """SELECT ticker, date, round((close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS 249 PRECEDING) - 1) * 100, 6) AS drawdown_pct FROM candles""")
def d17_trailing_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d).select("ticker", "date", F.round(ind.drawdown_percent(), 6).alias("drawdown_pct"))


@register(with_(BARS, SNAPS) + """SELECT ticker, date, round(sma200, 6) AS sma200, round(high_52w, 6) AS high_52w, round(perf_3m, 6) AS perf_3m, round(relative_volume, 6) AS relative_volume,
 round(gap_pct, 6) AS gap_pct, round(rsi14, 6) AS rsi14, round(atr, 6) AS atr FROM snaps""")
def b13_snapshots(spark: SparkSession, d: str) -> DataFrame:
    names = ["sma200", "high_52w", "perf_3m", "relative_volume", "gap_pct", "rsi14", "atr"]
    return src.snapshots(src.candles(spark, d)).select("ticker", "date", *(F.round(n, 6).alias(n) for n in names))


_SCREEN = {
    "b3_b4_momentum_screen": (market.momentum_screen, """close >= 10 AND close > sma20 AND close > sma50 AND sma200 > sma200_prev AND perf_1m >= 5 AND perf_3m >= 15 AND perf_6m >= 20
 AND (sma150 IS NULL OR sma200 IS NULL OR (sma50 > sma150 AND sma150 > sma200)) AND close * avg_volume_10d >= 1e6 AND close >= 0.75 * high_52w
 AND close <= CASE WHEN coalesce(atr, 0) > 0 THEN high_52w + 2 * atr ELSE 1.05 * high_52w END AND (atr IS NULL OR high - low <= 1.5 * atr)"""),
    "b5_episodic_screen": (market.episodic_screen, """close >= 5 AND gap_pct >= 3 AND change_pct >= 5 AND close > open AND relative_volume >= 1 AND close * volume >= 1e6 AND high > low
 AND (close - low) / (high - low) >= 0.7"""),
    "b6_leaders_screen": (market.leaders_screen, """close >= 20 AND rsi14 >= 50 AND close > sma50 AND perf_3m > 0 AND perf_6m > 0
 AND (sma150 IS NULL OR sma200 IS NULL OR (close > sma150 AND sma150 > sma200)) AND close >= 0.75 * high_52w"""),
}


def _screen_query(name, screen):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return screen(src.snapshots(src.candles(spark, d))).select("ticker", "date", "close")

    query.__name__ = name
    return query


for _name, (_screen, _where) in _SCREEN.items():
    register(with_(BARS, SNAPS) + f"SELECT ticker, date, close FROM snaps WHERE {_where}")(_screen_query(_name, _screen))


@register(with_(BARS, SNAPS) + """, x AS (SELECT *, (high - low) / CASE WHEN atr > 0 THEN atr END AS m, lag(high_52w) OVER (PARTITION BY ticker ORDER BY date) AS hb FROM snaps), r AS (
 SELECT ticker, date, CASE WHEN m >= 3 AND hb > 0 AND close > hb AND perf_3m > 50 THEN 'climax_top' WHEN m >= 2 AND hb > 0 AND perf_3m > 40 THEN 'WIDE_RANGE_WARNING' END AS rule FROM x)
SELECT CASE rule WHEN 'climax_top' THEN 'eliminated' WHEN 'WIDE_RANGE_WARNING' THEN 'flagged' ELSE 'passed' END AS status, rule, count(*) AS n FROM r GROUP BY ALL""")
def b8_d14_stage1_summary(spark: SparkSession, d: str) -> DataFrame:
    s = src.snapshots(src.candles(spark, d)).withColumn("high_52w_before", F.lag("high_52w").over(src.over()))
    return market.stage1(s, "momentum").groupBy("status", "rule").agg(F.count(F.lit(1)).alias("n"))


@register(with_(BARS, SNAPS) + """, y AS (SELECT *, sum(CAST(round(close * volume * 100) AS BIGINT)) OVER v AS sales, sum(CAST(round((high - low) * volume * 100) AS BIGINT)) OVER v AS earned, lag(high_52w) OVER w AS hb,
 (high - low) / CASE WHEN atr > 0 THEN atr END AS m FROM snaps WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING)),
 x AS (SELECT *, (sales / nullif(lag(sales, 63) OVER w, 0) - 1) * 100 AS rg, (earned / nullif(lag(earned, 63) OVER w, 0) - 1) * 100 AS eg FROM y WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 r AS (SELECT ticker, date, CASE WHEN m >= 3 AND hb > 0 AND close > hb AND perf_3m > 50 THEN 'climax_top' WHEN m >= 2 AND hb > 0 AND perf_3m > 40 THEN 'WIDE_RANGE_WARNING' WHEN rg > 0 AND rg < 5 AND eg > 3 * rg THEN 'FINANCIAL_ENGINEERING_RISK' END AS rule FROM x)
SELECT ticker, date, CASE rule WHEN 'climax_top' THEN 'eliminated' ELSE 'flagged' END AS status, rule FROM r WHERE rule IS NOT NULL""")
def b8_leaders_stage1(spark: SparkSession, d: str) -> DataFrame:
    """Bars that the leaders' rules eliminate or flag. Traded value and traded range of 63 bars stand for revenue and earnings."""
    w = src.over()
    sums = {n: F.sum(F.round(x * F.col("volume") * 100).cast("long")).over(w.rowsBetween(-62, 0)) for n, x in (("sales", F.col("close")), ("earned", F.col("high") - F.col("low")))}
    s = src.snapshots(src.candles(spark, d)).withColumns(sums | {"high_52w_before": F.lag("high_52w").over(w)})
    growth = lambda c: (F.try_divide(F.col(c), F.lag(c, 63).over(w)) - 1) * 100
    return market.stage1(s.withColumns({"revenue_growth": growth("sales"), "eps_growth": growth("earned")}), "leaders").where("rule is not null").select("ticker", "date", "status", "rule")


@register(with_(BARS, SNAPS) + """SELECT ticker, date, list_filter([CASE WHEN close < 100 OR close > 60000 THEN 'close out of range' END, CASE WHEN gap_pct < -90 OR gap_pct > 900 THEN 'gap_pct out of range' END,
 CASE WHEN rsi14 < 10 OR rsi14 > 90 THEN 'rsi14 out of range' END], lambda x: x IS NOT NULL) AS errors FROM snaps""")
def b9_row_errors(spark: SparkSession, d: str) -> DataFrame:
    errors = market.row_errors({"close": (100, 60000), "gap_pct": (-90, 900), "rsi14": (10, 90)})
    return src.snapshots(src.candles(spark, d)).select("ticker", "date", errors.alias("errors"))


@register(with_(BARS, SNAPS) + """SELECT ticker, date, round(coalesce(sma150, CASE WHEN (SELECT count(sma150) FROM snaps) = 0 THEN sma200 * 1.05 END), 6) AS sma150 FROM snaps""")
def b7_mean150_proxy(spark: SparkSession, d: str) -> DataFrame:
    return market.mean150_proxy(src.snapshots(src.candles(spark, d))).select("ticker", "date", F.round("sma150", 6).alias("sma150"))


@register(with_(BARS, SNAPS) + """SELECT count(*) AS evaluated, count(*) FILTER (WHERE close > 60000) AS rejected, count(*) FILTER (WHERE close > 60000) > 3 AS alert FROM snaps""")
def b11_d15_batch_alert(spark: SparkSession, d: str) -> DataFrame:
    bad = F.size(market.row_errors({"close": (0, 60000)})) > 0
    rows = src.snapshots(src.candles(spark, d)).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(bad).alias("rejected"))
    return rows.withColumn("alert", F.col("rejected") > 3)


@register(with_(BARS) + """, c AS (SELECT ticker, max(date) AS last, count(*) AS n FROM candles GROUP BY ticker)
SELECT l.ticker, coalesce(c.last + 1, DATE '2001-12-31' - 180) AS from_date, coalesce(c.last + 1, DATE '2001-12-31' - 180) > DATE '2001-12-31' AS up_to_date FROM listed l LEFT JOIN c USING (ticker)""")
def a24_next_ingestion(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import next_dates

    latest = src.candles(spark, d).groupBy("ticker").agg(F.max("date").alias("latest"))
    return next_dates(latest, src.tickers(spark, d), F.lit("2001-12-31").cast("date"), 180)


@register(with_(BARS) + """SELECT l.ticker, coalesce(CASE WHEN c.n < 2 * 252 * 0.8 THEN DATE '1995-01-01' ELSE c.last + 1 END, DATE '1995-01-01') AS from_date
FROM listed l LEFT JOIN (SELECT ticker, max(date) AS last, count(*) AS n FROM candles GROUP BY ticker) c USING (ticker)""")
def a25_gap_aware_backfill(spark: SparkSession, d: str) -> DataFrame:
    c = src.candles(spark, d).groupBy("ticker").agg(F.max("date").alias("latest"), F.count(F.lit(1)).alias("n"))
    cutoff = F.lit("1995-01-01").cast("date")
    start = F.when(F.col("n") < 2 * 252 * 0.8, cutoff).otherwise(F.date_add("latest", 1))
    return src.tickers(spark, d).join(c, "ticker", "left").select("ticker", F.coalesce(start, cutoff).alias("from_date"))


@register(with_(BARS) + """, x AS (SELECT l.ticker, coalesce(c.close, 0) AS price FROM listed l LEFT JOIN candles c ON c.ticker = l.ticker AND c.date = (SELECT max(date) FROM candles) WHERE l.exchange IN ('ASIA', 'EUROPE', 'AMERICA', 'AFRICA'))
SELECT ticker, price, price > 1 AS tradeable FROM x""")
def b14_c4_universe(spark: SparkSession, d: str) -> DataFrame:
    bars = src.candles(spark, d)
    last = bars.agg(F.max("date").alias("date"))
    day = bars.join(F.broadcast(last), "date", "left_semi").select("ticker", "close")
    listed = src.tickers(spark, d).where(F.col("exchange").isin("ASIA", "EUROPE", "AMERICA", "AFRICA"))
    return listed.join(day, "ticker", "left").select("ticker", F.coalesce("close", F.lit(0.0)).alias("price")).withColumn("tradeable", F.col("price") > 1)


@register(with_(BARS) + """, k AS (SELECT ticker, volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles)
SELECT ticker, CAST(round(avg(volume)) AS BIGINT) AS avg_volume FROM k WHERE k <= 20 GROUP BY ticker HAVING count(*) >= 5""")
def c6_lateral_avg_volume(spark: SparkSession, d: str) -> DataFrame:
    last = ind.last_bars(src.candles(spark, d), 20)
    return last.groupBy("ticker").agg(F.round(F.avg("volume")).cast("long").alias("avg_volume"), F.count(F.lit(1)).alias("n")).where("n >= 5").drop("n")


@register(with_(BARS) + """, x AS (SELECT t.ticker, s.date, s.close FROM (SELECT DISTINCT ticker FROM candles) t CROSS JOIN spy s)
SELECT x.ticker, x.date, x.close, c.date AS as_of, c.close AS bar_close FROM x ASOF LEFT JOIN candles c ON x.ticker = c.ticker AND x.date >= c.date""")
def c7_asof_join_all(spark: SparkSession, d: str) -> DataFrame:
    """Newest bar of every ticker at or before each index date, a window partition a ticker."""
    bar = src.candles(spark, d)
    both = bar.select("ticker").distinct().crossJoin(src.benchmark(spark, d).select("date", "close")).withColumn("bar", F.lit(None).cast("struct<as_of:date,bar_close:double>")).unionByName(
        bar.select("ticker", "date", F.lit(None).cast("double").alias("close"), F.struct(F.col("date").alias("as_of"), F.col("close").alias("bar_close")).alias("bar"))
    )
    w = src.over("date", F.col("bar").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.last("bar", ignorenulls=True).over(w)).where(F.col("bar").isNull())
    return found.select("ticker", "date", "close", F.col("last.as_of").alias("as_of"), F.col("last.bar_close").alias("bar_close"))


@register(with_(BARS) + """, o AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM candles), k AS (SELECT unnest([1, 2, 3]) AS k)
SELECT a.ticker, a.date AS older, b.date AS newer, CAST(k.k AS BIGINT) AS sessions FROM o a CROSS JOIN k JOIN o b ON a.ticker = b.ticker AND b.n = a.n + k.k""")
def c5_theta_days_between_all(spark: SparkSession, d: str) -> DataFrame:
    """Older and newer bars of a ticker within three sessions, over all bars."""
    o = src.candles(spark, d).select("ticker", "date", ind.ordinal().alias("n"))
    older = o.select("ticker", F.col("date").alias("older"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + 3)).alias("n"), F.col("n").alias("m"))
    return older.join(o.withColumnRenamed("date", "newer"), ["ticker", "n"]).select("ticker", "older", "newer", (F.col("n") - F.col("m")).cast("long").alias("sessions"))


@register(with_(BARS) + """, x AS (SELECT l_orderkey, l_linenumber, 'T' || l_suppkey AS ticker, CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT x.l_orderkey, x.l_linenumber, x.ticker, x.date, c.date AS as_of, c.close FROM x ASOF LEFT JOIN candles c ON x.ticker = c.ticker AND x.date >= c.date""")
def c7_asof_join(spark: SparkSession, d: str) -> DataFrame:
    """What each order line's ticker last closed at on the day of the order."""
    lines = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"))
    orders = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date"))
    wanted = lines.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "ticker", "date")
    return as_of(wanted, src.candles(spark, d), ["ticker"], "date", ["close"])


@register(with_(BARS) + "SELECT date, close FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM spy) WHERE k = 250")
def f3_offset(spark: SparkSession, d: str) -> DataFrame:
    """The 250th latest index date; nothing where there are fewer. At most 250 rows are numbered."""
    last = src.benchmark(spark, d).select("date", "close").orderBy(F.desc("date")).limit(250)
    return last.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))).where("k = 250").drop("k")


@register(with_(BARS) + "SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date FROM candles GROUP BY ticker")
def d1_d2_counts_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register(with_(BARS) + "SELECT ticker, count(DISTINCT date) AS days FROM candles WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY ticker")
def d3_distinct_days(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d).where("date between '1998-01-01' and '1998-12-31'").groupBy("ticker").agg(F.countDistinct("date").alias("days"))


@register(with_(BARS) + "SELECT ticker, arg_max(close, date) AS close, max(date) AS date FROM candles GROUP BY ticker")
def d18_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d).groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


@register(with_(BARS) + """, m AS (SELECT ticker, date, close, close / nullif(lag(close, 21) OVER w, 0) - 1 AS p1, close / nullif(lag(close, 63) OVER w, 0) - 1 AS p3,
  CASE WHEN count(*) OVER f50 >= 50 THEN avg(close) OVER f50 ELSE 0 END AS m50, CASE WHEN count(*) OVER f200 >= 200 THEN avg(close) OVER f200 ELSE 0 END AS m200,
  row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM sectors
  WINDOW w AS (PARTITION BY ticker ORDER BY date), f50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING), f200 AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING)),
x AS (SELECT ticker, round(coalesce(p1, 0), 6) AS p1, round(coalesce(p3, 0), 6) AS p3, round(coalesce(p3, 0), 6) - (SELECT round(close / lag63 - 1, 6) FROM (SELECT close, date, lag(close, 63) OVER (ORDER BY date) AS lag63 FROM spy) ORDER BY date DESC LIMIT 1) AS rs,
  CASE WHEN close > m50 AND close > m200 THEN 1.0 WHEN close > m50 THEN 0.6 ELSE 0.0 END AS trend FROM m WHERE k = 1),
r AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (rank() OVER (ORDER BY p1) - 1 + (count(*) OVER (PARTITION BY p1) - 1) / 2.0) / (count(*) OVER () - 1) END AS r1,
  CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (rank() OVER (ORDER BY p3) - 1 + (count(*) OVER (PARTITION BY p3) - 1) / 2.0) / (count(*) OVER () - 1) END AS r3 FROM x),
s AS (SELECT ticker AS sector, round(greatest(0, least(1, 0.4 * r3 + 0.25 * r3 + 0.15 * r1 + 0.2 * trend)), 6) AS score FROM r)
SELECT sector, score, CASE WHEN score >= 0.8 THEN 'LEADING' WHEN score >= 0.6 THEN 'STRONG' WHEN score >= 0.4 THEN 'NEUTRAL' WHEN score >= 0.2 THEN 'WEAK' ELSE 'LAGGING' END AS label FROM s""")
def l6_sector_scores(spark: SparkSession, d: str) -> DataFrame:
    """Last bar of each sector series scored across sectors; relative strength is the return less the index's."""
    rows = src.sector_series(spark, d)
    rows = rows.withColumns({"perf_1m": F.round(ind.session_return(21), 6), "perf_3m": F.round(ind.session_return(63), 6), "above50": F.col("close") > ind.sma(50), "above200": F.col("close") > ind.sma(200)})
    spy = src.benchmark(spark, d).withColumn("ticker", F.lit("SPY")).select("date", F.round(ind.session_return(63), 6).alias("r"))
    base = spy.agg(F.max_by("r", "date").alias("base"))  # one row
    last = ind.last_bars(rows).join(F.broadcast(base)).withColumns({"rs_3m": F.col("perf_3m") - F.col("base"), "all": F.lit(1)})
    return market.sector_scores(last, "all").select(F.col("ticker").alias("sector"), F.round("score", 6).alias("score"), "label")


@register(with_(BARS) + """, s AS (SELECT sector, round(avg(close), 6) AS score FROM candles JOIN listed USING (ticker) GROUP BY sector), k AS (
 SELECT sector, score, row_number() OVER (ORDER BY score DESC, sector) AS hi, row_number() OVER (ORDER BY score, sector) AS lo FROM s)
SELECT sector, score, 'leading' AS side, hi AS place FROM k WHERE hi <= 4 UNION ALL SELECT sector, score, 'lagging', lo FROM k WHERE lo <= 4""")
def f6_leading_and_lagging(spark: SparkSession, d: str) -> DataFrame:
    s = src.candles(spark, d).join(src.tickers(spark, d), "ticker").groupBy("sector").agg(F.round(F.avg("close"), 6).alias("score"))
    # two top-k lists over one row a sector
    hi = market.top_per(s.withColumn("side", F.lit("leading")), 4, [F.desc("score"), F.asc("sector")], "side")
    lo = market.top_per(s.withColumn("side", F.lit("lagging")), 4, [F.asc("score"), F.asc("sector")], "side")
    return hi.unionByName(lo).withColumnRenamed("rank", "place")


