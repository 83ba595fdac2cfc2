"""Registered queries for keyed reads, guards, run logs, horizons and wordings, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, outcomes, text
from ..operators import indicators as ind
from ..sources import market as src
from .lists import _TRADES as TRADES
from .lists import exits, rank_lists, scored_lists
from .sql import BARS, LISTS, OUTCOMES, with_

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KEYS = ["list_type", "ticker", "date"]


@register(with_(BARS) + "SELECT ticker, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles) WHERE k = 1 AND close <> 0 AND volume <> 0")
def a2_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Each ticker's newest bar; none where it has no price or no volume."""
    return ind.last_bars(src.candles(spark, d)).where("close <> 0 and volume <> 0").select("ticker", "date", "close", "volume")


@register("SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 40 AND p_retailprice > 950 AND p_type IN ('ECONOMY', 'SMALL')")
def a6_screener_scan(spark: SparkSession, d: str) -> DataFrame:
    """A screener as a scan: predicates and columns go down to the files."""
    return src.table(spark, d, "part").where("p_size between 10 and 40 and p_retailprice > 950 and p_type in ('ECONOMY', 'SMALL')").select("p_partkey", "p_brand", "p_retailprice")


@register(with_(BARS, LISTS) + "SELECT r.date, r.ticker, c.open, c.close, c.volume FROM rank_lists r JOIN candles c USING (ticker, date) WHERE r.list_type = 'momentum' AND r.rank = 1")
def a9_keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The stored rows of wanted keys, (ticker, date) here."""
    bars = src.candles(spark, d)
    wanted = rank_lists(bars).where("list_type = 'momentum' and rank = 1").select("ticker", "date")
    return bars.join(wanted, ["ticker", "date"]).select("date", "ticker", "open", "close", "volume")


@register(with_(BARS) + """, r AS (SELECT ticker, max(date) - 120 AS first_day, max(date) - 30 AS last_day FROM candles GROUP BY ticker)
SELECT c.ticker, c.date, c.close FROM candles c JOIN r ON r.ticker = c.ticker AND c.date BETWEEN first_day AND last_day""")
def a10_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """Bars of each ticker in its own range of dates, both ends included."""
    bars = src.candles(spark, d)
    ranges = bars.groupBy("ticker").agg(F.max("date").alias("last")).select("ticker", F.date_sub("last", 120).alias("first_day"), F.date_sub("last", 30).alias("last_day"))
    return bars.join(ranges, "ticker").where("date between first_day and last_day").select("ticker", "date", "close")


@register(with_(BARS) + """, n AS (SELECT max(date) AS today FROM spy), c AS (SELECT ticker, max(date) AS last FROM candles GROUP BY ticker)
SELECT l.ticker, coalesce(c.last + 1, today - 7) AS from_date, coalesce(c.last + 1, today - 7) > today AS up_to_date FROM listed l CROSS JOIN n LEFT JOIN c USING (ticker)""")
def a26_daily_update(spark: SparkSession, d: str) -> DataFrame:
    """Where the daily update starts: after the last bar, or a week back for a new ticker."""
    today = src.benchmark(spark, d).agg(F.max("date").alias("today"))  # one row
    latest = src.candles(spark, d).groupBy("ticker").agg(F.max("date").alias("latest"))
    wanted = src.tickers(spark, d).select("ticker").join(latest, "ticker", "left").join(F.broadcast(today))
    start = F.coalesce(F.date_add("latest", 1), F.date_sub("today", 7))
    return wanted.select("ticker", start.alias("from_date"), (start > F.col("today")).alias("up_to_date"))


@register(with_(BARS, LISTS) + """, n AS (SELECT date, list_type, count(*) AS n FROM rank_lists GROUP BY ALL)
SELECT date, CASE WHEN count(*) = 3 THEN 'complete' ELSE 'failed' END AS status, CAST(sum(n) AS BIGINT) AS total, '{' || string_agg('"' || list_type || '":' || n, ',' ORDER BY list_type) || '}' AS steps FROM n GROUP BY date""")
def a27_run_log(spark: SparkSession, d: str) -> DataFrame:
    """One row a run: complete if every list was written, with the rows of each step as a JSON map."""
    n = rank_lists(src.candles(spark, d)).groupBy("date", "list_type").agg(F.count(F.lit(1)).alias("n"))
    steps = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("list_type", "n")))))
    return n.groupBy("date").agg(F.when(F.count(F.lit(1)) == 3, "complete").otherwise("failed").alias("status"), F.sum("n").alias("total"), steps.alias("steps"))


@register(with_(BARS, LISTS) + "SELECT date, ticker, CAST(rank AS BIGINT) AS rank FROM rank_lists WHERE list_type = 'ep'")
def b2_source_filter(spark: SparkSession, d: str) -> DataFrame:
    return rank_lists(src.candles(spark, d)).where("list_type = 'ep'").select("date", "ticker", F.col("rank").cast("long").alias("rank"))


@register(with_(BARS, LISTS) + TRADES + """, picks AS (SELECT r.list_type, r.ticker, r.date, r.rank <= 2 AS recommended, CASE WHEN r.rank <= 1 THEN x.exit_type END AS exit_type FROM rank_lists r LEFT JOIN x USING (list_type, ticker, date))
SELECT list_type, ticker, date FROM picks WHERE recommended AND exit_type IS NULL AND date >= (SELECT max(date) FROM rank_lists) - 90""")
def b18_backfill_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Recommended rows of the last 90 days without an exit; only first ranks have been replayed."""
    bars = src.candles(spark, d)
    lists = rank_lists(bars).select(*KEYS, "rank")
    replayed = exits(bars).join(lists.where("rank = 1").select(*KEYS), KEYS, "left_semi").select(*KEYS, "exit_type")
    last = lists.agg(F.max("date").alias("last"))  # one row
    rows = lists.where("rank <= 2").join(F.broadcast(last)).where("date >= date_sub(last, 90)")
    return rows.join(replayed, KEYS, "left").where("exit_type is null").select(*KEYS)


@register(with_(BARS) + """, n AS (SELECT max(date) AS today FROM candles) SELECT ticker, max(date) AS last, isodow(any_value(today)) < 6 AND any_value(today) - max(date) > 4 AS stale FROM candles CROSS JOIN n GROUP BY ticker""")
def b20_freshness_guard(spark: SparkSession, d: str) -> DataFrame:
    """On a weekday a series whose last bar is more than four days old is stale."""
    last = src.candles(spark, d).groupBy("ticker").agg(F.max("date").alias("last"))
    today = last.agg(F.max("last").alias("today"))  # one row
    stale = (F.weekday("today") < 5) & (F.datediff("today", "last") > 4)
    return last.join(F.broadcast(today)).select("ticker", "last", stale.alias("stale"))


@register(with_(BARS) + "SELECT ticker, ticker IN (SELECT n_name FROM nation) AS critical FROM (SELECT ticker FROM listed UNION SELECT ticker FROM sectors)")
def b22_critical_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Sector series are critical: ingestion of theirs must be fresh before a run."""
    names = src.tickers(spark, d).select("ticker").union(src.sector_series(spark, d).select("ticker")).distinct()
    critical = src.table(spark, d, "nation").select(F.col("n_name").alias("ticker"), F.lit(True).alias("critical")).distinct()
    return names.join(critical, "ticker", "left").select("ticker", F.coalesce("critical", F.lit(False)).alias("critical"))


@register(with_(BARS, LISTS) + """, g AS (SELECT date, count(*) AS listed_rows FROM rank_lists GROUP BY date), f AS (SELECT date, close, avg(close) OVER w AS m, count(*) OVER w AS n FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING)),
b AS (SELECT date, round(avg(CASE WHEN close > m THEN 100.0 ELSE 0.0 END), 6) AS breadth FROM f WHERE n >= 50 GROUP BY date)
SELECT g.date, g.listed_rows, round(spy.close, 6) AS index_close, b.breadth FROM g LEFT JOIN spy USING (date) LEFT JOIN b USING (date)""")
def c3_run_context(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the index and the breadth of their date, where there are any."""
    bars = src.candles(spark, d)
    runs = rank_lists(bars).groupBy("date").agg(F.count(F.lit(1)).alias("listed_rows"))
    w = src.over().rowsBetween(-49, 0)
    means = bars.select("date", "close", F.avg("close").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n")).where("n >= 50")
    breadth = means.groupBy("date").agg(F.round(F.avg(F.when(F.col("close") > F.col("m"), 100.0).otherwise(0.0)), 6).alias("breadth"))
    index = src.benchmark(spark, d).select("date", F.round("close", 6).alias("index_close"))
    return runs.join(index, "date", "left").join(breadth, "date", "left").select("date", "listed_rows", "index_close", "breadth")


@register(with_(BARS, LISTS, OUTCOMES) + "SELECT r.list_type, r.ticker, r.date, o.ticker IS NOT NULL AS matched, round(o.return_10d, 6) AS return_10d FROM rank_lists r LEFT JOIN outcomes o USING (list_type, ticker, date) WHERE r.rank = 1")
def c20_memory_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Remembered picks with what became of them."""
    memory = rank_lists(src.candles(spark, d)).where("rank = 1").select(*KEYS)
    known = scored_lists(spark, d).select(*KEYS, F.lit(True).alias("matched"), F.round("return_10d", 6).alias("return_10d"))
    return memory.join(known, KEYS, "left").select(*KEYS, F.coalesce("matched", F.lit(False)).alias("matched"), "return_10d")


@register(with_(BARS) + "SELECT l.ticker, coalesce(max(c.date), DATE '1970-01-01') AS latest FROM listed l LEFT JOIN candles c ON c.ticker = l.ticker AND c.close > 45000 GROUP BY l.ticker")
def d2_latest_or_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The last date on which a ticker closed above a bound; the epoch for those that never did."""
    high = src.candles(spark, d).where("close > 45000").groupBy("ticker").agg(F.max("date").alias("latest"))
    return src.tickers(spark, d).select("ticker").join(high, "ticker", "left").select("ticker", F.coalesce("latest", F.lit("1970-01-01").cast("date")).alias("latest"))


@register(with_(BARS, LISTS, OUTCOMES) + """, f AS (SELECT date, 'return_1d' AS feature, return_1d AS delta FROM outcomes UNION ALL SELECT date, 'return_5d', return_5d FROM outcomes UNION ALL SELECT date, 'max_runup', max_runup FROM outcomes)
SELECT feature, count(delta) AS n, round(avg(delta), 6) AS mean FROM f WHERE date > (SELECT max(date) FROM outcomes) - 365 AND delta IS NOT NULL GROUP BY feature""")
def d10_deltas_by_feature(spark: SparkSession, d: str) -> DataFrame:
    """Mean and number of suggested changes by feature over the last year."""
    rows = scored_lists(spark, d).select("date", "return_1d", "return_5d", "max_runup")
    last = rows.agg(F.max("date").alias("last"))  # one row
    recent = rows.join(F.broadcast(last)).where("date > date_sub(last, 365)").drop("last")
    long = recent.unpivot(["date"], ["return_1d", "return_5d", "max_runup"], "feature", "delta").where("delta is not null")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("mean"))


@register(with_(BARS, LISTS, OUTCOMES) + """SELECT 'v' || CAST(year(date) % 3 AS VARCHAR) AS version, list_type, count(*) AS n, round(count(*) FILTER (WHERE return_5d > 0) / nullif(count(return_5d), 0), 6) AS win_rate, round(avg(return_5d), 6) AS mean,
 round(quantile_cont(return_5d, 0.5), 6) AS median, min(date) AS first_date, max(date) AS last_date FROM outcomes GROUP BY 1, 2""")
def d12_experiment_stats(spark: SparkSession, d: str) -> DataFrame:
    """By version and list; open returns count in n and not in the win rate."""
    r = F.col("return_5d")
    rows = scored_lists(spark, d).withColumn("version", F.concat(F.lit("v"), (F.year("date") % 3).cast("string")))
    return rows.groupBy("version", "list_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.try_divide(F.count_if(r > 0), F.count(r)), 6).alias("win_rate"), F.round(F.avg(r), 6).alias("mean"),
        F.round(F.percentile(r, F.lit(0.5)), 6).alias("median"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


_ALL_HORIZONS = ", ".join(f"round(max(CASE WHEN k = {k} THEN close END) / nullif(max(CASE WHEN k = 1 THEN open END), 0) - 1, 6) AS return_{k}d" for k in (1, 2, 3, 4, 5, 10, 20))


@register(with_(BARS, LISTS, OUTCOMES) + f"SELECT list_type, ticker, date, {_ALL_HORIZONS} FROM paths WHERE k <= 20 GROUP BY list_type, ticker, date")
def e11_all_horizons(spark: SparkSession, d: str) -> DataFrame:
    return scored_lists(spark, d).select(*KEYS, *(F.round(f"return_{k}d", 6).alias(f"return_{k}d") for k in outcomes.HORIZONS))


@register(with_(BARS, LISTS) + """, b AS (SELECT list_type, ticker, date, list_transform(string_split(ticker || '_' || strftime(date, '%Y-%m-%d'), ''), lambda c: CAST(ascii(c) AS HUGEINT)) AS s FROM rank_lists)
SELECT list_type, ticker, date, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), s), lambda h, c: (xor(h, c) * 1099511628211) % CAST(18446744073709551616 AS HUGEINT)) % CAST(9223372036854775808 AS HUGEINT) AS BIGINT) AS cluster_id FROM b""")
def h17_l10_cluster_id(spark: SparkSession, d: str) -> DataFrame:
    """A 63-bit id of ticker and date, the same on every run."""
    return rank_lists(src.candles(spark, d)).select(*KEYS, text.fnv_id(F.concat_ws("_", "ticker", F.date_format("date", "yyyy-MM-dd"))).alias("cluster_id"))


_PHRASES = """CASE WHEN return_10d IS NULL THEN '' WHEN return_10d >= 0 THEN printf('Two weeks: up %.1f%%.', return_10d * 100) ELSE printf('Two weeks: down %.1f%%.', return_10d * 100) END AS two_weeks,
 CASE WHEN return_20d IS NULL THEN '' WHEN return_20d >= 0 THEN printf('Whole period: up %.1f%%.', return_20d * 100) ELSE printf('Whole period: down %.1f%%.', return_20d * 100) END AS whole,
 CASE WHEN max_runup * 100 >= 10 THEN printf('Best: outstanding, +%.1f%%.', max_runup * 100) WHEN max_runup * 100 >= 5 THEN printf('Best: +%.1f%% before a pullback.', max_runup * 100) WHEN max_runup >= 0 THEN printf('Best: +%.1f%%.', max_runup * 100) ELSE '' END AS best,
 CASE WHEN max_drawdown IS NULL THEN '' WHEN max_drawdown * 100 >= -2 THEN printf('Worst: minimal, %.1f%%.', max_drawdown * 100) WHEN max_drawdown * 100 >= -5 THEN printf('Worst: controlled, %.1f%%.', max_drawdown * 100) ELSE printf('Worst: %.1f%%.', max_drawdown * 100) END AS worst,
 CASE WHEN evaluated_days >= 20 THEN 'Fully tracked.' WHEN evaluated_days >= 10 THEN evaluated_days || ' days, extended window.' ELSE evaluated_days || ' days, in progress.' END AS tracked"""


@register(with_(BARS, LISTS, OUTCOMES) + f"SELECT list_type, ticker, date, {_PHRASES} FROM outcomes")
def h31_outcome_phrases(spark: SparkSession, d: str) -> DataFrame:
    return scored_lists(spark, d).select(*KEYS, *outcomes.phrases())


@register(with_(BARS) + """, w AS (SELECT ticker, high, low, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles), f AS (SELECT ticker, 1 - min(low) / nullif(max(high), 0) AS depth FROM w WHERE k <= 3 GROUP BY ticker)
SELECT ticker, CASE WHEN depth <= 0.2 THEN 'Flat Base' WHEN depth <= 0.5 THEN 'Cup with Handle' WHEN depth <= 0.9 THEN 'VCP (Volatility Contraction)' ELSE 'deep base' END AS label FROM f""")
def h34_pattern_label(spark: SparkSession, d: str) -> DataFrame:
    """A base, named by its depth over three bars, with the label that is shown for it."""
    f = ind.last_bars(src.candles(spark, d), 3).groupBy("ticker").agg((1 - F.try_divide(F.min("low"), F.max("high"))).alias("depth"))
    base = F.when(F.col("depth") <= 0.2, "flat_base").when(F.col("depth") <= 0.5, "CUP").when(F.col("depth") <= 0.9, "contraction").otherwise("deep base")
    return f.select("ticker", text.pattern_label(base).alias("label"))


@register(with_(BARS, LISTS, OUTCOMES) + """, v AS (SELECT year(date) AS fold, round(score, 3) AS s, CASE WHEN return_5d > 0 THEN 1 ELSE 0 END AS y FROM outcomes WHERE return_5d IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS r FROM v),
a AS (SELECT fold, coalesce((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 0.5) AS auc FROM r GROUP BY fold)
SELECT count(*) AS folds, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std, avg(auc) - stddev_pop(auc) > 0.65 AS accepted FROM a""")
def i7_gate(spark: SparkSession, d: str) -> DataFrame:
    """Accepted where the mean of the folds' areas, less their deviation, passes 0.65; a fold is a year."""
    rows = scored_lists(spark, d).where("return_5d is not null").select(F.year("date").alias("fold"), F.round("score", 3).alias("s"), (F.col("return_5d") > 0).cast("int").alias("y"))
    a = evaluation.auc(rows, "y", "s", "fold").agg(F.count(F.lit(1)).alias("folds"), F.avg("auc").alias("m"), F.stddev_pop("auc").alias("v"))
    return a.select("folds", F.round("m", 6).alias("mean"), F.round("v", 6).alias("std"), (F.col("m") - F.col("v") > 0.65).alias("accepted"))
