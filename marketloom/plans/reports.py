"""Registered queries for inputs, attribution, charts and reports, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import indicators as ind
from ..operators import market, vectors
from ..sources import market as src
from ..sources import sinks
from ..streaming import events as ev
from .lists import exits, rank_lists, scored_lists
from .lists import _TRADES as TRADES
from .sql import BARS, LISTS, NEAREST, OUTCOMES, SNAPS, with_

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@register("""WITH x AS (SELECT r_name || ':' || 'T' || CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT split_part(symbol, ':', 2) AS ticker, split_part(symbol, ':', 1) AS exchange FROM x WHERE split_part(symbol, ':', 1) IN ('ASIA', 'EUROPE')""")
def b12_exchange_filter(spark: SparkSession, d: str) -> DataFrame:
    symbols = src.tickers(spark, d).select(F.concat_ws(":", "exchange", "ticker").alias("symbol"))
    part = F.split("symbol", ":")
    return symbols.select(part[1].alias("ticker"), part[0].alias("exchange")).where(F.col("exchange").isin("ASIA", "EUROPE"))


@register("SELECT list_transform(['date', 'open', 'vwap'], lambda x: x) AS expected, ['vwap'] AS missing, ['close', 'high', 'low', 'ticker', 'volume'] AS extra, count(*) AS rejected FROM (" + with_(BARS) + "SELECT * FROM candles)")
def b10_g4_header_check(spark: SparkSession, d: str) -> DataFrame:
    """A batch whose columns differ from the expected ones is rejected whole."""
    bars, expected = src.candles(spark, d), ["date", "open", "vwap"]
    have, want = F.array(*map(F.lit, bars.columns)), F.array(*map(F.lit, expected))
    return bars.agg(want.alias("expected"), F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("extra"), F.count(F.lit(1)).alias("rejected"))


def by_bucket(rows: DataFrame, bucket: str = "all", list_type: str = "") -> DataFrame:
    """Optional predicates: 'all' or '' leaves one out."""
    rows = rows if bucket in ("", "all") else rows.where(F.col("bucket") == bucket)
    return rows if list_type == "" else rows.where(F.col("list_type") == list_type)


@register(with_(BARS, LISTS, OUTCOMES) + """SELECT ticker, date, CASE WHEN return_1d > 0 THEN 'risk_on' ELSE 'risk_off' END AS bucket FROM outcomes WHERE list_type = 'ep' AND evaluated_days >= 5 AND NOT (return_1d > 0)""")
def b15_optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lists(spark, d).where("evaluated_days >= 5").withColumn("bucket", F.when(F.col("return_1d") > 0, "risk_on").otherwise("risk_off"))
    return by_bucket(rows, "risk_off", "ep").select("ticker", "date", "bucket")


@register(with_(BARS, LISTS) + """, s AS (SELECT list_type, ticker, date FROM rank_lists WHERE rank = 1), x AS (SELECT s.*, c.close AS price, c.date AS as_of, row_number() OVER (PARTITION BY s.list_type, s.ticker, s.date ORDER BY c.date DESC) AS k
 FROM s LEFT JOIN candles c ON c.ticker = s.ticker AND c.date < s.date) SELECT list_type, ticker, date, as_of, price FROM x WHERE k = 1""")
def c8_strict_asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot strictly before each signal: the previous bar of the series."""
    bars = src.candles(spark, d)
    w = src.over()
    before = bars.select("ticker", "date", F.lag("date").over(w).alias("as_of"), F.lag("close").over(w).alias("price"))
    return rank_lists(bars).where("rank = 1").join(before, ["ticker", "date"]).select("list_type", "ticker", "date", "as_of", "price")


@register(with_(BARS, LISTS) + """, l AS (SELECT date, ticker FROM rank_lists WHERE list_type = 'leaders')
SELECT m.date, m.ticker, round(m.score * CASE WHEN l.ticker IS NOT NULL THEN 1.05 ELSE 1 END, 6) AS score, l.ticker IS NOT NULL AS boosted FROM rank_lists m LEFT JOIN l ON l.date = m.date AND l.ticker = m.ticker WHERE m.list_type = 'momentum'""")
def c13_leadership_boost(spark: SparkSession, d: str) -> DataFrame:
    lists = rank_lists(src.candles(spark, d))
    leaders = lists.where("list_type = 'leaders'").select("date", "ticker", F.lit(True).alias("led"))
    boosted = F.coalesce("led", F.lit(False))
    rows = lists.where("list_type = 'momentum'").join(leaders, ["date", "ticker"], "left")
    return rows.select("date", "ticker", F.round(F.col("score") * F.when(boosted, 1.05).otherwise(1.0), 6).alias("score"), boosted.alias("boosted"))


@register(with_(BARS) + "SELECT ticker, date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles) WHERE k <= 5")
def f2_last_bars(spark: SparkSession, d: str) -> DataFrame:
    return ind.last_bars(src.candles(spark, d), 5).select("ticker", "date", "close")


@register(with_(BARS) + "SELECT DISTINCT date FROM candles ORDER BY date DESC LIMIT 30")
def f9_available_dates(spark: SparkSession, d: str) -> DataFrame:
    return src.candles(spark, d).select("date").distinct().orderBy(F.desc("date")).limit(30)


@register(with_(BARS) + """, f AS (SELECT date, close, avg(close) OVER w AS m, count(*) OVER w AS n FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING)),
b AS (SELECT date, avg(CASE WHEN close > m THEN 100.0 ELSE 0.0 END) AS breadth FROM f WHERE n >= 50 GROUP BY date), c AS (SELECT t.date, coalesce(t.breadth - arg_max(p.breadth, p.date), 0) AS change FROM b t LEFT JOIN b p ON p.date BETWEEN t.date - 10 AND t.date - 7 GROUP BY t.date, t.breadth),
s AS (SELECT date, close / lag(close, 5) OVER (ORDER BY date) - 1 AS r FROM spy) SELECT date, coalesce(r, 0) > 0.01 AND change <= 0 AS divergence FROM c JOIN s USING (date)""")
def l3_breadth_divergence(spark: SparkSession, d: str) -> DataFrame:
    """An index up over 1 percent in five sessions while breadth does not rise."""
    from .indicators import QUERIES as indicator_queries

    change = indicator_queries["e9_breadth_offset"](spark, d)
    spy = src.benchmark(spark, d).withColumn("ticker", F.lit("SPY")).select("date", ind.session_return(5).alias("r"))
    return change.join(spy, "date").select("date", ((F.col("r") > 0.01) & (F.col("breadth_change") <= 0)).alias("divergence"))


@register(with_(BARS) + """, w AS (SELECT date, close, CASE WHEN count(*) OVER f50 >= 50 THEN avg(close) OVER f50 ELSE 0 END AS m50, CASE WHEN count(*) OVER f200 >= 200 THEN avg(close) OVER f200 ELSE 0 END AS m200, max(close) OVER f250 AS top, row_number() OVER (ORDER BY date DESC) AS k
 FROM spy WINDOW f50 AS (ORDER BY date ROWS 49 PRECEDING), f200 AS (ORDER BY date ROWS 199 PRECEDING), f250 AS (ORDER BY date ROWS 249 PRECEDING)),
b AS (SELECT ticker, close, avg(close) OVER f50 AS m50, count(*) OVER f50 AS n50, avg(close) OVER f200 AS m200, count(*) OVER f200 AS n200, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles
 WINDOW f50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING), f200 AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING)),
g AS (SELECT round(avg(CASE WHEN close > m50 THEN 100.0 ELSE 0 END) FILTER (WHERE n50 >= 50), 6) AS breadth50, round(avg(CASE WHEN close > m200 THEN 100.0 ELSE 0 END) FILTER (WHERE n200 >= 200), 6) AS breadth200 FROM b WHERE k = 1)
SELECT date, close > m50 AS above50, close > m200 AS above200, round(CASE WHEN m50 = 0 THEN 0 ELSE (close - m50) / m50 * 100 END, 6) AS pct_sma50, round(CASE WHEN m200 = 0 THEN 0 ELSE (close - m200) / m200 * 100 END, 6) AS pct_sma200, m50 > m200 AS cross_up, round((close / top - 1) * 100, 6) AS drawdown, breadth50, breadth200 FROM w, g WHERE k = 1""")
def l1_market_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The last date's signals: one row from the index series, one from breadth."""
    spy = src.benchmark(spark, d).withColumn("ticker", F.lit("SPY")).withColumns({"m50": ind.sma(50), "m200": ind.sma(200), "drawdown": F.round(ind.drawdown_percent(), 6)})
    last = ind.last_bars(spy)
    rows = ind.last_bars(ind.with_sma(src.candles(spark, d), 50, 200))
    b = rows.agg(F.round(ind.breadth(rows, 50), 6).alias("breadth50"), F.round(ind.breadth(rows, 200), 6).alias("breadth200"))
    pct = lambda m: F.round(ind.distance_percent(F.col("close"), F.col(m)), 6)
    return last.join(F.broadcast(b)).select(
        "date", (F.col("close") > F.col("m50")).alias("above50"), (F.col("close") > F.col("m200")).alias("above200"), pct("m50").alias("pct_sma50"), pct("m200").alias("pct_sma200"),
        (F.col("m50") > F.col("m200")).alias("cross_up"), "drawdown", "breadth50", "breadth200",
    )


@register(with_(BARS, LISTS, OUTCOMES) + TRADES + """, a AS (SELECT r.list_type, r.ticker, r.date, r.rank <= 2 AS recommended, o.return_5d, x.exit_type, round((x.exit_price - x.entry) / (x.entry - x.stop), 6) AS rr
 FROM rank_lists r LEFT JOIN outcomes o USING (list_type, ticker, date) LEFT JOIN x USING (list_type, ticker, date))
SELECT list_type, ticker, date, recommended, round(return_5d, 6) AS return_5d, CASE WHEN recommended THEN exit_type END AS exit_type, CASE WHEN recommended THEN rr END AS actual_rr FROM a""")
def l14_c11_attribution(spark: SparkSession, d: str) -> DataFrame:
    """List rows with what prices did; exits are replayed for recommended ones only."""
    keys = ["list_type", "ticker", "date"]
    lists = rank_lists(src.candles(spark, d)).select(*keys, (F.col("rank") <= 2).alias("recommended"))
    x = exits(src.candles(spark, d)).select(*keys, "exit_type", F.round("actual_rr", 6).alias("actual_rr"))
    rows = lists.join(scored_lists(spark, d).select(*keys, F.round("return_5d", 6).alias("return_5d")), keys, "left").join(x, keys, "left")
    only = lambda c: F.when(F.col("recommended"), F.col(c)).alias(c)
    return rows.select(*keys, "recommended", "return_5d", only("exit_type"), only("actual_rr"))


@register(NEAREST + "SELECT query_id, vec_id, label, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS k FROM m) WHERE k <= 3")
def l15_b19_memory_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest stored vectors of each label to each query vector."""
    e = src.table(spark, d, "embeddings")
    return vectors.nearest(e.where("vec_id % 50 = 0"), e.where("label is not null"), 3, "label").select("query_id", "vec_id", "label", "distance")


@register(with_(BARS) + """, s AS (SELECT *, max(high) OVER b AS hb, max(high) OVER a AS ha, count(*) OVER b AS nb, count(*) OVER a AS na, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles
 WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
p AS (SELECT ticker, max(CASE WHEN k = 1 THEN close END) AS close, arg_max(high, date) FILTER (WHERE nb = 3 AND na = 3 AND high > hb AND high > ha) AS pivot_high FROM s GROUP BY ticker)
SELECT ticker, pivot_high, round((close / pivot_high - 1) * 100, 6) AS pct_from_pivot, pivot_high * 1.05 AS t1, pivot_high * 0.95 AS stop, abs((close / pivot_high - 1) * 100) <= 15 AS near FROM p WHERE pivot_high IS NOT NULL""")
def l16_l17_pivot_levels(spark: SparkSession, d: str) -> DataFrame:
    """The last swing high as pivot, with the levels drawn from it."""
    bars = src.candles(spark, d)
    pivot = ind.swings(bars).where("swing_high").groupBy("ticker").agg(F.max_by("high", "date").alias("pivot_high"))
    rows = ind.last_bars(bars).join(pivot, "ticker")
    pct = (F.try_divide("close", "pivot_high") - 1) * 100
    return rows.select("ticker", "pivot_high", F.round(pct, 6).alias("pct_from_pivot"), (F.col("pivot_high") * 1.05).alias("t1"), (F.col("pivot_high") * 0.95).alias("stop"), (F.abs(pct) <= 15).alias("near"))


@register(with_(BARS) + """, w AS (SELECT ticker, date, close, high, low, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM candles), f AS (SELECT ticker, max(high) AS top, min(low) AS bottom FROM w WHERE k <= 25 GROUP BY ticker)
SELECT ticker, top, bottom, round(1 - bottom / top, 6) AS depth, 1 - bottom / top <= 0.2 AS flat_base, 1 - bottom / top BETWEEN 0.08 AND 0.5 AS cup_depth FROM f""")
def l17_base_shape(spark: SparkSession, d: str) -> DataFrame:
    f = ind.last_bars(src.candles(spark, d), 25).groupBy("ticker").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    depth = 1 - F.try_divide("bottom", "top")
    return f.select("ticker", "top", "bottom", F.round(depth, 6).alias("depth"), (depth <= 0.2).alias("flat_base"), depth.between(0.08, 0.5).alias("cup_depth"))


@register(with_(BARS, LISTS, OUTCOMES) + """, c AS (SELECT date, ticker, min(rank) AS rank FROM rank_lists GROUP BY date, ticker), o AS (SELECT ticker, date, return_5d, return_10d, return_20d, row_number() OVER (PARTITION BY ticker, date ORDER BY list_type) AS k FROM outcomes)
SELECT c.date, c.ticker, c.rank, l.sector, round(coalesce(return_20d, return_10d, return_5d), 6) AS current_return, CASE WHEN return_20d IS NOT NULL THEN 20 WHEN return_10d IS NOT NULL THEN 10 WHEN return_5d IS NOT NULL THEN 5 END AS day
FROM c LEFT JOIN listed l USING (ticker) LEFT JOIN o ON o.ticker = c.ticker AND o.date = c.date AND o.k = 1""")
def l18_c19_enriched_report(spark: SparkSession, d: str) -> DataFrame:
    """Cards with sector and the ticker's first outcome; the latest return that exists."""
    cards = rank_lists(src.candles(spark, d)).groupBy("date", "ticker").agg(F.min("rank").cast("long").alias("rank"))
    first = scored_lists(spark, d).groupBy("ticker", "date").agg(F.min_by(F.struct("return_5d", "return_10d", "return_20d"), "list_type").alias("o"))
    rows = cards.join(src.tickers(spark, d).select("ticker", "sector"), "ticker", "left").join(first, ["ticker", "date"], "left")
    day = F.when(F.col("o.return_20d").isNotNull(), 20).when(F.col("o.return_10d").isNotNull(), 10).when(F.col("o.return_5d").isNotNull(), 5)
    return rows.select("date", "ticker", "rank", "sector", F.round(F.coalesce("o.return_20d", "o.return_10d", "o.return_5d"), 6).alias("current_return"), day.alias("day"))


@register(with_(BARS, LISTS) + """SELECT date, '| Rank | Ticker | Score |' || chr(10) || string_agg('| ' || rank || ' | ' || ticker || ' | ' || CAST(floor(score * 100) AS BIGINT) || ' |', chr(10) ORDER BY rank) AS body FROM rank_lists WHERE list_type = 'momentum' GROUP BY date""")
def l19_rendered_table(spark: SparkSession, d: str) -> DataFrame:
    """A date's list as a markdown table; at most a list's length of lines is gathered."""
    line = F.concat(F.lit("| "), F.col("rank").cast("string"), F.lit(" | "), F.col("ticker"), F.lit(" | "), F.floor(F.col("score") * 100).cast("string"), F.lit(" |"))
    rows = rank_lists(src.candles(spark, d)).where("list_type = 'momentum'").groupBy("date").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("date", F.concat(F.lit("| Rank | Ticker | Score |\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("body"))


@register("SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.75 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS code FROM events")
def l22_ordinal_encoding(spark: SparkSession, d: str) -> DataFrame:
    code = fn.lookup(F.col("event_type"), {"purchase": 1.0, "signup": 0.75, "click": 0.5, "view": 0.25}, 0.0)
    return src.table(spark, d, "events").select("event_id", code.alias("code"))


@register("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short, contains(lower(text), 'the') AS has_the, upper(trim(source)) AS source FROM documents")
def h21_h33_strings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    short = F.when(F.char_length(t) > 80, F.concat(F.substring(t, 1, 77), F.lit("..."))).otherwise(t)
    return src.table(spark, d, "documents").select("doc_id", short.alias("short"), F.lower(t).contains("the").alias("has_the"), F.upper(F.trim("source")).alias("source"))


@register("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(ts AS DATE) AS day FROM events""")
def h20_epoch_to_date(spark: SparkSession, d: str) -> DataFrame:
    """A field that holds epoch seconds or a date string, read either way."""
    e = src.table(spark, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 2 == 0, seconds.cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    day = F.coalesce(F.to_date(F.timestamp_seconds(raw.try_cast("long"))), raw.try_cast("date"))
    return e.select("event_id", seconds.alias("seconds"), day.alias("day"))


@register(with_(BARS, LISTS, OUTCOMES) + "SELECT date, count(*) FILTER (WHERE evaluated_days < 20) AS pending, count(*) AS signals FROM outcomes GROUP BY date HAVING count(*) FILTER (WHERE evaluated_days < 20) > 0")
def j3_pending_dates(spark: SparkSession, d: str) -> DataFrame:
    """Signal dates that have rows to evaluate again."""
    rows = scored_lists(spark, d).groupBy("date").agg(F.count_if(F.col("evaluated_days") < 20).alias("pending"), F.count(F.lit(1)).alias("signals"))
    return rows.where("pending > 0")


@register(with_(BARS, LISTS) + """SELECT list_type, ticker, date, map_from_entries([('score', round(score, 4)), ('rank', CAST(rank AS DOUBLE))])['score'] AS score FROM rank_lists""")
def h27_reason_json(spark: SparkSession, d: str) -> DataFrame:
    """A reason map written as JSON and read back."""
    reason = F.to_json(F.create_map(F.lit("score"), F.round("score", 4), F.lit("rank"), F.col("rank").cast("double")))
    rows = rank_lists(src.candles(spark, d)).withColumn("reason", reason)
    return rows.select("list_type", "ticker", "date", F.from_json("reason", "map<string,double>")["score"].alias("score"))


@register(with_(BARS, SNAPS) + """SELECT ticker, date, round(atr / nullif(close, 0) * 100, 4) AS adr_pct, round((close / nullif(sma50, 0) - 1) * 100, 4) AS extension_pct FROM snaps""")
def h15_adr_and_extension(spark: SparkSession, d: str) -> DataFrame:
    s = src.snapshots(src.candles(spark, d))
    return s.select("ticker", "date", F.round(F.try_divide("atr", "close") * 100, 4).alias("adr_pct"), F.round((F.try_divide("close", "sma50") - 1) * 100, 4).alias("extension_pct"))


@register("""SELECT doc_id, 'S' || doc_id AS ticker, CAST(n_chars % 100 AS DOUBLE) AS entry, CAST(n_chars % 7 AS DOUBLE) AS stop FROM documents""")
def h24_block_parser(spark: SparkSession, d: str) -> DataFrame:
    """Numbered blocks with labelled fields, cut at their headers and read by patterns."""
    n = F.col("n_chars")
    body = F.concat(F.lit("intro\n**1. S"), F.col("doc_id").cast("string"), F.lit("**\nEntry: $"), (n % 100).cast("string"), F.lit("\nStop loss: $"), (n % 7).cast("string"), F.lit("\n"))
    block = F.explode(F.filter(F.split(body, r"(?=\*\*\d+\. )"), lambda b: F.rlike(b, F.lit(r"^\*\*\d+\. "))))
    rows = src.table(spark, d, "documents").select("doc_id", block.alias("b"))
    field = lambda name: fn.parse_price(F.regexp_extract("b", rf"(?i){name}[^:]*:\s*([^\n]*)", 1))
    return rows.select("doc_id", F.regexp_extract("b", r"^\*\*\d+\. (\w+)", 1).alias("ticker"), field("entry").alias("entry"), field("stop").alias("stop"))
