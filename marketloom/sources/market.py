"""Readers, and the projection of the driver's tables onto the market domain."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CANDLE = "ticker string, date date, open double, high double, low double, close double, volume long"
BARS = "ticker string, results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>"
TEXT_BARS = "symbol string, values array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>"

#: One bar's order within a day; (order, line) alone repeats.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(*order: str | Column, by: str = "ticker") -> Window:
    return Window.partitionBy(by).orderBy(*(order or ("date",)))


def _ohlcv(rows: DataFrame, *keys: str) -> DataFrame:
    key, price = F.struct(*LINE_KEY), F.col("l_extendedprice") / F.col("l_quantity")
    return rows.groupBy(*keys, F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


#: Lines that one partition of the dealt lines holds, about.
PART_LINES = 2_000_000


def candles(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Daily bars of every supplier's unit prices: ticker, date, open, high, low, close, volume; with ``only`` (ticker) of these alone.

    Few lines share a ticker and day, so that sums before an exchange would save nothing: lines are dealt by ticker once, and
    bars and all windows over a ticker's series go on from there, sorted once. More lines make more partitions, not larger ones.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = -(-lines.count() // PART_LINES)  # from the files' footers
    lines = lines.select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), "l_shipdate", *LINE_KEY)
    if only is not None:
        lines = lines.join(only, "ticker", "left_semi")
    few = parts <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _ohlcv(lines.repartition("ticker") if few else lines.repartition(parts, "ticker"), "ticker")


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector (nation) and exchange (region)."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("n_name").alias("sector"), F.col("r_name").alias("exchange"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index series: mean order value a day, summed exactly in cents; number of orders as volume."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100).alias("close"), F.count(F.lit(1)).alias("volume"))


def sector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by supplier nation, named ``ticker`` like any series."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", *LINE_KEY)
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    named = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("ticker"))
    return _ohlcv(lines.join(named, lines.l_suppkey == named.s_suppkey), "ticker")


def snapshots(bars: DataFrame) -> DataFrame:
    """Screener-like columns for every bar, from windows over the series.

    The bar counts stand in for calendar spans: 21 sessions a month, 63 three, 126 six,
    250 a year. Values are NULL where the history is short.
    """
    w = over()
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    full = lambda c, n: F.when(F.count("close").over(last(n)) >= n, c)
    change = lambda n: (F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1) * 100
    back = lambda c, *ns: [F.col(c), *(F.lag(c, n).over(w) for n in ns)]
    total = lambda cs: reduce(add, cs)
    # long frames are put together from shorter ones, so that a row costs the same whatever their length;
    # a sum is NULL where its frame is not full of values
    rows = bars.withColumns(
        {
            "prev_close": F.lag("close").over(w), "perf_1m": change(21), "perf_3m": change(63), "perf_6m": change(126), "avg_volume_10d": full(F.avg("volume").over(last(10)), 10),
            "atr": full(F.avg(F.col("high") - F.col("low")).over(last(14)), 14), "_s10": full(F.sum("close").over(last(10)), 10), "_h10": F.max("high").over(last(10)),
            "gain": F.greatest(F.col("close") - F.lag("close").over(w), F.lit(0.0)), "loss": F.greatest(F.lag("close").over(w) - F.col("close"), F.lit(0.0)),
        }
    ).withColumns({"_s50": total(back("_s10", 10, 20, 30, 40)), "_h50": F.greatest(*back("_h10", 10, 20, 30, 40)), "sma20": total(back("_s10", 10)) / 20})
    rows = rows.withColumns({"_s150": total(back("_s50", 50, 100)), "high_52w": F.greatest(*back("_h50", 50, 100, 150, 200)), "sma50": F.col("_s50") / 50})
    rows = rows.withColumns({"sma150": F.col("_s150") / 150, "sma200": (F.col("_s50") + F.lag("_s150", 50).over(w)) / 200})
    up, down = F.sum("gain").over(last(14)), F.sum("loss").over(last(14))
    return rows.select(
        *bars.columns, "prev_close", "sma20", "sma50", "sma150", "sma200", "high_52w", "perf_1m", "perf_3m", "perf_6m", "avg_volume_10d", "atr", F.lag("sma200").over(w).alias("sma200_prev"),
        F.try_divide(F.col("volume").cast("double"), F.col("avg_volume_10d")).alias("relative_volume"), ((F.try_divide(F.col("close"), F.col("prev_close")) - 1) * 100).alias("change_pct"),
        ((F.try_divide(F.col("open"), F.col("prev_close")) - 1) * 100).alias("gap_pct"), ((F.try_divide(F.col("close"), F.col("high_52w")) - 1) * 100).alias("distance_52w_high"),
        full(F.try_divide(up * 100, up + down), 15).alias("rsi14"),
    )


def landed_bars(spark: SparkSession, path: str) -> DataFrame:
    """Provider JSON (millisecond times); bars with a missing field are dropped."""
    rows = spark.read.schema(BARS).json(path).select("ticker", F.explode("results").alias("b"))
    date = F.to_date(F.timestamp_millis(F.col("b.t")))
    out = rows.select("ticker", date.alias("date"), *(F.col(f"b.{k}").alias(n) for k, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)))
    return out.dropna().withColumns({"volume": F.col("volume").cast("long"), "adjusted_close": F.col("close")})


def landed_text_bars(spark: SparkSession, path: str) -> DataFrame:
    """The second provider's JSON: numbers as strings, unreadable ones 0, unreadable dates dropped."""
    rows = spark.read.schema(TEXT_BARS).json(path).select(F.col("symbol").alias("ticker"), F.explode("values").alias("b"))
    number = lambda n: F.coalesce(F.col(f"b.{n}").try_cast("double"), F.lit(0.0)).alias(n)
    date = F.col("b.datetime").try_cast("date").alias("date")
    out = rows.select("ticker", date, number("open"), number("high"), number("low"), number("close"), F.coalesce(F.col("b.volume").try_cast("long"), F.lit(0).cast("long")).alias("volume"))
    return out.where(F.col("date").isNotNull()).withColumn("adjusted_close", F.lit(None).cast("double"))


def landed_splits(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("ticker string, execution_date date, split_from double, split_to double").json(path)
    kind = F.when(F.col("split_from") > F.col("split_to"), "reverse_split").otherwise("split")
    return rows.select("ticker", F.col("execution_date").alias("ex_date"), kind.alias("action_type"), F.try_divide(F.col("split_to"), F.col("split_from")).alias("ratio"))


def training_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
