"""Indicators over daily series (ticker, date, close ...): one window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.market import over


def frame(n: int) -> Window:
    return over().rowsBetween(-(n - 1), 0)


def sma(n: int, column: str = "close") -> Column:
    """Mean of the last n bars; 0 while there are fewer."""
    return F.when(F.count(column).over(frame(n)) >= n, F.avg(column).over(frame(n))).otherwise(F.lit(0.0))


def session_return(n: int) -> Column:
    """Return over n sessions; 0 where short or the reference is 0."""
    return F.coalesce(F.try_divide(F.col("close"), F.lag("close", n).over(over())) - 1, F.lit(0.0))


def distance_percent(price: Column, mean: Column) -> Column:
    return F.coalesce(F.try_divide(price - mean, mean) * 100, F.lit(0.0))


def distribution_days(n: int = 20) -> Column:
    """Down days on rising volume among the last n bars."""
    return F.sum("down_on_volume").over(frame(n))


def with_distribution_flag(bars: DataFrame) -> DataFrame:
    w = over()
    hit = (F.col("close") < F.lag("close").over(w)) & (F.col("volume") > F.lag("volume").over(w))
    return bars.withColumn("down_on_volume", F.when(hit, 1).otherwise(0))


def drawdown_percent(n: int = 250) -> Column:
    """Percent below the highest close of the last n bars; 0 where that is 0."""
    return F.coalesce((F.try_divide("close", F.max("close").over(frame(n))) - 1) * 100, F.lit(0.0))


def percentile_rank(value: str, *by: str) -> Column:
    """Mean ordinal of ties over n - 1; 1 for a single row."""
    part, same = Window.partitionBy(*by), Window.partitionBy(*by, value)
    n = F.count(F.lit(1)).over(part)
    ordinal = F.rank().over(part.orderBy(value)) - 1 + (F.count(F.lit(1)).over(same) - 1) / 2
    return F.when(n == 1, F.lit(1.0)).otherwise(F.try_divide(ordinal.cast("double"), n - 1))


def ordinal() -> Column:
    """Dense trading-day number within the series."""
    return F.row_number().over(over())


def last_bars(df: DataFrame, n: int = 1) -> DataFrame:
    """The last n rows of each series."""
    w = over(F.desc("date"))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def swings(bars: DataFrame, k: int = 3) -> DataFrame:
    """Bars strictly above (below) their k neighbours on both sides."""
    before, after = over().rowsBetween(-k, -1), over().rowsBetween(1, k)
    full = (F.count("high").over(before) == k) & (F.count("high").over(after) == k)
    high = full & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    low = full & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    flags = bars.withColumns({"swing_high": high, "swing_low": low})
    return flags.where("swing_high or swing_low")


def relative_strength(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ratio of closes on shared dates, each rebased to its first shared date's close; 0 where a base is 0."""
    joined = a.select("ticker", "date", "close").join(b.select("date", F.col("close").alias("base")), "date")
    first = lambda c: F.first(c).over(over().rowsBetween(Window.unboundedPreceding, 0))
    rebased = lambda c: F.try_divide(c, first(c))
    return joined.select("ticker", "date", F.coalesce(F.try_divide(rebased("close"), rebased("base")), F.lit(0.0)).alias("rs"))


def relative_strength_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parity mode: bars zipped by position from the oldest, ratio of closes; 0 where the base is 0."""
    at = F.row_number().over(over())
    left = a.select("ticker", "date", "close", at.alias("k"))
    right = b.withColumn("ticker", F.lit("base")).select(F.row_number().over(over()).alias("k"), F.col("close").alias("base"))
    return left.join(right, "k").select("ticker", "date", F.coalesce(F.try_divide("close", "base"), F.lit(0.0)).alias("ratio"))


def breadth(bars: DataFrame, n: int) -> Column:
    """Share of rows in percent whose close is above their n-bar mean, among rows with a full frame."""
    return F.avg(F.when(F.col(f"bars_{n}") >= n, F.when(F.col("close") > F.col(f"sma_{n}"), 100.0).otherwise(0.0)))


def with_sma(bars: DataFrame, *lengths: int) -> DataFrame:
    columns = {f"sma_{n}": sma(n) for n in lengths} | {f"bars_{n}": F.count("close").over(frame(n)) for n in lengths}
    return bars.withColumns(columns)
