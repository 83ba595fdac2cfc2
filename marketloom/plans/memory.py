"""Registered queries that keep state: memories of listed picks and smoothed series, with DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory, outcomes
from ..sources import market as src
from ..streaming import events as ev
from ..streaming import memory as stream
from .lists import _TRADES as TRADES
from .lists import exits, rank_lists, scored_lists
from .sql import BARS, LISTS, OUTCOMES, with_

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Memories of all listed picks on the last day of the bars, with what is known of them.
MEMORIES = """
last AS (SELECT max(date) AS today FROM candles),
known AS (SELECT o.list_type, o.ticker, o.date, o.evaluated_days, o.return_5d, x.exit_type = 'stop' AS stop_hit, x.t1_hit, x.stop FROM outcomes o LEFT JOIN x USING (list_type, ticker, date)),
m AS (
  SELECT r.date, r.list_type, r.ticker, r.ticker || '|' || r.list_type || '|setup_' || r.list_type AS context_summary, c.close, k.*  EXCLUDE (list_type, ticker, date),
    CASE WHEN today - r.date < 7 THEN 'pending' WHEN k.evaluated_days >= 5 THEN 'verified' WHEN today - r.date > 30 THEN 'insufficient_data' ELSE 'pending' END AS status
  FROM rank_lists r JOIN candles c USING (ticker, date) CROSS JOIN last LEFT JOIN known k USING (list_type, ticker, date)
), v AS (
  SELECT date, list_type, ticker, context_summary, printf('$%.2f-$%.2f', floor(close * 100) / 100, floor(close * 102) / 100) AS entry, printf('$%.2f', floor(close * 90) / 100) AS stop, status AS outcome_status,
    CASE WHEN status = 'verified' THEN return_5d END AS return_5d, CASE WHEN status = 'verified' THEN stop_hit END AS stop_hit, CASE WHEN status = 'verified' THEN t1_hit END AS target_hit,
    CASE WHEN status = 'verified' THEN coalesce(nullif(concat_ws(' ', CASE WHEN stop_hit THEN printf('Stop hit at $%.2f.', floor(stop * 100) / 100) END, CASE WHEN t1_hit THEN 'Target 1 reached.' END,
      CASE WHEN return_5d IS NOT NULL THEN printf('5D return: %+.1f%%.', return_5d * 100) END), ''), 'Outcome recorded.') || ' [' || ticker || ']' END AS summary
  FROM m
)"""


def _memories(spark: SparkSession, d: str) -> DataFrame:
    """Every listed pick stored, then looked up on the last day of the bars."""
    bars, cents = src.candles(spark, d), lambda price, n=100: F.floor(price * n) / 100
    picks = outcomes.with_bars(rank_lists(bars), bars.select("ticker", "date", "close"))
    picks = picks.select(*memory.KEYS, F.lit("v1").alias("prompt_version"), F.col("list_type").alias("setup"), F.lit("").alias("conviction"), *(cents(F.col("close"), n).alias(c) for c, n in (("entry_low", 100), ("entry_high", 102), ("stop", 90))))
    x = exits(bars).select(*memory.KEYS, (F.col("exit_type") == "stop").alias("stop_hit"), F.col("t1_hit").alias("target1_hit"), cents(F.col("stop")).alias("recommended_stop"))
    known = scored_lists(spark, d).select(*memory.KEYS, "evaluated_days", "return_5d").join(x, memory.KEYS, "left")
    today = bars.agg(F.max("date")).first()[0]
    return memory.updated(memory.stored(None, picks), known, F.lit(today))


@register(with_(BARS, LISTS, OUTCOMES) + TRADES + "," + MEMORIES + "SELECT date, list_type, ticker, context_summary, entry, stop, outcome_status, round(return_5d, 6) AS return_5d, stop_hit, target_hit, summary FROM v")
def j4_l15_memories(spark: SparkSession, d: str) -> DataFrame:
    """Memories with their outcomes: pending, verified or given up by their age and their bars."""
    return _memories(spark, d).select(
        *memory.KEYS, "context_summary", "entry", "stop", "outcome_status", F.round("outcome_return_5d", 6).alias("return_5d"), F.col("outcome_stop_hit").alias("stop_hit"),
        F.col("outcome_target_hit").alias("target_hit"), F.col("outcome_summary").alias("summary"),
    )


@register(with_(BARS, LISTS, OUTCOMES) + """, born AS (SELECT list_type, ticker, date FROM rank_lists), ready AS (SELECT p.list_type, p.ticker, p.date, p.d AS day, o.return_5d FROM paths p JOIN outcomes o USING (list_type, ticker, date) WHERE p.k = 5),
last AS (SELECT greatest((SELECT max(date) FROM born), (SELECT max(day) FROM ready)) AS today),
f AS (SELECT b.*, r.day, r.return_5d, coalesce(r.day <= b.date + 31, false) AS ok FROM born b LEFT JOIN ready r USING (list_type, ticker, date)),
g AS (SELECT *, CASE WHEN ok THEN greatest(day, date + 7) ELSE date + 31 END AS closed_on FROM f)
SELECT list_type, ticker, date, CASE WHEN ok THEN 'verified' ELSE 'insufficient_data' END AS status, closed_on, CASE WHEN ok THEN round(return_5d, 6) END AS return_5d FROM g, last WHERE closed_on < today - 1 OR (ok AND closed_on = day)""")
def j4_memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """Picks and outcomes landed as events in the order of months, and closed by timers as event time goes on."""
    bars = src.candles(spark, d)
    picks = rank_lists(bars).select("list_type", "ticker", "date")
    paths = outcomes.forward_paths(bars, picks)
    entry, fifth = F.get("path", F.lit(0))["open"], F.get("path", F.lit(4))
    ready = paths.where(fifth.isNotNull() & entry.isNotNull()).select("list_type", "ticker", "date", fifth["date"].alias("on"), (F.try_divide(fifth["close"], entry) - 1).alias("return_5d"))
    events = picks.withColumns({"on": F.col("date"), "return_5d": F.lit(None).cast("double")}).unionByName(ready)
    events = events.withColumn("day", F.unix_date("on").cast("long")).drop("on")
    folder = f"{ev.shared_folder(spark)}/memory-{uuid.uuid4().hex}"
    events.write.parquet(folder)
    landed = spark.readStream.schema(events.schema).parquet(folder)
    return ev.finished(stream.closed(landed)).withColumn("return_5d", F.round("return_5d", 6))


@register("WITH RECURSIVE" + with_(BARS).removeprefix("WITH") + """, r AS (SELECT ticker, date, coalesce((close - low) / nullif(high - low, 0), 0.5) AS raw, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM candles),
s AS (SELECT ticker, date, n, raw, raw AS s FROM r WHERE n = 1 UNION ALL SELECT r.ticker, r.date, r.n, r.raw, CASE WHEN r.raw - s.s < -0.25 THEN r.raw ELSE 0.5 * r.raw + 0.5 * s.s END FROM s JOIN r ON r.ticker = s.ticker AND r.n = s.n + 1)
SELECT ticker AS series, date, round(raw, 6) AS raw, round(s, 6) AS smoothed FROM s""")
def j1_smoothed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Where each bar closed within its range, smoothed for every ticker by a stream that is stopped half way and goes on."""
    place = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    days = src.candles(spark, d).select(F.col("ticker").alias("series"), "date", place.alias("raw"))
    folder = f"{ev.shared_folder(spark)}/smoothed-{uuid.uuid4().hex}"
    for half in (F.year("date") < 1998, F.coalesce(F.year("date") >= 1998, F.lit(True))):
        days.where(half).write.mode("append").parquet(f"{folder}/days")
        done = ev.finished(ev.smoothed_stream(spark.readStream.schema(days.schema).parquet(f"{folder}/days")), folder)
    return done.select("series", "date", F.round("raw", 6).alias("raw"), F.round("smoothed", 6).alias("smoothed"))
