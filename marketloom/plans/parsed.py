"""Registered queries over report texts: each day's list is written out as a text of one of three shapes and read back; the
DuckDB side works the fields out of the bars without any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parsing
from ..sources import market as src
from .lists import rank_lists
from .sql import BARS, LISTS, with_

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Picks with a name in letters and prices in whole cents.
PICKED = """
picked AS (
  SELECT list_type, r.date, rank, 'STOCK_' || translate(ticker, 'T0123456789', 'TABCDEFGHIJ') AS name, ticker, CAST(floor(close * 100) AS BIGINT) AS c, volume AS v
  FROM rank_lists r JOIN candles USING (ticker, date)
)"""


def picked(spark: SparkSession, d: str) -> DataFrame:
    bars = src.candles(spark, d)
    rows = rank_lists(bars).join(bars.select("ticker", "date", F.floor(F.col("close") * 100).alias("c"), F.col("volume").alias("v")), ["ticker", "date"])
    return rows.select("list_type", "date", "rank", F.concat(F.lit("STOCK_"), F.translate("ticker", "T0123456789", "TABCDEFGHIJ")).alias("name"), "ticker", "c", "v")


def money(cents: Column) -> Column:
    """12345678 -> $123,456.78"""
    return F.concat(F.lit("$"), F.format_number(F.call_function("div", cents, F.lit(100)), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def tenths(n: Column) -> Column:
    return F.concat(F.call_function("div", n, F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string"))


def text_of(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """A report a list and day: momentum in numbered blocks and a table, leaders in named blocks, the third in tables alone."""
    p = picked(spark, d)
    c, v, name = F.col("c"), F.col("v"), F.col("name")
    low, high, stop, one, two = (money(c + n) for n in (0, 137, -250, 1000, 2000))
    rank, risk, ratio = F.col("rank").cast("string"), tenths(v % 90 + 5), tenths(F.col("rank") * 7 + 10)
    size = F.when(v % 3 == 0, "Standard (20%)").when(v % 3 == 1, "full").otherwise("Reduced")
    numbered = text_of("**", rank, ". ", name, " — of the day**\n- **Entry zone**: ", low, "–", high, "\n- **Stop**: ", stop, ", Risk ", risk, "%\n- **T1 / T2**: ", one, " / ", two, "\n- **R/R**: ", ratio, ":1\n- **Size**: ", size, "\n- **Hold period**: 2 weeks\n- **A/D**: accumulation\n- **Conviction**: high\n\n")
    named = text_of("### ", name, "\nSetup: Tight base **\nEntry range: ", low, " to ", high, "\nStop: ", stop, "\nTarget 1: ", one, "\nTarget 2: insufficient data\npays **", ratio, ":1**\nRisk% (of price): **", risk, "%**\nPosition: ", size, "\n", F.when(v % 5 == 0, "Conviction: disqualified\nDisqualifier reason: too thin\n").otherwise("Conviction: high\n"))
    beside = text_of("| ", rank, " | **", name, "** | vcp | low | $1.00 | $2.00 |\n")
    row = text_of("| ", rank, " | ", name, " | cup | ", low, "-", high, " | ", stop, " | ", risk, "% | ", one, " | - | ", ratio, ":1 | ", size, " | low | 5 days | distribution |\n")
    each = p.withColumn("block", F.when(F.col("list_type") == "momentum", numbered).when(F.col("list_type") == "leaders", named)).withColumn("row", F.when(F.col("list_type") == "momentum", beside).when(F.col("list_type") == "ep", row))
    day = each.groupBy("list_type", "date").agg(F.array_sort(F.collect_list(F.struct("rank", "block", "row"))).alias("x"))
    blocks, rows = (F.array_join(F.transform("x", lambda x: x[f]), "") for f in ("block", "row"))
    body = (
        F.when(F.col("list_type") == "momentum", text_of("## Analysis\n\n", blocks, "## Summary\n| Rank | Ticker | Pattern | Conviction | Entry | Stop |\n|---|---|---|---|---|---|\n", rows, "| 9 | STOCK_ZZ | flat | low | $1.00 | $2.00 |\n"))
        .when(F.col("list_type") == "leaders", text_of("intro\n", blocks))
        .otherwise(text_of("| Rank | Ticker |\n|--|--|\n| 1 | OLD |\nthen\n| # | Symbol | Pattern | Entry range | Stop price | Risk pct | Target 1 | T2 (12m) | R:R | Position | Conviction | Hold | A/D |\n|:--|:--|--|--|--|--|--|--|--|--|--|--|--|\n", rows))
    )
    return day.select(F.concat_ws("/", "list_type", "date").alias("report"), body.alias("said"))


@register(with_(BARS, LISTS, PICKED) + """SELECT list_type || '/' || date AS report, list_type <> 'ep' AS from_block, rank, name AS ticker,
 CASE list_type WHEN 'momentum' THEN 'vcp' WHEN 'leaders' THEN 'Tight base' ELSE 'cup' END AS setup, CASE WHEN list_type = 'momentum' THEN 'HIGH' WHEN list_type = 'ep' THEN 'LOW' WHEN v % 5 = 0 THEN 'DISQUALIFIED' ELSE 'HIGH' END AS conviction,
 c / 100 AS entry_low, (c + 137) / 100 AS entry_high, (c - 250) / 100 AS stop_price, (c + 1000) / 100 AS target1, CASE WHEN list_type = 'momentum' THEN (c + 2000) / 100 END AS target2, (v % 90 + 5) / 10 AS risk_pct, (rank * 7 + 10) / 10 AS risk_reward,
 CASE v % 3 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'FULL' ELSE 'REDUCED' END AS position_size, CASE list_type WHEN 'momentum' THEN '2 weeks' WHEN 'ep' THEN '5 days' END AS hold_period, CASE list_type WHEN 'momentum' THEN 'ACCUMULATION' WHEN 'ep' THEN 'DISTRIBUTION' END AS accum_distrib,
 list_type = 'leaders' AND v % 5 = 0 AS disqualified, CASE WHEN list_type = 'leaders' AND v % 5 = 0 THEN 'too thin' END AS disqualifier_reason
FROM picked UNION ALL SELECT DISTINCT 'momentum/' || date, false, 9, 'STOCK_ZZ', 'flat', 'LOW', 1, 1, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL FROM picked WHERE list_type = 'momentum'""")
def h22_h23_h24_c18_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every pick of every report with its fifteen fields."""
    # leaders' headers have no number; they are numbered as they come, which is by rank
    return parsing.picks(reports(spark, d), "report", "said").drop("place")


@register(with_(BARS, LISTS, PICKED) + """, j AS (SELECT *, CASE WHEN v % 7 = 0 THEN 'STOCK_ZZ' ELSE name END AS stock_id FROM picked WHERE list_type = 'momentum'),
s AS (SELECT date, rank, stock_id, CASE WHEN v % 7 <> 0 THEN ticker END AS ticker, CASE WHEN v % 11 = 0 THEN 0 ELSE (c - 250) / 100 END AS stop, v % 150 / 10 AS risk_pct,
 CASE WHEN v % 7 = 0 THEN 'unknown_stock_id' WHEN v % 11 = 0 OR c < 0 THEN 'invalid_stop_or_entry' WHEN v % 13 = 0 THEN 'empty_stop_anchor' END AS error, CASE WHEN v % 2 = 0 THEN '3 weeks' ELSE '4 days' END AS hold_period FROM j WHERE day(date) NOT IN (9, 19, 29))
SELECT date, rank, stock_id, ticker, stop, risk_pct, hold_period, error, CASE WHEN error IS NULL AND risk_pct > 10 THEN 'risk_pct exceeds 10' END AS warning FROM s
UNION ALL SELECT DISTINCT date, NULL, NULL, NULL, NULL, NULL, NULL, 'json_block_not_found', NULL FROM j WHERE day(date) IN (9, 19, 29)""")
def h25_h26_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Each day's contract, fenced on even days and bare after its heading on odd ones, some cut off: selections with ticker, refusal and warning."""
    p = picked(spark, d).where("list_type = 'momentum'")
    v, c = F.col("v"), F.col("c")
    stock = F.when(v % 7 == 0, "STOCK_ZZ").otherwise(F.col("name"))
    one = F.struct(
        "rank", stock.alias("stock_id"), (c / 100).alias("entry_zone_low"), F.when(v % 11 == 0, 0.0).otherwise((c - 250) / 100).alias("stop"), F.when(v % 13 == 0, " ").otherwise("low of {the} day").alias("stop_anchor"),
        (v % 150 / 10).alias("risk_pct"), F.lit(3).alias("hold_weeks"), F.when(v % 2 == 1, 4).otherwise(0).alias("hold_days"))
    said = p.groupBy("date").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("selections"))).alias("json"))
    day = F.dayofmonth("date")
    text = F.when(day % 2 == 0, text_of("so {\n```json\n", F.col("json"), "\n```\nmore")).when(day % 10 == 9, text_of("so\n```json\n", F.col("json"))).otherwise(text_of("{ first }\n## MANDATORY OUTPUT CONTRACT\n", F.col("json"), " done }"))
    known = p.select("date", F.col("name").alias("stock_id"), "ticker")
    found = parsing.contract_selections(said.select("date", text.alias("said")), known, "date", "said")
    return found.select("date", "rank", "stock_id", "ticker", "stop", "risk_pct", "hold_period", "error", "warning")
