"""Registered chart queries over every series, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, text
from ..sources import market as src
from .sql import BARS, with_

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Swing points numbered from both ends, and what lies between them.
SWINGS = """
c0 AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS d1 FROM candles),
c1 AS (SELECT ticker, date, high, low, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM c0 WHERE date >= d1 - INTERVAL 6 MONTH),
c AS (SELECT *, n - i AS back FROM c1 WHERE n >= 20),
sw AS (SELECT *, i > 3 AND back >= 3 AND high > max(high) OVER b AND high > max(high) OVER a AS hi, i > 3 AND back >= 3 AND low < min(low) OVER b AND low < min(low) OVER a AS lo FROM c
  WINDOW b AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
hs AS (SELECT ticker, i, date, high AS p, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS r FROM sw WHERE hi),
ls AS (SELECT ticker, i, date, low AS p, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS r FROM sw WHERE lo),
hp AS (SELECT b.ticker, b.r, a.date AS t1, a.p AS v1, b.date AS t2, b.p AS v2 FROM hs a JOIN hs b ON a.ticker = b.ticker AND a.r = b.r + 1),
lp AS (SELECT b.ticker, b.r, a.date AS t1, a.p AS v1, b.date AS t2, b.p AS v2 FROM ls a JOIN ls b ON a.ticker = b.ticker AND a.r = b.r + 1),
falling AS (SELECT * FROM hp WHERE v2 < v1 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY r) = 1),
rising AS (SELECT * FROM lp WHERE v2 > v1 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY r) = 1),
ends AS (SELECT ticker, min(date) AS d0, max(date) AS d1, arg_max(close, i) AS close FROM c GROUP BY ticker),
deep AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY p, i) = 1),
lip AS (SELECT c.ticker, max(high) AS lip FROM c JOIN deep USING (ticker) WHERE c.i < deep.i GROUP BY c.ticker),
flat AS (SELECT ticker, min(date) AS d, max(high) AS h, min(low) AS l FROM c WHERE back < 15 GROUP BY ticker),
lines AS (
  SELECT ticker, 'flat' AS kind, 1 AS line, 'resistance' AS role, d AS t1, h AS v1, d1 AS t2, h AS v2 FROM flat JOIN ends USING (ticker)
  UNION ALL SELECT ticker, 'flat', 2, 'support', d, l, d1, l FROM flat JOIN ends USING (ticker)
  UNION ALL SELECT ticker, 'vcp', 1, 'resistance', t1, v1, t2, v2 FROM falling
  UNION ALL SELECT ticker, 'vcp', 2, 'support', t1, v1, t2, v2 FROM rising
  UNION ALL SELECT ticker, 'vcp', 3, 'support', t1, v1, t2, v2 FROM lp WHERE r = 1 AND (ticker NOT IN (SELECT ticker FROM falling) OR ticker NOT IN (SELECT ticker FROM rising))
  UNION ALL SELECT ticker, 'cup', 1, 'resistance', d0, lip, d1, lip FROM lip JOIN ends USING (ticker)
  UNION ALL SELECT ticker, 'cup', 2, 'support', deep.date, deep.p, l.date, l.p FROM deep JOIN ls l USING (ticker) WHERE l.r = 1 AND l.i <> deep.i
  UNION ALL SELECT ticker, 'other', 1, 'resistance', t1, v1, t2, v2 FROM hp WHERE r = 1
  UNION ALL SELECT ticker, 'other', 2, 'support', t1, v1, t2, v2 FROM lp WHERE r = 1
)"""

#: Tops of all kinds of bases.
TOPS = """
low2 AS (SELECT a.ticker, a.i AS i1, b.i AS i2 FROM ls a JOIN ls b ON a.ticker = b.ticker AND a.r = 2 AND b.r = 1),
middle AS (SELECT ticker, (SELECT max(p) FROM hs WHERE hs.ticker = low2.ticker AND hs.i > i1 AND hs.i < i2) AS swing, (SELECT max(high) FROM c WHERE c.ticker = low2.ticker AND c.i >= i1 AND c.i < i2) AS top FROM low2),
recent AS (SELECT ticker, max(high) AS h, min(low) AS l FROM c WHERE back < 25 GROUP BY ticker),
tops AS (
  SELECT ticker, 'cup_with_handle' AS base_type, lip AS base_top FROM lip JOIN deep USING (ticker) WHERE (lip - p) / lip BETWEEN 0.08 AND 0.5
  UNION ALL SELECT ticker, 'double_bottom', coalesce(swing, top) FROM middle WHERE ticker IN (SELECT ticker FROM hs)
  UNION ALL SELECT ticker, 'flat_base', h FROM recent WHERE (h - l) / h <= 0.2
  UNION ALL SELECT ticker, 'VCP', p FROM hs WHERE r = 1
  UNION ALL SELECT ticker, 'consolidation', h FROM recent
)"""

#: Base types as a report may name them, one for each kind.
LINE_BASES = {"flat": "Tight flat base", "vcp": "VCP", "cup": "Cup with handle", "other": "consolidation"}
TOP_BASES = ["cup_with_handle", "double_bottom", "flat_base", "VCP", "consolidation"]


def _structure(spark: SparkSession, d: str) -> DataFrame:
    return charts.structure(charts.charted(src.candles(spark, d)))


def _lined(spark: SparkSession, d: str) -> DataFrame:
    """Each series with its lines for every base type."""
    rows = _structure(spark, d).withColumn("base_type", F.explode(F.array(*map(F.lit, LINE_BASES.values()))))
    kind = charts.kind_of(F.col("base_type"), charts.LINE_KINDS)
    return rows.withColumn("kind", kind).withColumn("lines", charts.lines(F.col("kind")))


@register(with_(BARS, SWINGS) + "SELECT ticker, kind, row_number() OVER (PARTITION BY ticker, kind ORDER BY line) AS line, role, t1, v1, t2, v2 FROM lines")
def l16_trendlines(spark: SparkSession, d: str) -> DataFrame:
    """Every series' trendlines for each kind of base."""
    rows = _lined(spark, d).select("ticker", "kind", F.posexplode("lines").alias("line", "x"))
    return rows.select("ticker", "kind", (F.col("line") + 1).alias("line"), "x.*")


@register(with_(BARS, SWINGS) + """, p AS (SELECT ticker, kind, arg_min(v2, line) AS pivot_price FROM lines WHERE role = 'resistance' GROUP BY ticker, kind), x AS (SELECT ticker, kind, pivot_price, round((close - pivot_price) / pivot_price * 100, 1) AS pct FROM p JOIN ends USING (ticker))
SELECT ticker, kind, pivot_price, pct FROM x WHERE pct BETWEEN -15 AND 15""")
def l16_pivot_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far each series' last close lies from the resistance of each kind of base, where that is near."""
    pivot, pct = charts.pivot_distance(F.col("lines"))
    return _lined(spark, d).select("ticker", "kind", pivot.alias("pivot_price"), pct.alias("pct")).where("pivot_price is not null")


@register(with_(BARS, SWINGS, TOPS) + "SELECT ticker, base_type, base_top, base_top AS entry_low, base_top * 1.05 AS entry_high, base_top * 0.95 AS stop_loss, base_top * 1.2 AS target1, base_top * 1.25 AS target2 FROM tops WHERE base_top > 0")
def l17_base_tops(spark: SparkSession, d: str) -> DataFrame:
    """Every series' base top by kind of base, with the levels drawn from it."""
    return _tops(spark, d).select("ticker", "base_type", "base_top", *charts.levels())


def _tops(spark: SparkSession, d: str) -> DataFrame:
    rows = _structure(spark, d).withColumn("base_type", F.explode(F.array(*map(F.lit, TOP_BASES))))
    return rows.withColumn("base_top", charts.base_top(charts.kind_of(F.col("base_type"), charts.TOP_KINDS))).where("base_top is not null")


@register(with_(BARS, SWINGS, TOPS) + """SELECT ticker, base_type, CASE base_type WHEN 'cup_with_handle' THEN 'Cup with Handle' WHEN 'flat_base' THEN 'Flat Base' WHEN 'VCP' THEN 'VCP (Volatility Contraction)' ELSE base_type END AS label FROM tops WHERE base_top > 0""")
def h34_base_labels(spark: SparkSession, d: str) -> DataFrame:
    """The bases that a series' bars show, with the label that a chart gives them."""
    return _tops(spark, d).select("ticker", "base_type", text.pattern_label(F.col("base_type")).alias("label"))
