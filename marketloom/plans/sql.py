"""Common table expressions of the DuckDB side: the same projections as sources.market."""

BARS = """
bars AS (
  SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS ticker, l_suppkey, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, l_quantity AS q,
    row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k
  FROM lineitem
), candles AS (
  SELECT ticker, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(sum(q) AS BIGINT) AS volume
  FROM bars GROUP BY ticker, date
), listed AS (
  SELECT 'T' || CAST(s_suppkey AS VARCHAR) AS ticker, n_name AS sector, r_name AS exchange
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), spy AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close, count(*) AS volume FROM orders GROUP BY 1
), sectors AS (
  SELECT n_name AS ticker, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(sum(q) AS BIGINT) AS volume
  FROM bars JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, date
)"""

#: Columns of sources.market.snapshots.
SNAPS = """
s1 AS (
  SELECT *, lag(close) OVER w AS prev_close,
    CASE WHEN count(close) OVER f20 >= 20 THEN avg(close) OVER f20 END AS sma20, CASE WHEN count(close) OVER f50 >= 50 THEN avg(close) OVER f50 END AS sma50,
    CASE WHEN count(close) OVER f150 >= 150 THEN avg(close) OVER f150 END AS sma150, CASE WHEN count(close) OVER f200 >= 200 THEN avg(close) OVER f200 END AS sma200,
    max(high) OVER f250 AS high_52w, (close / lag(close, 21) OVER w - 1) * 100 AS perf_1m, (close / lag(close, 63) OVER w - 1) * 100 AS perf_3m,
    (close / lag(close, 126) OVER w - 1) * 100 AS perf_6m, CASE WHEN count(close) OVER f10 >= 10 THEN avg(volume) OVER f10 END AS avg_volume_10d,
    CASE WHEN count(close) OVER f14 >= 14 THEN avg(high - low) OVER f14 END AS atr,
    greatest(close - lag(close) OVER w, 0.0) AS gain, greatest(lag(close) OVER w - close, 0.0) AS loss
  FROM candles
  WINDOW w AS (PARTITION BY ticker ORDER BY date), f10 AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING), f14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING),
    f20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), f50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING),
    f150 AS (PARTITION BY ticker ORDER BY date ROWS 149 PRECEDING), f200 AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING),
    f250 AS (PARTITION BY ticker ORDER BY date ROWS 249 PRECEDING)
), snaps AS (
  SELECT *, lag(sma200) OVER w AS sma200_prev, volume / avg_volume_10d AS relative_volume, (close / prev_close - 1) * 100 AS change_pct,
    (open / prev_close - 1) * 100 AS gap_pct, (close / high_52w - 1) * 100 AS distance_52w_high,
    CASE WHEN count(close) OVER f14 >= 15 THEN NULL WHEN count(close) OVER f15 >= 15 THEN sum(gain) OVER f14 * 100 / nullif(sum(gain) OVER f14 + sum(loss) OVER f14, 0) END AS rsi14
  FROM s1
  WINDOW w AS (PARTITION BY ticker ORDER BY date), f14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), f15 AS (PARTITION BY ticker ORDER BY date ROWS 14 PRECEDING)
)"""

#: The three daily lists of plans.lists.rank_lists.
LISTS = """
scored AS (
  SELECT ticker, date, close / lag(close, 21) OVER w - 1 AS momentum, close / lag(close, 63) OVER w - 1 AS leaders,
    volume / nullif(lag(volume) OVER w, 0) AS ep
  FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date)
), long AS (
  SELECT ticker, date, 'momentum' AS list_type, momentum AS score FROM scored WHERE momentum IS NOT NULL
  UNION ALL SELECT ticker, date, 'leaders', leaders FROM scored WHERE leaders IS NOT NULL
  UNION ALL SELECT ticker, date, 'ep', ep FROM scored WHERE ep IS NOT NULL
), rank_lists AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, list_type ORDER BY score DESC, ticker) AS rank FROM long) WHERE rank <= 3
)"""

#: Forward results of every list row, by a range join.
OUTCOMES = """
paths AS (
  SELECT r.ticker, r.date, r.list_type, r.rank, r.score, c.date AS d, c.open, c.high, c.low, c.close,
    row_number() OVER (PARTITION BY r.list_type, r.ticker, r.date ORDER BY c.date) AS k
  FROM rank_lists r JOIN candles c ON c.ticker = r.ticker AND c.date > r.date AND c.date <= r.date + 50
), outcomes AS (
  SELECT list_type, ticker, date, any_value(rank) AS rank, any_value(score) AS score, CAST(count(*) AS INT) AS evaluated_days,
    max(CASE WHEN k = 1 THEN open END) AS entry_price,
    max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 1 THEN open END) - 1 AS return_1d,
    max(CASE WHEN k = 5 THEN close END) / max(CASE WHEN k = 1 THEN open END) - 1 AS return_5d,
    max(CASE WHEN k = 10 THEN close END) / max(CASE WHEN k = 1 THEN open END) - 1 AS return_10d,
    max(CASE WHEN k = 20 THEN close END) / max(CASE WHEN k = 1 THEN open END) - 1 AS return_20d,
    max(high) / max(CASE WHEN k = 1 THEN open END) - 1 AS max_runup, min(low) / max(CASE WHEN k = 1 THEN open END) - 1 AS max_drawdown
  FROM paths WHERE k <= 20 GROUP BY list_type, ticker, date
)"""


#: Every query vector against every other labelled one.
NEAREST = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
m AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, round(1 - list_dot_product(q.e, r.e) / (q.size * r.size), 6) AS distance FROM n q JOIN n r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND r.label IS NOT NULL AND q.size * r.size > 0)
"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"
