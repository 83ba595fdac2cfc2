"""Steps whose cost must not grow faster than their input: what they keep, move and look at."""

import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from marketloom.operators import market, outcomes
from marketloom.sources import market as src

DAY = date(2020, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _bars(spark, tickers, days, close=lambda t, k: 10.0 + (t * 7 + k * 13) % 29):
    rows = [(f"T{t}", DAY + timedelta(days=k), c, c + 1, c - 1, c, 100) for t in range(tickers) for k in range(days) for c in [close(t, k)]]
    return spark.createDataFrame(rows, src.CANDLE)


def test_tops_are_cut_to_few_rows_without_loss(spark):
    odd = [("X1", None, 5.0, None), ("X2", None, 4.0, 1.0), ("X3", DAY, None, None), ("X4", DAY, float("nan"), 2.0), ("X5", DAY, None, 2.0)]
    many = [(f"T{i}", DAY + timedelta(days=i % 2), float(i * 7919 % 1009), 3.0 if i < 40 else float(i % 50)) for i in range(4000)]
    rows = spark.createDataFrame(odd + many, "ticker string, date date, a double, b double")

    def top(df):
        long = df.unpivot(["ticker", "date"], ["a", "b"], "kind", "score").where("score is not null")
        return {tuple(map(str, r)) for r in market.top_per(long, 3, [F.desc("score"), F.asc("ticker")], "date", "kind").collect()}

    few = market.likely_top(rows, 3, ["a", "b"])
    assert top(few) == top(rows)
    assert few.where("a is not null").count() < 60 and few.where("b is null").count() > 0


def test_paths_are_made_for_signals_alone(spark):
    bars = _bars(spark, 4, 40)
    signals = spark.createDataFrame([("T1", DAY + timedelta(days=k), "x") for k in (0, 3, 30, 39)] + [("T2", DAY, "x"), ("T2", DAY, "y"), ("T9", DAY, "x"), ("T1", DAY + timedelta(days=90), "x")], "ticker string, date date, list_type string")
    paths = outcomes.forward_paths(bars, signals, 5, 4)
    got = {(r["ticker"], r["date"], r["list_type"]): [b["date"] for b in r["path"]] for r in paths.collect()}
    want = {(t, d, n): [x for x in (d + timedelta(days=k) for k in range(1, 5)) if x < DAY + timedelta(days=40)] for t, d, n in signals.collect() if t in ("T1", "T2") and d < DAY + timedelta(days=40)}
    assert got == want
    # what no path holds is left out below the window that gathers
    plan = _plan(paths)
    assert "_near" in plan[plan.index("collect_list") :]


def test_frames_of_snapshots_are_short(spark):
    s = src.snapshots(_bars(spark, 2, 260))
    assert max(map(int, re.findall(r"RowFrame, -(\d+), currentrow", _plan(s)))) < 20
    rows = {(r["ticker"], (r["date"] - DAY).days): r for r in s.collect()}
    for (t, k), r in rows.items():
        closes = [10.0 + (int(t[1:]) * 7 + j * 13) % 29 for j in range(k + 1)]
        for n in (20, 50, 150, 200):
            assert r[f"sma{n}"] is None if k + 1 < n else abs(r[f"sma{n}"] - sum(closes[-n:]) / n) < 1e-9
        assert r["high_52w"] == max(closes[-250:]) + 1
    # a series that does not move has means that do not move
    flat = src.snapshots(_bars(spark, 1, 230, lambda t, k: 0.1)).where("sma200_prev is not null")
    assert flat.count() == 30 and flat.where("sma200 <> sma200_prev").count() == 0


def test_lines_are_dealt_by_ticker_once(spark):
    bars = src.candles(spark, "/root/testdata/sf0.001")
    s = src.snapshots(bars).select("ticker", "date", "sma200", "atr")
    assert _plan(s).count("Exchange") == 1


def test_bars_are_joined_to_signals_without_an_exchange_by_date(spark):
    bars = src.candles(spark, "/root/testdata/sf0.001")
    signals = bars.where("date >= '1998-01-01'").groupBy("ticker").agg(F.min("date").alias("date"))
    got = outcomes.with_bars(signals, bars.select("ticker", "date", "close"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in bars.join(signals, ["ticker", "date"]).select("ticker", "date", "close").collect()}
    plan = _plan(got)
    assert "array_contains" in plan[plan.index("hashpartitioning(ticker") :]


def test_more_lines_make_more_partitions(spark, monkeypatch):
    lines = src.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    monkeypatch.setattr(src, "PART_LINES", 500)
    bars = src.candles(spark, "/root/testdata/sf0.001")
    # more than the session's shuffle partitions
    assert bars.rdd.getNumPartitions() == -(-lines // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
