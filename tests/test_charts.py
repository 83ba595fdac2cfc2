"""Trendlines and base tops against plain scans over lists of bars."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import charts

BAR = "ticker string, date date, open double, high double, low double, close double, volume long"
DAY = dt.date(2024, 1, 1)


def frame(spark, series):
    """series: ticker -> list of (high, low)."""
    rows = [(t, DAY + dt.timedelta(days=i), lo, hi, lo, (hi + lo) / 2, 1) for t, bars in series.items() for i, (hi, lo) in enumerate(bars)]
    return spark.createDataFrame(rows, BAR).repartition(3)


def swing_places(values, better):
    return [i for i in range(3, len(values) - 3) if all(better(values[i], values[j]) for j in (*range(i - 3, i), *range(i + 1, i + 4)))]


def scan(bars):
    """kind -> lines and kind -> top, by scanning the lists."""
    high, low = [h for h, _ in bars], [x for _, x in bars]
    hs, ls = swing_places(high, lambda a, b: a > b), swing_places(low, lambda a, b: a < b)
    at = lambda i, v: (DAY + dt.timedelta(days=i), v)
    line = lambda role, i, v, j, u: (role, *at(i, v), *at(j, u))
    n, lines, tops = len(bars), {}, {}
    flat = range(n - 15, n)
    top, bottom = max(high[i] for i in flat), min(low[i] for i in flat)
    lines["flat"] = [line("resistance", n - 15, top, n - 1, top), line("support", n - 15, bottom, n - 1, bottom)]
    down = [(a, b) for a, b in zip(hs, hs[1:]) if high[b] < high[a]]
    up = [(a, b) for a, b in zip(ls, ls[1:]) if low[b] > low[a]]
    vcp = [line("resistance", a, high[a], b, high[b]) for a, b in down[-1:]] + [line("support", a, low[a], b, low[b]) for a, b in up[-1:]]
    if len(vcp) < 2 and len(ls) > 1:
        vcp.append(line("support", ls[-2], low[ls[-2]], ls[-1], low[ls[-1]]))
    lines["vcp"] = vcp
    cup, tops["cup"] = [], None
    if ls:
        deep = min(ls, key=lambda i: (low[i], i))
        lip = max(high[:deep])
        cup.append(line("resistance", 0, lip, n - 1, lip))
        if deep != ls[-1]:
            cup.append(line("support", deep, low[deep], ls[-1], low[ls[-1]]))
        tops["cup"] = lip if 0.08 <= (lip - low[deep]) / lip <= 0.5 else None
    lines["cup"] = cup
    lines["other"] = [line("resistance", a, high[a], b, high[b]) for a, b in list(zip(hs, hs[1:]))[-1:]] + [line("support", a, low[a], b, low[b]) for a, b in list(zip(ls, ls[1:]))[-1:]]
    tops["double"] = None
    if hs and len(ls) > 1:
        inside = [high[i] for i in hs if ls[-2] < i < ls[-1]]
        tops["double"] = max(inside or high[ls[-2] : ls[-1]])
    ceiling, floor = max(high[-25:]), min(low[-25:])
    tops |= {"flat": ceiling if (ceiling - floor) / ceiling <= 0.2 else None, "vcp": high[hs[-1]] if hs else None, "other": ceiling}
    return lines, tops


def walk(rng, n, step):
    out, p = [], 100.0
    for _ in range(n):
        p *= 1 + rng.uniform(-step, step)
        out.append((round(p * (1 + rng.uniform(0, step / 2)), 4), round(p * (1 - rng.uniform(0, step / 2)), 4)))
    return out


def test_lines_and_tops_against_scans(spark):
    rng = random.Random(1)
    series = {f"T{i}": walk(rng, rng.choice([20, 26, 40, 90]), rng.choice([0.004, 0.02, 0.08, 0.3])) for i in range(80)}
    series |= {"up": [(10.0 + i, 9.0 + i) for i in range(30)], "down": [(50.0 - i, 49.0 - i) for i in range(30)], "level": [(5.0, 4.0)] * 25}
    found = charts.structure(frame(spark, series | {"short": [(2.0, 1.0)] * 19}))
    kinds = F.explode(F.array(*(F.lit(k) for k in ("flat", "vcp", "cup", "double", "other")))).alias("kind")
    rows = found.select("*", kinds).select("ticker", "kind", charts.lines(F.col("kind")).alias("lines"), charts.base_top(F.col("kind")).alias("top")).collect()
    assert {r.ticker for r in rows} == set(series)
    hit = dict.fromkeys(("cup", "double", "flat", "vcp", "other"), 0)
    for r in rows:
        lines, tops = scan(series[r.ticker])
        if r.kind in lines:
            assert [tuple(x) for x in r.lines] == lines[r.kind], (r.ticker, r.kind)
        assert r.top == tops[r.kind], (r.ticker, r.kind)
        hit[r.kind] += r.top is not None
    assert min(hit.values()) >= 10


def test_base_types_by_their_words(spark):
    names = ["Tight flat base", "high tight FLAG", "VCP", "volatility", "Cup with Handle", "double bottom", "flat_base", "contraction", "", "ascending"]
    rows = spark.createDataFrame([(x,) for x in names], "base string").select(charts.kind_of(F.col("base"), charts.LINE_KINDS).alias("line"), charts.kind_of(F.col("base"), charts.TOP_KINDS).alias("top")).collect()
    assert [r.line for r in rows] == ["flat", "flat", "vcp", "vcp", "cup", "other", "flat", "vcp", "other", "other"]
    assert [r.top for r in rows] == ["flat", "flat", "vcp", "other", "cup", "double", "flat", "vcp", "other", "other"]


def test_pivot_distance_and_levels(spark):
    near, far = [(10.0, 9.0)] * 24 + [(10.5, 10.1)], [(10.0, 9.0)] * 24 + [(6.0, 5.0)]
    pivot, pct = charts.pivot_distance(charts.lines(F.lit("flat")))
    rows = charts.structure(frame(spark, {"near": near, "far": far})).select("ticker", pivot.alias("pivot"), pct.alias("pct"), charts.base_top(F.lit("other")).alias("base_top"))
    by = {r.ticker: r for r in rows.select("*", *charts.levels()).collect()}
    assert (by["near"].pivot, by["near"].pct) == (10.5, -1.9) and by["far"].pivot is None and by["far"].pct is None
    assert [by["near"][n] for n in ("entry_low", "entry_high", "stop_loss", "target1", "target2")] == pytest.approx([10.5, 11.025, 9.975, 12.6, 13.125])


def test_a_chart_shows_six_months(spark):
    bars = frame(spark, {"T": [(2.0, 1.0)] * 300})
    shown = charts.charted(bars).agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    assert (shown.a, shown.b) == (dt.date(2024, 4, 26), dt.date(2024, 10, 26))


def test_one_exchange_and_no_python(spark):
    plan = charts.structure(frame(spark, {"T": [(2.0, 1.0)] * 30}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1 and "Python" not in plan.replace("ExistingRDD", "")
