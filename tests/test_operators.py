"""Golden values and edge cases of the market operators."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from marketloom.functions import columns as fn
from marketloom.operators import evaluation, indicators, market, outcomes, text, vectors
from marketloom.plans.relational import memory_status
from marketloom.sources import market as src
from marketloom.sources import sinks
from marketloom.streaming import events

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, ticker="A", volume=None, spread=0.0):
    rows = [(ticker, DAY + dt.timedelta(days=i), float(c), c + spread, c - spread, float(c), (volume or [100] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, src.CANDLE)


def values(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize(("xs", "want"), [([10, 20, 20, 30], [0, 0.5, 0.5, 1]), ([5, 5, 10, 20], [1 / 6, 1 / 6, 2 / 3, 1]), ([42], [1.0]), ([], [])])
def test_percentile_ranks(spark, xs, want):
    df = spark.createDataFrame([(i, float(x), "g") for i, x in enumerate(xs)], "i int, x double, g string")
    got = [r.p for r in df.withColumn("p", indicators.percentile_rank("x", "g")).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_means_returns_and_distribution_days(spark):
    b = bars(spark, [1, 2, 3, 4, 3, 2], volume=[1, 1, 1, 1, 2, 1])
    assert values(b.withColumn("m", indicators.sma(3)), "m") == pytest.approx([0, 0, 2, 3, 10 / 3, 3])
    assert values(b.withColumn("r", indicators.session_return(2)), "r") == pytest.approx([0, 0, 2, 1, 0, -0.5])
    flagged = indicators.with_distribution_flag(b)
    assert values(flagged.withColumn("n", indicators.distribution_days(3)), "n") == [0, 0, 0, 0, 1, 1]
    assert values(b.withColumn("d", indicators.drawdown_percent()), "d")[-1] == pytest.approx(-50)
    assert [(r.swing_high, r.swing_low) for r in indicators.swings(b, 2).collect()] == [(True, False)]


def test_relative_strength_by_date_and_by_position(spark):
    a, b = bars(spark, [2, 4, 8]), bars(spark, [1, 1, 2, 2])
    assert values(indicators.relative_strength(a, b), "rs") == pytest.approx([1, 2, 2])
    assert values(indicators.relative_strength_by_position(a, b), "ratio") == pytest.approx([2, 4, 4])


def test_smoothing_bypasses_sharp_falls(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i), x) for i, x in enumerate([0.8, 0.6, 0.2, 0.4])], "date date, raw double")
    assert values(market.smoothed(days), "smoothed") == pytest.approx([0.8, 0.7, 0.2, 0.3])


def test_regime_labels_and_gates(spark):
    df = spark.createDataFrame([(0.8, -5.0, "bull", 10.0), (0.8, -20.0, "correction", 28.0), (0.8, -20.1, "Correction", None), (0.39, -31.0, None, 10.0)], "s double, d double, r string, v double")
    got = df.select(market.regime_label(F.col("s"), F.col("d")).alias("l"), market.circuit_breaker(F.col("r"), F.col("v")).alias("g")).collect()
    assert [(r.l, r.g) for r in got] == [("strong_bull", "full"), ("strong_bull", "halt"), ("correction", "ep_only"), ("bear", "halt")]
    vix = spark.createDataFrame([(14.0, 25.0), (40.0, 25.0), (None, 1.0), (24.9, 0.0)], "l double, c double")
    assert [r.p for r in vix.select(market.vix_points(F.col("l"), F.col("c")).alias("p")).collect()] == [0.75, 0.0, 0.5, 0.5]


def forward(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 100.0 + i, 101.5 + i, 99.5 + i - 0.5 + 0.5 + 0.0, 100.5 + i, 1) for i in range(21)]
    return spark.createDataFrame([(t, d, o, c + 1, o - 1, c, v) for t, d, o, _, _, c, v in rows], src.CANDLE)


def test_forward_path_golden(spark):
    signal = spark.createDataFrame([("A", DAY, "x")], "ticker string, date date, list_type string")
    r = outcomes.outcomes(outcomes.forward_paths(forward(spark), signal)).first()
    assert (r.entry_price, r.evaluated_days) == (101.0, 20)
    assert r.return_5d == pytest.approx(0.04455, abs=1e-5) and r.return_10d == pytest.approx(0.09406, abs=1e-5)
    assert r.return_20d == pytest.approx(0.19307, abs=1e-5) and r.max_runup == pytest.approx(0.20297, abs=1e-5) and r.max_drawdown == pytest.approx(-0.00990, abs=1e-5)


def test_whipsaw_exits_at_the_stop(spark):
    b = spark.createDataFrame([("A", DAY, 141.5, 156.0, 135.0, 150.0, 1)], src.CANDLE)
    trades = spark.createDataFrame([("A", DAY, 141.5, 136.8, 155.0, 170.0), ("A", DAY, 141.5, 100.0, None, None)], "ticker string, date date, entry double, stop double, t1 double, t2 double")
    stop, time = outcomes.replay_exits(b, trades).orderBy(F.desc("stop")).collect()
    assert (stop.exit_type, stop.exit_price, stop.t1_hit) == ("stop", 136.8, True) and stop.actual_rr == pytest.approx(-1.0)
    assert (time.exit_type, time.exit_price, time.t1_hit) == ("time", 150.0, False)


def test_costs_levels_and_sizes(spark):
    df = spark.createDataFrame([(30.0, 6e7, "stop"), (6.0, 6e6, None), (1.0, 1.0, "time")], "p double, v double, e string")
    df = df.withColumn("t", outcomes.slippage_tier(F.col("p"), F.col("v")))
    got = df.select("t", outcomes.net_return(F.lit(0.1), F.col("t"), F.col("e")).alias("n"), outcomes.capped_size(F.lit(5.0), F.col("v"), F.lit(1e5)).alias("s")).collect()
    assert [r.t for r in got] == ["leaders", "ep_tier1", "default"]
    assert [r.n for r in got] == pytest.approx([0.0965, 0.095, 0.0925]) and got[2].s == pytest.approx(0.00002) and got[0].s == 5.0
    lv = spark.createDataFrame([(10.0, 10.5, 10.0, 12.0, None, "x"), (10.0, 10.5, 9.0, None, None, "x"), (10.0, 10.5, 9.0, 10.5, None, "x"), (10.0, 10.5, 9.0, 12.0, 11.0, "x"), (10.0, 10.5, 9.0, 12.9, None, " ep_tier1"), (10.0, 10.5, 9.0, 13.5, 14.0, "vcp")], "a double, b double, s double, t1 double, t2 double, k string")
    errors = [r.e for r in lv.select(outcomes.level_error(*(F.col(c) for c in ("a", "b", "s", "t1", "t2", "k"))).alias("e")).collect()]
    assert errors == ["stop_too_high", "no_target", "target_too_low", "second_below_first", "reward_too_small", None]
    be = spark.createDataFrame([(0.01234,), (-0.0003,), (None,)], "g double").select(fn.breakeven_bps(F.col("g")).alias("b")).collect()
    assert [r.b for r in be] == [123.0, -2.0, None]


def test_auc_and_tests(spark):
    def auc(y, s):
        return evaluation.auc(spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double"), "y", "s").first().auc

    assert auc([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]) == 0.75
    assert auc([0, 1, 0, 1], [0.5] * 4) == 0.5 and auc([1, 1], [0.1, 0.2]) == 0.5
    cdf = spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "x double").select(fn.normal_cdf(F.col("x")).alias("p")).collect()
    assert [r.p for r in cdf] == pytest.approx([0.5 * math.erfc(1.96 / math.sqrt(2)), 0.5, 0.841344746], abs=1e-7)


def test_logistic_weights_find_the_signal(spark):
    rows = spark.createDataFrame([(x / 10, ((x * 7) % 10) / 10 - 0.5, float(x > 0)) for x in range(-20, 21)], "a double, b double, y double")
    w = evaluation.logistic_weights(rows, ["a", "b"], "y", epochs=30)
    assert sum(w) == pytest.approx(1) and w[0] > 0.7 and min(w) >= 0
    assert evaluation.logistic_weights(rows.limit(0), ["a", "b"], "y") == [0.5, 0.5]


def test_walk_forward(spark):
    rows = spark.createDataFrame([(DAY + dt.timedelta(days=i // 3), i, "g%d" % (i % 4)) for i in range(60)], "date date, i int, g string")
    got = evaluation.walk_forward(rows, ["date", "i"], 2, 5).groupBy("fold", "side").agg(F.min("row").alias("a"), F.max("row").alias("b")).collect()
    assert {(r.fold, r.side): (r.a, r.b) for r in got} == {(1, "train"): (0, 19), (1, "valid"): (25, 44), (2, "train"): (0, 39), (2, "valid"): (45, 59)}
    assert evaluation.walk_forward(rows, ["date", "i"], 2, 5, "g").where("side = 'train'").count() == 0


def test_parsers(spark):
    df = spark.createDataFrame([("$1,234.50",), ("N/A",), ("insufficient data",), ("about 7",), ("",), (None,)], "s string")
    assert [r.p for r in df.select(fn.parse_price(F.col("s")).alias("p")).collect()] == [1234.5, None, None, 7.0, None, None]
    low, high = fn.entry_zone(F.col("s"))
    zones = spark.createDataFrame([("$10 – $12",), ("10-11.5",), ("5 to 6",), ("7",)], "s string").select(low.alias("a"), high.alias("b")).collect()
    assert [(r.a, r.b) for r in zones] == [(10.0, 12.0), (10.0, 11.5), (5.0, 6.0), (7.0, 7.0)]
    said = spark.createDataFrame([("x ```json\n{\"a\": 1}\n``` y",), ("x ```json {\"a\"",), ("PICK: {\"a\": {\"b\": 2}} }",), ("none",), (None,)], "s string")
    got = said.select(text.fenced_json(F.col("s")).alias("f"), text.braced_json(F.col("s")).alias("b")).collect()
    assert got[0].f == '{"a": 1}' and got[1].f is None and got[2].b == '{"a": {"b": 2}}' and got[3].b is None
    table = spark.createDataFrame([("a\n| T | P |\n|:--|--:|\n| X** | 5 |\n| bad |\n",), ("none",)], "s string").select(text.table_rows(F.col("s")).alias("t")).collect()
    assert table[0].t == [{"t": "X", "p": "5"}] and table[1].t == []
    sizes = spark.createDataFrame([("5-10%",), ("4%",), ("Half position",), ("Full",), ("none",)], "s string").select(text.shortened_size(F.col("s")).alias("v")).collect()
    assert [r.v for r in sizes] == ["3.5-7.0%", "2.8%", "Third position", "Two-thirds", "none (reduced 30%)"]
    names = spark.createDataFrame([(0,), (25,), (26,), (51,), (52,)], "n int").select(text.anonymous_name(F.col("n")).alias("v")).collect()
    assert [r.v for r in names] == ["A", "Z", "AA", "AZ", "BA"]


def test_leaders_with_engineered_earnings(spark):
    wide = (13.0, 6.0, 3.0, 10.0, 50.0, 45.0)
    calm = (2.0, 1.0, 3.0, 10.0, 50.0, 0.0)
    top = (13.0, 1.0, 3.0, 60.0, 50.0, 55.0)
    rows = [("a", *calm, 12.1, 4.0, ["old"]), ("b", *calm, 12.0, 4.0, None), ("c", *calm, 99.0, 5.0, None), ("d", *calm, 99.0, 0.0, None), ("e", *calm, None, 1.0, None), ("f", *wide, 99.0, 1.0, None), ("g", *top, 99.0, 1.0, None)]
    df = spark.createDataFrame(rows, "ticker string, high double, low double, atr double, close double, high_52w_before double, perf_3m double, eps_growth double, revenue_growth double, risk_flags array<string>")
    got = {r.ticker: r for r in market.stage1(df, "leaders").collect()}
    assert {t: r.status for t, r in got.items()} == {"a": "flagged", "b": "passed", "c": "passed", "d": "passed", "e": "passed", "f": "flagged", "g": "eliminated"}
    assert (got["a"].risk_flags, got["b"].risk_flags, got["f"].risk_flags) == (["old", "FINANCIAL_ENGINEERING_RISK"], [], ["WIDE_RANGE_WARNING"])
    assert got["g"].metrics == {"today_range": 12.0, "atr": 3.0, "range_mult": 4.0, "close": 60.0, "price_52w_high": 50.0, "perf_3m": 55.0}
    assert got["g"].reason == "Climax top: range 12.00 = 4.0×ATR, close 60.00 above 52W high 50.00, perf_3m 55.0%" and got["a"].reason is None
    assert market.stage1(df, "momentum").where("ticker = 'a'").first().status == "passed"


def test_numbers_for_readers(spark):
    df = spark.createDataFrame([(None,), (999.0,), (1500.0,), (2500.0,), (45_678.0,), (1_250_000.0,), (3.2e9,), (4.5e12,)], "x double")
    shown = lambda f: [r.v for r in df.select(f(F.col("x")).alias("v")).collect()]
    none = "[DATA MISSING]"
    assert shown(fn.human_number) == [none, "999", "2K", "2K", "46K", "1.2M", "3.2B", "4500.0B"]
    assert shown(fn.human_volume) == [none, "999", "2K", "2K", "46K", "1.2M", "3200.0M", "4500000.0M"]
    assert shown(fn.market_cap) == [none, "$999", "$1500", "$2500", "$45678", "$1M", "$3.2B", "$4.5T"]
    assert shown(fn.revenue) == [none, "$999", "$1500", "$2500", "$45678", "$1M", "$3.2B", "$4500.0B"]


def test_stage1_and_row_errors(spark):
    rows = [("a", 13.0, 1.0, 3.0, 60.0, 50.0, 55.0, 1.0, 1.0), ("b", 13.0, 6.0, 3.0, 10.0, 50.0, 45.0, 1.0, 1.0), ("c", 13.0, 12.0, 3.0, 60.0, 50.0, None, 1.0, 1.0), ("d", 9.0, 1.0, None, 60.0, 50.0, 90.0, 31.0, 51.0)]
    df = spark.createDataFrame(rows, "ticker string, high double, low double, atr double, close double, high_52w_before double, perf_3m double, gap_pct double, perf_1m double")
    assert [(r.status, r.risk_flags) for r in market.stage1(df, "momentum").orderBy("ticker").collect()] == [("eliminated", []), ("flagged", ["WIDE_RANGE_WARNING"]), ("passed", []), ("passed", [])]
    assert market.stage1(df, "ep").orderBy("ticker").collect()[3].risk_flags == ["EXHAUSTION_RISK"]
    bad = spark.createDataFrame([(5.0, float("nan")), (11.0, -1.0), (None, float("inf"))], "a double, b double").select(market.row_errors({"a": (0, 10), "b": (0, 1)}).alias("e")).collect()
    assert [r.e for r in bad] == [[], ["a out of range", "b out of range"], []]


def test_keyed_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, v string, w double")
    new = spark.createDataFrame([(2, "c", 2.0, 1), (2, "d", None, 2), (3, "e", 3.0, 1)], "k int, v string, w double, at int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(sinks.upsert(old, new, ["k"], "at")) == [(1, "a", 1.0), (2, "d", None), (3, "e", 3.0)]
    assert rows(sinks.insert_if_absent(old, new.where("at = 1").drop("at"), ["k"])) == [(1, "a", 1.0), (2, "b", None), (3, "e", 3.0)]
    assert rows(sinks.update_from(old, new.where("at = 1"), ["k"], ["v", "w"], only_missing=True)) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert rows(sinks.precedence_upsert(old, new.where("at = 2").drop("at"), ["k"], ["v"], F.col("o_v") == "b", ["w"])) == [(1, "a", 1.0), (2, "b", None)]
    assert rows(sinks.delete_keys(old, new, ["k"])) == [(1, "a", 1.0)]
    sinks.write_partitions(old, f"file://{tmp_path}/t", "k")
    sinks.write_partitions(old.where("k = 2").withColumn("v", F.lit("z")), f"file://{tmp_path}/t", "k")
    assert sorted(r.v for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == ["a", "z"]


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ticker": "A", "results": [{"t": 1704067200000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10}, {"t": 1704153600000, "o": 1, "h": 2, "l": None, "c": 1.5, "v": 10}]}))
    (tmp_path / "b.json").write_text(json.dumps({"symbol": "B", "values": [{"datetime": "2024-01-01", "open": "1", "high": "x", "low": "1", "close": "2", "volume": "7"}, {"datetime": "bad", "open": "1", "high": "1", "low": "1", "close": "2", "volume": "7"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"ticker": "C", "execution_date": "2024-02-01", "split_from": 10, "split_to": 1}))
    a = src.landed_bars(spark, f"file://{tmp_path}/a.json").collect()
    assert [(r.date, r.close, r.volume, r.adjusted_close) for r in a] == [(DAY, 1.5, 10, 1.5)]
    b = src.landed_text_bars(spark, f"file://{tmp_path}/b.json").collect()
    assert [(r.date, r.high, r.close, r.adjusted_close) for r in b] == [(DAY, 0.0, 2.0, None)]
    c = src.landed_splits(spark, f"file://{tmp_path}/c.json").first()
    assert (c.action_type, c.ratio) == ("reverse_split", 0.1)


def test_splits_duplicates_and_status(spark):
    rows = spark.createDataFrame([("A", DAY, "x", 0.2), ("B", DAY, "x", 0.2)], "ticker string, date date, list_type string, return_5d double")
    actions = spark.createDataFrame([("A", DAY + dt.timedelta(days=10), "split", 2.0), ("A", DAY + dt.timedelta(days=11), "split", 2.0)], "ticker string, ex_date date, action_type string, ratio double")
    got = {r.ticker: (r.return_5d, r.action_count) for r in outcomes.adjust_for_splits(rows, actions, 5, "return_5d").collect()}
    assert got == {"A": (0.1, 1), "B": (0.2, 0)}
    lists = spark.createDataFrame([("A", DAY, x) for x in ("ep", "leaders", "momentum")], "ticker string, date date, list_type string")
    assert {r.list_type: r.cross_list_duplicate for r in outcomes.cross_list_duplicates(lists).collect()} == {"leaders": False, "momentum": True, "ep": True}
    s = spark.createDataFrame([(7, 5), (6, 5), (31, 2), (8, 2)], "a int, e int").select(memory_status(F.col("a"), F.col("e")).alias("s")).collect()
    assert [r.s for r in s] == ["verified", "pending", "insufficient_data", "pending"]


def test_smoothing_as_a_stream_resumes(spark, tmp_path):
    schema = "series string, date date, raw double"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    write([("s", DAY, 0.8), ("s", DAY + dt.timedelta(days=1), 0.6)])
    run = lambda: events.finished(events.smoothed_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), f"file://{tmp_path}/out")
    run()
    write([("s", DAY + dt.timedelta(days=2), 0.2), ("s", DAY + dt.timedelta(days=3), 0.4)])
    assert values(run(), "smoothed") == pytest.approx([0.8, 0.7, 0.2, 0.3])


def test_zero_prices_do_not_stop_a_job(spark):
    rows = [("A", dt.date(2024, 1, k), 0.0) for k in (1, 2)] + [("A", dt.date(2024, 1, 3), 5.0)]
    a = spark.createDataFrame(rows, "ticker string, date date, close double")
    base = spark.createDataFrame([(d, c) for _, d, c in rows], "date date, close double")
    assert [r.d for r in a.withColumn("d", indicators.drawdown_percent()).orderBy("date").collect()] == [0, 0, 0]
    assert [r.rs for r in indicators.relative_strength(a, base).collect()] == [0, 0, 0]
    assert sorted(r.ratio for r in indicators.relative_strength_by_position(a, base).collect()) == [0, 0, 1]


def test_equal_headers_and_long_names(spark):
    table = spark.createDataFrame([("| T | T | P |\n|---|---|---|\n| X | Y | 5 |",)], "s string").select(text.table_rows(F.col("s")).alias("t")).first().t
    assert table == [{"t": "X", "p": "5"}]
    names = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (18277,), (18278,), (2**62,)], "n long").select(text.anonymous_name(F.col("n")).alias("v")).collect()
    assert [r.v for r in names[:7]] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"] and len(names[7].v) == 14
    back = spark.sql("select array(named_struct('alias', 'A', 'name', 'one'), named_struct('alias', 'AA', 'name', 'two')) as m").select(text.put_back(F.lit("A, AA; B AAA"), F.col("m")).alias("s"))
    assert back.first().s == "one, two; B AAA"


def test_labels_ids_and_phrases(spark):
    df = spark.createDataFrame([("Deep VCP",), ("Cup",), ("flat_base",), ("TIGHT",), ("other",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.pattern_label(F.col("s"))).collect()] == ["VCP (Volatility Contraction)", "Cup with Handle", "Flat Base", "Tight Base", "other", "", None]

    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h % 2**63

    names = ["a", "ABC_2024-01-02", "T999_1999-12-31"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(text.fnv_id(F.col("s"))).collect()]
    assert got == [fnv(n) for n in names] and got[0] == 0xAF63DC4C8601EC8C % 2**63
    rows = spark.createDataFrame([(0.021, -0.04, 0.12, -0.01, 20), (None, None, 0.06, -0.04, 12), (-0.1, 0.0, -0.01, None, 3)], "return_10d double, return_20d double, max_runup double, max_drawdown double, evaluated_days int")
    assert [tuple(r) for r in rows.select(*outcomes.phrases()).collect()] == [
        ("Two weeks: up 2.1%.", "Whole period: down -4.0%.", "Best: outstanding, +12.0%.", "Worst: minimal, -1.0%.", "Fully tracked."),
        ("", "", "Best: +6.0% before a pullback.", "Worst: controlled, -4.0%.", "12 days, extended window."),
        ("Two weeks: down -10.0%.", "Whole period: up 0.0%.", "", "", "3 days, in progress."),
    ]


def test_nearest_in_blocks(spark, monkeypatch):
    """Several blocks give what comparing every pair gives; vectors without a direction take no part."""
    import random

    monkeypatch.setattr(vectors, "BLOCK", 2)
    rng = random.Random(5)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(40)] + [(40, [0.0] * 4, 0), (41, None, 1), (42, [1.0, None, 0.0, 0.0], 2)]
    e = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    want = {(q, c, i) for q in range(0, 40, 5) for c in range(3) for _, i in sorted((round(1 - cos(data[q][1], v), 6), i) for i, v, k in data[:40] if i != q and k == c)[:2]}
    got = vectors.nearest(e.where("vec_id % 5 = 0"), e, 2, "label").collect()
    assert {(r.query_id, r.label, r.vec_id) for r in got} == want
    assert vectors.nearest(e.where("vec_id < 0"), e, 2).count() == 0
