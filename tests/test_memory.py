"""Memories of picks: stored, closed and told, in one go and as a stream."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from marketloom.operators import market, memory, outcomes, text
from marketloom.streaming import events as ev
from marketloom.streaming import memory as stream

PICK = "date date, list_type string, ticker string, prompt_version string, setup string, conviction string, entry_low double, entry_high double, stop double"
KNOWN = "date date, list_type string, ticker string, evaluated_days int, return_5d double, stop_hit boolean, target1_hit boolean, recommended_stop double"
TODAY = dt.date(2026, 5, 1)


def picks(spark, *rows):
    return spark.createDataFrame([(TODAY - dt.timedelta(days=age), "ep", t, "v1", *rest) for age, t, *rest in rows], PICK)


def known(spark, *rows):
    return spark.createDataFrame([(TODAY - dt.timedelta(days=age), kind, t, *rest) for age, kind, t, *rest in rows], KNOWN)


def looked_up(spark, age, *outcome):
    m = memory.stored(None, picks(spark, (age, "AAPL", "VCP", "A", 99.5, 101.0, 95.0)))
    return memory.updated(m, known(spark, *outcome), F.lit(TODAY)).first()


def test_a_pick_as_stored(spark):
    full, bare = memory.stored(None, picks(spark, (1, "AAPL", "VCP", "A", 99.5, 101.0, 95.0), (1, "MSFT", "", "", 10.0, None, None))).orderBy("ticker").collect()
    assert (full.context_summary, full.setup, full.conviction, full.entry, full.stop) == ("AAPL|ep|setup_VCP", "VCP", "A", "$99.50-$101.00", "$95.00")
    assert (bare.context_summary, bare.setup, bare.conviction, bare.entry, bare.stop) == ("MSFT|ep|setup_", None, None, None, None)
    assert full.outcome_status == bare.outcome_status == "pending" and full.outcome_return_5d is None


def test_storing_again_changes_nothing(spark):
    new = picks(spark, (1, "AAPL", "VCP", "A", 99.5, 101.0, 95.0), (2, "MSFT", "EP", "B", None, None, None))
    once = memory.stored(None, new)
    assert sorted(map(str, memory.stored(once, new).collect())) == sorted(map(str, once.collect()))
    assert memory.stored(once, picks(spark, (3, "X", "EP", "B", None, None, None))).count() == 3


def test_verified_with_all_that_happened(spark):
    r = looked_up(spark, 30, (30, "ep", "AAPL", 10, 0.05, True, True, 95.0))
    assert (r.outcome_status, r.outcome_return_5d, r.outcome_stop_hit, r.outcome_target_hit) == ("verified", 0.05, True, True)
    assert r.outcome_summary == "Stop hit at $95.00. Target 1 reached. 5D return: +5.0%. [AAPL]"


def test_too_recent_unmatched_short_and_given_up(spark):
    good = ("ep", "AAPL", 10, 0.05, False, False, None)
    assert looked_up(spark, 1, (1, *good)).outcome_status == "pending"
    assert looked_up(spark, 6, (6, *good)).outcome_status == "pending"
    assert looked_up(spark, 7, (7, *good)).outcome_status == "verified"
    assert looked_up(spark, 14).outcome_status == "pending"
    assert looked_up(spark, 14, (14, "ep", "AAPL", 4, 0.05, False, False, None)).outcome_status == "pending"
    assert looked_up(spark, 14, (14, "momentum", "AAPL", 9, 0.05, False, False, None), (14, "ep", "MSFT", 9, 0.1, False, False, None), (13, *good)).outcome_status == "pending"
    assert looked_up(spark, 30).outcome_status == "pending"
    assert looked_up(spark, 31).outcome_status == "insufficient_data"
    r = looked_up(spark, 40, (40, "ep", "AAPL", 3, 0.05, True, False, 95.0))
    assert r.outcome_status == "insufficient_data" and r.outcome_return_5d is None and r.outcome_summary is None


def test_only_pending_memories_change(spark):
    m = memory.stored(None, picks(spark, (40, "AAPL", "VCP", "A", None, None, None)))
    closed = memory.updated(m, known(spark), F.lit(TODAY))
    again = memory.updated(closed, known(spark, (40, "ep", "AAPL", 10, 0.05, False, False, None)), F.lit(TODAY))
    assert again.first() == closed.first() and again.first().outcome_status == "insufficient_data"


def test_summaries(spark):
    cases = [(True, None, False, None), (False, None, True, -0.0123), (False, None, False, None), (None, None, None, 0.2)]
    rows = spark.createDataFrame([("T", *c) for c in cases], "t string, s boolean, p double, g boolean, r double")
    said = [r.x for r in rows.select(memory.summary(F.col("t"), F.col("s"), F.col("p"), F.col("g"), F.col("r")).alias("x")).collect()]
    assert said == ["Stop hit at unknown level. [T]", "Target 1 reached. 5D return: -1.2%. [T]", "Outcome recorded. [T]", "5D return: +20.0%. [T]"]


def test_recalled_and_told(spark):
    m = memory.stored(None, picks(spark, *((age, t, "VCP", "", None, None, None) for age, t in ((10, "A"), (11, "B"), (12, "C"), (13, "D"), (50, "E")))))
    m = memory.updated(m, known(spark, *((age, "ep", t, 9, 0.01 * age, False, True, None) for age, t in ((10, "A"), (11, "B"), (12, "C"), (50, "E")))), F.lit(TODAY))
    vectors = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [1.0, 0.2]), ("C", [0.0, 1.0]), ("D", [1.0, 0.0]), ("E", [1.0, 0.0])], "ticker string, embedding array<float>")
    stock = memory.retrievable(m.join(vectors, "ticker", "left"), F.lit(TODAY), 45)
    assert {r.ticker for r in stock.collect()} == {"A", "B", "C"}
    asked = spark.createDataFrame([(1, "ep", "A", [1.0, 0.0]), (2, "ep", "", [1.0, 0.0]), (3, "leaders", "", [1.0, 0.0])], "ask_id long, list_type string, exclude_ticker string, vector array<float>")
    rows = memory.recalled(asked, stock, 2)
    assert sorted((r.ask_id, r["rank"], r.ticker) for r in rows.collect()) == [(1, 1, "B"), (1, 2, "C"), (2, 1, "A"), (2, 2, "B")]
    said = {r.ask_id: r.text for r in memory.told(rows).collect()}
    assert said[1].startswith("## Similar past evaluations\n\n### Memory 1: 2026-04-20 (B)\n- List type: ep\n- Context: B|ep|setup_VCP\n- Setup: VCP\n- Return 5D: +11.0%\n- Stop hit: false\n- Target hit: true\n\n### Memory 2")


def test_the_stream_closes_alike_in_any_batches(spark):
    born = dt.date(2026, 1, 1)
    day = lambda n: (born - dt.date(1970, 1, 1)).days + n
    ready = {"early": 5, "usual": 8, "last": 31, "late": 33, "never": None}
    want = {"early": ("verified", 7, 0.5), "usual": ("verified", 8, 0.8), "last": ("verified", 31, 3.1), "late": ("insufficient_data", 31, None), "never": ("insufficient_data", 31, None)}
    rows = [("ep", t, born, day(0), None) for t in ready] + [("ep", t, born, day(n), n / 10) for t, n in ready.items() if n]
    rows += [("ep", "clock", dt.date(2026, 3, 1), day(n), None) for n in (59, 62)]  # later days let event time go on
    schema = "list_type string, ticker string, date date, day long, return_5d double"
    for parts in ([rows], [[r] for r in sorted(rows, key=lambda r: r[3])]):
        folder = f"{ev.shared_folder(spark)}/memory-test-{uuid.uuid4().hex}"
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        got = ev.finished(stream.closed(landed), folder).collect()
        assert {r.ticker: (r.status, (r.closed_on - born).days, r.return_5d) for r in got if r.ticker != "clock"} == want
        assert len([r for r in got if r.ticker != "clock"]) == len(want)


def test_badges(spark):
    returns = [None, 0.05, 0.049, 0.03, 0.01, 0.005, -0.005, -0.01, -0.02, -0.03, -0.031]
    rows = spark.createDataFrame([(r,) for r in returns], "r double").select(outcomes.badge(F.col("r")).alias("b")).collect()
    assert [r.b for r in rows] == ["tracking", "big winner", "strong winner", "strong winner", "winner", "flat", "flat", "flat", "small loss", "small loss", "stopped out"]


def test_sizes_cut_by_three_tenths(spark):
    cases = {"": "", "5-10%": "3.5-7.0%", "8%": "5.6%", "8% now, then 5 - 10 %": "3.5-7.0%", "Half position": "Third position", "start half": "start half", "Full size, Full risk": "Two-thirds size, Full risk", "small": "small (reduced 30%)"}
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select("s", text.shortened_size(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in rows} == cases


def test_smoothing_of_many_series(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    rows = spark.createDataFrame([(s, d, v) for s, values in {"a": (0.8, 0.6, 0.2, 0.4), "b": (0.1, 0.3, 0.3, 0.0)}.items() for d, v in zip(days, values, strict=True)], "series string, date date, x double")
    got = {(r.series, r.date): round(r.smoothed, 6) for r in market.smoothed(rows, "x", 0.5, -0.25, "series").collect()}
    assert [got["a", d] for d in days] == [0.8, 0.7, 0.2, 0.3] and [got["b", d] for d in days] == [0.1, 0.2, 0.25, 0.125]
