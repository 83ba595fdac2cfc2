"""Landed responses as a data source, and staged merges by partition."""

import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from marketloom.plans import stored
from marketloom.sources import landed, sinks
from marketloom.sources import market as src

D = dt.date


def ms(day):
    return int(dt.datetime.combine(day, dt.time(5), dt.UTC).timestamp() * 1000)


@pytest.fixture
def folder(tmp_path):
    def put(ticker, day, text, name="r.json"):
        at = tmp_path / f"ticker={ticker}" / f"landed={day}"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)

    bar = lambda day, c: {"t": ms(day), "o": 1, "h": 3, "l": 0.5, "c": c, "v": 10.9}
    put("A", "2024-01-03", json.dumps({"results": [bar(D(2024, 1, 2), 2), bar(D(2024, 1, 3), 2.5) | {"v": None}, bar(D(2024, 1, 3), 2.25)]}, indent=1))
    put("A", "2024-02-01", json.dumps({"results": [bar(D(2024, 2, 1), 4)]}) + "\n" + json.dumps({"results": None}))
    values = [{"datetime": "2024-01-05", "open": "1", "high": "x", "low": None, "close": "2.5", "volume": "7.5"}, {"datetime": "soon", "close": "1"}]
    put("B%2FC", "2024-01-06", json.dumps({"status": "ok", "values": values}))
    put("B%2FC", "2024-01-06", "not json", "_SUCCESS")
    return tmp_path


def test_both_shapes(spark, folder):
    rows = landed.bars(spark, str(folder)).orderBy("ticker", "date").collect()
    assert [tuple(r) for r in rows] == [
        ("A", D(2024, 1, 2), 1, 3, 0.5, 2, 2, 10, "aggregates", D(2024, 1, 3)),
        ("A", D(2024, 1, 3), 1, 3, 0.5, 2.25, 2.25, 10, "aggregates", D(2024, 1, 3)),
        ("A", D(2024, 2, 1), 1, 3, 0.5, 4, 4, 10, "aggregates", D(2024, 2, 1)),
        ("B/C", D(2024, 1, 5), 1, 0, 0, 2.5, None, 0, "series", D(2024, 1, 6)),
    ]


def test_filters_choose_files(spark, folder):
    read = lambda where: landed.bars(spark, str(folder)).where(where)
    # a file that must not be opened
    (folder / "ticker=A" / "landed=2024-01-03" / "r.json").write_text("{")
    assert read("ticker = 'B/C'").count() == 1 and read("ticker in ('B/C', 'Z')").count() == 1
    assert read("ticker = 'A' and date >= '2024-01-15'").count() == 1
    assert read("landed = date'2024-02-01'").count() == 1
    assert read("ticker = 'A' and ticker in ('B/C', 'D')").count() == 0
    with pytest.raises(Exception, match="landed=2024-01-03"):
        read("ticker = 'A'").count()
    plan = read("ticker = 'A' and date >= '2024-01-15'")._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("Filter", 1)[1].split("BatchScan")[0] if "Filter" in plan else ""
    assert "ticker" not in pruned.split("\n")[0].replace("isnotnull(ticker", "") and "date" in pruned


def test_pushed_filters_are_taken_over():
    r = landed.LandedReader({"path": "/nowhere"})
    day = D(2024, 1, 5)
    filters = [landed.In(("ticker",), ("A", "B")), landed.EqualTo(("ticker",), "B"), landed.GreaterThan(("date",), day), landed.EqualTo(("close",), 1.0)]
    assert list(r.pushFilters(filters)) == filters[2:]
    assert (r.tickers, r.least, r.days) == ({"B"}, day, None)


def test_bad_files(spark, folder):
    at = folder / "ticker=Z" / "landed=2024-03-01"
    at.mkdir(parents=True)
    for text in ("[1]", '{"status": "error", "message": "no such symbol"}', '{"results": [', "\udcff".encode("utf-8", "surrogateescape").decode("latin-1")):
        (at / "r.json").write_text(text)
        with pytest.raises(Exception, match="landed=2024-03-01"):
            landed.bars(spark, str(folder)).count()
        assert landed.bars(spark, str(folder), bad_files="skip").count() == 4
    (at / "r.json").write_text("")
    assert landed.bars(spark, str(folder)).count() == 4
    with pytest.raises(Exception, match="nothing-here"):
        landed.bars(spark, str(folder / "nothing-here")).count()


def test_many_files_share_tasks(folder, monkeypatch):
    monkeypatch.setattr(landed, "SHARE_FILES", 2)
    assert [len(s.files) for s in landed.LandedReader({"path": str(folder)}).partitions()] == [2, 1]


SCHEMA = "ticker string, close double, seen int, year int"
KEYS = ["year", "ticker"]


def files(folder):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_ino for at, _, names in os.walk(f"{folder}/table/") for f in names if f.endswith(".parquet")}


def test_staged_merge_touches_its_partitions_only(spark, tmp_path):
    f = str(tmp_path)
    batch = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    table = lambda: sorted(map(tuple, sinks.merged_table(spark, f, SCHEMA).collect()))
    assert sinks.staged_merge(batch(("A", 1.0, 1, 2020), ("B", 1.0, 1, 2020), ("A", 2.0, 1, 2021)), f, KEYS, "year", 1)
    before = files(f)
    assert sinks.staged_merge(batch(("A", 3.0, 1, 2021), ("A", 4.0, 2, 2021), ("C", 5.0, 1, 2022)), f, KEYS, "year", 2, "seen")
    want = [("A", 1.0, 1, 2020), ("A", 4.0, 2, 2021), ("B", 1.0, 1, 2020), ("C", 5.0, 1, 2022)]
    assert table() == want
    after = files(f)
    assert {p for p in before if "year=2020" in p} == {p for p in after if "year=2020" in p}
    assert not {p for p in before if "year=2021" in p} & set(after)
    # neither an applied batch again nor an older one after it changes a file
    assert not sinks.staged_merge(batch(("A", 9.0, 1, 2020)), f, KEYS, "year", 2)
    assert not sinks.staged_merge(batch(("A", 9.0, 1, 2020)), f, KEYS, "year", 1)
    assert files(f) == after
    assert sinks.staged_merge(batch(), f, KEYS, "year", 3) and table() == want


def test_a_swap_that_was_cut_off_goes_on(spark, tmp_path):
    f = str(tmp_path)
    sinks.staged_merge(spark.createDataFrame([("A", 1.0, 1, 2020), ("B", 2.0, 1, 2020)], SCHEMA), f, KEYS, "year", 1)
    new = spark.createDataFrame([("A", 5.0, 1, 2020)], SCHEMA)
    sinks.staged_merge(new, f, KEYS, "year", 2)
    # as if it had died between taking the old partition away and putting the new one there
    shutil.rmtree(f"{f}/batches/2/applied")
    shutil.rmtree(f"{f}/table/year=2020")
    assert sinks.staged_merge(new, f, KEYS, "year", 2)
    assert sorted(map(tuple, sinks.merged_table(spark, f, SCHEMA).collect())) == [("A", 5.0, 1, 2020), ("B", 2.0, 1, 2020)]


def test_rows_that_cannot_be_merged(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, SCHEMA)
    for bad, message in ((rows((None, 1.0, 1, 2020)), "null key"), (rows(("A", 1.0, 1, 2020), ("A", 2.0, 1, 2020)), "repeats a key")):
        with pytest.raises(ValueError, match=message):
            sinks.staged_merge(bad, str(tmp_path), KEYS, "year", 1)
    with pytest.raises(ValueError, match="partitioned"):
        sinks.staged_merge(rows(), str(tmp_path), ["ticker"], "year", 1)
    assert not os.path.exists(f"{tmp_path}/table")


def test_numbers_that_are_not_finite(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1), (1.0, float("-inf"), 2), (None, 2.0, 3)], "a double, b double, n int")
    assert [tuple(r) for r in sinks.finite(df, zero=["a"]).orderBy("n").collect()] == [(0.0, None, 1), (1.0, None, 2), (None, 2.0, 3)]


def test_files_of_many_tickers(spark, tmp_path, monkeypatch):
    at = tmp_path / "landed=2024-01-06"
    at.mkdir()
    lines = [
        json.dumps({"ticker": "A", "results": [{"t": ms(D(2024, 1, k)), "o": 1, "h": 3, "l": 0.5, "c": k, "v": 10} for k in (2, 3)]}),
        json.dumps({"symbol": "B/C", "status": "ok", "values": [{"datetime": "2024-01-05", "open": "1", "high": "2", "low": "1", "close": "2.5", "volume": "7"}]}),
        json.dumps({"ticker": "D", "results": None}),
    ]
    (at / "r.json").write_text("\n".join(lines))
    alone = tmp_path / "ticker=E" / "landed=2024-01-06"
    alone.mkdir(parents=True)
    (alone / "r.json").write_text(lines[0])  # a folder's ticker counts
    read = lambda where="true", **o: sorted((r["ticker"], r["date"].day, r["close"]) for r in landed.bars(spark, str(tmp_path), **o).where(where).collect())
    a, b, e = [("A", 2, 2.0), ("A", 3, 3.0)], [("B/C", 5, 2.5)], [("E", 2, 2.0), ("E", 3, 3.0)]
    assert read() == a + b + e
    assert read("ticker = 'A'") == a and read("ticker in ('B/C', 'E')") == b + e and read("ticker = 'Z'") == []
    assert read("landed = date'2024-01-07'") == [] and read("date >= '2024-01-07'") == []
    # a long file is not held whole
    monkeypatch.setattr(landed, "BATCH_BARS", 2)
    r = landed.LandedReader({"path": str(tmp_path)})
    assert [x.num_rows for s in r.partitions() for x in r.read(s)] == [2, 1, 2]
    for bad in ('{"results": [', '{"results": []}', "[1]"):
        (at / "r.json").write_text("\n".join([lines[0], bad, lines[1]]))
        with pytest.raises(Exception, match="line 2"):
            read()
        assert read(bad_files="skip") == a + b + e


def test_landed_files_do_not_grow_with_tickers(spark):
    rows = [(f"T{t}", D(2024, 1, 1 + k), 1.0, 2.0, 0.5, 1.5, 10) for t in range(300) for k in range(2)]
    folder = stored.landed_folder(spark, spark.createDataFrame(rows, src.CANDLE).repartition("ticker"))
    names = [f for _, _, files in os.walk(folder.removeprefix("file://")) for f in files if f.endswith(".json")]
    assert 0 < len(names) <= 4
    assert landed.bars(spark, folder).select("ticker", "date").distinct().count() == 600
