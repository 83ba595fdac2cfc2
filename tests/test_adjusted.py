"""Splits taken out of results, against the rule row by row."""

import datetime as dt
import random

import pytest

from marketloom.operators import outcomes

DAY = dt.date(2024, 1, 1)
LOOKS = {"r5": 5, "r10": 10}
ACTIONS = "ticker string, ex_date date, action_type string, ratio double"
ROWS = "ticker string, entry_date date, r5 double, r10 double, note string"
BARS = "ticker string, date date, adjusted_close double"


def plain(row, actions, bars):
    ticker, entry, *values, note = row
    found, most = [], 0
    for v, k in zip(values, LOOKS.values(), strict=True):
        if v is not None and ticker is not None and entry is not None:
            inside = lambda t, x: t == ticker and x is not None and entry <= x <= entry + dt.timedelta(days=2 * k)  # noqa: B023, E731
            if not any(inside(t, x) and a is not None for t, x, a in bars):
                met = [(kind, r) for t, x, kind, r in actions if inside(t, x)]
                most = max(most, len(met))
                for kind, r in met:
                    if r is not None and r > 0:
                        v = v / r if kind == "split" else v * r if kind == "reverse_split" else v
        found.append(v)
    return ticker, entry, *found, note, most


def check(spark, rows, actions, bars):
    got = outcomes.adjusted(spark.createDataFrame(rows, ROWS), spark.createDataFrame(actions, ACTIONS), spark.createDataFrame(bars, BARS), LOOKS)
    assert got.columns == ["ticker", "entry_date", "r5", "r10", "note", "corporate_action_count"]
    key = lambda r: str(r)
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted((plain(r, actions, bars) for r in rows), key=key), strict=True):
        assert a[:2] == b[:2] and a[4:] == b[4:] and a[2:4] == tuple(pytest.approx(x) if x is not None else None for x in b[2:4])


def test_cases(spark):
    at = lambda n: DAY + dt.timedelta(days=n)
    rows = [("A", at(0), 0.5, 0.4, "x"), ("A", at(0), 0.5, 0.4, "x"), ("A", at(0), None, 0.4, None), ("B", at(3), 0.1, 0.2, "y"), ("C", at(0), 0.3, None, "z"), ("D", None, 0.1, 0.1, "no entry"), (None, at(0), 0.1, 0.1, "no ticker")]
    actions = [("A", at(10), "split", 2.0), ("A", at(11), "reverse_split", 0.5), ("A", at(-1), "split", 9.0), ("B", at(3), "dividend", 0.3), ("B", at(4), "split", 0.0), ("B", at(5), "split", None), ("C", at(1), "split", 2.0), (None, at(0), "split", 2.0), ("D", None, "split", 2.0)]
    bars = [("C", at(10), 1.0), ("A", at(21), 1.0), ("B", at(3), None), ("A", None, 2.0)]
    check(spark, rows, actions, bars)
    check(spark, rows, [], bars)
    check(spark, rows, actions, [])
    check(spark, [], actions, bars)


def test_random_series(spark):
    rnd = random.Random(4)
    day = lambda: DAY + dt.timedelta(days=rnd.randrange(120))
    rows = [(rnd.choice("AAAB"), day(), rnd.choice([None, rnd.random()]), rnd.random(), str(i)) for i in range(150)]
    actions = [(rnd.choice("AB"), day(), rnd.choice(["split", "reverse_split", "spin"]), rnd.choice([2.0, 0.5, 3.0])) for _ in range(25)]
    check(spark, rows, actions, [(rnd.choice("AB"), day(), rnd.choice([None, 1.0])) for _ in range(8)])
