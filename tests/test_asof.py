"""As-of joins against a loop over all rows."""

import datetime as dt
import random

import pytest

from marketloom.operators.asof import as_of


@pytest.mark.parametrize("period", ["month", "year"])
def test_against_a_loop(spark, period):
    rng = random.Random(7)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900))
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    rows = [(key(), rng.choice([None, day(), day(), day()]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(120)]
    wanted = [(i % 90, key(), rng.choice([None, day(), day(), day(), day()]), "x") for i in range(200)]
    want = []
    for i, k, d, x in wanted:
        met = [(r[1], -1.0 if r[2] is None else r[2]) for r in rows if None not in (k, d, r[0], r[1]) and r[0] == k and r[1] <= d]
        best = max(met, default=(None, None))
        want.append((i, k, d, x, best[0], None if best[1] == -1.0 else best[1]))
    # a wanted column may carry the name of an inner one
    asked = spark.createDataFrame(wanted, "id int, key string, day date, _row string")
    got = as_of(asked, spark.createDataFrame(rows, "key string, day date, price double"), ["key"], "day", ["price"], period)
    assert got.columns == ["id", "key", "day", "_row", "as_of", "price"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_sides(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "key string, day date, price double")
    asked = spark.createDataFrame([("a", dt.date(2020, 1, 1))], "key string, day date")
    assert as_of(asked.limit(0), rows, ["key"], "day", ["price"]).collect() == []
    assert [tuple(r)[2:] for r in as_of(asked, rows.limit(0), ["key"], "day", ["price"]).collect()] == [(None, None)]
    assert [tuple(r)[2:] for r in as_of(asked, rows, ["key"], "day", ["price"]).collect()] == [(dt.date(2020, 1, 1), 1.0)]


def test_no_pairs_are_formed(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "key string, day date, price double")
    plan = as_of(rows.select("key", "day"), rows, ["key"], "day", ["price"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
