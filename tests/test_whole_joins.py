"""The joins of c5 and c7 cover every bar and every ticker."""

import os

import pytest

from marketloom.plans import indicators
from marketloom.sources import market as src

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_pairs_of_all_bars(spark):
    bars = [r["count"] for r in src.candles(spark, DATA).groupBy("ticker").count().collect()]
    got = indicators.QUERIES["c5_theta_days_between_all"](spark, DATA).count()
    assert got == sum(max(n - k, 0) for n in bars for k in (1, 2, 3))


def test_as_of_of_all_tickers(spark):
    tickers = src.candles(spark, DATA).select("ticker").distinct().count()
    got = indicators.QUERIES["c7_asof_join_all"](spark, DATA)
    assert got.count() == tickers * src.benchmark(spark, DATA).count()
    assert got.where("as_of > date").count() == 0 and got.where("as_of is not null").select("ticker").distinct().count() > 1
