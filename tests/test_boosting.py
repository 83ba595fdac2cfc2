"""Trees over folds: signal is accepted, noise refused, leakage by group removed; areas against pairs."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.columns import clamp01
from marketloom.operators import boosting, evaluation, outcomes
from marketloom.plans import learning, lists
from marketloom.sources import market as src

FEATURES = [f"f{k}" for k in range(6)]
TREES = boosting.Trees(rounds=12, rate=0.3)


def table(spark, x, y, groups):
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(days=i), i, f"T{g}", *map(float, a), float(b)) for i, (a, b, g) in enumerate(zip(x, y, groups, strict=True))]
    schema = "date date, id int, ticker string, " + ", ".join(f"{f} double" for f in FEATURES) + ", won double"
    return spark.createDataFrame(rows, schema).repartition(2)


def train(rows, **more):
    return boosting.train(rows, FEATURES, "won", ["date", "id"], **({"folds": 3, "trees": TREES} | more))


def test_signal_is_accepted_and_saved(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(800, 6)), np.array([2.0, -1.5, 1.0, 0.5, 0.0, 0.0])
    y = rng.uniform(size=800) < 1 / (1 + np.exp(-x @ w))
    done = train(table(spark, x, y, rng.integers(0, 20, 800)), least_auc=0.6)
    assert done.status == "accepted" and done.auc_gate > 0.6 and done.samples == 800
    assert [(f.trained, f.validated) for f in done.folds] == [(200, 200), (400, 200), (600, 200)]
    areas = [f.auc for f in done.folds]
    assert done.auc_gate == pytest.approx(np.mean(areas) - np.std(areas))
    assert done.rounds == int(np.median([f.rounds for f in done.folds])) == done.model.stages[-1].getNumTrees
    assert all(1 <= f.rounds <= 12 for f in done.folds)
    assert done.positive_weight == pytest.approx((800 - y.sum()) / y.sum())
    assert max(done.importances, key=done.importances.get) == "f0" and sum(done.importances.values()) == pytest.approx(1)
    boosting.save(done, spark, str(tmp_path))
    [part] = [p for p in os.listdir(tmp_path / "metrics") if p.endswith(".json")]
    told = json.loads((tmp_path / "metrics" / part).read_text())
    assert told["status"] == "accepted" and told["auc_gate"] == pytest.approx(done.auc_gate) and len(told["folds"]) == 3
    again = boosting.PipelineModel.load(str(tmp_path / "model"))
    rows = table(spark, x[:50], y[:50], [0] * 50)
    assert boosting.scored(again, rows).orderBy("id").collect() == boosting.scored(done.model, rows).orderBy("id").collect()


def test_noise_is_refused_and_no_model_written(spark, tmp_path):
    rng = np.random.default_rng(2)
    done = train(table(spark, rng.normal(size=(600, 6)), rng.uniform(size=600) < 0.5, [0] * 600), least_auc=0.6)
    assert done.status == "refused" and done.auc_gate < 0.6 and done.model is None and done.importances == {}
    boosting.save(done, spark, str(tmp_path))
    assert os.listdir(tmp_path) == ["metrics"]


def test_leakage_by_group_is_removed(spark):
    rng = np.random.default_rng(3)
    groups = np.minimum(rng.integers(0, 25, 1000), np.arange(1000) // 20 + 12) % 25
    late = rng.integers(25, 40, 1000)
    groups = np.where(rng.uniform(size=1000) < 0.5, groups, late)
    # in each stretch some groups are missing, so that rows are left to train on
    groups = np.where((groups % 4) == (np.arange(1000) // 250), (groups + 1) % 40, groups)
    marks, answers = rng.normal(size=(40, 6)), rng.integers(0, 2, 40)
    x = marks[groups] + 0.05 * rng.normal(size=(1000, 6))
    rows = table(spark, x, answers[groups], groups)
    leaky, purged = train(rows, least_auc=0.0), train(rows, least_auc=0.0, group="ticker")
    assert leaky.auc_gate > 0.85 and leaky.auc_gate > purged.auc_gate + 0.15
    assert all(p.trained < q.trained and p.validated == q.validated for p, q in zip(purged.folds, leaky.folds, strict=True))


def test_folds_that_cannot_be_used(spark):
    x = np.zeros((240, 6))
    early = table(spark, x, np.arange(240) < 60, [0] * 240)
    done = train(early)
    assert done.status == "no_usable_folds" and [f.auc for f in done.folds] == [None] * 3 and done.auc_gate == 0 and done.model is None
    with pytest.raises(ValueError, match="two folds"):
        train(early, folds=1)
    with pytest.raises(ValueError, match="not_binary"):
        train(table(spark, x, np.full(240, 2), [0] * 240))
    with pytest.raises(ValueError, match="not_finite"):
        train(table(spark, x * np.nan, np.zeros(240), [0] * 240))
    with pytest.raises(ValueError, match="validation"):
        train(early, embargo=300)


def test_area_against_pairs(spark):
    rng = np.random.default_rng(5)
    for n, levels in ((3000, 10_000), (500, 4), (40, 1)):
        y, s = rng.integers(0, 2, n), rng.integers(0, levels, n) / 7
        up, down = s[y == 1][:, None], s[y == 0][None, :]
        want = ((up > down) + 0.5 * (up == down)).mean()
        got = evaluation.auc(spark.createDataFrame(list(zip(y.tolist(), s.tolist(), strict=True)), "y int, s double").repartition(5), "y", "s").first()
        assert got.auc == pytest.approx(want, abs=1e-12) and (got.n_pos, got.n_neg) == (y.sum(), n - y.sum())


def test_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(7)
    rows = table(spark, rng.normal(size=(300, 6)), rng.uniform(size=300) < 0.5, [0] * 300).withColumn("f0", F.udf(told, "double")("f0"))
    train(rows, trees=boosting.Trees(rounds=1), least_auc=0.99)
    assert seen.value == 300


def test_picks_are_read_from_a_table_and_come_from_their_tickers_lines(spark):
    d = "/root/testdata/sf0.001"
    got = learning._picks(spark, d)
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString()
    bars = src.candles(spark, d)
    few = spark.createDataFrame([("T1",), ("T3",)], "ticker string")
    assert sorted(src.candles(spark, d, few).collect()) == sorted(bars.where("ticker in ('T1', 'T3')").collect())
    names = ["list_type", "date", "ticker", "won", "volume", "trend"]
    points = src.snapshots(bars).select("ticker", "date", clamp01((F.col("relative_volume") - 0.5) / 4.5).alias("volume"), clamp01(F.col("rsi14") / 100).alias("trend"))
    scored = outcomes.outcomes(outcomes.forward_paths(bars, lists.rank_lists(bars))).where("return_5d is not null")
    want = scored.withColumn("won", (F.col("return_5d") > 0).cast("double")).join(points, ["ticker", "date"]).select(*names)
    assert sorted(got.select(*names).collect()) == sorted(want.collect()) and got.count() > 50
