"""Refits against numpy's projected descent, and the cases of gate, deployment and reconciliation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import learning

DAY = dt.date(2025, 1, 1)


def descended(x, y, penalty, epochs=30_000):
    """Projected descent, a step for each epoch, from equal weights."""
    w = np.full(x.shape[1], 1 / x.shape[1])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-x @ w))
        w = np.maximum(0, w - 0.1 * (x.T @ (p - y) / len(y) + penalty * w))
    return w / w.sum() if w.sum() > 0 else np.full(x.shape[1], 1 / x.shape[1])


def samples(spark, x, y):
    rows = [(DAY + dt.timedelta(days=i // 3), f"T{i % 3}", *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"f{k} double" for k in range(x.shape[1])) + ", won double").repartition(3)


def signal(n, seed=1, strength=6.0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    return x, (rng.random(n) < 1 / (1 + np.exp(-strength * (x[:, 0] - 0.5)))).astype(float)


def test_weights_against_descent(spark):
    for seed, strength in ((1, 6.0), (2, -4.0), (3, 1.0)):
        x, y = signal(150, seed, strength)
        got = learning.bounded_weights(samples(spark, x - 0.5, y), ["f0", "f1", "f2"], "won", 0.05)
        assert got == pytest.approx(descended(x - 0.5, y, 0.05).tolist(), abs=2e-3)
        assert min(got) >= 0 and sum(got) == pytest.approx(1)


def test_nothing_to_fit_gives_equal_weights(spark):
    x, y = signal(4)
    rows = samples(spark, x, y)
    assert learning.bounded_weights(rows.where("false"), ["f0", "f1"], "won") == [0.5, 0.5]
    # features that only harm are all 0
    worse = samples(spark, np.full((60, 2), 1.0), np.zeros(60))
    assert learning.bounded_weights(worse, ["f0", "f1"], "won") == [0.5, 0.5]


def test_too_few_samples_are_skipped(spark):
    x, y = signal(99)
    assert learning.refit(samples(spark, x, y), ["f0", "f1", "f2"], "won", ["date", "ticker"]) == learning.Refit("skipped", 99)


def test_the_last_sixty_are_held_out(spark):
    for n, held in ((200, 60), (120, 60), (110, 55)):
        x, y = signal(n)
        train, test, count = learning.split_last(samples(spark, x, y), ["date", "ticker"])
        assert (count, test.count(), train.count()) == (n, held, n - held)
        assert train.agg(F.max(F.struct("date", "ticker"))).first()[0] < test.agg(F.min(F.struct("date", "ticker"))).first()[0]


def test_signal_is_deployed_and_noise_is_kept(spark):
    x, y = signal(400, 4, 10.0)
    done = learning.refit(samples(spark, x, y), ["f0", "f1", "f2"], "won", ["date", "ticker"])
    assert done.status == "deployed" and done.test_auc > 0.6 and done.holdout_auc > 0.6 and done.weights[0] > 0.5
    flat = learning.refit(samples(spark, np.ones((200, 2)), np.arange(200) % 2), ["f0", "f1"], "won", ["date", "ticker"])
    assert (flat.status, flat.test_auc) == ("kept", 0.5)


def test_one_version_is_active_after_a_deployment(spark):
    old = spark.createDataFrame([("ep", 1, {"a": 1.0}, 0.7, False), ("ep", 2, {"a": 1.0}, 0.7, True), ("momentum", 1, {"a": 1.0}, 0.7, True)], "engine string, version int, weights map<string,double>, auc double, active boolean")
    new = learning.deployed(old, "ep", {"a": 0.4, "b": 0.6}, 0.66)
    assert {(r.engine, r.version) for r in new.where("active").collect()} == {("ep", 3), ("momentum", 1)} and new.count() == 4


def test_reconciliation(spark):
    suggested = spark.createDataFrame([("up", 0.05), ("against", -0.01), ("little", 0.2), ("down", -0.1), ("unknown", 0.3), ("still", 0.0)], "feature string, mean double")
    old = {"up": 0.2, "against": 0.2, "little": 0.2, "down": 0.2, "silent": 0.2, "still": 0.1}
    new = {"up": 0.3, "against": 0.25, "little": 0.21, "down": 0.1, "silent": 0.04, "still": 0.1}
    got = {r.feature: (r.change, r.action) for r in learning.reconciled(old, new, suggested).collect()}
    assert got == {"up": (0.1, "applied"), "against": (0.05, "blocked"), "little": (0.01, "ignored"), "down": (-0.1, "applied"), "still": (0.0, "ignored")}
