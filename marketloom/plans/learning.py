"""Registered queries that fit models; fits have no SQL and are tested against numpy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clamp01
from ..operators import boosting, learning, outcomes
from ..sources import market as src
from ..streaming import events as ev
from .lists import rank_lists

QUERIES: dict = {}
ORACLES: dict = {}

FEATURES = ["breakout", "volume", "strength", "trend"]
OUT = "engine string, status string, samples long, train_auc double, test_auc double, holdout_auc double, feature string, weight double, suggested double, change double, action string"


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again; folds join them with themselves, which a cache does not always serve."""
    spark = rows.sparkSession
    path = f"{ev.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _picks(spark: SparkSession, d: str) -> DataFrame:
    """Every pick with its features at the signal and whether its first week won.

    All bars are made once, for the lists, nine picks a date at most. Features and results come from the picked tickers' lines
    alone, as no window reaches beyond a ticker; these names are as few as the picks, and so are broadcast."""
    lists = _kept(rank_lists(src.candles(spark, d)), "lists")
    bars = src.candles(spark, d, F.broadcast(lists.select("ticker").distinct()))
    s = src.snapshots(bars)
    points = {
        "breakout": clamp01((F.col("distance_52w_high") + 30) / 30), "volume": clamp01((F.col("relative_volume") - 0.5) / 4.5),
        "strength": clamp01((F.col("perf_3m") + 20) / 120), "trend": clamp01(F.col("rsi14") / 100),
    }
    met = outcomes.with_bars(lists.select("ticker", "date").distinct(), s.select("ticker", "date", *(c.alias(n) for n, c in points.items())))
    rows = outcomes.outcomes(outcomes.forward_paths(bars, lists)).where("return_5d is not null").join(met, ["ticker", "date"])
    return _kept(rows.select("list_type", "date", "ticker", *FEATURES, (F.col("return_5d") > 0).cast("double").alias("won")).dropna(), "picks")


def i6_i7_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """What boosted trees make of the picks over five walk-forward folds, a row a fold beside the verdict.

    Labels look five sessions ahead, of nine picks at most: so many rows part a fold from its training rows. Steps are
    larger and fewer than the defaults'."""
    trees = boosting.Trees(rounds=20, rate=0.3)
    rows = _picks(spark, d)
    done = boosting.metrics(boosting.train(rows, FEATURES, "won", ["date", "list_type", "ticker"], embargo=45, trees=trees, least=50), spark)
    return done.select("status", "samples", "auc_mean", "auc_std", "auc_gate", F.col("rounds").alias("final_rounds"), "importances", F.explode("folds").alias("f")).select("*", "f.*").drop("f")


def i8_weight_refit(spark: SparkSession, d: str) -> DataFrame:
    """Each list's weights refitted from its picks' first weeks, and held against the changes that rank means suggest."""
    rows = _picks(spark, d).cache()
    means = rows.groupBy("list_type").agg(*((F.avg(F.when(F.col("won") == 1, F.col(f))) - F.avg(F.when(F.col("won") == 0, F.col(f)))).alias(f) for f in FEATURES))
    suggested = means.unpivot(["list_type"], FEATURES, "feature", "mean")
    old, out = dict.fromkeys(FEATURES, 1 / len(FEATURES)), None
    for engine in ("ep", "leaders", "momentum"):
        done = learning.refit(rows.where(F.col("list_type") == engine), FEATURES, "won", ["date", "ticker"])
        new = dict(zip(FEATURES, done.weights or list(old.values()), strict=True))
        found = learning.reconciled(old, new, suggested.where(F.col("list_type") == engine))
        head = [F.lit(x).cast(t).alias(n) for n, t, x in (("engine", "string", engine), ("status", "string", done.status), ("samples", "long", done.samples), ("train_auc", "double", done.train_auc), ("test_auc", "double", done.test_auc), ("holdout_auc", "double", done.holdout_auc))]
        weight = F.create_map(*(F.lit(x) for kv in new.items() for x in kv))[F.col("feature")].alias("weight")
        # without a deployment nothing is reconciled
        part = found.select(*head, "feature", weight, "suggested", "change", F.when(F.lit(done.status == "deployed"), F.col("action")).alias("action"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES |= {"i6_i7_boosted_trees": i6_i7_boosted_trees, "i8_weight_refit": i8_weight_refit}
