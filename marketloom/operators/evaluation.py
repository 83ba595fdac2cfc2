"""Statistics over scored signals: tests, calibration, ranking quality, folds, learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import normal_cdf


def group_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, win rate in which NULL is no win but stays in the denominator, mean, exact median."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("win_rate_null_loses"),
        F.avg(F.when(F.col(value) > 0, 1.0).when(F.col(value).isNotNull(), 0.0)).alias("win_rate"),
        F.avg(value).alias("mean_return"),
        F.percentile(value, F.lit(0.5)).alias("median_return"),
    )


def two_proportions(wins_a: Column, n_a: Column, wins_b: Column, n_b: Column) -> tuple[Column, Column]:
    """(z, two-sided p) of a pooled two-proportion test."""
    p = F.try_divide((wins_a + wins_b).cast("double"), n_a + n_b)
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    z = F.try_divide(wins_b / n_b - wins_a / n_a, error)
    return z, 2 * (1 - normal_cdf(F.abs(z)))


#: Stretches that the scores of an ungrouped area are cut into.
STRETCHES = 64


def auc(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """Area under the curve by rank sums, ties at their mean rank; 0.5 for one class.

    Ranks come from counts of distinct scores. Without groups the scores are cut at approximate quantiles: each
    stretch is ordered in a task of its own, and what lies before it is added to its sums, which are exact
    wherever the cuts fall.
    """
    stretch = F.lit(0)
    if not by:
        cuts = sorted(set(df.select(F.col(score).cast("double").alias("_s")).approxQuantile("_s", [i / STRETCHES for i in range(1, STRETCHES)], 0.002)))
        if cuts:
            stretch = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(score)))
    levels = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col(label).cast("double")).alias("pos")).withColumn("_stretch", stretch)
    run = Window.partitionBy(*by, "_stretch").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.withColumn("rank", F.coalesce(F.sum("k").over(run), F.lit(0)) + (F.col("k") + 1) / 2)
    parts = ranked.groupBy(*by, "_stretch").agg(F.sum(F.col("pos") * F.col("rank")).alias("ranks"), F.sum("pos").alias("p"), F.sum("k").alias("k"))
    # a row a group and stretch
    earlier = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    sums = parts.groupBy(*by).agg(F.sum(F.col("ranks") + F.col("before") * F.col("p")).alias("rank_sum"), F.sum("p").alias("n_pos"), (F.sum("k") - F.sum("p")).alias("n_neg"))
    area = F.try_divide(F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))
    return sums.select(*by, F.coalesce(area, F.lit(0.5)).alias("auc"), F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def calibration(df: DataFrame, least: int = 10) -> DataFrame:
    """Conviction against win rate, by setup."""
    value = F.when(F.col("conviction") == "HIGH", 3.0).when(F.col("conviction") == "MEDIUM", 2.0).when(F.col("conviction") == "STARTER", 1.0)
    rows = df.groupBy("setup").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("return_5d") > 0, 1).otherwise(0)).alias("wins"), F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_conviction")
    ).where(F.col("n") >= least)
    rows = rows.withColumn("win_rate_pct", F.col("wins") / F.col("n") * 100)
    rows = rows.withColumn("gap_pp", F.col("avg_conviction") / 3 * 100 - F.col("win_rate_pct"))
    return rows.withColumn("flag", F.when(F.col("gap_pp") > 15, "OVERCONFIDENT").when(F.col("gap_pp") < -15, "UNDERCONFIDENT").otherwise("OK"))


def walk_forward(rows: DataFrame, order: list[str], folds: int, embargo: int, group: str | None = None) -> DataFrame:
    """(fold, side, ...) rows of expanding folds; with ``group``, training rows whose group is
    in the fold's validation rows are taken out.

    Row numbers over everything come from counts of a leading key, joined back, so only the
    per-key counts meet in one window.
    """
    key, *rest = order
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_k").over(Window.partitionBy(F.lit(0)))
    base = counts.select(F.col(key).alias("_key"), before.alias("_before"), total.alias("_total"))
    within = F.row_number().over(Window.partitionBy(key).orderBy(*(rest or [key])))
    numbered = rows.withColumn("_within", within).join(base, F.col(key) == F.col("_key")).withColumn("row", F.col("_before") + F.col("_within") - 1)
    size = F.floor(F.col("_total") / (folds + 1))
    many = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("_end", size * F.col("fold"))
    start = F.col("_end") + embargo
    stop = F.when(F.col("fold") < folds, start + size).otherwise(F.col("_total"))
    side = F.when(F.col("row") < F.col("_end"), "train").when((F.col("row") >= start) & (F.col("row") < stop), "valid")
    out = many.withColumn("side", side).where(F.col("side").isNotNull()).drop("_within", "_key", "_before", "_total", "_end")
    if group:
        taken = out.where("side = 'valid'").select("fold", group).distinct().withColumn("_taken", F.lit(True))
        out = out.join(taken, ["fold", group], "left").where((F.col("side") == "valid") | F.col("_taken").isNull()).drop("_taken")
    return out


def logistic_weights(rows: DataFrame, features: list[str], label: str, rate: float = 0.1, penalty: float = 0.01, epochs: int = 200) -> list[float]:
    """Weights of a logistic model without intercept, kept at 0 or more and normalised to 1.

    Each epoch is one distributed aggregate; the driver holds a number per feature.
    """
    rows = rows.select(*features, label).cache()
    n, w = rows.count(), [1.0 / len(features)] * len(features)
    for _ in range(epochs if n else 0):
        z = sum((F.lit(wi) * F.col(f) for wi, f in zip(w, features, strict=True)), F.lit(0.0))
        error = 1 / (1 + F.exp(-z)) - F.col(label)
        sums = rows.agg(*(F.sum(error * F.col(f)).alias(f) for f in features)).first()
        w = [max(0.0, wi - rate * (sums[f] / n + penalty * wi)) for wi, f in zip(w, features, strict=True)]
    rows.unpersist()
    total = sum(w)
    return [wi / total for wi in w] if total > 0 else [1.0 / len(features)] * len(features)


def input_problems(rows: DataFrame, features: list[str], label: str, least: int = 200) -> DataFrame:
    """One row of counts that tell whether a training table can be used."""
    bad = F.count_if(F.lit(False) if not features else F.greatest(*(F.coalesce(F.isnan(f) | (F.abs(F.col(f)) == float("inf")) | F.col(f).isNull(), F.lit(True)) for f in [*features, features[0]])))
    return rows.agg(F.count(F.lit(1)).alias("n"), bad.alias("not_finite"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("not_binary")).withColumn("usable", (F.col("n") >= least) & (F.col("not_finite") == 0) & (F.col("not_binary") == 0))
