"""Refit of an engine's weights from what its picks did: bounded logistic regression, gate, deployment, reconciliation.

Fits are Spark ML's bounded optimiser over distributed rows (some ten aggregates a fit, whatever the number of
epochs a plain descent would take); the driver holds a number a feature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import auc

#: Fewest samples for a refit, samples held out, fewest to train on, and the area above which weights are deployed.
LEAST_SAMPLES, HELD_OUT, LEAST_TRAINED, GATE = 100, 60, 60, 0.60
#: A change this small is ignored in the reconciliation.
SMALL_CHANGE = 0.02


@dataclass
class Refit:
    """What became of a refit: ``status`` is skipped (too few samples), kept (gate not met) or deployed."""

    status: str
    samples: int
    weights: list[float] | None = None
    train_auc: float | None = None
    #: Area that the gate looks at: weights fitted on the held-out rows, scored on them.
    test_auc: float | None = None
    #: Area of the trained weights on the held-out rows.
    holdout_auc: float | None = None


def bounded_weights(rows: DataFrame, features: list[str], label: str, penalty: float = 0.01) -> list[float]:
    """Weights, 0 or more each and 1 in sum, of the logistic model without intercept that minimises the mean loss plus
    penalty / 2 times the squared weights; equal weights if all are 0 or there is nothing to fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    equal = [1 / len(features)] * len(features)
    known = rows.select(*(F.col(f).cast("double") for f in features), F.col(label).cast("double").alias("_y")).dropna()
    if not known.limit(1).count():
        return equal
    bounds = DenseMatrix(1, len(features), [0.0] * len(features))
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", fitIntercept=False, standardization=False, regParam=penalty, elasticNetParam=0.0, family="binomial", maxIter=200, tol=1e-9, lowerBoundsOnCoefficients=bounds
    ).fit(VectorAssembler(inputCols=features, outputCol="_x").transform(known))
    fitted = [max(0.0, float(w)) for w in model.coefficients]
    total = sum(fitted)
    return [w / total for w in fitted] if total > 1e-12 else equal


def area(rows: DataFrame, features: list[str], label: str, weights: list[float]) -> float:
    """The area under the curve of the weighted sum of the features."""
    score = sum((F.lit(w) * F.col(f) for w, f in zip(weights, features, strict=True)), F.lit(0.0))
    return float(auc(rows.select(F.round(score, 12).alias("_s"), F.col(label).alias("_y")), "_y", "_s").first()["auc"])


def split_last(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(train, test, samples): the last HELD_OUT rows in the order of the columns ``order``, which tell rows apart, are
    for the test; half of them, if fewer than LEAST_TRAINED would be left."""
    n = rows.count()
    trained = n - HELD_OUT if n - HELD_OUT >= LEAST_TRAINED else n // 2
    key = F.struct(*order)
    # at most HELD_OUT rows, or half of fewer than twice as many, are ordered; one is fetched
    cut = rows.select(key.alias("k")).orderBy(F.desc("k")).limit(max(n - trained, 1)).agg(F.min("k").alias("k")).first()
    if cut["k"] is None:
        return rows, rows, n
    first = F.struct(*(F.lit(cut["k"][c]).cast(rows.schema[c].dataType).alias(c) for c in order))
    return rows.where(key < first), rows.where(key >= first), n


def refit(rows: DataFrame, features: list[str], label: str, order: list[str], penalty: float = 0.01) -> Refit:
    """Trains on all but the last rows and decides whether the weights are deployed."""
    rows = rows.dropna(subset=[*features, label])
    train, test, n = split_last(rows, order)
    if n < LEAST_SAMPLES:
        return Refit("skipped", n)
    weights = bounded_weights(train, features, label, penalty)
    on_test = area(test, features, label, bounded_weights(test, features, label, penalty))
    status = "deployed" if on_test > GATE else "kept"
    return Refit(status, n, weights, area(train, features, label, weights), on_test, area(test, features, label, weights))


def deployed(versions: DataFrame, engine: str, weights: dict[str, float], area_under: float) -> DataFrame:
    """The table (engine, version, weights, auc, active) with new weights as the engine's one active version."""
    mine = F.col("engine") == engine
    version = (versions.where(mine).agg(F.max("version")).first()[0] or 0) + 1
    new = versions.sparkSession.createDataFrame([(engine, version, weights, float(area_under), True)], "engine string, version int, weights map<string,double>, auc double, active boolean")
    return versions.withColumn("active", F.col("active") & ~mine).unionByName(new)


def action(suggested: Column, change: Column) -> Column:
    """What a suggested change comes to beside the fitted one: null where nothing was suggested."""
    agree = (suggested >= 0) == (change >= 0)
    done = F.when(agree & (F.abs(change) > SMALL_CHANGE), "applied").when(~agree, "blocked").otherwise("ignored")
    return F.when(suggested.isNotNull() & change.isNotNull(), done)


def reconciled(old: dict[str, float], new: dict[str, float], suggested: DataFrame) -> DataFrame:
    """feature, suggested, change and action for the features that ``suggested`` (feature, mean) names; both weights
    are a number a feature."""
    rows = [(f, new[f] - old[f]) for f in new if f in old]
    changes = suggested.sparkSession.createDataFrame(rows, "feature string, change double")
    both = changes.join(suggested.select("feature", F.col("mean").alias("suggested")), "feature")
    return both.select("feature", F.round("suggested", 4).alias("suggested"), F.round("change", 4).alias("change"), action(F.col("suggested"), F.col("change")).alias("action"))
