"""Boosted trees that have to earn their place: walk-forward folds, early stopping, a gate, and a last fit on everything.

Trees are Spark ML's, so rows stay distributed; the driver holds a handful of numbers a fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import fmean, median, pstdev

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import auc, input_problems, walk_forward

#: Fewest rows that a fold is trained on.
LEAST_TRAINED = 100


@dataclass(frozen=True)
class Trees:
    """Settings of a fit. ``rounds`` is the most that are tried: a fold stops at the first round that does worse on its
    validation rows, as Spark's learner has it, and keeps the rounds up to its best one."""

    rounds: int = 500
    rate: float = 0.05
    depth: int = 4
    least_in_leaf: int = 20
    share_of_rows: float = 0.8
    share_of_features: float = 0.8
    seed: int = 42


@dataclass
class Fold:
    """What a fold came to; ``auc`` and ``rounds`` are null where it could not be used."""

    fold: int
    trained: int
    validated: int
    auc: float | None = None
    rounds: int | None = None


@dataclass
class Training:
    """``status`` is accepted, refused (gate not met) or no_usable_folds; only accepted ones hold a model."""

    status: str
    samples: int
    positive_weight: float
    folds: list[Fold] = field(default_factory=list)
    auc_mean: float = 0.0
    auc_std: float = 0.0
    auc_gate: float = 0.0
    rounds: int = 0
    importances: dict[str, float] = field(default_factory=dict)
    model: PipelineModel | None = None


def fitted(rows: DataFrame, features: list[str], label: str, positive_weight: float, trees: Trees, validation: str | None = None) -> PipelineModel:
    """Trees on ``rows``, positives weighing ``positive_weight``; those where ``validation`` holds only tell when to stop."""
    learner = GBTClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=trees.rounds, stepSize=trees.rate, maxDepth=trees.depth, minInstancesPerNode=trees.least_in_leaf,
        subsamplingRate=trees.share_of_rows, featureSubsetStrategy=str(trees.share_of_features), seed=trees.seed, validationTol=0.0,
    )
    if validation:
        learner = learner.setValidationIndicatorCol(validation)
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    known = rows.withColumns({"_y": F.col(label).cast("double"), "_w": F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))})
    return PipelineModel([assembler, learner.fit(assembler.transform(known))])


def scored(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    """``rows`` with the model's probability of label 1."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def train(
    rows: DataFrame, features: list[str], label: str, order: list[str], folds: int = 5, embargo: int = 0, group: str | None = None, least_auc: float = 0.65, trees: Trees = Trees(), least: int = 200
) -> Training:
    """Trains over expanding folds in the order of the columns ``order`` and, past the gate, once more on all rows.

    A fold's trees stop early by its validation rows. The gate is the folds' mean area less its standard deviation, which
    must exceed ``least_auc``; the last fit has the median of the folds' rounds. With ``group``, a fold's training rows
    whose group is among its validation rows are left out. Folds with too few training rows or one class on a side are
    reported and not used. Raises ValueError for unusable rows (fewer than ``least``, values that are null or not finite,
    labels other than 0 and 1) and for folds that cannot be laid out.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    kept = list(dict.fromkeys([*order, *features, label, *([group] if group else [])]))
    rows = rows.select(*kept).persist(StorageLevel.MEMORY_AND_DISK)  # before anything is counted: what they come from is worked out once
    problems = input_problems(rows, features, label, least).first()
    n = problems["n"]
    if not problems["usable"] or n < folds + 1:
        rows.unpersist()
        raise ValueError("fewer rows than folds" if problems["usable"] else f"rows cannot be trained on: {problems.asDict()}")
    positives = rows.agg(F.count_if(F.col(label) == 1)).first()[0]
    done = Training("no_usable_folds", n, (n - positives) / positives if positives else 1.0)
    dealt = walk_forward(rows, order, folds, embargo, group).persist(StorageLevel.MEMORY_AND_DISK)
    # at most two rows a fold
    sides = {(r["fold"], r["side"]): r for r in dealt.groupBy("fold", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).collect()}
    laid_out = sorted(k for k, side in sides if side == "valid")
    if not laid_out:
        raise ValueError("no fold has validation rows")
    for k in laid_out:
        t, v = sides.get((k, "train")), sides[k, "valid"]
        fold = Fold(k, t["n"] if t else 0, v["n"])
        done.folds.append(fold)
        if fold.trained < LEAST_TRAINED or not all(0 < s["pos"] < s["n"] for s in (t, v)):
            continue
        mine = dealt.where(F.col("fold") == k).withColumn("_late", F.col("side") == "valid")
        model = fitted(mine, features, label, done.positive_weight, trees, "_late")
        fold.rounds = model.stages[-1].getNumTrees
        fold.auc = auc(scored(model, mine.where("_late"), "_s"), label, "_s").first()["auc"]
    areas = [f.auc for f in done.folds if f.auc is not None]
    if areas:
        done.auc_mean, done.auc_std = fmean(areas), pstdev(areas)
        done.auc_gate = done.auc_mean - done.auc_std
        done.rounds = int(median(f.rounds for f in done.folds if f.rounds is not None))
        done.status = "accepted" if done.auc_gate > least_auc else "refused"
    if done.status == "accepted":
        last = Trees(**{**trees.__dict__, "rounds": done.rounds})
        done.model = fitted(rows, features, label, done.positive_weight, last)
        done.importances = dict(zip(features, map(float, done.model.stages[-1].featureImportances.toArray()), strict=True))
    dealt.unpersist()
    rows.unpersist()
    return done


def metrics(training: Training, spark) -> DataFrame:
    """One row of what a training came to."""
    schema = "status string, samples long, positive_weight double, auc_mean double, auc_std double, auc_gate double, rounds int, folds array<struct<fold:int,trained:long,validated:long,auc:double,rounds:int>>, importances map<string,double>"
    folds = [(f.fold, f.trained, f.validated, f.auc, f.rounds) for f in training.folds]
    row = (training.status, training.samples, training.positive_weight, training.auc_mean, training.auc_std, training.auc_gate, training.rounds, folds, training.importances)
    return spark.createDataFrame([row], schema)


def save(training: Training, spark, folder: str) -> None:
    """Writes the metrics as JSON, and the model if there is one. A refused training leaves an earlier model alone."""
    if training.model is not None:
        training.model.write().overwrite().save(f"{folder}/model")
    metrics(training, spark).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
