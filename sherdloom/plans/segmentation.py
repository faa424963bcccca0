"""Fracture segmentation: point classifier, evaluation, ablation table."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rand import DEFAULT_SEED, hash_uniform
from ..operators.geometry import feature_columns
from ..operators.metrics import segmentation_report
from ..operators.ordering import with_global_rank

THRESHOLD = 0.5  # fixed value, strict

ABLATIONS = {
    "normals": {"use_curvature": False, "use_roughness": False},
    "normals+curvature": {"use_roughness": False},
    "normals+curvature+roughness": {},
}


def train_classifier(
    points: DataFrame, columns: list[str], label: str = "frac", kind: str = "logistic",
    seed: int = DEFAULT_SEED,
) -> PipelineModel:
    """Standardise the feature columns and fit a per-point fracture classifier."""
    if kind == "logistic":
        head = LogisticRegression(labelCol=label, featuresCol="scaled", regParam=1e-3, maxIter=20)
    elif kind == "mlp":
        head = MultilayerPerceptronClassifier(
            labelCol=label, featuresCol="scaled", layers=[len(columns), 16, 2], seed=seed, maxIter=30
        )
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    stages = [
        VectorAssembler(inputCols=columns, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        head,
    ]
    return Pipeline(stages=stages).fit(points.withColumn(label, F.col(label).cast("double")))


def score_points(model: PipelineModel, points: DataFrame, label: str = "frac") -> DataFrame:
    """Points with ``score`` = probability of fracture and ``gt`` = their label."""
    scored = model.transform(points)
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "gt", F.col(label).cast("long")
    ).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def binarise(score: Column) -> Column:
    return score > THRESHOLD


def segmentation_used(mode: str, gt: Column, score: Column) -> Column:
    """Labels the next stage sees: the truth while training, predictions otherwise."""
    return gt == 1 if mode == "train" else binarise(score)


def fused_features(encoder: Column, geometry: list[str]) -> Column:
    """Encoder feature array followed by the geometric features."""
    return F.concat(encoder, F.array(*geometry))


def compare_models(scores: DataFrame) -> DataFrame:
    """Segmentation report per model with its place: F1 first, then recall, then name."""
    report = segmentation_report(scores, ["model"])
    keyed = report.withColumns({"_f": -F.col("f1"), "_r": -F.col("recall")})
    return with_global_rank(keyed, ["_f", "_r", "model"], "place").drop("_f", "_r")


def held_out(points: DataFrame, share: float = 0.3, seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows: whole objects go to one side, by a digest of their name."""
    draw = hash_uniform(seed, F.lit("held out"), "name")
    return points.where(draw >= share), points.where(draw < share)


def ablation_table(features: DataFrame, kinds: tuple[str, ...] = ("logistic", "mlp")) -> DataFrame:
    """Report on held-out objects of one classifier per head and feature set."""
    training, test = held_out(features)
    out = None
    for kind in kinds:
        for name, switches in ABLATIONS.items():
            columns = feature_columns(**switches)
            scored = score_points(train_classifier(training, columns, kind=kind), test)
            one = segmentation_report(scored).withColumns({"head": F.lit(kind), "model": F.lit(name)})
            out = one if out is None else out.unionByName(one)
    return out
