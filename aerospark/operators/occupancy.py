"""Occupied and free spots."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospark.operators.pixels import EDGE_THRESHOLD

FEATURES = ["edge_density", "mean", "std"]


def classify_by_edges(features: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """Occupied when the edge density reaches the threshold; the density is the score."""
    return features.withColumns(
        {"occupied": F.col("edge_density") >= threshold, "score": F.col("edge_density")}
    )


def train_classifier(labelled: DataFrame, features: list[str] = FEATURES, label: str = "label") -> PipelineModel:
    """A classifier on standardised features, trained where the rows lie.

    Logistic regression: Spark ML has no radial-basis support vector machine.
    """
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_scaled", labelCol=label, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(labelled)


def classify(features: DataFrame, model: PipelineModel) -> DataFrame:
    """``occupied`` and the probability of it as ``score``."""
    scored = model.transform(features)
    return scored.select(
        *features.columns, (F.col("prediction") == 1.0).alias("occupied"),
        vector_to_array("probability")[1].alias("score"),
    )


def occupancy_summary(classified: DataFrame, keys: list[str]) -> DataFrame:
    total, taken = F.count(F.lit(1)), F.count_if("occupied")
    return classified.groupBy(*keys).agg(
        total.alias("total_spots"), taken.alias("occupied"), (total - taken).alias("available"),
        F.bround(taken / total, 4).alias("occupancy_rate"),
    )
