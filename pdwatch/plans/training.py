"""Training the boosted-tree classifier and describing the model."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdwatch.schemas import ACTUAL, FEATURES, ID

# Training parameters.
TREES, LEARNING_RATE, DEPTH, SEED, TRAINING_SHARE = 100, 0.05, 4, 42, 0.8


def split(
    df: DataFrame, seed: int = SEED, share: float = TRAINING_SHARE, id_column: str = ID
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of identifier and seed, whatever the layout of the table."""
    digits = F.substring(F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"|{seed}")).cast("binary")), 1, 8)
    trains = F.coalesce(F.conv(digits, 16, 10).cast("bigint") < int(share * 2**32), F.lit(False))
    return df.where(trains), df.where(~trains)


def train(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = ACTUAL,
    trees: int = TREES,
    learning_rate: float = LEARNING_RATE,
    depth: int = DEPTH,
    seed: int = SEED,
) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    booster = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=trees, stepSize=learning_rate, maxDepth=depth, seed=seed
    )
    data = assembler.transform(df.select(*features, F.col(label).cast("double").alias(label)))
    return PipelineModel([assembler, booster.fit(data)])


def scorer(model: PipelineModel, column: str = "default_probability"):
    """The model as a function of DataFrames that adds the probability of default."""

    def apply(df: DataFrame) -> DataFrame:
        return model.transform(df).select(*df.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(column))

    return apply


def write_model_info(
    spark: SparkSession, path: str, name: str, version: str, algorithm: str, trained: dt.date, features: Sequence[str]
) -> str:
    """Model metadata as one JSON document."""
    info = {
        "model_name": name,
        "model_version": version,
        "algorithm": algorithm,
        "training_date": trained.isoformat(),
        "features": list(features),
    }
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_model_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "model_name string, model_version string, algorithm string, training_date string, features array<string>"
    ).json(path, multiLine=True)


def with_model_info(report: DataFrame, info: DataFrame) -> DataFrame:
    """The model's description on each row of a report of that version. One row per version, so broadcast."""
    return report.join(F.broadcast(info), "model_version")
