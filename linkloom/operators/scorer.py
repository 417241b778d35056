"""A native scorer for pairs: gradient-boosted trees or logistic regression of Spark ML on path counts and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def path_count_features(pairs: DataFrame, whole: dict[int, DataFrame]) -> DataFrame:
    """Number of paths of each length between the ends of each pair."""
    key = ["u_node_id", "v_node_id", "date"]
    out = pairs
    for k, paths in whole.items():
        n = paths.groupBy(F.col("node_0_id").alias("u_node_id"), F.col(f"node_{k}_id").alias("v_node_id"), "date").agg(F.count(F.lit(1)).cast("double").alias(f"paths_{k}"))
        out = out.join(n, key, "left").withColumn(f"paths_{k}", F.coalesce(f"paths_{k}", F.lit(0.0)))
    return out


def train(df: DataFrame, features: Sequence[str], kind: str = "logistic"):
    """A fitted pipeline; the label column is `label`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = LogisticRegression(featuresCol="_x", maxIter=50) if kind == "logistic" else GBTClassifier(featuresCol="_x", maxIter=20, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model]).fit(df)


def score(model, df: DataFrame) -> DataFrame:
    """Adds prediction, the probability of the positive class."""
    from pyspark.ml.functions import vector_to_array

    names = df.columns
    return model.transform(df).select(*names, vector_to_array("probability")[1].alias("prediction_")).withColumnRenamed("prediction_", "prediction")
