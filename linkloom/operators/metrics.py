"""Ranking and probability metrics as aggregates. Tables have score and label (0 or 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkloom.operators.table import running, top_n


def _by_score(df: DataFrame) -> DataFrame:
    """Positives and rows at each distinct score and, running, at or above it. Equal scores are one step; the running sums go over ranges of
    the scores."""
    steps = df.groupBy("score").agg(F.sum("label").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    return running(steps.withColumn("down", -F.col("score")), ["down"], {"cum_pos": F.col("pos"), "cum_n": F.col("n")}).drop("down")


def average_precision(df: DataFrame) -> DataFrame:
    return _by_score(df).agg((F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.sum("pos")).alias("pr_auc"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Chance that a positive scores above a negative; ties count half."""
    s = _by_score(df).withColumn("neg", F.col("n") - F.col("pos"))
    above = F.col("cum_pos") - F.col("pos") / 2
    return s.agg((F.sum(F.col("neg") * above) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def log_loss(df: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def bce_logits(df: DataFrame) -> DataFrame:
    """Loss of logits: softplus(x) - x * label, written so that it can't overflow."""
    x = F.col("score")
    return df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * F.col("label") + F.log1p(F.exp(-F.abs(x)))).alias("bce_logits"))


def errors(df: DataFrame) -> DataFrame:
    e = F.col("score") - F.col("label")
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def precision_at(df: DataFrame, k: int, key: str) -> DataFrame:
    """Share of positives among the k rows of highest score; ties by key."""
    return top_n(df, k, ["score", key], ["score"]).agg(F.avg("label").alias("precision_at_k"))


def top_k_accuracy(df: DataFrame, k: int, key: str) -> DataFrame:
    """Positives among the k rows of highest score, over k even if there are fewer rows."""
    return top_n(df, k, ["score", key], ["score"]).agg((F.coalesce(F.sum("label"), F.lit(0)) / F.lit(float(k))).alias("top_k_accuracy"))


def recall_at_percent(df: DataFrame, percent: float, key: str) -> DataFrame:
    """Share of all positives among the best `percent` of the rows."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    top = top_n(df, int(total["n"] * percent / 100), ["score", key], ["score"])
    return top.agg((F.coalesce(F.sum("label"), F.lit(0)) / F.lit(float(total["p"] or 1))).alias("recall_at_percent"))


def all_metrics(df: DataFrame, k: int, key: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for part in (average_precision(df), roc_auc(df), log_loss(df), errors(df), precision_at(df, k, key), top_k_accuracy(df, k, key)):
        out |= part.first().asDict()
    return out
