"""Cutting lineage and labelling connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def cut(df: DataFrame) -> DataFrame:
    """Writes the frame as a table in the shared folder and goes on from there: its lineage ends, and a lost executor costs
    nothing that was written."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of an edge list; the label is the least node of its component. Each round takes the
    least label among a node's neighbours, then the label of that label, so chains halve; ends when nothing changes. Only labels
    that changed are looked up, so the node that names a large component is no hot key once it has settled."""
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("n")).select("node", F.least("node", "n").alias("label"), F.lit(True).alias("fresh")))
    while True:
        # A neighbour whose label is as it was has been taken into account before.
        near = both.join(labels.where("fresh"), both["y"] == F.col("node")).groupBy("x").agg(F.min("label").alias("n"))
        step = cut(labels.join(near, labels["node"] == near["x"], "left").select("node", F.col("label").alias("old"), F.least("label", "n").alias("label")))
        jump = step.where("label <> node").select(F.col("node").alias("j"), F.col("label").alias("jl"))
        new = cut(step.join(jump, step["label"] == jump["j"], "left").select("node", "old", F.least("label", "jl").alias("label")))
        labels = new.select("node", "label", (F.col("label") != F.col("old")).alias("fresh"))
        if labels.where("fresh").isEmpty():
            return labels.select("node", "label")


def stage_folder(spark: SparkSession) -> str:
    """A new folder for this application under spark.checkpoint.dir. Where that is unset, a temporary one, if driver and
    executors are one process; a cluster must name a shared folder. linkloom.session.forget removes the application's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base}/stages-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
