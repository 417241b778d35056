"""The corpus pipeline: quality rules, line dedup, near-dedup, packing. Counted as part of the subpackage llm.

Nulls: a null text, like an empty one, has too few words and goes in the first stage; a null id stays a null id. Very long texts pass whole.
Repeated rows and copies pass the first stage alike; line dedup treats equal rows as one document, near-dedup keeps one of them; ties
go to the least id, then to the least hash of the text. An empty table gives an empty result of the last stage's columns. Other columns are carried up to
packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.linededup import stage_line_dedup
from linkloom.llm.neardup import stage_near_duplicates
from linkloom.llm.packing import stage_packing
from linkloom.llm.quality import stage_quality
from linkloom.llm.spark_util import stage_folder

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_duplicates),
    ("packing", stage_packing),
]

#: SQL cannot express the line alignment, the signatures or the packing; a test holds run() against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = stage_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.mode("overwrite").parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
