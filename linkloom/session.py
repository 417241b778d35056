"""Spark sessions, the engine's context, and running tasks."""

from __future__ import annotations

import functools
import logging
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

COMMON = {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.adaptive.enabled": "true"}


def settings(platform: str, cores: int | None = None, input_bytes: int = 0) -> dict[str, str]:
    """Spark settings of a platform. Shuffles get a partition for each 64 MB of input, so that one fits a core's share of memory, and
    at least three for each core, so that an early end of some is made up for; AQE merges what is too small. A partition counts as skewed
    from four times the median on: below that, splitting costs more than waiting."""
    if platform == "local":
        n = cores or os.cpu_count() or 1
        return COMMON | {"spark.master": f"local[{n}]", "spark.sql.shuffle.partitions": str(max(n, input_bytes >> 26)), "spark.ui.enabled": "false"}
    if platform == "cluster":
        parts = max(3 * (cores or 0), input_bytes >> 26, 200)
        return COMMON | {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "96m", "spark.dynamicAllocation.enabled": "true"}
    raise ValueError(f"unknown platform: {platform}")


def build_session(platform: str = "local", extra: Mapping[str, str] | None = None, name: str = "linkloom", cores: int | None = None, input_bytes: int = 0) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (settings(platform, cores, input_bytes) | dict(extra or {})).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@dataclass(frozen=True)
class EngineContext:
    spark: SparkSession
    base: str = ""
    log: logging.Logger = field(default_factory=lambda: logging.getLogger("linkloom"))


def run_task(task: Callable[..., object], make: Callable[[], EngineContext], retries: int = 3, retryable: Callable[[Exception], bool] = lambda e: "SparkContext was shut down" in str(e), **arguments: object) -> object:
    """Runs a task with a context; a lost context is built anew. Spark itself retries single tasks."""
    for left in range(retries, -1, -1):
        context = make()
        try:
            return task(context, **arguments)
        except Exception as e:
            if not left or not retryable(e):
                raise
            context.log.warning("retrying after: %s", e)
    raise AssertionError


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """A frame that is kept while the block runs."""
    df = df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """While the block runs, a query's shuffle files go as soon as it ends, rather than when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keeper(spark: SparkSession) -> Callable[[str, DataFrame | Sequence[DataFrame]], DataFrame]:
    """What to do with a result that is used again and again: written as a table under spark.checkpoint.dir, which ends its lineage and
    outlives executors; kept in memory and on disk where that is unset, as in tests. Parts of a result, alike in columns, are written one after
    another, so that only one of them has shuffle files at a time."""
    base = spark.conf.get("spark.checkpoint.dir", None)

    def keep(name: str, df: DataFrame | Sequence[DataFrame]) -> DataFrame:
        parts = [df] if isinstance(df, DataFrame) else list(df)
        if base is None:
            return functools.reduce(DataFrame.union, parts).persist(StorageLevel.MEMORY_AND_DISK)
        path = f"{base}/kept-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        with swept(spark):
            for part in parts:
                part.write.mode("append").option("compression", "zstd").parquet(path)
        return spark.read.schema(parts[0].schema).parquet(path)

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a result is read from: under spark.checkpoint.dir, or a temporary one where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Removes what was written for this application under the shared folder; frames that were read from there are void afterwards."""
    from linkloom.sources.files import Files

    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    for kind in ("kept", "scratch", "stages"):
        Files(spark).delete(f"{base}/{kind}-{spark.sparkContext.applicationId}")


def reformat_times(values: Sequence[Sequence[str]], source: Sequence[str], target: Sequence[str]) -> list[list[str]]:
    """Time values given in parts, such as [["2020", "01"]] for %Y and %m, in the parts of other formats."""
    return [[datetime.strptime(" ".join(v), " ".join(source)).strftime(f) for f in target] for v in values]


def timed(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(*a: object, **k: object) -> object:
        began = time.time()
        try:
            return f(*a, **k)
        finally:
            logging.getLogger("linkloom").info("%s took %.1f s", f.__name__, time.time() - began)

    return run
