"""Batches for training and inference, and the sink of predictions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkloom.functions.columns import hash_bucket, hash_order
from linkloom.sources.files import Files


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, by name."""
    return [f"{path.rstrip('/')}/{n}" for n in Files(spark).names(path) if n.endswith(".parquet")]


def balanced_shares(sizes: Sequence[tuple[str, int]], workers: int) -> list[list[str]]:
    """Files for each worker: the largest first, each to the worker with the fewest rows so far; fullest worker first."""
    heap = [(0, w) for w in range(workers)]
    shares: list[list[str]] = [[] for _ in range(workers)]
    loads = [0] * workers
    for name, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        load, w = heapq.heappop(heap)
        shares[w].append(name)
        loads[w] = load + n
        heapq.heappush(heap, (loads[w], w))
    return [shares[w] for w in sorted(range(workers), key=lambda w: (-loads[w], w))]


def shuffled_batches(df: DataFrame, n_batches: int, unique: Sequence[str], epoch: int = 0, seed: str | int = 0) -> DataFrame:
    """Adds batch_id and order_in_batch, the rows' order by hash: another order each epoch, the same for a repeated one. Batches are near equal, and
    no row changes place on account of where it is stored."""
    return df.withColumn("batch_id", hash_bucket(n_batches, f"{seed}/{epoch}", *unique)).withColumn("order_in_batch", hash_order(f"{seed}/{epoch}/order", *unique))


class SequentialFiles:
    """The files of a folder one after another, for a worker of some; files that are marked as done are left out, so a restart goes on."""

    def __init__(self, spark: SparkSession, path: str, locks: str | None = None, rank: int = 0, workers: int = 1):
        self.spark, self.files, self.locks = spark, Files(spark), locks or f"{path.rstrip('/')}/_locks"
        done = set(self.files.names(self.locks))
        left = [f for f in data_files(spark, path) if f"{f.rpartition('/')[2]}.done" not in done]
        self.own = left[rank::workers]

    def __iter__(self) -> Iterator[tuple[str, DataFrame]]:
        for f in self.own:
            yield f, self.spark.read.parquet(f)

    def done(self, file: str) -> None:
        self.files.write_text(f"{self.locks}/{file.rpartition('/')[2]}.done", "")


def write_predictions(df: DataFrame, path: str, chunk_rows: int, score: Column | None = None) -> None:
    """Predictions in files of chunk_rows rows at most; each task appends its own, so none are collected."""
    out = df if score is None else df.withColumn("prediction", score)
    out.write.mode("overwrite").option("maxRecordsPerFile", chunk_rows).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("file", F.input_file_name())
