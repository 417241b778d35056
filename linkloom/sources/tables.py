"""Reading and writing tables by partition, sizing their files, and the record of what is complete."""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from linkloom.functions.columns import hash_unit
from linkloom.operators.table import where_in
from linkloom.sources.files import Files

FILE_BYTES = 1 << 30
#: Estimated bytes of a value by type; other types count as 300.
TYPE_BYTES = {"int": 4, "bigint": 8, "double": 8, "float": 4, "date": 4, "boolean": 1, "string": 50}
MAX_PARTITIONS = 100_000


def partition_instances(spec: Mapping[str, Sequence] | Sequence, columns: Sequence[str]) -> list[tuple[str, ...]]:
    """Instances from {column: values} (all combinations), a list for one column, or a list of lists."""
    if isinstance(spec, Mapping):
        if set(spec) != set(columns):
            raise ValueError(f"the spec names {sorted(spec)}, not {sorted(columns)}")
        out = list(itertools.product(*[[str(v) for v in spec[c]] for c in columns]))
    else:
        out = [tuple(str(x) for x in v) if isinstance(v, (list, tuple)) else (str(v),) for v in spec]
    if any(len(v) != len(columns) for v in out):
        raise ValueError(f"each instance needs {len(columns)} values")
    if len(set(out)) != len(out):
        raise ValueError("instances repeat")
    if len(out) > MAX_PARTITIONS:
        raise ValueError("too many instances")
    if bad := [x for v in out for x in v if not x or re.search(r"[=/*?\\]", x)]:
        raise ValueError(f"not usable in a path: {bad[:3]}")
    return out


def partition_path(base: str, columns: Sequence[str], values: Sequence) -> str:
    return "/".join([base.rstrip("/"), *[f"{c}={v}" for c, v in zip(columns, values, strict=True)]])


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | str | None = None, partition_columns: Sequence[str] = (), instances: Sequence[Sequence] | None = None, **options: str) -> DataFrame:
    """The table, or some of its partitions: a predicate on partition columns, which the scan prunes by."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df if instances is None else where_in(df, partition_columns, [tuple(v) for v in instances]) if instances else df.limit(0)


def column_bytes(df: DataFrame, vector_lengths: Mapping[str, int] | None = None) -> dict[str, int]:
    return {c: 4 * vector_lengths[c] if vector_lengths and c in vector_lengths else TYPE_BYTES.get(kind, 300) for c, kind in df.dtypes}


def output_statistics(df: DataFrame, partition_columns: Sequence[str] = (), sizes: Mapping[str, int | str] | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows, estimated bytes and files of each partition. A size is bytes a value, or SQL for the bytes of a value."""
    sizes = dict(column_bytes(df)) | dict(sizes or {})
    parts: list[Column] = [F.sum(F.expr(s)) if isinstance(s, str) else F.count(F.col(c)) * s for c, s in sizes.items() if c in df.columns and c not in partition_columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out = df.groupBy(*partition_columns).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(total, F.lit(0)).cast("long").alias("size_bytes"))
    return out.withColumn("num_files", (F.floor(F.col("size_bytes") / file_bytes) + 1).cast("int"))


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", partition_columns: Sequence[str] = (), max_records: int | None = None, rebalance: bool = True, **options: str) -> None:
    """Writes with files of the advisory partition size: Spark rebalances rows over the partition columns at run time, so
    large partitions get several files and small ones one. overwrite replaces only the partitions that the rows touch."""
    if rebalance:
        df = df.hint("rebalance", *[F.col(c) for c in partition_columns]) if partition_columns else df.hint("rebalance")
    writer = df.write.format(format).mode(mode).options(**options)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_columns:
        writer = writer.partitionBy(*partition_columns).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def file_numbers(df: DataFrame, statistics: DataFrame, unique: Sequence[str], partition_columns: Sequence[str] = (), seed: str | int = 0) -> DataFrame:
    """Adds file_no: each partition has the numbers after those of the partitions before it, as many as output_statistics says, and its rows
    are spread over them by hash. The statistics have a row a partition."""
    before = Window.orderBy(*(partition_columns or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, -1)
    first = statistics.select(*partition_columns, "num_files", F.coalesce(F.sum("num_files").over(before), F.lit(0)).alias("_first"))
    dealt = df.join(F.broadcast(first), list(partition_columns)) if partition_columns else df.crossJoin(F.broadcast(first))
    return dealt.withColumn("file_no", (F.col("_first") + F.floor(hash_unit(seed, *unique) * F.col("num_files"))).cast("int")).drop("_first", "num_files")


def write_numbered(df: DataFrame, path: str, n_files: int, format: str = "parquet", mode: str = "overwrite", partition_columns: Sequence[str] = (), files_at_once: int = 1500, **options: str) -> int:
    """Writes a file for each file_no, some files at a time, so that one job commits no more than these; how many jobs it took. write_table's
    rebalance needs neither numbers nor batches and is the usual way; this one fixes which row goes where."""
    jobs = 0
    for lo in range(0, n_files, files_at_once):
        hi = min(n_files, lo + files_at_once)
        part = df.where((F.col("file_no") >= lo) & (F.col("file_no") < hi)).repartitionById(hi - lo, F.col("file_no") - lo).drop("file_no")
        writer = part.write.format(format).mode(mode if lo == 0 else "append").options(**options)
        (writer.partitionBy(*partition_columns) if partition_columns else writer).save(path)
        jobs += 1
    return jobs


def write_with_info(df: DataFrame, path: str, info: object, name: str, **options: object) -> None:
    """A table with a JSON sidecar of that name, whose leading underscore hides it from readers of the table."""
    write_table(df, path, **options)
    Files(df.sparkSession).write_json(f"{path.rstrip('/')}/_{name}.json", info)


def read_info(spark: SparkSession, path: str, name: str) -> object:
    return Files(spark).read_json(f"{path.rstrip('/')}/_{name}.json")


def feature_counts(spark: SparkSession, paths: Mapping[str, str], name: str = "element_info") -> dict[str, int]:
    """How many features each element type has, by the record beside its table; 0 without one."""
    files = Files(spark)
    return {t: len(files.read_json(at)) if files.exists(at := f"{p.rstrip('/')}/_{name}.json") else 0 for t, p in paths.items()}


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header, in the frame's order."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cleanup_table(spark: SparkSession, path: str, partition_columns: Sequence[str] = (), instances: Sequence[Sequence] | None = None) -> None:
    files = Files(spark)
    for target in [path] if instances is None else [partition_path(path, partition_columns, v) for v in instances]:
        files.delete(target)


def show_table(df: DataFrame, n: int = 20, width: int = 10) -> None:
    for i in range(0, len(df.columns), width):
        df.select(*df.columns[i : i + width]).show(n, truncate=False)


class Manifest:
    """Which tables or partitions are complete, as marker files beside the data."""

    MARK = "_COMPLETE"

    def __init__(self, spark: SparkSession, force: bool = False):
        self.files, self.force = Files(spark), force

    def missing(self, path: str, partition_columns: Sequence[str] = (), instances: Sequence[Sequence] | None = None) -> list[tuple]:
        """Instances that are not complete; without partitions [()] or []."""
        wanted = [()] if instances is None else [tuple(v) for v in instances]
        return wanted if self.force else [v for v in wanted if not self.files.exists(f"{partition_path(path, partition_columns if v else (), v)}/{self.MARK}")]

    def complete(self, path: str, partition_columns: Sequence[str] = (), instances: Sequence[Sequence] | None = None) -> None:
        for v in [()] if instances is None else instances:
            self.files.write_text(f"{partition_path(path, partition_columns if v else (), v)}/{self.MARK}", "")
