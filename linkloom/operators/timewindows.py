"""Features over time windows that end before a snapshot date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkloom.operators.table import aggregate, rename_ids

#: More windows or snapshots than this in one call are refused.
MAX_WINDOWS = 10_000


@dataclass(frozen=True)
class WindowSpec:
    """`count` windows of `length` units, the first one `offset` units from the snapshot."""

    unit: str
    offset: int
    count: int
    length: int

    def windows(self) -> list[tuple[str, str, int, int]]:
        """(id, unit, offset, length) of each."""
        if self.unit not in ("day", "month", "year"):
            raise ValueError(f"unknown unit: {self.unit}")
        return [(f"{self.unit}_{o}_{self.length}", self.unit, o, self.length) for o in range(self.offset, self.offset + self.count * self.length, self.length)]


def time_map(spark: SparkSession, snapshots: Sequence[str], specs: Sequence[WindowSpec]) -> DataFrame:
    """(snapshot, mapped_date, window_id): every date that a window covers, `length` steps of its unit. Its size follows from
    the configuration alone, and is checked."""
    windows = [w for s in specs for w in s.windows()]
    if len(snapshots) > MAX_WINDOWS or len(windows) > MAX_WINDOWS:
        raise ValueError("too many snapshots or windows")
    rows = [(s, i, u, o, n) for s in snapshots for i, u, o, n in windows]
    df = spark.createDataFrame(rows, "snapshot string, window_id string, unit string, o int, n int").withColumn("snapshot", F.to_date("snapshot"))
    df = df.withColumn("start", F.when(F.col("unit") == "day", F.date_add("snapshot", F.col("o"))).otherwise(F.add_months("snapshot", F.when(F.col("unit") == "year", F.col("o") * 12).otherwise(F.col("o")))))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    step = F.when(F.col("unit") == "day", F.date_add("start", F.col("k"))).otherwise(F.add_months("start", F.when(F.col("unit") == "year", F.col("k") * 12).otherwise(F.col("k"))))
    return df.select("snapshot", step.alias("mapped_date"), "window_id")


def map_windows(facts: DataFrame, time_column: str, snapshots: Sequence[str], specs: Sequence[WindowSpec], contain: bool = False) -> DataFrame:
    """Facts with snapshot and window_id, once for each window whose dates hold the fact's. A fact matches a covered date
    by equality; contain=True compares with the window's bounds instead, for dates between steps. The map is small
    and checked, so it is broadcast; the dates' range also filters the scan."""
    spark = facts.sparkSession
    table = time_map(spark, snapshots, specs)
    lo, hi = table.agg(F.min("mapped_date"), F.max("mapped_date")).first()
    if contain:
        windows = [(s, *w) for s in snapshots for x in specs for w in x.windows()]
        bounds = spark.createDataFrame(windows, "s string, window_id string, unit string, o int, n int").withColumn("snapshot", F.to_date("s"))
        at = lambda steps: F.when(F.col("unit") == "day", F.date_add("snapshot", steps)).otherwise(F.add_months("snapshot", F.when(F.col("unit") == "year", steps * 12).otherwise(steps)))
        bounds = bounds.select("snapshot", "window_id", at(F.col("o")).alias("_from"), at(F.col("o") + F.col("n")).alias("_to"))
        return facts.join(F.broadcast(bounds), (F.col(time_column) >= F.col("_from")) & (F.col(time_column) < F.col("_to"))).drop("_from", "_to")
    return facts.where(F.col(time_column).between(F.lit(lo), F.lit(hi))).join(F.broadcast(table), F.col(time_column) == F.col("mapped_date")).drop("mapped_date")


def map_static(facts: DataFrame, snapshots: Sequence[str]) -> DataFrame:
    """Facts without time, repeated for each snapshot."""
    days = facts.sparkSession.createDataFrame([(s,) for s in snapshots], "snapshot string").select(F.to_date("snapshot").alias("snapshot"), F.lit("static").alias("window_id"))
    return facts.crossJoin(F.broadcast(days))


@dataclass(frozen=True)
class Stage:
    """One grouping of a feature pipeline. windows: drop (all windows together), keep (the window is part of the key)
    or pivot (a column for each window)."""

    group_by: tuple[str, ...]
    windows: str = "drop"
    functions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    group_count: bool = False


def run_stages(mapped: DataFrame, stages: Sequence[Stage], window_ids: Sequence[str]) -> DataFrame:
    """Stages feed each other; keys always hold the snapshot. Pivoted columns end in w<i>, the place of their window."""
    df = mapped
    for s in stages:
        keys = [*s.group_by, "snapshot"]
        if s.windows == "pivot":
            place = {w: i for i, w in enumerate(window_ids)}
            df = aggregate(df.withColumn("_w", F.concat(F.lit("w"), F.try_element_at(F.create_map(*[F.lit(x) for p in place.items() for x in p]), F.col("window_id")))), keys, s.functions, ("_w", [f"w{i}" for i in place.values()]), s.group_count)
        elif s.windows in ("drop", "keep"):
            df = aggregate(df, [*keys, "window_id"] if s.windows == "keep" else keys, s.functions, None, s.group_count)
        else:
            raise ValueError(f"unknown window mode: {s.windows}")
    return df


@dataclass(frozen=True)
class FeatureSource:
    """How one context table becomes features of an element."""

    name: str
    ids: tuple[str | Mapping[str, str], ...]
    stages: tuple[Stage, ...]
    time_column: str | None = None
    windows: tuple[WindowSpec, ...] = ()
    contain: bool = False

    def features(self) -> list[str]:
        """Names of the feature columns, in the order of the configuration."""
        names: list[str] = []
        for s in self.stages:
            base = [f"{fn}_{c}" for c, fns in s.functions.items() for fn in fns] + (["count"] if s.group_count else [])
            names = [f"{b}_w{i}" for b in base for i in range(len(self.window_ids()))] if s.windows == "pivot" else base
        return names

    def window_ids(self) -> list[str]:
        return [w[0] for s in self.windows for w in s.windows()] or ["static"]

    def metadata(self) -> list[dict]:
        """Index, name, and how each feature came about."""
        ids = self.window_ids()
        chain = [{"group_by": list(s.group_by), "windows": s.windows, "functions": {k: list(v) for k, v in s.functions.items()}, "group_count": s.group_count} for s in self.stages]
        return [{"index": i, "name": n, "source": self.name, "window": ids[int(n.rsplit("_w", 1)[1])] if self.stages[-1].windows == "pivot" else ids, "pipeline": chain} for i, n in enumerate(self.features())]

    def build(self, context: DataFrame, snapshots: Sequence[str]) -> DataFrame:
        """Key, snapshot and features; missing cells are 0. Without functions: the distinct keys."""
        facts = rename_ids(context, self.ids)
        mapped = map_windows(facts, self.time_column, snapshots, self.windows, self.contain) if self.time_column else map_static(facts, snapshots)
        out = run_stages(mapped, self.stages, self.window_ids())
        keys = [*self.stages[-1].group_by, "snapshot"]
        return out.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.features()])


def build_element(keys: Sequence[str], sources: Sequence[tuple[FeatureSource, DataFrame]], snapshots: Sequence[str]) -> tuple[DataFrame, list[dict]]:
    """Element table: key, snapshot and feat_vector, all sources merged with zeros where one has no row; and metadata."""
    frames, columns, meta = [], [], []
    for source, context in sources:
        names = {c: f"{source.name}__{c}" for c in source.features()}
        frames.append(source.build(context, snapshots).withColumnsRenamed(names))
        columns += names.values()
        meta += source.metadata()
    key = [*keys, "snapshot"]
    if len(frames) == 1:
        merged = frames[0]
    else:
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f, allowMissingColumns=True)
        merged = whole.groupBy(*key).agg(*[F.max(c).alias(c) for c in columns]) if columns else whole.select(*key).distinct()
    vector = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns]) if columns else F.array().cast("array<double>")
    return merged.select(*key, vector.alias("feat_vector")), [m | {"index": i} for i, m in enumerate(meta)]
