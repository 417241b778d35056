"""Known and existing relations, labelled samples and batches of pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from linkloom.functions.columns import hash_bucket, split_label
from linkloom.operators.table import hash_ranked, take_n, top_n


def year_starts(start: str, end: str) -> list[str]:
    """The first days of years inside a half-open range."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    return [date(y, 1, 1).isoformat() for y in range(a.year, b.year + 1) if a <= date(y, 1, 1) < b]


def first_events(facts: DataFrame, u: str, v: str, when: str) -> DataFrame:
    """Earliest date of each relation."""
    return facts.groupBy(F.col(u).alias("u_node_id"), F.col(v).alias("v_node_id")).agg(F.min(when).alias("first_date"))


def shared_pairs(facts: DataFrame, entity: str, by: Sequence[str]) -> DataFrame:
    """Ordered pairs of different entities that share the `by` columns."""
    a, b = facts.select(F.col(entity).alias("u_node_id"), *by), facts.select(F.col(entity).alias("v_node_id"), *by)
    return a.join(b, list(by)).where("u_node_id <> v_node_id").select("u_node_id", "v_node_id", *by).distinct()


def active(facts: DataFrame, entity: str, when: str, snapshots: Sequence[str], years: int = 5) -> DataFrame:
    """(id, date) of entities that acted in one of the `years` years before a snapshot."""
    days = facts.sparkSession.createDataFrame([(s,) for s in snapshots], "s string").select(F.to_date("s").alias("date"))
    acted = facts.select(F.col(entity).alias("id"), F.year(when).alias("y")).distinct()
    return acted.join(F.broadcast(days), (F.col("y") >= F.year("date") - years) & (F.col("y") <= F.year("date") - 1)).select("id", "date").distinct()


def known_edges(first: DataFrame, ranges: Mapping[str, tuple[str, str]], active_u: DataFrame, active_v: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """First relations with their sample type, dated to the start of their year, between active ends, without own relations."""
    if own is not None:
        first = first.join(own.select("u_node_id", "v_node_id").distinct(), ["u_node_id", "v_node_id"], "left_anti")
    out = first.withColumn("sample_type", split_label("first_date", ranges)).where("sample_type is not null").select("u_node_id", "v_node_id", "sample_type", F.trunc("first_date", "year").alias("date"))
    out = out.join(active_u.withColumnRenamed("id", "u_node_id"), ["u_node_id", "date"], "left_semi")
    if active_v is not None:
        out = out.join(active_v.withColumnRenamed("id", "v_node_id"), ["v_node_id", "date"], "left_semi")
    return out.select("u_node_id", "v_node_id", "date", "sample_type")


def existing_edges(first: DataFrame, snapshots: Sequence[str], active_u: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Relations from before each snapshot, with the entities' own ones, of active u."""
    days = first.sparkSession.createDataFrame([(s,) for s in snapshots], "s string").select(F.to_date("s").alias("date"))
    whole = first.select("u_node_id", "v_node_id", "first_date")
    if own is not None:
        whole = whole.union(own.select("u_node_id", "v_node_id", "first_date"))
    out = whole.join(F.broadcast(days), F.col("first_date") < F.col("date")).select("u_node_id", "v_node_id", "date").distinct()
    return out.join(active_u.withColumnRenamed("id", "u_node_id"), ["u_node_id", "date"], "left_semi")


_PAIR = ["u_node_id", "v_node_id", "date"]


def labelled(candidates: DataFrame, targets: DataFrame, ratios: Sequence[float], max_positive: int | None = None, seed: str | int = 0, other_known: DataFrame | None = None) -> DataFrame:
    """(pair, neg_ratio, label): all positives for each ratio, and ratio times as many negatives, drawn anew for each.
    other_known: relations that must not serve as negatives either."""
    pool = candidates.select(*_PAIR).distinct()  # read once for each ratio and for the count: keep the candidates as a table
    positive = pool.join(targets.select(*_PAIR).distinct(), _PAIR, "left_semi")
    if max_positive is not None:
        positive = take_n(positive, max_positive, _PAIR, seed)
    negative = pool.join(targets.select(*_PAIR), _PAIR, "left_anti")
    if other_known is not None:
        negative = negative.join(other_known.select(*_PAIR), _PAIR, "left_anti")
    n = positive.count()
    out = None
    for r in ratios:
        part = positive.withColumn("label", F.lit(1)).union(take_n(negative, int(r * n), _PAIR, f"{seed}/{r:g}").withColumn("label", F.lit(0))).withColumn("neg_ratio", F.lit(float(r)))
        out = part if out is None else out.union(part)
    return out


def batches(pairs: DataFrame, u_batches: int, v_batches: int, seed: str | int = 0) -> DataFrame:
    """Batch id of each pair from the batches of its ends."""
    u, v = hash_bucket(u_batches, f"{seed}/u", "u_node_id"), hash_bucket(v_batches, f"{seed}/v", "v_node_id")
    return pairs.withColumn("batch_id", u * v_batches + v)


def pair_batches(pairs: DataFrame, n: int, seed: str | int = 0) -> DataFrame:
    return pairs.withColumn("batch_id", hash_bucket(n, seed, *_PAIR))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("neg_ratio", "label").agg(F.count(F.lit(1)).alias("pair_count"))


def best_pairs(scored: DataFrame, n: int) -> DataFrame:
    """The n pairs of highest prediction; ties by key."""
    return top_n(scored, n, ["prediction", *_PAIR], ["prediction"])


def numbered(df: DataFrame, groups: Sequence[str], unique: Sequence[str], name: str, seed: str | int = 0) -> DataFrame:
    """0-based number of each row in its group, by hash order."""
    return hash_ranked(df, name, groups, unique, seed).withColumn(name, F.col(name) - 1)
