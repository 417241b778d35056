"""Column builders: deterministic order, one-hot marks, null marks, prefixes, splits, label lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def hash_order(seed: str | int, *columns: str) -> Column:
    """A pseudo-random but repeatable order: md5 of the seed and the columns' text, the same in other SQL engines."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_unit(seed: str | int, *columns: str) -> Column:
    """A repeatable number in [0, 1) from the first 13 hex digits of `hash_order`."""
    return F.conv(F.substring(hash_order(seed, *columns), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def hash_bucket(n: int, seed: str | int, *columns: str) -> Column:
    """A repeatable batch number below n."""
    return F.floor(hash_unit(seed, *columns) * n).cast("int")


def one_hot(column: str, values: Sequence[object], prefix: str | None = None) -> list[Column]:
    return [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{prefix or column}_is_{str(v).lower().replace(' ', '_').replace('-', '_')}") for v in values]


def null_marks(columns: Sequence[str]) -> list[Column]:
    """Each column with nulls as 0, and 1 where it was null."""
    return [c for name in columns for c in (F.coalesce(F.col(name), F.lit(0)).alias(name), F.col(name).isNull().cast("int").alias(f"{name}_is_null"))]


def strip_prefix(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    return df.withColumns({c: F.regexp_replace(c, "^" + pattern, "") for c in columns})


def split_label(date: str, ranges: Mapping[str, tuple[str, str]]) -> Column:
    """Name of the half-open date range that holds the date; null outside all."""
    out = None
    for name, (start, end) in ranges.items():
        inside = (F.col(date) >= F.to_date(F.lit(start))) & (F.col(date) < F.to_date(F.lit(end)))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def lookup(column: str, names: Mapping[int, str]) -> Column:
    """Readable name of a small code, as a literal map: no join."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def month_after(date: str) -> Column:
    """First day of the month after a date: facts count from then on. Malformed text gives null."""
    return F.trunc(F.add_months(F.col(date).cast("date"), 1), "month")
