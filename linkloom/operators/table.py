"""Relational operators over DataFrames, driven by plain Python values so that they can be written in configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, NumericType

from linkloom.functions.columns import hash_order, hash_unit

AGGREGATES = {
    "count": F.count, "mean": F.avg, "avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min,
    "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
    "stddev": F.stddev_samp, "variance": F.var_samp,
}


# --- projection and filters -------------------------------------------------------------------------------------------


def select(df: DataFrame, items: Sequence[str | Mapping], distinct: bool = False) -> DataFrame:
    """Columns by name, {column, alias}, {column: [..]}, {pattern, regex}, {exclude} or {expr, alias}. A name that was
    already taken is left out; order is that of the items."""
    chosen: dict[str, Column] = {}

    def take(name: str, column: Column) -> None:
        chosen.setdefault(name, column)

    for item in items:
        if isinstance(item, str):
            take(item, F.col(item))
        elif "expr" in item:
            take(item["alias"], F.expr(item["expr"]).alias(item["alias"]))
        elif "pattern" in item:
            hit = (lambda c: re.match(item["pattern"], c)) if item.get("regex") else (lambda c: item["pattern"] in c)
            for c in filter(hit, df.columns):
                take(c, F.col(c))
        elif "exclude" in item:
            gone = {item["exclude"]} if isinstance(item["exclude"], str) else set(item["exclude"])
            for c in df.columns:
                if c not in gone:
                    take(c, F.col(c))
        elif "column" in item:
            names = [item["column"]] if isinstance(item["column"], str) else item["column"]
            for c in names:
                alias = item.get("alias", c) if len(names) == 1 else c
                take(alias, F.col(c).alias(alias))
        else:
            raise ValueError(f"unknown select item: {item}")
    if not chosen:
        raise ValueError("nothing selected")
    out = df.select(*chosen.values())
    return out.distinct() if distinct else out


def condition(tree: str | Mapping) -> Column:
    """A SQL text, or {and: [..]} / {or: [..]} of conditions."""
    if isinstance(tree, str):
        return F.expr(tree)
    if len(tree) != 1 or next(iter(tree)) not in ("and", "or"):
        raise ValueError(f"a condition has one key, and or or: {tree}")
    (kind, parts), = tree.items()
    if not isinstance(parts, list) or not parts:
        raise ValueError("and / or need a list that is not empty")
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), map(condition, parts))


def where(df: DataFrame, tree: str | Mapping) -> DataFrame:
    return df.where(condition(tree))


def where_in(df: DataFrame, columns: Sequence[str], values: Sequence[Sequence]) -> DataFrame:
    """Rows whose columns equal one of the value tuples; no values: all rows. One column becomes a plain IN list,
    which reaches the scan."""
    if not values:
        return df
    if len(columns) == 1:
        return df.where(F.col(columns[0]).isin([v[0] for v in values]))
    return df.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == x for c, x in zip(columns, v, strict=True)]) for v in values]))


def rename_ids(df: DataFrame, columns: Sequence[str | Mapping[str, str]]) -> DataFrame:
    """Renames {original, alias} columns; the alias wins over a column that had its name."""
    for c in columns:
        if not isinstance(c, str) and c["original"] != c["alias"]:
            df = df.drop(c["alias"]).withColumnRenamed(c["original"], c["alias"])
    return df


def fill_nulls(df: DataFrame, columns: Sequence[str], vector_sizes: Mapping[str, int] | None = None, mark: bool = True, value: float = 0) -> DataFrame:
    """Nulls and NaN of numbers become `value`, null vectors zeros. Marks: null_mark_of_<c>, 0 where it was missing."""
    out: dict[str, Column] = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, NumericType):
            missing = F.col(c).isNull() | F.isnan(F.col(c)) if isinstance(kind, (DoubleType, FloatType)) else F.col(c).isNull()
            out[c] = F.when(missing, F.lit(value).cast(kind)).otherwise(F.col(c))
        elif isinstance(kind, ArrayType):
            missing = F.col(c).isNull()
            out[c] = F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), (vector_sizes or {})[c]))
        else:
            raise TypeError(f"{c} is neither a number nor a vector")
        if mark:
            out[f"null_mark_of_{c}"] = F.when(missing, 0).otherwise(1)
    return df.withColumns(out)


def assemble(df: DataFrame, inputs: Sequence[str], output: str, stable: Sequence[str], vector_sizes: Mapping[str, int] | None = None) -> DataFrame:
    """One array of doubles from numbers and vectors, beside the stable columns. Nulls and wrong sizes raise."""
    def part(c: str) -> Column:
        if isinstance(df.schema[c].dataType, ArrayType):
            return F.when(F.size(c) == vector_sizes[c], F.col(c)).otherwise(F.raise_error(F.lit(f"{c}: wrong size or null")))
        return F.array(F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(F.raise_error(F.lit(f"{c}: null")).cast("double")))

    return df.select(*stable, F.concat(*[part(c) for c in inputs]).alias(output))


#: Ranges into which an order over a whole table is cut, and sampled keys for each border.
MAX_RANGES, SAMPLED = 256, 32


def ranged(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> tuple[DataFrame, int]:
    """Adds _part, ascending with the keys, and gives the number of parts. Borders come from a sample by hash, whose size depends on the number
    of parts alone; they are whole keys of any type that can be ordered, so a frequent first key is split by the following ones."""
    n = min(MAX_RANGES, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*keys)
    some = df.select(key.alias("k"), hash_order("ranges", *keys).alias("h")).orderBy("h").limit(SAMPLED * n).agg(F.sort_array(F.collect_list("k")).alias("k"))
    fine = F.filter("k", lambda x, i: (i + 1) % F.greatest(F.floor(F.size("k") / n), F.lit(1)) == 0)
    # The borders stay columns, whatever their types: one row of at most a few hundred keys, and every sixteenth of these.
    borders = some.select(fine.alias("_fine")).select("_fine", F.filter("_fine", lambda x, i: i % 16 == 15).alias("_coarse"))
    low = lambda borders: F.size(F.filter(borders, lambda x: x < key))
    dealt = df.crossJoin(F.broadcast(borders)).withColumn("_part", low("_coarse") * 16)
    return dealt.withColumn("_part", F.col("_part") + low(F.slice("_fine", F.col("_part") + 1, 16))).drop("_fine", "_coarse"), n


def running(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """Adds, for each name, the sum of its column over this row and those before it in the order of the keys. Sums of the ranges are added up
    first, so no task orders the whole table. Keys should tell all rows apart."""
    dealt, _ = ranged(df, keys, parts)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # MAX_RANGES rows or a few more
    base = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(base), "_part").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def row_numbers(df: DataFrame, name: str, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """0-based numbers in the order of the keys, which should tell all rows apart."""
    return running(df, keys, {name: F.lit(1)}, parts).withColumn(name, (F.col(name) - 1).cast("long"))


def hash_ranked(df: DataFrame, name: str, groups: Sequence[str], unique: Sequence[str], seed: str | int = 0, parts: int = MAX_RANGES) -> DataFrame:
    """Adds the 1-based place of each row in its group by hash order. A group is cut into `parts` equal ranges of the hash, which are counted
    first, so a huge group is never ordered in one task."""
    dealt = df.withColumn("_part", F.floor(hash_unit(seed, *unique) * parts).cast("int"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*groups, "_part").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(hash_order(seed, *unique), *unique))
    return dealt.withColumn(name, inside).join(base, [*groups, "_part"]).withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


# --- joins ------------------------------------------------------------------------------------------------------------


#: Rows up to which a side counts as small.
SMALL_ROWS = 100_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The frame with a broadcast hint, if it has so few rows; a count that ends after them says so. Otherwise as it is, for Spark to decide."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", small: str | None = None) -> DataFrame:
    """Join on equal names. Other names on both sides raise. small: 'left' or 'right' gets a broadcast hint if it is small indeed."""
    if how not in ("semi", "left_semi", "anti", "left_anti") and (shared := set(left.columns) & set(right.columns) - set(on)):
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    left, right = (if_small(left) if small == "left" else left), (if_small(right) if small == "right" else right)
    return left.crossJoin(right) if how == "cross" else left.join(right, list(on), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def skewed_keys(df: DataFrame, on: Sequence[str], threshold: int = 100_000) -> DataFrame:
    """Keys of more than `threshold` rows, and salts: into how many parts to split them."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > threshold).select(*on, F.ceil(F.col("_c") / threshold).cast("int").alias("salts"))


def salt_skewed_keys(df: DataFrame, skewed: DataFrame, on: Sequence[str], buckets: int = 0) -> DataFrame:
    """Adds salt: 0, or for a skewed key a part of it by a hash of the whole row, so that a repeated task deals alike. buckets: rows of a
    skewed key with a salt from there on are dropped, which caps the key near threshold * buckets; 0 drops none."""
    out = df.join(skewed, list(on), "left").withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return out.where(F.col("salt") < buckets) if buckets else out


def replicate_for_salts(df: DataFrame, skewed: DataFrame, on: Sequence[str], buckets: int = 0) -> DataFrame:
    """Each row once for every salt of its key."""
    n = F.coalesce("salts", F.lit(1))
    return df.join(skewed, list(on), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.least(n, F.lit(buckets)) if buckets else n) - 1))).drop("salts")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], threshold: int = 100_000) -> DataFrame:
    """Inner join whose frequent left keys are split into ceil(count / threshold) salts, with the right side repeated for
    each. No row is lost. AQE splits most skew alone; this is for keys that it can't split."""
    skewed = skewed_keys(left, on, threshold)
    return salt_skewed_keys(left, skewed, on).join(replicate_for_salts(right, skewed, on), [*on, "salt"]).drop("salt")


def outer_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge on the keys as a union and one grouping: one shuffle whatever the number of frames. Each frame has
    one row a key; columns of their own."""
    columns = [c for f in frames for c in f.columns if c not in keys]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


# --- aggregation ------------------------------------------------------------------------------------------------------


def aggregate(df: DataFrame, keys: Sequence[str], functions: Mapping[str, Sequence[str]] | None = None, pivot: tuple[str, Sequence] | None = None, group_count: bool = False) -> DataFrame:
    """functions: column to names of AGGREGATES; results are <fn>_<column>. Nothing to compute: distinct keys.
    pivot (column, values): one result a value, <fn>_<column>_<value>; written as filtered aggregates in one pass."""
    wanted = [(fn, c) for c, fns in (functions or {}).items() for fn in fns]
    if bad := [fn for fn, _ in wanted if fn not in AGGREGATES]:
        raise ValueError(f"unknown functions: {bad}")
    if not wanted and not group_count:
        return df.select(*keys).distinct()
    out: list[Column] = []
    if pivot is None:
        out = [AGGREGATES[fn](F.col(c)).alias(f"{fn}_{c}") for fn, c in wanted] + ([F.count(F.lit(1)).alias("count")] if group_count else [])
    else:
        column, values = pivot
        for fn, c in wanted:
            out += [AGGREGATES[fn](F.when(F.col(column) == v, F.col(c))).alias(f"{fn}_{c}_{v}") for v in values]
        if group_count:
            out += [F.count(F.when(F.col(column) == v, 1)).alias(f"count_{v}") for v in values]
    return df.groupBy(*keys).agg(*out)


def minmax_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in columns}


def minmax_scale(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Scales to [0, 1] by fitted bounds; a constant column becomes 0.5; values outside the bounds go outside [0, 1]."""
    return df.withColumns({c: F.lit(0.5) if lo == hi else (F.col(c) - F.lit(lo)) / F.lit(hi - lo) for c, (lo, hi) in bounds.items()})


# --- samples ----------------------------------------------------------------------------------------------------------


def sample_per_group(df: DataFrame, groups: Sequence[str], n: int, unique: Sequence[str], seed: str | int = 0, distinct: bool = False) -> DataFrame:
    """At most n rows of each group, chosen by hash order of the `unique` columns. Spark cuts each group to n rows
    before the shuffle and after it, by the hash's first four bytes, so that the shuffle carries no more of it; rows alike in these stay until the whole hash decides.
    distinct: equal rows count once, without a shuffle of their own."""
    by = Window.partitionBy(*groups)
    near = (F.dense_rank() if distinct else F.rank()).over(by.orderBy(F.unhex(F.substring(hash_order(seed, *unique), 1, 8))))
    some = df.withColumn("_rank", near).where(F.col("_rank") <= n).drop("_rank")
    some = some.distinct() if distinct else some
    rank = F.row_number().over(by.orderBy(hash_order(seed, *unique), *unique))
    return some.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sample_skewed(df: DataFrame, groups: Sequence[str], n: int, unique: Sequence[str], salts: int = 64, seed: str | int = 0) -> DataFrame:
    """As sample_per_group and with the same rows, in two levels: n rows of each salted part first, so a huge group is
    never ordered in one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*unique), F.lit(salts)))
    return sample_per_group(sample_per_group(salted, [*groups, "_salt"], n, unique, seed).drop("_salt"), groups, n, unique, seed)


#: Parts into which a result is cut that is made and written one part at a time.
MAX_PARTS = 16


def parts_of(df: DataFrame, rows: int) -> int:
    """Parts of about so many rows, MAX_PARTS at most."""
    return min(MAX_PARTS, max(1, -(-df.count() // rows)))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Mapping[str, str], n: int, unique: Sequence[str], seed: str | int = 0) -> DataFrame:
    """The n first rows of each group by the order (column to asc or desc); ties by hash order."""
    by = [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order.items()]
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*by, hash_order(seed, *unique)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def take_n(df: DataFrame, n: int, unique: Sequence[str], seed: str | int = 0) -> DataFrame:
    """Exactly n rows (or all) by hash order. Of few rows Spark keeps n a task and merges those; many are cut off by their rank, in
    ranges of the hash."""
    if n <= SMALL_ROWS:
        return df.orderBy(hash_order(seed, *unique), *unique).limit(n)
    return hash_ranked(df.withColumn("_all", F.lit(0)), "_rank", ["_all"], unique, seed).where(F.col("_rank") <= n).drop("_rank", "_all")


def top_n(df: DataFrame, n: int, keys: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """Exactly the n first rows (or all) in the order of the keys, those named in `descending` from the greatest down; numbers if so. As for take_n, many rows are
    cut off by their number."""
    if n <= SMALL_ROWS:
        return df.orderBy(*[F.col(c).desc() if c in descending else F.col(c).asc() for c in keys]).limit(n)
    turned = df.withColumns({f"_k{i}": -F.col(c) if c in descending else F.col(c) for i, c in enumerate(keys)})
    return row_numbers(turned, "_n", [f"_k{i}" for i in range(len(keys))]).where(F.col("_n") < n).select(*df.columns)


def sample_fraction(df: DataFrame, fraction: float, unique: Sequence[str], seed: str | int = 0) -> DataFrame:
    return df.where(hash_unit(seed, *unique) < fraction)
