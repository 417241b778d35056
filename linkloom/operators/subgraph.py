"""Subgraphs of pairs: the elements of paths, their scaled features and ids, and the arrays of one row a pair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkloom.operators.table import row_numbers
from linkloom.sources.files import Files


def end_of(i: int, which: str, part: str) -> Column:
    """Id or type of an edge's u or v end on a wide path."""
    return F.when(F.col(f"edge_{i}_{which}") == i, F.col(f"node_{i}_{part}")).otherwise(F.col(f"node_{i + 1}_{part}"))


def path_nodes(paths: DataFrame, k: int, first: int = 0) -> DataFrame:
    """(node_type, node_id, date) of every node from place `first` on, distinct; one pass over the paths."""
    items = F.array(*[F.struct(F.col(f"node_{i}_type").alias("node_type"), F.col(f"node_{i}_id").alias("node_id")) for i in range(first, k + 1)])
    return paths.select(F.explode(items).alias("x"), "date").select("x.node_type", "x.node_id", "date").distinct()


def path_edges(paths: DataFrame, k: int) -> DataFrame:
    """(edge_type, u_node_id, v_node_id, date) of every edge, distinct."""
    items = F.array(*[F.struct(F.col(f"edge_{i}_type").alias("edge_type"), end_of(i, "u", "id").alias("u_node_id"), end_of(i, "v", "id").alias("v_node_id")) for i in range(k)])
    return paths.select(F.explode(items).alias("x"), "date").select("x.edge_type", "x.u_node_id", "x.v_node_id", "date").distinct()


def unique_elements(paths: Mapping[int, DataFrame], seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all paths (by length), with the seeds."""
    nodes = [path_nodes(p, k) for k, p in paths.items()] + ([seeds.select("node_type", "node_id", "date")] if seeds is not None else [])
    edges = [path_edges(p, k) for k, p in paths.items() if k]
    return reduce(DataFrame.union, nodes).distinct(), reduce(DataFrame.union, edges).distinct()


def with_features(elements: DataFrame, table: DataFrame, keys: Sequence[str], size: int, inner: bool = False) -> DataFrame:
    """Adds feat_vector. Nodes (left join) get zeros where they have none; edges (inner) go."""
    out = elements.join(table.select(*keys, "feat_vector"), list(keys), "inner" if inner else "left")
    return out.withColumn("feat_vector", F.coalesce("feat_vector", F.array_repeat(F.lit(0.0), size)))


def fit_scaler(df: DataFrame, size: int) -> list[tuple[float, float]]:
    """Least and greatest of each place of the vectors, in one aggregation."""
    row = df.agg(*[f(F.col("feat_vector")[i]) for i in range(size) for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(size)]


def scale(df: DataFrame, bounds: Sequence[tuple[float, float]]) -> DataFrame:
    """Vectors scaled by fitted bounds; a constant place becomes 0.5."""
    items = [F.lit(0.5) if lo is None or lo == hi else (F.col("feat_vector")[i] - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) for i, (lo, hi) in enumerate(bounds)]
    return df.withColumn("feat_vector", F.array(*items) if items else F.array().cast("array<double>"))


def save_scaler(files: Files, path: str, bounds: Mapping[str, Sequence[tuple[float, float]]]) -> None:
    """Keeps fitted bounds by element key, for evaluation and inference to scale by the same."""
    files.write_json(path, {k: [list(b) for b in v] for k, v in bounds.items()})


def load_scaler(files: Files, path: str) -> dict[str, list[tuple[float, float]]]:
    return {k: [(lo, hi) for lo, hi in v] for k, v in files.read_json(path).items()}


def feature_ids(df: DataFrame, type_column: str, keys: Sequence[str]) -> DataFrame:
    """Dense feat_id of each element inside its type, in the order of its key and date: its number in the whole order, from its type's first on."""
    whole = row_numbers(df, "feat_id", [type_column, *keys, "date"])
    first = df.groupBy(type_column).agg(F.count(F.lit(1)).alias("_n"))  # a row a type
    start = first.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy(type_column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return whole.join(F.broadcast(start), type_column).withColumn("feat_id", F.col("feat_id") - F.col("_first")).drop("_first")


def element_key(kind: int, type_column: str) -> Column:
    """0_<node type> or 1_<edge type>."""
    return F.concat(F.lit(f"{kind}_"), F.col(type_column).cast("string"))


def seed_paths(paths: DataFrame, k: int) -> DataFrame:
    """Wide paths as arrays for each seed: node arrays leave out the seed itself."""
    nodes, edges = range(1, k + 1), range(k)
    return paths.select(
        F.col("node_0_id").alias("seed_id"), F.col("node_0_type").alias("seed_type"), "side", "date", F.lit(k).alias("hop_k"),
        *_arrays(nodes, edges),
    )


def bipath_arrays(paths: DataFrame, k: int) -> DataFrame:
    """Whole paths as arrays for each pair: node arrays leave out both ends."""
    return paths.select(F.col("node_0_id").alias("u_node_id"), F.col(f"node_{k}_id").alias("v_node_id"), "date", F.lit(k).alias("hop_k"), *_arrays(range(1, k), range(k)))


def _arrays(nodes: range, edges: range) -> list[Column]:
    def many(kind: str, columns: list[Column]) -> Column:
        return F.array(*columns).cast(f"array<{kind}>")

    return [
        many("int", [F.col(f"node_{i}_type") for i in nodes]).alias("node_type_array"), many("bigint", [F.col(f"node_{i}_id") for i in nodes]).alias("node_id_array"),
        many("int", [F.col(f"edge_{i}_type") for i in edges]).alias("edge_type_array"), many("int", [F.col(f"edge_{i}_u") for i in edges]).alias("u_index_array"), many("int", [F.col(f"edge_{i}_v") for i in edges]).alias("v_index_array"),
        many("bigint", [end_of(i, "u", "id") for i in edges]).alias("edge_u_id_array"), many("bigint", [end_of(i, "v", "id") for i in edges]).alias("edge_v_id_array"),
    ]


def long_elements(paths: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """One row a place of a path that has keys: kind 0 nodes without the first, kind 1 edges."""
    nodes = [F.struct(F.lit(0).alias("kind"), F.lit(i).alias("pos"), F.col(f"node_{i}_type").alias("element_type"), F.col(f"node_{i}_id").alias("id_a"), F.lit(None).cast("long").alias("id_b")) for i in range(1, k + 1)]
    edges = [F.struct(F.lit(1).alias("kind"), F.lit(i).alias("pos"), F.col(f"edge_{i}_type").alias("element_type"), end_of(i, "u", "id").cast("long").alias("id_a"), end_of(i, "v", "id").cast("long").alias("id_b")) for i in range(k)]
    return paths.select(*keys, "date", F.explode(F.array(*nodes, *edges)).alias("x")).select(*keys, "date", "x.*")


def rebuild_paths(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The arrays of seed_paths from rows of long_elements: each path, named by the keys, is put together again by position."""
    at = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "element_type", "id_a", "id_b"))))
    got = long.groupBy(*keys, "date").agg(at(0).alias("n"), at(1).alias("e"))
    names = {"node_type_array": "n.element_type", "node_id_array": "n.id_a", "edge_type_array": "e.element_type", "edge_u_id_array": "e.id_a", "edge_v_id_array": "e.id_b"}
    return got.select(*keys, "date", F.size("e").alias("hop_k"), *[F.col(c).alias(a) for a, c in names.items()])


def collect_pairs(pairs: DataFrame, u_paths: DataFrame, v_paths: DataFrame, whole: DataFrame) -> DataFrame:
    """One row a pair with all paths of its u (type 0), its v (type 1) and between them (type 2), as arrays of arrays in a
    fixed order, and their number. A pair without paths has empty arrays."""
    fields = ["hop_k", "node_type_array", "node_id_array", "edge_type_array", "u_index_array", "v_index_array"]
    item = F.struct("path_type", *fields)
    key = ["u_node_id", "v_node_id", "date"]
    u = pairs.join(u_paths.withColumnRenamed("seed_id", "u_node_id").select("u_node_id", "date", *fields), ["u_node_id", "date"]).withColumn("path_type", F.lit(0))
    v = pairs.join(v_paths.withColumnRenamed("seed_id", "v_node_id").select("v_node_id", "date", *fields), ["v_node_id", "date"]).withColumn("path_type", F.lit(1))
    w = whole.join(pairs, key, "left_semi").withColumn("path_type", F.lit(2))
    every = reduce(DataFrame.union, [x.select(*key, "path_type", *fields) for x in (u, v, w)])
    got = every.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("p"))
    return pairs.select(*key).join(got, key, "left").select(
        *key, F.coalesce(F.size("p"), F.lit(0)).alias("path_count"), *[F.coalesce(F.col(f"p.{c}"), F.expr("array()").cast(got.select(f"p.{c}").schema[0].dataType)).alias(a) for c, a in (("path_type", "path_type_array"), ("hop_k", "hop_k_array"), *[(f, f"paths_{f}") for f in fields[1:]])]
    )


FIELDS = ["hop_k", "node_type_array", "node_id_array", "edge_type_array", "u_index_array", "v_index_array"]


def lists(paths: DataFrame, used: DataFrame, vectors: DataFrame, keys: Sequence[str], types: Sequence[str]) -> DataFrame:
    """A row a key (date goes with each) with its paths (FIELDS) in a fixed order as _paths, and its distinct elements with their vectors as _<type>."""
    own = paths.groupBy(*keys, "date").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("_paths"))
    held = used.select(*keys, "date", "element_key", "feat_id").join(vectors, ["element_key", "feat_id"])
    held = held.groupBy(*keys, "date").agg(*[F.collect_list(F.when(F.col("element_key") == t, F.struct("feat_id", "feat_vector"))).alias(f"_{t}") for t in types])
    return own.join(held, [*keys, "date"], "full")


def join_lists(pairs: DataFrame, u: DataFrame, v: DataFrame, between: DataFrame, types: Sequence[str]) -> DataFrame:
    """What collect_pairs and collect_features give, from the lists of both ends and of the pair: each is made once and joined to its pairs, so no row is a path or
    an element of a pair."""
    key = ["u_node_id", "v_node_id", "date"]
    out = pairs.select(*key)
    kinds = {}
    for n, (side, on) in enumerate(((u, ["u_node_id", "date"]), (v, ["v_node_id", "date"]), (between, key))):
        flat = side.select(*on, *[F.col("_paths")[c].alias(f"_{n}_{c}") for c in FIELDS], *[c for t in types for c in (F.col(f"_{t}")["feat_id"].alias(f"_{n}_{t}_id"), F.col(f"_{t}").alias(f"_{n}_{t}"))])
        kinds = {f.name[3:]: f.dataType for f in flat.schema if f.name not in key}
        out = out.join(flat, on, "left")
    all_of = lambda name: [F.coalesce(F.col(f"_{n}_{name}"), F.array().cast(kinds[name])) for n in range(3)]
    union = lambda name: F.sort_array(reduce(F.array_union, all_of(name)))
    count = sum((F.size(c) for c in all_of("node_id_array")[1:]), F.size(all_of("node_id_array")[0]))
    path_type = F.concat(*[F.array_repeat(F.lit(n), F.size(c)) for n, c in enumerate(all_of("node_id_array"))])
    out = out.select("*", *[union(f"{t}_id").alias(f"e{t}_feat_id_array") for t in types])
    return out.select(
        *key, count.alias("path_count"), path_type.alias("path_type_array"), F.concat(*all_of("hop_k")).alias("hop_k_array"), *[F.concat(*all_of(c)).alias(f"paths_{c}") for c in FIELDS[1:]],
        *[c for t in types for c in (F.size(f"e{t}_feat_id_array").cast("long").alias(f"e{t}_count"), F.col(f"e{t}_feat_id_array"), union(t)["feat_vector"].alias(f"e{t}_feat_vector_array"))],
    )


def collect_features(used: DataFrame, features: DataFrame, types: Sequence[str]) -> DataFrame:
    """used: (pair, element_key, feat_id) rows; features: (element_key, feat_id, feat_vector). For each pair and element type
    the number of distinct elements, their ids and vectors, by id; one grouping for all types."""
    key = ["u_node_id", "v_node_id", "date"]
    each = used.select(*key, "element_key", "feat_id").distinct().join(features, ["element_key", "feat_id"])
    out = []
    for t in types:
        own = F.sort_array(F.collect_list(F.when(F.col("element_key") == t, F.struct("feat_id", "feat_vector"))))
        out += [F.count(F.when(F.col("element_key") == t, 1)).alias(f"e{t}_count"), own["feat_id"].alias(f"e{t}_feat_id_array"), own["feat_vector"].alias(f"e{t}_feat_vector_array")]
    return each.groupBy(*key).agg(*out)


def element_features(elements: DataFrame, kind: int, tables: Mapping[int, tuple[DataFrame, int]], bounds: Mapping[str, Sequence[tuple[float, float]]] | None = None, keep=None) -> tuple[DataFrame, dict[str, list[tuple[float, float]]]]:
    """Vectors and ids of all elements whose type has features. kind 0: nodes (node_type, node_id, date), which all stay, with zeros where
    they have no vector; kind 1: edges (edge_type, u_node_id, v_node_id, date) that have one. tables: type to (its vectors by id and date, their size). Vectors are scaled
    by the given bounds, or by those fitted here, which are given back. Result: element_key, id_a, id_b (null for nodes), date, feat_id, feat_vector: the map from an id
    to its vector, and from an element to its id."""
    column, ids = ("node_type", ["node_id"]) if kind == 0 else ("edge_type", ["u_node_id", "v_node_id"])
    parts, fitted = [], {}
    for t, (table, size) in sorted(tables.items()):
        key = f"{kind}_{t}"
        own = with_features(elements.where(F.col(column) == t), table, [*ids, "date"], size, inner=kind == 1)
        own = keep(f"features_{key}", own) if keep else own
        fitted[key] = list((bounds or {}).get(key) or fit_scaler(own, size))
        numbered = feature_ids(scale(own, fitted[key]), column, ids)
        id_b = F.col("v_node_id").cast("long") if kind else F.lit(None).cast("long")
        parts.append(numbered.select(element_key(kind, column).alias("element_key"), F.col(ids[0]).cast("long").alias("id_a"), id_b.alias("id_b"), "date", "feat_id", "feat_vector"))
    return reduce(DataFrame.union, parts), fitted


def path_elements(paths: Mapping[int, DataFrame], features: DataFrame, keys: Sequence[str], ends: bool = True) -> DataFrame:
    """keys, element_key and feat_id of every place of the paths (by length) whose element has features, distinct. Node 0 is left out, as it is the seed;
    ends: whether the last node counts."""
    each = [long_elements(p, k, keys).where(F.lit(ends) | (F.col("kind") == 1) | (F.col("pos") < k)) for k, p in paths.items() if k]
    every = reduce(DataFrame.union, each).withColumn("element_key", F.concat(F.col("kind").cast("string"), F.lit("_"), F.col("element_type").cast("string"))).withColumn("id_a", F.col("id_a").cast("long"))
    same = (F.col("e.element_key") == F.col("f.element_key")) & (F.col("e.id_a") == F.col("f.id_a")) & F.col("e.id_b").eqNullSafe(F.col("f.id_b")) & (F.col("e.date") == F.col("f.date"))
    return every.alias("e").join(features.alias("f"), same).select(*[F.col(f"e.{c}") for c in keys], "e.date", "e.element_key", "f.feat_id").distinct()


def seed_elements(seeds: DataFrame, paths: Mapping[int, DataFrame], features: DataFrame) -> DataFrame:
    """node_0_id, side, date, element_key, feat_id: what each seed collects, itself included. seeds: node_0_id, node_0_type, side, date."""
    own = seeds.withColumn("element_key", element_key(0, "node_0_type")).alias("e").join(features.where("id_b is null").alias("f"), (F.col("e.element_key") == F.col("f.element_key")) & (F.col("e.node_0_id") == F.col("f.id_a")) & (F.col("e.date") == F.col("f.date")))
    walked = path_elements(paths, features, ["node_0_id", "side"])
    return own.select("e.node_0_id", "e.side", "e.date", "e.element_key", "f.feat_id").union(walked.select("node_0_id", "side", "date", "element_key", "feat_id")).distinct()


def pair_elements(pairs: DataFrame, from_seeds: DataFrame, whole: Mapping[int, DataFrame], features: DataFrame) -> DataFrame:
    """(pair, element_key, feat_id): what its u collects, what its v collects, and what stands on the paths between them."""
    key = ["u_node_id", "v_node_id", "date"]
    side = lambda n, c: pairs.select(*key).join(from_seeds.where(F.col("side") == n).select(F.col("node_0_id").alias(c), "date", "element_key", "feat_id"), [c, "date"]).select(*key, "element_key", "feat_id")
    ended = {k: p.withColumn("u_node_id", F.col("node_0_id")).withColumn("v_node_id", F.col(f"node_{k}_id")) for k, p in whole.items()}
    between = path_elements(ended, features, ["u_node_id", "v_node_id"], ends=False)
    return side(0, "u_node_id").union(side(1, "v_node_id")).union(between.select(*key, "element_key", "feat_id")).distinct()


def assemble_pairs(pairs: DataFrame, features: DataFrame, u_type: int, v_type: int, collected_paths: DataFrame, collected_features: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """One row a pair, the input of every model: the ids of its ends' vectors, its paths and its elements' vectors (of collected_paths itself without collected_features), with
    counts of 0 where it has none. samples: rows of pairs with labels; a pair then has a row for each of its samples."""
    key = ["u_node_id", "v_node_id", "date"]
    out = pairs.select(*key) if samples is None else pairs.select(*key).join(samples, key, "left")
    for t, c, name in ((u_type, "u_node_id", "u_node_feat_id"), (v_type, "v_node_id", "v_node_feat_id")):
        own = features.where(F.col("element_key") == f"0_{t}").select(F.col("id_a").alias(c), "date", F.col("feat_id").alias(name))
        out = out.join(own, [c, "date"], "left")
    out = out.join(collected_paths, key, "left")
    out = out if collected_features is None else out.join(collected_features, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in out.columns if c == "path_count" or c.startswith("e") and c.endswith("_count")})
