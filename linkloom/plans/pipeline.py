"""The discovery pipeline with persistence: each step is a table with a completion mark, so a restart goes on where it ended."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators import graph as G
from linkloom.operators.pairs import batches, labelled, pair_batches
from linkloom.operators.table import parts_of
from linkloom.operators.timewindows import FeatureSource, build_element
from linkloom.plans.schema import GraphSchema
from linkloom.sources.files import Files
from linkloom.sources.tables import Manifest, read_info, read_table, write_csv, write_table, write_with_info

#: Pairs from which on their rows are made in parts.
PART_PAIRS = 1 << 14


class Steps:
    """Named tables under a folder; a complete one is read, another is made, written, marked and read."""

    def __init__(self, spark: SparkSession, base: str, force: bool = False):
        self.spark, self.base, self.manifest = spark, base.rstrip("/"), Manifest(spark, force)

    def table(self, name: str, make: Callable[[], DataFrame], partition_columns: Sequence[str] = ()) -> DataFrame:
        path = f"{self.base}/{name}"
        if self.manifest.missing(path):
            df = make()
            schema = df.schema
            write_table(df, path, partition_columns=partition_columns)
            self.manifest.complete(path)
            return read_table(self.spark, path, schema=schema)
        return read_table(self.spark, path)


def discovery(steps: Steps, schema: GraphSchema, element_tables: dict[str, DataFrame], u_seeds: DataFrame, v_seeds: DataFrame, targets: DataFrame, known: DataFrame, settings: G.Discovery, max_neighbor: int) -> DataFrame:
    """Ranked path types, written as a table and as CSV with readable names."""
    from pyspark.sql import functions as F

    from linkloom.functions.columns import lookup

    inner = steps.table("join_edge/inner", lambda: G.inner_edges(schema, element_tables))
    outer = steps.table("join_edge/outer", lambda: G.outer_edges(inner, max_neighbor, settings.seed))
    keep = lambda name, df: steps.table(f"exploration/{name}", lambda: df if isinstance(df, DataFrame) else reduce(DataFrame.union, df))
    ranked = steps.table("matched_bipaths/summary", lambda: G.discover(u_seeds, v_seeds, outer, targets, known, settings, keep))
    named = G.order_types(ranked, settings.max_hop)
    for i in range(settings.max_hop + 1):
        named = named.withColumn(f"node_{i}_name", lookup(f"node_{i}_type", schema.node_names()))
    for i in range(settings.max_hop):
        named = named.withColumn(f"edge_{i}_name", lookup(f"edge_{i}_type", schema.edge_names()))
    write_csv(named.orderBy(F.col("tgt_pair_percent").desc_nulls_last()), f"{steps.base}/matched_bipaths_csv")
    return ranked


def candidates(steps: Steps, ranked: DataFrame, u_seeds: DataFrame, v_seeds: DataFrame, known: DataFrame, settings: G.Discovery, top_k: int) -> DataFrame:
    types = steps.table("selected_types", lambda: G.top_types(ranked, settings.max_hop, top_k))
    outer = read_table(steps.spark, f"{steps.base}/join_edge/outer")
    return steps.table("candidate_pairs", lambda: G.candidate_pairs(u_seeds, v_seeds, outer, types, settings.max_hop, known, settings.u_type, settings.v_type, settings.max_instance, settings.seed), ["date"])


def samples(steps: Steps, pairs: DataFrame, targets: DataFrame, ratios: Sequence[float], max_positive: int | None, seed: str | int = 0) -> DataFrame:
    return steps.table("sample_pairs/labelled", lambda: labelled(pairs, targets, ratios, max_positive, seed), ["neg_ratio"])


def inference_batches(steps: Steps, pairs: DataFrame, u_batches: int, v_batches: int, seed: str | int = 0) -> DataFrame:
    return steps.table("sample_pairs/infer", lambda: batches(pairs, u_batches, v_batches, seed), ["batch_id"])


def element(steps: Steps, name: str, keys: Sequence[str], sources: Sequence[tuple[FeatureSource, DataFrame]], snapshots: Sequence[str]) -> tuple[DataFrame, list[dict]]:
    """An element's table with the record of its features beside it. Each source is a table of its own first, which goes once they are merged, so
    a restart repeats only what is missing."""
    path, files = f"{steps.base}/element/{name}", Files(steps.spark)
    if steps.manifest.missing(path):
        staged = [(s, steps.table(f"element_stage/{name}/{s.name}", lambda s=s, df=df: df)) for s, df in sources]
        df, info = build_element(keys, staged, snapshots)
        write_with_info(df, path, info, "element_info", partition_columns=["snapshot"])
        steps.manifest.complete(path)
        files.delete(f"{steps.base}/element_stage/{name}")
    return read_table(steps.spark, path), read_info(steps.spark, path, "element_info")


def pair_rows(pairs: DataFrame, forward: list[DataFrame], back: list[DataFrame], whole: dict[int, DataFrame], features: DataFrame, u_type: int, v_type: int, samples: DataFrame | None = None) -> DataFrame:
    """Whole rows of pairs from their walks (pair_walks), the paths between them and the elements' features."""
    return pair_row_parts(pairs, forward, back, whole, features, u_type, v_type, samples, None, 1)[0]


def pair_row_parts(pairs: DataFrame, forward: list[DataFrame], back: list[DataFrame], whole: dict[int, DataFrame], features: DataFrame, u_type: int, v_type: int, samples: DataFrame | None = None, keep=None, n: int | None = None) -> list[DataFrame]:
    """pair_rows in n parts by a hash of u, or in as many as the pairs need: the lists of both ends pass shuffles with their pairs, so a keep should write one part at a time."""
    from pyspark.sql import functions as F

    from linkloom.operators import subgraph as S

    n = n or parts_of(pairs, PART_PAIRS)
    seed_side = lambda walks: {k: p for k, p in enumerate(walks) if k}
    arrays = lambda walks: reduce(DataFrame.unionByName, [S.seed_paths(p, k) for k, p in seed_side(walks).items()])
    both = {k: reduce(DataFrame.unionByName, [w[k] for w in (forward, back) if len(w) > k]) for k in range(1, max(len(forward), len(back)))}
    collected = S.seed_elements(forward[0].union(back[0]), both, features)
    collected = keep("seed_elements", collected) if keep else collected
    types = [r["element_key"] for r in features.select("element_key").distinct().orderBy("element_key").collect()]  # a row a type
    vectors = features.select("element_key", "feat_id", "feat_vector")
    of = lambda walks, side, c: S.lists(arrays(walks).withColumnRenamed("seed_id", c), side.withColumnRenamed("node_0_id", c), vectors, [c], types)
    far = of(back, collected.where("side = 1"), "v_node_id")
    far = keep("v_lists", far) if keep else far

    def rows(i: int) -> DataFrame:
        def own(df: DataFrame, c: str) -> DataFrame:
            return df if n == 1 else df.where(F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)) == i)

        some, ended = own(pairs, "u_node_id"), {k: own(p, "node_0_id").withColumn("u_node_id", F.col("node_0_id")).withColumn("v_node_id", F.col(f"node_{k}_id")) for k, p in whole.items()}
        near = of([own(p, "node_0_id") for p in forward], own(collected.where("side = 0"), "node_0_id"), "u_node_id")
        key = ["u_node_id", "v_node_id"]
        met = S.lists(reduce(DataFrame.unionByName, [S.bipath_arrays(p, k) for k, p in ended.items()]), S.path_elements(ended, features, key, ends=False), vectors, key, types)
        return S.assemble_pairs(some, features, u_type, v_type, S.join_lists(some, near, far, met, types), None, None if samples is None else own(samples, "u_node_id"))

    return [rows(i) for i in range(n)]


def subgraph_batches(steps: Steps, name: str, pairs: DataFrame, n_batches: int, make: Callable[[DataFrame], DataFrame], seed: str | int = 0) -> DataFrame:
    """The rows that `make` gives for the pairs, a batch at a time: each is a partition that is written and marked, so a restart makes only those that
    are missing."""
    from pyspark.sql import functions as F

    dealt = steps.table(f"{name}_pairs", lambda: pair_batches(pairs.distinct(), n_batches, seed), ["batch_id"])
    path, ids = f"{steps.base}/{name}", [(str(i),) for i in range(n_batches)]
    for (i,) in steps.manifest.missing(path, ["batch_id"], ids):
        write_table(make(dealt.where(F.col("batch_id") == int(i)).drop("batch_id")).withColumn("batch_id", F.lit(int(i))), path, partition_columns=["batch_id"])
        steps.manifest.complete(path, ["batch_id"], [(i,)])
    return read_table(steps.spark, path)
