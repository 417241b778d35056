"""The engine's own example: orders, customers, parts, suppliers and nations as a typed graph. The task is to find
customers' first purchases of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.functions.columns import month_after
from linkloom.operators import graph as G
from linkloom.operators.pairs import active, existing_edges, first_events, known_edges
from linkloom.operators.timewindows import FeatureSource, Stage, WindowSpec
from linkloom.plans.schema import GraphSchema
from linkloom.session import keeper

SNAPSHOT = "2000-01-01"
RANGES = {"train": ("1998-01-01", "2000-01-01"), "valid": ("2000-01-01", "2000-07-01"), "test": ("2000-07-01", "2001-01-01"), "infer": ("2001-01-01", "2002-01-01")}
SCHEMA = GraphSchema.parse(
    {
        "nodes": {"order": {"table": "orders", "id_column": "o_orderkey"}, "customer": {"table": "customer", "id_column": "c_custkey"}, "part": {"table": "part", "id_column": "p_partkey"}, "supplier": {"table": "supplier", "id_column": "s_suppkey"}, "nation": {"table": "nation", "id_column": "n_nationkey"}},
        "edges": {
            "order_customer": {"table": "order_customer", "u_node": {"type": "order", "id_column": "o_orderkey"}, "v_node": {"type": "customer", "id_column": "o_custkey"}},
            "order_part": {"table": "order_part", "u_node": {"type": "order", "id_column": "o_orderkey"}, "v_node": {"type": "part", "id_column": "l_partkey"}},
            "order_supplier": {"table": "order_supplier", "u_node": {"type": "order", "id_column": "o_orderkey"}, "v_node": {"type": "supplier", "id_column": "l_suppkey"}},
            "part_supplier": {"table": "part_supplier", "u_node": {"type": "part", "id_column": "l_partkey"}, "v_node": {"type": "supplier", "id_column": "l_suppkey"}},
            "customer_nation": {"table": "customer_nation", "u_node": {"type": "customer", "id_column": "c_custkey"}, "v_node": {"type": "nation", "id_column": "n_nationkey"}},
        },
    }
)
CUSTOMER, PART = SCHEMA.node_index("customer"), SCHEMA.node_index("part")
MAX_NEIGHBOR, MAX_INSTANCE, SEED = 8, 8, "s"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the date from which they count."""
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", month_after("o_orderdate").alias("date"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with customer and date."""
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return line.join(orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "date"), "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")


def edge_tables(spark: SparkSession, sf: str, snapshot: str = SNAPSHOT, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Edges from facts before the snapshot. rows: the table of `lines`, if it is kept; so for what follows."""
    day = F.to_date(F.lit(snapshot))
    o = orders(spark, sf).where(F.col("date") < day).withColumn("date", day)
    l = (lines(spark, sf) if rows is None else rows).where(F.col("date") < day).withColumn("date", day)
    nation = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n_nationkey"), day.alias("date"))
    return {"order_customer": o, "order_part": l, "order_supplier": l, "part_supplier": l, "customer_nation": nation}


def inner(spark: SparkSession, sf: str) -> DataFrame:
    return G.inner_edges(SCHEMA, edge_tables(spark, sf))


def outer(spark: SparkSession, sf: str) -> DataFrame:
    return G.outer_edges(inner(spark, sf), MAX_NEIGHBOR, SEED)


def outer_parts(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> list[DataFrame]:
    """The rows of `outer` by edge type and side, for a keep that writes them one after another."""
    return [part for edges in G.edge_rows(SCHEMA, edge_tables(spark, sf, rows=rows)) for part in G.outer_sides(edges, MAX_NEIGHBOR, SEED)]


def first_purchases(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return first_events(lines(spark, sf) if rows is None else rows, "o_custkey", "l_partkey", "date")


def active_customers(spark: SparkSession, sf: str, snapshots: list[str] | None = None) -> DataFrame:
    return active(orders(spark, sf), "o_custkey", "date", snapshots or [SNAPSHOT])


def targets(spark: SparkSession, sf: str, sample_type: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    out = known_edges(first_purchases(spark, sf, rows), RANGES, active_customers(spark, sf, ["1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01"])).where(F.col("date") == F.to_date(F.lit(SNAPSHOT)))
    return out if sample_type is None else out.where(F.col("sample_type") == sample_type)


def known(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return existing_edges(first_purchases(spark, sf, rows), [SNAPSHOT], active_customers(spark, sf))


def customer_seeds(spark: SparkSession, sf: str, pairs: DataFrame | None = None) -> DataFrame:
    """A quarter as many other active customers beside those with targets. pairs: the targets, if they are kept."""
    return G.seed_nodes(targets(spark, sf) if pairs is None else pairs, active_customers(spark, sf), CUSTOMER, 0, 0.25, SEED)


def part_seeds(spark: SparkSession, sf: str, pairs: DataFrame | None = None) -> DataFrame:
    parts = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.to_date(F.lit(SNAPSHOT)).alias("date"))
    return G.seed_nodes(targets(spark, sf) if pairs is None else pairs, parts, PART, 1, 0.25, SEED)


def discovered(spark: SparkSession, sf: str, max_hop: int = 4, max_target_pairs: int | None = None) -> DataFrame:
    """Path types of up to max_hop edges. Edges, targets, known relations and hops are each used several times, so they are kept."""
    keep = keeper(spark)
    rows = keep("lines", lines(spark, sf))
    edges, pairs, old = keep("edges", outer_parts(spark, sf, rows)), keep("targets", targets(spark, sf, None, rows)), keep("known", known(spark, sf, rows))
    starts = keep("u_seeds", customer_seeds(spark, sf, pairs)), keep("v_seeds", part_seeds(spark, sf, pairs))
    return G.discover(*starts, edges, pairs, old, G.Discovery(CUSTOMER, PART, max_hop, MAX_INSTANCE, max_target_pairs, SEED), keep)


#: Customers' spending: three years by year, and quantities by month through two stages.
SPENDING = FeatureSource("spending", ({"original": "o_custkey", "alias": "c_custkey"},), (Stage(("c_custkey",), "pivot", {"o_totalprice": ("sum", "max")}, True),), "date", (WindowSpec("month", -36, 3, 12),))
BASKETS = FeatureSource("baskets", ({"original": "o_custkey", "alias": "c_custkey"},), (Stage(("c_custkey", "l_partkey"), "keep", {"l_quantity": ("sum",)}, True), Stage(("c_custkey",), "pivot", {"sum_l_quantity": ("mean", "max", "min")}, True)), "date", (WindowSpec("month", -24, 2, 12),))
