"""Path groups of model samples, their tokens and positions, as windows and explosions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Path types: walked from u, walked from v, whole.
FROM_U, FROM_V, WHOLE = 0, 1, 2


def pack_paths(paths: DataFrame, max_groups: int, group_len: int) -> DataFrame:
    """paths: sample, path_type, hop_k, path_no. Paths are dealt in turn to at most max_groups groups of their sample and
    type, shortest first; inside a group they stand one after another from `offset`, and those that would pass
    group_len go. path_pos counts from 1."""
    n = F.when(F.col("path_type") == WHOLE, 2 * F.col("hop_k") - 1).otherwise(2 * F.col("hop_k"))
    base = F.when(F.col("path_type") == WHOLE, 3).otherwise(2)
    turn = Window.partitionBy("sample", "path_type").orderBy("token_len", "path_no")
    inside = Window.partitionBy("sample", "path_type", "path_group").orderBy("token_len", "path_no")
    df = paths.withColumn("token_len", n.cast("int")).withColumn("i", F.row_number().over(turn) - 1).withColumn("path_group", F.pmod(F.col("i"), F.lit(max_groups)))
    df = df.withColumn("path_pos", F.row_number().over(inside)).withColumn("end", (base + F.sum("token_len").over(inside.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    return df.where(F.col("end") <= group_len).select("sample", "path_type", "path_group", "path_no", "path_pos", "hop_k", "token_len", (F.col("end") - F.col("token_len")).alias("offset"))


def path_tokens(packed: DataFrame) -> DataFrame:
    """packed with node and edge arrays (node_type_array, u_index_array, v_index_array): a row a token, nodes first, with its
    place in the group and its position (path, node, u, v)."""
    whole = F.col("path_type") == WHOLE
    nodes = F.transform("node_type_array", lambda t, j: F.struct(F.lit(0).alias("is_edge"), j.alias("j"), t.alias("element_type"), (j + F.when(whole, 3).otherwise(2)).alias("node_pos"), F.lit(0).alias("u_pos"), F.lit(0).alias("v_pos")))

    def place(x):
        inner = F.when(x == 0, 1).when(x == F.col("hop_k"), 2).otherwise(x + 2)
        return F.when(whole, inner).otherwise(x + 1)

    edges = F.transform(F.arrays_zip("edge_type_array", "u_index_array", "v_index_array"), lambda x, j: F.struct(F.lit(1).alias("is_edge"), j.alias("j"), x["edge_type_array"].alias("element_type"), F.lit(0).alias("node_pos"), place(x["u_index_array"]).alias("u_pos"), place(x["v_index_array"]).alias("v_pos")))
    df = packed.withColumn("t", F.explode(F.concat(nodes, edges)))
    at = F.col("offset") + F.when(F.col("t.is_edge") == 1, F.size("node_type_array") + F.col("t.j")).otherwise(F.col("t.j"))
    return df.select("sample", "path_type", "path_group", "path_pos", at.alias("token_at"), "t.is_edge", "t.element_type", "t.node_pos", "t.u_pos", "t.v_pos")


def group_to_sample(packed: DataFrame) -> DataFrame:
    """A running number for each path group, and its sample."""
    groups = packed.select("sample", "path_type", "path_group").distinct()
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("path_type", "path_group")) - 1)


def frame_tokens(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The tokens that open each path group, in the shape of path_tokens: place 0 stands for the whole group, place 1 for the end that the
    paths start from, place 2, for whole paths, for the far end. pairs: sample, u_node_feat_id, v_node_feat_id; feat_id is the end's vector."""
    groups = packed.select("sample", "path_type", "path_group").distinct().join(pairs, "sample")
    near = F.when(F.col("path_type") == FROM_V, F.col("v_node_feat_id")).otherwise(F.col("u_node_feat_id"))
    token = lambda at, feat: F.struct(F.lit(at).alias("token_at"), F.lit(at).alias("node_pos"), feat.cast("long").alias("feat_id"))
    opening = F.array(token(0, F.lit(None)), token(1, near))
    tokens = F.when(F.col("path_type") == WHOLE, F.concat(opening, F.array(token(2, F.col("v_node_feat_id"))))).otherwise(opening)
    return groups.select("sample", "path_type", "path_group", F.explode(tokens).alias("t")).select("sample", "path_type", "path_group", "t.token_at", "t.node_pos", "t.feat_id")


def unique_features(rows: DataFrame, batch: str, key: str) -> DataFrame:
    """Distinct vectors of a batch of assembled pairs for one element type, with their places in the order of feat_id: what a model
    embeds once a batch."""
    each = rows.where(F.col(f"e{key}_count") > 0).select(batch, F.explode(F.arrays_zip(F.col(f"e{key}_feat_id_array").alias("feat_id"), F.col(f"e{key}_feat_vector_array").alias("feat_vector"))).alias("x"))
    once = each.groupBy(batch, F.col("x.feat_id").alias("feat_id")).agg(F.first("x.feat_vector").alias("feat_vector"))
    return once.withColumn("embed_id", F.row_number().over(Window.partitionBy(batch).orderBy("feat_id")) - 1)


def grouped_arange(df: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as its count says, numbered from 0."""
    return df.where(F.col(count) > 0).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
