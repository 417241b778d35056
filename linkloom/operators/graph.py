"""Edges, path exploration from both ends, the meeting in the middle, and the ranking of path types.

A path of k edges is a wide row: node_0..k_id and _type, and for edge i between node i and node i + 1 its type and the
places of its u and v ends (edge_i_u, edge_i_v), so that direction survives reversal. Ids are unique only within a type;
the type is part of every comparison. Every cap takes rows by hash order, always within one snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from linkloom.operators.table import hash_ranked, parts_of, sample_per_group, take_n
from linkloom.plans.schema import GraphSchema

#: Rows of found pairs from which on their u ends are counted in parts.
PART_ROWS = 1 << 18

#: Columns of a kind of edges.
KIND = ["edge_type", "join_node_side", "join_node_type", "add_node_type"]


def edge_rows(schema: GraphSchema, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """(u, v) of each edge table in turn, with type and snapshot, repeated as there."""
    return [
        tables[e.table].select(
            F.col(e.u_column).alias("u_node_id"), F.col(e.v_column).alias("v_node_id"), F.lit(schema.node_index(e.u_type)).alias("u_node_type"),
            F.lit(schema.node_index(e.v_type)).alias("v_node_type"), F.lit(i).alias("edge_type"), F.col(schema.partition).alias("date"),
        )
        for i, e in enumerate(schema.edges)
    ]


def inner_edges(schema: GraphSchema, tables: dict[str, DataFrame]) -> DataFrame:
    """All edge tables as one: distinct (u, v) of each type and snapshot."""
    return reduce(DataFrame.union, [rows.distinct() for rows in edge_rows(schema, tables)])


def outer_edges(inner: DataFrame, max_neighbor: int | None = None, seed: str | int = 0) -> DataFrame:
    """Each edge from both ends: side 0 walks u to v, side 1 v to u. At most max_neighbor for each node, edge type and side. Under such a cap, repeated
    edges count once."""
    def side(join: str, add: str, n: int) -> DataFrame:
        return inner.select(F.col(f"{join}_node_id").alias("join_node_id"), F.col(f"{add}_node_id").alias("add_node_id"), F.col(f"{join}_node_type").alias("join_node_type"), F.col(f"{add}_node_type").alias("add_node_type"), "edge_type", F.lit(n).alias("join_node_side"), "date")

    both = side("u", "v", 0).union(side("v", "u", 1))
    return both if max_neighbor is None else sample_per_group(both, ["join_node_id", "join_node_type", "edge_type", "join_node_side", "date"], max_neighbor, ["add_node_id"], seed, distinct=True)


def outer_sides(rows: DataFrame, max_neighbor: int, seed: str | int = 0) -> list[DataFrame]:
    """outer_edges of one of edge_rows, a part a side. Its types are the same in all rows, so they stay out of the cap."""
    columns = ["join_node_id", "add_node_id", "join_node_type", "add_node_type", "edge_type", "join_node_side", "date"]
    sides = [{"join_node_id": "u_node_id", "add_node_id": "v_node_id", "join_node_type": "u_node_type", "add_node_type": "v_node_type"}, {"join_node_id": "v_node_id", "add_node_id": "u_node_id", "join_node_type": "v_node_type", "add_node_type": "u_node_type"}]
    return [
        sample_per_group(rows.select(*[F.col(c).alias(n) for n, c in names.items()], "edge_type", "date"), ["join_node_id", "date"], max_neighbor, ["add_node_id"], seed, distinct=True).withColumn("join_node_side", F.lit(n)).select(*columns)
        for n, names in enumerate(sides)
    ]


def edge_cols(i: int) -> list[str]:
    return [f"edge_{i}_type", f"edge_{i}_u", f"edge_{i}_v"]


def node_cols(i: int) -> list[str]:
    return [f"node_{i}_id", f"node_{i}_type"]


def type_columns(k: int) -> list[str]:
    """Columns that make a path's type: all node types, then each edge's type and places."""
    return [f"node_{i}_type" for i in range(k + 1)] + [c for i in range(k) for c in edge_cols(i)]


def path_columns(k: int) -> list[str]:
    return [c for i in range(k + 1) for c in node_cols(i)] + [c for i in range(k) for c in edge_cols(i)]


def same_edge(i: int, j: int) -> Column:
    """Whether edges i and j of a row join the same u and v. Edge types are not compared: two edges between the same ends
    count as one."""
    def end(k: int, which: str, part: str) -> Column:
        return F.when(F.col(f"edge_{k}_{which}") == k, F.col(f"node_{k}_{part}")).otherwise(F.col(f"node_{k + 1}_{part}"))

    return reduce(lambda a, b: a & b, [end(i, w, p) == end(j, w, p) for w in "uv" for p in ("id", "type")])


def distinct_edges(left: Sequence[int], right: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, [~same_edge(i, j) for i in left for j in right], F.lit(True))


def seeds(ids: DataFrame, node_type: int, side: int) -> DataFrame:
    """(id, date) rows as paths of length 0. side 0: walked from u, 1: from v."""
    return ids.select(F.col("id").alias("node_0_id"), F.lit(node_type).alias("node_0_type"), F.lit(side).alias("side"), "date").distinct()


def seed_nodes(targets: DataFrame, candidates: DataFrame, node_type: int, side: int, ratio: float, seed: str | int = 0) -> DataFrame:
    """Endpoints of target pairs and `ratio` times as many other candidates, by hash order within each snapshot."""
    ends = targets.select(F.col("u_node_id" if side == 0 else "v_node_id").alias("id"), "date").distinct()
    wanted = ends.groupBy("date").agg(F.ceil(F.count(F.lit(1)) * ratio).cast("int").alias("_n"))
    others = candidates.select("id", "date").distinct().join(ends, ["id", "date"], "left_anti")
    more = hash_ranked(others, "_r", ["date"], ["id"], seed).join(F.broadcast(wanted), "date").where("_r <= _n").select("id", "date")  # a row a snapshot
    return seeds(ends.union(more), node_type, side)


def expand(paths: DataFrame, edges: DataFrame, hop: int, max_instance: int | None = None, types: DataFrame | None = None, seed: str | int = 0) -> DataFrame:
    """Paths of hop - 1 edges grown by one edge that none of them used, at most max_instance for each seed and path type.
    types: allowed path types of `hop` edges; a path is kept for each that continues it."""
    j, h = hop - 1, hop
    step = edges.select(
        F.col("join_node_id").alias(f"node_{j}_id"), F.col("join_node_type").alias(f"node_{j}_type"), F.col("add_node_id").alias(f"node_{h}_id"), F.col("add_node_type").alias(f"node_{h}_type"),
        F.col("edge_type").alias(f"edge_{j}_type"), F.when(F.col("join_node_side") == 0, j).otherwise(h).alias(f"edge_{j}_u"), F.when(F.col("join_node_side") == 0, h).otherwise(j).alias(f"edge_{j}_v"), "date",
    )
    keys = [f"node_{j}_id", f"node_{j}_type", "date"]
    if types is not None:
        paths = paths.join(F.broadcast(types.select(*type_columns(h)).distinct()), type_columns(j))
        keys += [*edge_cols(j), f"node_{h}_type"]
    out = paths.join(step, keys)
    if h > 1:
        out = out.where(distinct_edges(range(j), [j]))
    if max_instance is not None and h > 1:
        # Columns that hardly vary stand together, which shuffle files hold in a few bytes.
        out = out.select(*type_columns(h), "side", "date", *[f"node_{i}_id" for i in range(h + 1)])
        out = sample_per_group(out, ["node_0_id", "node_0_type", "side", *[c for i in range(h) for c in edge_cols(i)], "date"], max_instance, [f"node_{i}_id" for i in range(1, h + 1)], seed)
    return out.select(*path_columns(h), "side", "date")


def by_kind(edges: DataFrame) -> list[DataFrame]:
    """The edges of each type and side. Caps of paths never span two of them."""
    kinds = edges.select("edge_type", "join_node_type", "join_node_side").distinct().orderBy("edge_type", "join_node_side", "join_node_type").collect()  # a row a kind
    return [edges.where((F.col("edge_type") == e) & (F.col("join_node_type") == t) & (F.col("join_node_side") == s)) for e, t, s in kinds]


def types_in(df: DataFrame, columns: Sequence[str]) -> list[dict[str, int]]:
    """The values of type columns, of which there are few."""
    return [r.asDict() for r in df.select(*columns).distinct().orderBy(*columns).collect()]


def of_type(df: DataFrame, values: dict[str, int]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()]))


def clash(t: dict[str, int], left: Sequence[int], right: Sequence[int], at) -> Column | None:
    """same_edge for paths whose types t are known: whether an edge of the left is one of the right; None if it can't be. at: the id at a place."""
    out = None
    for i in left:
        for j in right:
            ends = [[n if t[f"edge_{n}_{w}"] == n else n + 1 for n in (i, j)] for w in "uv"]
            if all(t[f"node_{a}_type"] == t[f"node_{b}_type"] for a, b in ends):
                same = reduce(lambda x, y: x & y, [at(a) == at(b) for a, b in ends if a != b], F.lit(True))
                out = same if out is None else out | same
    return out


def first_by_hash(items: Column, fields: Sequence[str], n: int, seed: str | int = 0) -> Column:
    """The rows that sample_per_group takes, from an array of structs that is bounded by other caps."""
    bare = lambda x: [x[c].alias(c) for c in fields]
    hashed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), *[x[c].cast("string") for c in fields])).alias("h"), *bare(x)))
    return F.when(F.size(items) <= n, items).otherwise(F.transform(F.slice(F.sort_array(hashed), 1, n), lambda x: F.struct(*bare(x))))


def expand_typed(paths: DataFrame, edges: DataFrame, hop: int, max_instance: int, was: dict[str, int], kind: dict[str, int], seed: str | int = 0) -> DataFrame:
    """expand for the paths of one type and the edges of one kind: rows hold ids alone, and each node's edges are one row. Edges should be capped."""
    j, h = hop - 1, hop
    u = j if kind["join_node_side"] == 0 else h
    t = was | {f"node_{h}_type": kind["add_node_type"], f"edge_{j}_type": kind["edge_type"], f"edge_{j}_u": u, f"edge_{j}_v": j + h - u}
    step = of_type(edges, kind).groupBy(F.col("join_node_id").alias(f"node_{j}_id"), "date").agg(F.collect_list("add_node_id").alias("_next"))
    rows = of_type(paths, was).select(*[f"node_{i}_id" for i in range(h)], "date").join(step, [f"node_{j}_id", "date"])
    used = lambda x: clash(t, range(j), [j], lambda n: x if n == h else F.col(f"node_{n}_id"))
    if used(F.lit(0)) is not None:
        rows = rows.withColumn("_next", F.filter("_next", lambda x: ~used(x)))
    fields = [f"node_{i}_id" for i in range(1, h + 1)]
    grown = F.transform("_next", lambda x: F.struct(*[F.col(f"node_{i}_id") for i in range(1, h)], x.alias(f"node_{h}_id")))
    each = rows.where(F.size("_next") > 0).select("node_0_id", "date", grown.alias("_p")).groupBy("node_0_id", "date").agg(F.flatten(F.collect_list("_p")).alias("_p"))
    out = each.select("node_0_id", "date", F.inline(first_by_hash(F.col("_p"), fields, max_instance, seed)))
    return out.select(*[F.col(c) if c.endswith("_id") else F.lit(t[c]).alias(c) for c in path_columns(h)], F.lit(t["side"]).alias("side"), "date")


def explore(start: DataFrame, edges: DataFrame, hops: int, max_instance: int | None = None, types: dict[int, DataFrame] | None = None, seed: str | int = 0, keep=None) -> list[DataFrame]:
    """Paths of 0 to `hops` edges. keep: what to do with each hop's result before the next, such as writing it; it gets the paths by the last edge's type
    and side, as parts that it may write one by one."""
    out = [start]
    parts = by_kind(edges) if keep and hops > 1 else []
    kinds = types_in(edges, KIND) if parts and max_instance is not None else []
    for h in range(1, hops + 1):
        only = (types or {}).get(h)
        if keep is None:
            out.append(expand(out[-1], edges, h, max_instance, only, seed))
        elif h == 1 or not parts:
            out.append(keep(h, [expand(out[-1], edges, h, max_instance, only, seed)]))
        elif max_instance is None:
            out.append(keep(h, [expand(out[-1], some, h, max_instance, only, seed) for some in parts]))
        else:
            was = types_in(out[-1], [*type_columns(h - 1), "side"])
            wanted = None if only is None else [tuple(r) for r in only.select(*type_columns(h)).distinct().collect()]
            none = expand(out[-1], edges, h).where(F.lit(False))
            by = {(k["edge_type"], k["join_node_side"], k["join_node_type"]): [] for k in kinds}
            for kind in kinds:
                for w in was:
                    u = h - 1 if kind["join_node_side"] == 0 else h
                    t = w | {f"node_{h}_type": kind["add_node_type"], f"edge_{h - 1}_type": kind["edge_type"], f"edge_{h - 1}_u": u, f"edge_{h - 1}_v": 2 * h - 1 - u}
                    if w[f"node_{h - 1}_type"] == kind["join_node_type"] and (wanted is None or tuple(t[c] for c in type_columns(h)) in wanted):
                        by[kind["edge_type"], kind["join_node_side"], kind["join_node_type"]].append(expand_typed(out[-1], edges, h, max_instance, w, kind, seed))
            out.append(keep(h, [reduce(DataFrame.union, some) if some else none for some in by.values()]))
    return out


def reverse(paths: DataFrame, length: int, total: int) -> DataFrame:
    """A path of `length` edges from the far end, as the last part of one of `total`: node i becomes total - i, edge i
    total - i - 1, place x total - x. Reversing twice with total = length gives the path back."""
    nodes = [F.col(f"node_{i}_{p}").alias(f"node_{total - i}_{p}") for i in range(length, -1, -1) for p in ("id", "type")]
    edges = [c for i in range(length - 1, -1, -1) for c in (F.col(f"edge_{i}_type").alias(f"edge_{total - i - 1}_type"), (F.lit(total) - F.col(f"edge_{i}_u")).alias(f"edge_{total - i - 1}_u"), (F.lit(total) - F.col(f"edge_{i}_v")).alias(f"edge_{total - i - 1}_v"))]
    return paths.select(*nodes, *edges, "date")


def split(k: int) -> tuple[int, int]:
    """Edges walked forward and backward for a path of k."""
    return (k + 1) // 2, k // 2


def backward(paths: DataFrame, k: int, max_instance: int | None = None, seed: str | int = 0) -> DataFrame:
    """Paths from v, reversed onto places f to k, at most max_instance for each middle node and type."""
    f, b = split(k)
    out = reverse(paths, b, k)
    if max_instance is not None and b > 0:
        out = sample_per_group(out, [*node_cols(f), *[c for i in range(f, k) for c in edge_cols(i)], "date"], max_instance, [f"node_{i}_id" for i in range(f + 1, k + 1)], seed)
    return out


def meet(forward: DataFrame, back: DataFrame, k: int, types: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Whole paths of k edges: both halves joined on the middle node, no edge used twice. types: only these whole path types.
    pairs (u_node_id, v_node_id, date): only paths between them; the pair joins the forward side first, so the far end is
    part of the join key."""
    f, _ = split(k)
    keys = [*node_cols(f), "date"]
    forward = forward.drop("side")
    if types is not None:
        wanted = F.broadcast(types.select(*type_columns(k)).distinct())
        forward = forward.join(wanted, type_columns(f))
        keys += [c for c in type_columns(k) if c not in type_columns(f)]
    if pairs is not None:
        ends = pairs.select(F.col("u_node_id").alias("node_0_id"), F.col("v_node_id").alias(f"node_{k}_id"), "date").distinct()
        if k == f:  # one edge: the far end is already on the path
            return forward.join(ends, ["node_0_id", f"node_{k}_id", "date"], "left_semi").join(back, list(dict.fromkeys(keys)), "left_semi").select(*path_columns(k), "date")
        forward = forward.join(ends, ["node_0_id", "date"])
        keys += [f"node_{k}_id"]
    out = forward.join(back, list(dict.fromkeys(keys)))
    return out.where(distinct_edges(range(f), range(f, k))).select(*path_columns(k), "date")


def bipaths(forward: list[DataFrame], back: list[DataFrame], k: int, max_instance: int | None = None, seed: str | int = 0) -> DataFrame:
    """Distinct (u, v, path type, snapshot) over all paths of k edges."""
    f, b = split(k)
    whole = meet(forward[f], backward(back[b], k, max_instance, seed), k)
    return whole.select("node_0_id", f"node_{k}_id", *type_columns(k), "date").distinct()


def bipath_parts(forward: list[DataFrame], back: list[DataFrame], k: int, max_instance: int | None = None, seed: str | int = 0) -> list[DataFrame]:
    """bipaths by the middle node's type and the edge behind it, of which there are few. No path type is in two parts."""
    f, b = split(k)
    cols = [f"node_{f}_type", *(edge_cols(f) if b else [])]
    halves = backward(back[b], k, max_instance, seed)
    out = []
    for kind in reverse(back[b], b, k).select(*cols).distinct().orderBy(*cols).collect():  # a row a kind
        half = halves.where(reduce(lambda a, c: a & c, [F.col(c) == v for c, v in zip(cols, kind, strict=True)]))
        whole = meet(forward[f].where(F.col(f"node_{f}_type") == kind[0]), half, k)
        out.append(whole.select("node_0_id", f"node_{k}_id", *type_columns(k), "date").distinct())
    return out or [bipaths(forward, back, k, max_instance, seed)]


def without_known(found: DataFrame, known: DataFrame, k: int, u_type: int, v_type: int) -> DataFrame:
    """Pairs that are not known edges; ids are compared within their types."""
    gone = known.select(F.col("u_node_id").alias("node_0_id"), F.col("v_node_id").alias(f"node_{k}_id"), F.lit(u_type).alias("node_0_type"), F.lit(v_type).alias(f"node_{k}_type"), "date")
    return found.join(gone, ["node_0_id", "node_0_type", f"node_{k}_id", f"node_{k}_type", "date"], "left_anti")


def cap_pairs(found: DataFrame, k: int, max_instance: int | None, seed: str | int = 0) -> DataFrame:
    return found if max_instance is None else sample_per_group(found, ["node_0_id", *type_columns(k), "date"], max_instance, [f"node_{k}_id"], seed)


def rank_types(found: DataFrame, targets: DataFrame, known: DataFrame, k: int, u_type: int, v_type: int, max_instance: int | None = None, seed: str | int = 0, min_support: int = 0) -> DataFrame:
    """For each path type: pairs that it makes, how many are targets, and the share."""
    return rated(count_types(found, targets, known, k, u_type, v_type, max_instance, seed), k, min_support)


def count_types(found: DataFrame, targets: DataFrame, known: DataFrame, k: int, u_type: int, v_type: int, max_instance: int | None = None, seed: str | int = 0) -> DataFrame:
    """For each path type: pairs that it makes and how many are targets. Counts of different u add up."""
    left = cap_pairs(without_known(found, known, k, u_type, v_type), k, max_instance, seed)
    hit = targets.select(F.col("u_node_id").alias("node_0_id"), F.col("v_node_id").alias(f"node_{k}_id"), F.lit(u_type).alias("node_0_type"), F.lit(v_type).alias(f"node_{k}_type"), "date", F.lit(1).alias("match_mark")).distinct()
    return left.join(hit, ["node_0_id", "node_0_type", f"node_{k}_id", f"node_{k}_type", "date"], "left").groupBy(*type_columns(k)).agg(F.coalesce(F.sum("match_mark"), F.lit(0)).cast("long").alias("tgt_pair_count"), F.count(F.lit(1)).alias("all_pair_count"))


def count_parts(found: DataFrame, targets: DataFrame, known: DataFrame, k: int, u_type: int, v_type: int, max_instance: int | None = None, seed: str | int = 0) -> list[DataFrame]:
    """count_types of the u ends in up to MAX_PARTS parts by hash. found should be a table, as it is counted and read for each."""
    n = parts_of(found, PART_ROWS)
    own = lambda df, c, i: df.where(F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)) == i)
    return [count_types(own(found, "node_0_id", i), own(targets, "u_node_id", i), own(known, "u_node_id", i), k, u_type, v_type, max_instance, seed) for i in range(n)]


def ends_of(pairs: DataFrame, name: str) -> DataFrame:
    """A row a u with the v of its pairs."""
    return pairs.groupBy(F.col("u_node_id").alias("node_0_id"), "date").agg(F.collect_set("v_node_id").alias(name))


def count_met(forward: list[DataFrame], back: list[DataFrame], ends: DataFrame, k: int, u_type: int, v_type: int, max_instance: int, seed: str | int = 0, keep=None) -> list[DataFrame]:
    """count_types over bipaths, a part for each type of the forward half. The far ends behind a middle node are one row a type of the back half, so whole paths are never
    rows of their own. ends: node_0_id, date, known and targets, the v of known and of target pairs (ends_of)."""
    f, b = split(k)
    far = [f"node_{i}_id" for i in range(f + 1, k + 1)]
    used_twice = lambda t, x: clash(t, range(f), range(f, k), lambda i: x[f"node_{i}_id"] if i > f else F.col(f"node_{i}_id"))
    unused = lambda t: F.filter("_far", lambda x: ~used_twice(t, x))
    turned = reverse(back[b], b, k)
    own = [c for c in type_columns(k) if c not in type_columns(f)] + [f"node_{f}_type"]
    halves, tails = [], types_in(turned, own)
    for n, tail in enumerate(tails):
        some = of_type(turned, tail).select(f"node_{f}_id", *far, "date")
        some = sample_per_group(some, [f"node_{f}_id", "date"], max_instance, far, seed) if b else some.withColumn("_v", F.col(f"node_{f}_id"))
        item = F.struct(*[F.col(c) for c in far]) if b else F.struct(F.col("_v").alias(f"node_{k}_id"))
        halves.append(some.groupBy(f"node_{f}_id", "date").agg(F.collect_list(item).alias("_far")).withColumn("_tail", F.lit(n)))
    if not halves:
        return [count_types(bipaths(forward, back, k, max_instance, seed), *(ends.select(F.col("node_0_id").alias("u_node_id"), F.explode(c).alias("v_node_id"), "date") for c in ("targets", "known")), k, u_type, v_type, max_instance, seed)]
    halves = keep(f"back_{k}", halves) if keep else reduce(DataFrame.union, halves)
    out = []
    for head in types_in(forward[f], type_columns(f)):
        whole = [(n, head | t) for n, t in enumerate(tails) if t[f"node_{f}_type"] == head[f"node_{f}_type"]]
        if not whole:
            continue
        rows = of_type(forward[f], head).select(*[f"node_{i}_id" for i in range(f + 1)], "date").join(halves.where(F.col("_tail").isin([n for n, _ in whole])), [f"node_{f}_id", "date"])
        free = F.col("_far")
        for n, t in whole:
            if used_twice(t, F.struct(*[F.lit(0).alias(c) for c in far])) is not None:
                free = F.when(F.col("_tail") == n, unused(t)).otherwise(free)
        rows = rows.select("node_0_id", "_tail", "date", F.transform(free, lambda x: x[f"node_{k}_id"]).alias("_v")).where(F.size("_v") > 0)
        each = rows.repartition("node_0_id", "date").groupBy("node_0_id", "date", "_tail").agg(F.array_distinct(F.flatten(F.collect_list("_v"))).alias("_v")).join(ends, ["node_0_id", "date"], "left")
        close = [n for n, t in whole if t["node_0_type"] == u_type and t[f"node_{k}_type"] == v_type]
        none = F.array().cast(each.schema["_v"].dataType)
        of = lambda c: F.when(F.col("_tail").isin(close), F.coalesce(F.col(c).cast(each.schema["_v"].dataType), none)).otherwise(none)  # noqa: B023, E731
        each = each.select("_tail", F.transform(F.array_except("_v", of("known")), lambda x: F.struct(x.alias("v"))).alias("_v"), of("targets").alias("_t")).where(F.size("_v") > 0)
        each = each.select("_tail", "_t", first_by_hash(F.col("_v"), ["v"], max_instance, seed)["v"].alias("_v"))
        counts = each.groupBy("_tail").agg(F.sum(F.size(F.array_intersect("_v", "_t"))).cast("long").alias("tgt_pair_count"), F.sum(F.size("_v")).cast("long").alias("all_pair_count"))
        names = counts.sparkSession.createDataFrame([(n, *[t[c] for c in type_columns(k)]) for n, t in whole], "_tail int, " + ", ".join(f"{c} int" for c in type_columns(k)))
        out.append(counts.join(F.broadcast(names), "_tail").select(*type_columns(k), "tgt_pair_count", "all_pair_count"))
    return out or [count_types(bipaths(forward, back, k, max_instance, seed), *(ends.select(F.col("node_0_id").alias("u_node_id"), F.explode(c).alias("v_node_id"), "date") for c in ("targets", "known")), k, u_type, v_type, max_instance, seed)]


def rated(counts: DataFrame, k: int, min_support: int = 0) -> DataFrame:
    """Adds counts of the same type up and gives the share of targets."""
    out = counts.groupBy(*type_columns(k)).agg(*[F.sum(c).alias(c) for c in ("tgt_pair_count", "all_pair_count")])
    return out.where(F.col("all_pair_count") >= min_support).withColumn("tgt_pair_percent", F.try_divide("tgt_pair_count", "all_pair_count")).withColumn("hop_k", F.lit(k))


def union_types(ranked: Sequence[DataFrame]) -> DataFrame:
    """Types of all lengths, padded with nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def order_types(ranked: DataFrame, k_max: int) -> DataFrame:
    return ranked.orderBy(F.col("tgt_pair_percent").desc_nulls_last(), F.col("tgt_pair_count").desc(), *[F.col(c).asc_nulls_first() for c in type_columns(k_max) if c in ranked.columns])


def top_types(ranked: DataFrame, k_max: int, n: int, strict: bool = False) -> DataFrame:
    """The n best types; strict raises if there are fewer."""
    out = order_types(ranked, k_max).limit(n)
    if strict and (m := out.count()) < n:
        raise ValueError(f"{m} path types, {n} wanted")
    return out


def u_prefixes(types: DataFrame, h: int) -> DataFrame:
    """First h edges of the types that are walked that far from u."""
    return types.where(F.col("hop_k") >= 2 * h - 1).select(*type_columns(h)).distinct()


def v_prefixes(types: DataFrame, h: int, k_max: int) -> DataFrame:
    """Last h edges of the types, walked from v."""
    def at(name: str, place) -> Column:
        out = None
        for k in range(2 * h, k_max + 1):
            c = place(k)
            out = F.when(F.col("hop_k") == k, c) if out is None else out.when(F.col("hop_k") == k, c)
        return out.alias(name)

    nodes = [at(f"node_{i}_type", lambda k, i=i: F.col(f"node_{k - i}_type")) for i in range(h + 1)]
    edges = [c for i in range(h) for c in (at(f"edge_{i}_type", lambda k, i=i: F.col(f"edge_{k - 1 - i}_type")), at(f"edge_{i}_u", lambda k, i=i: F.lit(k) - F.col(f"edge_{k - 1 - i}_u")), at(f"edge_{i}_v", lambda k, i=i: F.lit(k) - F.col(f"edge_{k - 1 - i}_v")))]
    return types.where(F.col("hop_k") >= 2 * h).select(*nodes, *edges).distinct()


def typed(types: DataFrame, k: int) -> DataFrame:
    return types.where(F.col("hop_k") == k).select(*type_columns(k)).distinct()


def prefix_maps(types: DataFrame, k_max: int) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    f, b = split(k_max)
    return {h: u_prefixes(types, h) for h in range(1, f + 1)}, {h: v_prefixes(types, h, k_max) for h in range(1, b + 1)}


def candidate_pairs(u_seeds: DataFrame, v_seeds: DataFrame, edges: DataFrame, types: DataFrame, k_max: int, known: DataFrame, u_type: int, v_type: int, max_instance: int | None = None, seed: str | int = 0, ks: Sequence[int] | None = None, keep=None) -> DataFrame:
    """Distinct (u, v, date) that the given path types make and that are not known, capped for each u and type. keep: as for discover."""
    f, b = split(k_max)
    forward_types, back_types = prefix_maps(types, k_max)
    forward, back = explore(u_seeds, edges, f, max_instance, forward_types, seed, noted(keep, "u")), explore(v_seeds, edges, b, max_instance, back_types, seed, noted(keep, "v"))
    out = []
    for k in ks or range(1, k_max + 1):
        whole = meet(forward[split(k)[0]], backward(back[split(k)[1]], k, max_instance, seed), k, typed(types, k))
        found = whole.select("node_0_id", f"node_{k}_id", *type_columns(k), "date").distinct()
        found = cap_pairs(without_known(found, known, k, u_type, v_type), k, max_instance, seed)
        out.append(found.select(F.col("node_0_id").alias("u_node_id"), F.col(f"node_{k}_id").alias("v_node_id"), "date"))
    return reduce(DataFrame.union, out).distinct()


def pair_bipaths(pairs: DataFrame, edges: DataFrame, types: DataFrame, k_max: int, u_type: int, v_type: int, max_instance: int | None = None, seed: str | int = 0, keep=None) -> dict[int, DataFrame]:
    """All path instances of the given types between given pairs, by length."""
    forward, back = pair_walks(pairs, edges, types, k_max, u_type, v_type, max_instance, seed, keep)
    return between(pairs, forward, back, types, k_max, max_instance, seed)


def pair_walks(pairs: DataFrame, edges: DataFrame, types: DataFrame, k_max: int, u_type: int, v_type: int, max_instance: int | None = None, seed: str | int = 0, keep=None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Paths of the given types from the pairs' u ends and from their v ends, by length."""
    f, b = split(k_max)
    forward_types, back_types = prefix_maps(types, k_max)
    u = seeds(pairs.select(F.col("u_node_id").alias("id"), "date"), u_type, 0)
    v = seeds(pairs.select(F.col("v_node_id").alias("id"), "date"), v_type, 1)
    return explore(u, edges, f, max_instance, forward_types, seed, noted(keep, "u")), explore(v, edges, b, max_instance, back_types, seed, noted(keep, "v"))


def between(pairs: DataFrame, forward: list[DataFrame], back: list[DataFrame], types: DataFrame, k_max: int, max_instance: int | None = None, seed: str | int = 0) -> dict[int, DataFrame]:
    """The walks of pair_walks joined to whole paths between the pairs' ends, by length."""
    return {k: meet(forward[split(k)[0]], backward(back[split(k)[1]], k, max_instance, seed), k, typed(types, k), pairs) for k in range(1, k_max + 1)}


def noted(keep, side: str):
    """A keep for explore from one that takes names."""
    return (lambda h, df: keep(f"{side}_hop_{h}", df)) if keep else None


@dataclass(frozen=True)
class Discovery:
    """Settings of one discovery."""

    u_type: int
    v_type: int
    max_hop: int
    max_instance: int | None = 20
    max_target_pairs: int | None = None
    seed: str | int = 0


def discover(u_seeds: DataFrame, v_seeds: DataFrame, edges: DataFrame, targets: DataFrame, known: DataFrame, d: Discovery, keep=None) -> DataFrame:
    """The ranked path types of up to max_hop edges between the two node types. keep(name, df): what to do with each hop and ranking
    before it is used again and again, such as writing it as a table."""
    if d.max_target_pairs is not None:
        targets = take_n(targets, d.max_target_pairs, ["u_node_id", "v_node_id", "date"], d.seed)
    f, b = split(d.max_hop)
    forward, back = explore(u_seeds, edges, f, d.max_instance, None, d.seed, noted(keep, "u")), explore(v_seeds, edges, b, d.max_instance, None, d.seed, noted(keep, "v"))
    ends = (d.u_type, d.v_type, d.max_instance, d.seed)
    ranked = []
    both = keep("ends", ends_of(known, "known").join(ends_of(targets, "targets"), ["node_0_id", "date"], "full")) if keep and d.max_instance is not None else None
    for k in range(1, d.max_hop + 1):
        if keep is not None and d.max_instance is None:
            found = keep(f"found_{k}", bipath_parts(forward, back, k, d.max_instance, d.seed))
            ranked.append(rated(keep(f"counted_{k}", count_parts(found, targets, known, k, *ends)), k))
        elif keep is None:
            ranked.append(rank_types(bipaths(forward, back, k, d.max_instance, d.seed), targets, known, k, *ends))
        else:
            ranked.append(rated(keep(f"counted_{k}", count_met(forward, back, both, k, *ends, keep)), k))
    return union_types(ranked)
