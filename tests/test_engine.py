"""The engine's operators on hand-made tables: properties that SQL comparison does not show."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.operators import graph as G
from linkloom.operators import metrics as M
from linkloom.operators import table as T
from linkloom.operators.packing import pack_paths
from linkloom.operators.timewindows import FeatureSource, Stage, WindowSpec, map_windows
from linkloom.plans import publications as pub
from linkloom.plans.schema import GraphSchema
from linkloom.sources import tables as io

DAY = "2020-01-01"


def edges_of(spark, rows):
    return spark.createDataFrame([(u, v, ut, vt, e, DAY) for u, v, ut, vt, e in rows], "u_node_id long, v_node_id long, u_node_type int, v_node_type int, edge_type int, date string")


def brute_paths(rows, start, k):
    """All walks of k edges from (id, type) that use no edge twice; edges are the same if their ends are."""
    step = [(u, ut, v, vt, e, 0) for u, v, ut, vt, e in rows] + [(v, vt, u, ut, e, 1) for u, v, ut, vt, e in rows]
    out = [([start], [])]
    for _ in range(k):
        out = [([*n, (b, bt)], [*w, (key, e, side)]) for n, w in out for a, at, b, bt, e, side in step if (a, at) == n[-1] for key in [((a, at), (b, bt)) if side == 0 else ((b, bt), (a, at))] if key not in [x[0] for x in w]]
    return out


TINY = [(1, 1, 0, 1, 0), (1, 2, 0, 1, 0), (2, 1, 0, 1, 0), (2, 3, 0, 1, 0), (1, 1, 0, 2, 1), (2, 1, 0, 2, 1), (3, 1, 0, 2, 1), (3, 3, 0, 1, 0), (1, 2, 0, 0, 2)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_exploration_equals_brute_force(spark, k):
    e = G.outer_edges(edges_of(spark, TINY))
    got = G.explore(spark.createDataFrame([(1, DAY)], "id long, date string").transform(lambda d: G.seeds(d, 1, 0)), e, k)[k]
    assert Counter(tuple((r[f"node_{i}_id"], r[f"node_{i}_type"]) for i in range(k + 1)) for r in got.collect()) == Counter(tuple(n) for n, _ in brute_paths(TINY, (1, 1), k))


@pytest.mark.parametrize("k", [2, 3, 4])
def test_both_halves_make_all_paths(spark, k):
    e = G.outer_edges(edges_of(spark, TINY))
    seed = lambda i, t, s: G.seeds(spark.createDataFrame([(i, DAY)], "id long, date string"), t, s)
    f, b = G.split(k)
    u, v = G.explore(seed(1, 1, 0), e, f), G.explore(seed(3, 1, 1), e, b)
    got = G.meet(u[f], G.backward(v[b], k), k)
    want = [tuple(n) for n, _ in brute_paths(TINY, (1, 1), k) if n[-1] == (3, 1)]
    assert Counter(tuple((r[f"node_{i}_id"], r[f"node_{i}_type"]) for i in range(k + 1)) for r in got.collect()) == Counter(want)


def test_reverse_is_an_involution(spark):
    e = G.outer_edges(edges_of(spark, TINY))
    p = G.explore(G.seeds(spark.createDataFrame([(1, DAY)], "id long, date string"), 1, 0), e, 3)[3].drop("side")
    twice = G.reverse(G.reverse(p, 3, 3), 3, 3).select(*p.columns)
    assert Counter(map(tuple, twice.collect())) == Counter(map(tuple, p.collect()))


def test_caps_hold_and_repeat(spark):
    rows = [(1, i, 0, 1, 0) for i in range(50)]
    for n in (0, 49, 50, 51):
        a = G.outer_edges(edges_of(spark, rows), n).where("join_node_side = 0")
        assert a.count() == min(n, 50)
    pick = lambda seed: {r.add_node_id for r in G.outer_edges(edges_of(spark, rows), 10, seed).where("join_node_side = 0").collect()}
    assert pick(1) == pick(1) != pick(2)


def test_prefixes_from_the_far_end(spark):
    types = spark.createDataFrame([(2, 7, 8, 9, 0, 0, 1, 1, 2, 1)], "hop_k int, node_0_type int, node_1_type int, node_2_type int, edge_0_type int, edge_0_u int, edge_0_v int, edge_1_type int, edge_1_u int, edge_1_v int")
    assert [tuple(r) for r in G.v_prefixes(types, 1, 2).collect()] == [(9, 8, 1, 0, 1)]
    assert [tuple(r) for r in G.u_prefixes(types, 1).collect()] == [(7, 8, 0, 0, 1)]


def test_salted_join_loses_nothing(spark):
    left = spark.createDataFrame([(0, i) for i in range(500)] + [(k, 0) for k in range(1, 40)], "k int, x int")
    right = spark.createDataFrame([(k, y) for k in range(40) for y in range(2)], "k int, y int")
    assert Counter(map(tuple, T.salted_join(left, right, ["k"], 30).collect())) == Counter(map(tuple, left.join(right, "k").collect()))


def test_sampling_levels_agree(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id")
    one, two = (sorted(r.id for r in f(df, ["g"], 40, ["id"]).collect()) for f in (T.sample_per_group, T.sample_skewed))
    assert one == two and len(one) == 80


def test_row_numbers_are_dense(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    assert [(r.k, r.n) for r in T.row_numbers(df, "n", ["k"]).orderBy("k").collect()] == [(i, i) for i in range(101)]


def test_bad_input_raises(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    for f in (lambda: T.condition({"and": [], "or": []}), lambda: T.condition({"and": []}), lambda: T.fill_nulls(df, ["b"]), lambda: T.aggregate(df, ["a"], {"b": ["median"]}), lambda: T.join(df, df, ["a"]), lambda: T.select(df, []), lambda: GraphSchema.parse({"nodes": {}}), lambda: io.partition_instances(["a/b"], ["p"]), lambda: io.partition_instances(["a", "a"], ["p"]), lambda: io.partition_instances([["a", "b"]], ["p"])):
        with pytest.raises((ValueError, TypeError)):
            f()
    with pytest.raises(ValueError):
        GraphSchema.parse({"nodes": {"a": {"table": "a", "id_column": "i"}}, "edges": {"e": {"table": "t", "u_node": {"type": "a", "id_column": "u"}, "v_node": {"type": "zz", "id_column": "v"}}}})


def test_fill_and_assemble(spark):
    df = spark.createDataFrame([(1, None, None), (2, float("nan"), [1.0, 2.0]), (3, 4.0, [3.0, 4.0])], "k int, x double, v array<double>")
    out = T.fill_nulls(df, ["x", "v"], {"v": 2})
    assert [tuple(r) for r in out.orderBy("k").select("x", "v", "null_mark_of_x", "null_mark_of_v").collect()] == [(0.0, [0.0, 0.0], 0, 0), (0.0, [1.0, 2.0], 0, 1), (4.0, [3.0, 4.0], 1, 1)]
    assert [r.f for r in T.assemble(out, ["x", "v"], "f", ["k"], {"v": 2}).orderBy("k").collect()] == [[0.0, 0.0, 0.0], [0.0, 1.0, 2.0], [4.0, 3.0, 4.0]]


def test_windows_match_by_equality_unless_contained(spark):
    facts = spark.createDataFrame([("2019-12-01",), ("2019-12-15",), ("2020-01-01",)], "d string").select(F.to_date("d").alias("d"))
    spec = [WindowSpec("month", -1, 1, 1)]
    assert map_windows(facts, "d", [DAY], spec).count() == 1 and map_windows(facts, "d", [DAY], spec, contain=True).count() == 2
    leap = map_windows(spark.createDataFrame([("2020-01-31",), ("2020-01-29",)], "d string").select(F.to_date("d").alias("d")), "d", ["2020-02-29"], spec)
    assert [str(r.d) for r in leap.collect()] == ["2020-01-29"]


def test_feature_names_follow_the_configuration(spark):
    s = FeatureSource("x", (), (Stage(("k",), "pivot", {"v": ("sum", "max")}, True),), "d", (WindowSpec("month", -2, 2, 1),))
    assert s.features() == ["sum_v_w0", "sum_v_w1", "max_v_w0", "max_v_w1", "count_w0", "count_w1"] and [m["window"] for m in s.metadata()][:2] == ["month_-2_1", "month_-1_1"]
    facts = spark.createDataFrame([(1, "2019-12-01", 5.0)], "k int, d string, v double").withColumn("d", F.to_date("d"))
    assert tuple(s.build(facts, [DAY]).drop("snapshot").first()) == (1, 0.0, 5.0, 0.0, 5.0, 0.0, 1.0)


def test_packing_keeps_within_groups(spark):
    rows = [(1, t, k, n) for t in (0, 1, 2) for n, k in enumerate([1, 2, 3, 1, 2, 3, 1])]
    out = pack_paths(spark.createDataFrame(rows, "sample long, path_type int, hop_k int, path_no long"), 2, 10).collect()
    for key, g in itertools.groupby(sorted(out, key=lambda r: (r.path_type, r.path_group, r.offset)), key=lambda r: (r.path_type, r.path_group)):
        at = 3 if key[0] == 2 else 2
        for r in g:
            assert r.offset == at and r.path_group < 2
            at += r.token_len
        assert at <= 10


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.4, 0), (5, 0.3, 1), (6, 0.1, 0)], "id int, score double, label int")
    got = M.all_metrics(df, 2, "id")
    assert got["pr_auc"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3) and got["roc_auc"] == pytest.approx(6.5 / 9) and got["precision_at_k"] == 0.5
    assert M.recall_at_percent(df, 50, "id").first()[0] == pytest.approx(2 / 3)


def test_tables_resume_by_partition(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "x int, p string")
    m = io.Manifest(spark)
    assert m.missing(path, ["p"], [("a",), ("b",)]) == [("a",), ("b",)]
    io.write_table(df.where("p = 'a'"), path, partition_columns=["p"])
    m.complete(path, ["p"], [("a",)])
    assert m.missing(path, ["p"], [("a",), ("b",)]) == [("b",)]
    io.write_table(df.where("p = 'b'"), path, partition_columns=["p"])
    assert io.read_table(spark, path, partition_columns=["p"], instances=[("b",)]).count() == 2 and io.read_table(spark, path).count() == 3
    plan = io.read_table(spark, path, partition_columns=["p"], instances=[("b",)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan
    io.cleanup_table(spark, path, ["p"], [("a",)])
    assert io.read_table(spark, path).count() == 2
    io.Files(spark).write_json(f"{path}/_info.json", {"a": 1})
    assert io.Files(spark).read_json(f"{path}/_info.json") == {"a": 1}


def test_filters_reach_the_scan(spark):
    df = T.where_in(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), ["o_orderstatus"], [("F",)]).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderstatus" in plan.split("PushedFilters")[1] and "o_totalprice" not in plan


def test_publications_flatten(spark):
    work = ("W1", "t", "2020-01-15", "article", "en", [("first", ("A1", "n"), [("I1", "i")]), ("last", ("A2", "n"), [("I1", "i"), ("I2", "j")])], ["W2", "W2", None], (("S1", "s", "journal", True, None), False), [("T1", "x", 0.5), ("T2", "y", None)])
    bad = ("W9", "t", "not a date", None, None, None, None, None, None)
    w = pub.dated(spark.createDataFrame([work, bad], pub.SCHEMA))
    n = {k: f(w).count() for k, f in pub.TABLES.items()}
    assert n == {"works_basic": 2, "works_citation": 1, "works_author": 2, "works_institution": 2, "works_source": 1, "works_topic": 2, "author_institution": 3}
    assert str(w.where("work_id = 'W1'").first().date) == "2020-02-01" and w.where("work_id = 'W9'").first().date is None


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_paths_met_in_parts_equal_those_met_at_once(spark, k):
    e = G.outer_edges(edges_of(spark, TINY)).localCheckpoint()
    seed = lambda t, s: G.seeds(spark.createDataFrame([(i, DAY) for i in (1, 2, 3)], "id long, date string"), t, s)
    f, b = G.split(k)
    u, v = [p.localCheckpoint() for p in G.explore(seed(1, 0), e, f)], [p.localCheckpoint() for p in G.explore(seed(1, 1), e, b)]
    parts = [p.collect() for p in G.bipath_parts(u, v, k, 3, "s")]
    assert Counter(tuple(r) for rows in parts for r in rows) == Counter(map(tuple, G.bipaths(u, v, k, 3, "s").collect()))
    types = [{tuple(r[c] for c in G.type_columns(k)) for r in rows} for rows in parts]
    assert sum(map(len, types)) == len(set().union(*types))


def test_types_counted_in_parts_rank_as_at_once(spark, monkeypatch):
    e = G.outer_edges(edges_of(spark, TINY)).localCheckpoint()
    seed = lambda s: G.seeds(spark.createDataFrame([(i, DAY) for i in (1, 2, 3)], "id long, date string"), 1, s)
    pair = lambda rows: spark.createDataFrame([(u, v, DAY) for u, v in rows], "u_node_id long, v_node_id long, date string")
    targets, known, d = pair([(1, 3), (2, 1), (3, 2)]), pair([(1, 2), (3, 3)]), G.Discovery(1, 1, 4, 3, None, "s")
    monkeypatch.setattr(G, "PART_ROWS", 2)
    seen = {}
    keep = lambda name, df: seen.setdefault(name, len(df)) and df[0].sparkSession.createDataFrame([r for p in df for r in p.collect()], df[0].schema)
    by_parts = G.discover(seed(0), seed(1), e, targets, known, d, keep)
    assert seen["counted_4"] > 1 and seen["found_4"] > 1
    assert Counter(map(tuple, by_parts.collect())) == Counter(map(tuple, G.discover(seed(0), seed(1), e, targets, known, d).collect()))
