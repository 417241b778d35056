"""Distributed orders and ranks, skew, sessions, batches, streams and the scorer."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom import session
from linkloom.operators import metrics as M
from linkloom.operators import pairs as P
from linkloom.operators import scorer
from linkloom.operators import subgraph as S
from linkloom.operators import table as T
from linkloom.plans import pipeline as L
from linkloom.sources import batches as R
from linkloom.sources import tables as io
from linkloom.sources.files import Files
from linkloom.streaming import feed


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_over_ranges_of_any_keys(spark, parts):
    r = random.Random(1)
    rows = [("same" if i % 3 else f"k{r.randint(0, 30):03}", i, r.randint(-5, 9)) for i in range(500)] + [(None, 900, 1), ("", 901, 2)]
    df = spark.createDataFrame(rows, "a string, b long, x long").repartition(7)
    got = {x.b: (x.s, x.n) for x in T.row_numbers(T.running(df, ["a", "b"], {"s": F.col("x")}, parts), "n", ["a", "b"], parts).collect()}
    total = 0
    for n, (_, b, x) in enumerate(sorted(rows, key=lambda t: (t[0] is not None, t[0] or "", t[1]))):
        total += x
        assert got[b] == (total, n)
    dealt, _ = T.ranged(df, ["a", "b"], 40)
    assert max(x["count"] for x in dealt.groupBy("_part").count().collect()) < 100  # the frequent first key is split
    assert T.row_numbers(df.limit(0), "n", ["a"]).count() == 0


def test_ranks_by_hash_are_those_of_one_window(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 3)
    want = {r.id: r.n for r in P.numbered(df, ["g"], ["id"], "n", "s").collect()}
    one = T.top_per_group(df.withColumn("h", T.hash_order("s", "id")), ["g"], {"h": "asc"}, 7, ["id"])
    assert {r.id for r in one.collect()} == {i for i, n in want.items() if n < 7}
    assert sorted(n for i, n in want.items() if i % 3 == 1) == list(range(1000))


def test_many_rows_are_cut_off_as_few_are(spark, monkeypatch):
    df = spark.range(2000).withColumn("x", F.col("id") % 17)
    few = [{r.id for r in f.collect()} for f in (T.take_n(df, 300, ["id"], "q"), T.top_n(df, 300, ["x", "id"], ["x"]))]
    monkeypatch.setattr(T, "SMALL_ROWS", 10)
    many = [{r.id for r in f.collect()} for f in (T.take_n(df, 300, ["id"], "q"), T.top_n(df, 300, ["x", "id"], ["x"]))]
    assert few == many and len(few[0]) == len(few[1]) == 300 and T.top_n(df, 5000, ["id"]).count() == 2000


def test_metrics_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, round(r.random(), 3), int(r.random() < 0.3)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    above = [(sum((s > t) + (s == t) / 2 for _, t, m in rows if not m), 1) for _, s, label in rows if label]
    auc = sum(a for a, _ in above) / len(above) / sum(not m for *_, m in rows)
    assert M.roc_auc(df).first()[0] == pytest.approx(auc)
    got = M.all_metrics(df, 50, "id")
    best = sorted(rows, key=lambda x: (-x[1], x[0]))[:50]
    assert got["precision_at_k"] == got["top_k_accuracy"] == pytest.approx(sum(x[2] for x in best) / 50)
    assert M.top_k_accuracy(df.limit(3), 10, "id").first()[0] <= 0.3


def test_salts_split_keys_alike_each_time(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (None, 2)], "k long, x long")
    skewed = T.skewed_keys(df, ["k"], 100)
    salted = T.salt_skewed_keys(df, skewed, ["k"])
    assert [tuple(r) for r in skewed.collect()] == [(1, 5)] and salted.where("k = 1").select("salt").distinct().count() == 5
    assert Counter(map(tuple, salted.collect())) == Counter(map(tuple, T.salt_skewed_keys(df.repartition(9), skewed, ["k"]).collect()))
    capped = T.salt_skewed_keys(df, skewed, ["k"], 2)
    assert 100 < capped.where("k = 1").count() < 300 and capped.where("k = 2").count() == 1
    assert T.replicate_for_salts(df.where("x = 1"), skewed, ["k"]).count() == 6


def test_hints_only_for_small_sides(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(T.if_small(spark.range(10), 10)) and "broadcast" not in plan(T.if_small(spark.range(11), 10))


def test_nan_of_both_widths_is_filled(spark):
    df = spark.createDataFrame([(float("nan"), float("nan")), (1.0, None)], "a float, b double")
    assert [tuple(r) for r in T.fill_nulls(df, ["a", "b"], mark=False).collect()] == [(0.0, 0.0), (1.0, 0.0)]


def test_tasks_are_run_again_with_a_new_context(spark):
    made, tried = [], []

    def make():
        made.append(1)
        return session.EngineContext(spark)

    @session.timed
    def task(context, n):
        tried.append(context)
        if len(tried) < 3:
            raise RuntimeError("SparkContext was shut down")
        return context.spark.range(n).count()

    assert session.run_task(task, make, n=5) == 5 and len(made) == 3
    with pytest.raises(ValueError):
        session.run_task(lambda c: (_ for _ in ()).throw(ValueError("no")), make)
    with session.cached(spark.range(5)) as kept:
        assert kept.is_cached and kept.count() == 5
    assert not kept.is_cached
    assert session.reformat_times([["2020", "01"]], ["%Y", "%m"], ["%m/%Y"]) == [["01/2020"]]


def test_settings_follow_cores_and_input():
    assert session.settings("local", 4)["spark.sql.shuffle.partitions"] == "4" and session.settings("local", 4, 1 << 30)["spark.sql.shuffle.partitions"] == "16"
    assert session.settings("cluster", 1000, 100 << 40)["spark.sql.shuffle.partitions"] == str(100 << 14) and session.settings("cluster", 1000)["spark.sql.shuffle.partitions"] == "3000"
    with pytest.raises(ValueError):
        session.settings("moon")


def test_kept_tables_are_written_and_forgotten(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    kept, place = session.keeper(spark)("x", spark.range(3)), session.scratch(spark, "y")
    spark.range(2).write.parquet(place)
    assert kept.count() == 3 and place.startswith(base) and kept.inputFiles()[0].startswith(base)
    session.forget(spark)
    assert not Files(spark).exists(place) and not Files(spark).exists(kept.inputFiles()[0])


def test_shares_are_balanced_and_files_resume(spark, tmp_path):
    shares = R.balanced_shares([("a", 9), ("b", 5), ("c", 4), ("d", 1)], 2)
    assert shares == [["a", "d"], ["b", "c"]]
    spark.range(100).repartition(5).write.parquet(f"{tmp_path}/t")
    first = R.SequentialFiles(spark, f"{tmp_path}/t")
    seen = []
    for f, part in first:
        seen += [r.id for r in part.collect()]
        first.done(f)
        if len(seen) >= 40:
            break
    seen += [r.id for _, part in R.SequentialFiles(spark, f"{tmp_path}/t") for r in part.collect()]
    assert sorted(seen) == list(range(100))


def test_scaler_is_saved_and_numbered_files_hold_their_rows(spark, tmp_path):
    files = Files(spark)
    S.save_scaler(files, f"{tmp_path}/s.json", {"0_1": [(0.5, 2.0)], "1_0": [(None, None)]})
    assert S.load_scaler(files, f"{tmp_path}/s.json") == {"0_1": [(0.5, 2.0)], "1_0": [(None, None)]}
    df = spark.range(200).withColumn("p", F.col("id") % 2)
    stats = io.output_statistics(df, ["p"], {"id": 8}, 200)
    numbered = io.file_numbers(df, stats, ["id"], ["p"])
    n = stats.agg(F.sum("num_files")).first()[0]
    assert n == 10 and io.write_numbered(numbered, f"{tmp_path}/t", n, partition_columns=["p"], files_at_once=4) == 3
    got = spark.read.parquet(f"{tmp_path}/t").groupBy(F.input_file_name()).count().collect()
    assert Counter(r["count"] for r in got) == Counter(r["count"] for r in numbered.groupBy("file_no").count().collect())
    io.show_table(df, 1)


def test_streams_count_days_and_months(spark, tmp_path):
    rows = [(1, "2024-01-30 10:00:00"), (1, "2024-01-30 11:00:00"), (2, "2024-02-01 09:00:00"), (1, "2024-02-02 00:00:00"), (9, "2024-06-01 00:00:00")]
    spark.createDataFrame(rows, "k long, s string").select("k", F.to_timestamp("s").alias("t")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, t timestamp").parquet(f"{tmp_path}/in")
    daily = feed.daily_counts(stream, "t", ["k"])
    daily.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/daily").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/daily")
    assert {(r.k, str(r.day), r.facts) for r in done.collect()} == {(1, "2024-01-30", 2), (2, "2024-02-01", 1), (1, "2024-02-02", 1)}
    assert {(r.k, str(r.month), r.facts) for r in feed.monthly_counts(done, ["k"]).collect()} == {(1, "2024-01-01", 2), (2, "2024-02-01", 1), (1, "2024-02-01", 1)}


@pytest.mark.parametrize("kind", ["logistic", "trees"])
def test_scorer_learns_from_path_counts(spark, kind):
    pairs = spark.createDataFrame([(u, v, "d") for u in range(12) for v in range(12)], "u_node_id long, v_node_id long, date string")
    paths = spark.createDataFrame([(u, v, "d") for u in range(12) for v in range(12) if (u + v) % 2 for _ in range(3)], "node_0_id long, node_2_id long, date string")
    x = scorer.path_count_features(pairs, {2: paths}).withColumn("label", ((F.col("u_node_id") + F.col("v_node_id")) % 2).cast("double"))
    scored = scorer.score(scorer.train(x, ["paths_2"], kind), x)
    assert M.roc_auc(scored.withColumnRenamed("prediction", "score")).first()[0] == 1.0


def test_batches_of_pairs_resume(spark, tmp_path):
    pairs = spark.createDataFrame([(i, i + 1, "d") for i in range(30)], "u_node_id long, v_node_id long, date string")
    made = []
    make = lambda part: made.append(1) or part.withColumn("n", F.lit(1))
    steps = L.Steps(spark, f"file://{tmp_path}/b")
    assert L.subgraph_batches(steps, "rows", pairs.union(pairs), 3, make).count() == 30 and len(made) == 3
    assert L.subgraph_batches(steps, "rows", pairs, 3, make).count() == 30 and len(made) == 3


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


def test_parts_are_kept_one_by_one_and_leave_no_shuffle_files(spark):
    part = lambda n: spark.range(n).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = session.keeper(spark)("parts", [part(100), part(1000)])
    assert not shuffle_files(spark) - before
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, part(100).collect() + part(1000).collect()))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_caps_shuffle_no_whole_hash_and_count_repeated_rows_once(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") % 100).alias("x"))
    got = T.sample_per_group(df, ["g"], 20, ["x"], distinct=True)
    want = T.sample_per_group(df.distinct(), ["g"], 20, ["x"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 60
    plan = T.sample_per_group(df, ["g"], 20, ["x"], distinct=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_kept_hops_equal_those_made_at_once(spark):
    from linkloom.operators import graph as G
    from linkloom.plans import trade as X

    sf, seen = "/root/testdata/sf0.001", []
    edges = X.outer(spark, sf)
    parts = [r for p in X.outer_parts(spark, sf) for r in map(tuple, p.collect())]
    assert Counter(parts) == Counter(map(tuple, edges.collect()))
    kept = edges.localCheckpoint()
    start = X.part_seeds(spark, sf).localCheckpoint()
    whole = G.explore(start, kept, 2, 8, None, "s")[2]
    keep = session.keeper(spark)
    by_parts = G.explore(start, kept, 2, 8, None, "s", lambda h, df: seen.append(len(df)) or keep("hop", df))[2]
    assert Counter(map(tuple, by_parts.collect())) == Counter(map(tuple, whole.collect())) and seen == [1, 10]


def test_rows_of_pairs_in_parts_equal_those_made_at_once(spark, monkeypatch):
    from linkloom.plans.queries import QUERIES

    made, rows = [], lambda: Counter(map(tuple, QUERIES["x_pair_rows"](spark, "/root/testdata/sf0.001").collect()))
    whole = rows()
    monkeypatch.setattr(L, "parts_of", lambda df, n: made.append(n) or 3)
    assert rows() == whole and made


def test_types_are_ranked_without_rows_of_whole_paths(spark, monkeypatch):
    from linkloom.operators import graph as G
    from linkloom.plans import trade as X

    sf, seen = "/root/testdata/sf0.001", {}
    keep = session.keeper(spark)

    def noted(name, df):
        kept = keep(name, df)
        seen[name] = kept.columns
        return kept

    monkeypatch.setattr(X, "keeper", lambda s: noted)
    got = X.discovered(spark, sf, 3)
    d = G.Discovery(X.CUSTOMER, X.PART, 3, 2, None, "s")
    starts = X.customer_seeds(spark, sf).localCheckpoint(), X.part_seeds(spark, sf).localCheckpoint()
    ends = X.outer(spark, sf).localCheckpoint(), X.targets(spark, sf).localCheckpoint(), X.known(spark, sf).localCheckpoint()
    assert not [n for n, c in seen.items() if {"node_0_id", "node_3_id"} <= set(c)] and "lines" in seen and got.count()
    tight = lambda k: Counter(tuple(r[c] for c in (*G.type_columns(3), "tgt_pair_count", "all_pair_count")) for r in G.discover(*starts, *ends, d, k).collect())
    assert tight(keep) == tight(None)  # with caps of two, which cut most groups


def test_lists_of_ends_make_the_rows_of_pairs(spark):
    r = random.Random(3)
    fields = "hop_k int, node_type_array array<int>, node_id_array array<bigint>, edge_type_array array<int>, u_index_array array<int>, v_index_array array<int>"
    path = lambda: (r.randint(1, 2), [1], [r.randint(1, 9)], [0], [0], [1])
    pairs = spark.createDataFrame([(u, v, "d") for u in range(4) for v in range(3)], "u_node_id long, v_node_id long, date string")
    u, v = (spark.createDataFrame([(i % 3, "d", *path()) for i in range(12)], f"seed_id long, date string, {fields}") for _ in "uv")
    w = spark.createDataFrame([(1, 2, "d", *path()) for _ in range(3)], f"u_node_id long, v_node_id long, date string, {fields}")
    vectors = spark.createDataFrame([(k, i, [float(i)]) for k in ("0_1", "1_0") for i in range(6)], "element_key string, feat_id long, feat_vector array<double>")
    some = lambda n: {(r.randint(0, 2), r.choice(["0_1", "1_0"]), r.randint(0, 5)) for _ in range(n)}
    ue, ve = (spark.createDataFrame([(i, "d", k, f) for i, k, f in some(9)], f"{c} long, date string, element_key string, feat_id long") for c in ("u_node_id", "v_node_id"))
    we = spark.createDataFrame([(1, 2, "d", k, f) for _, k, f in some(4)], "u_node_id long, v_node_id long, date string, element_key string, feat_id long").distinct()
    types, key = ["0_1", "1_0"], ["u_node_id", "v_node_id"]
    near, far = (S.lists(p.withColumnRenamed("seed_id", c), e, vectors, [c], types) for p, e, c in ((u, ue, "u_node_id"), (v, ve, "v_node_id")))
    got = S.join_lists(pairs, near, far, S.lists(w, we, vectors, key, types), types)
    used = pairs.join(ue, ["u_node_id", "date"]).unionByName(pairs.join(ve, ["v_node_id", "date"])).unionByName(we)
    want = S.collect_pairs(pairs, u, v, w).join(S.collect_features(used, vectors, types), [*key, "date"], "left")
    rows = lambda df: {tuple(x[c] for c in key): [x[c] or 0 if c.endswith("count") else x[c] or [] for c in want.columns if c not in key] for x in df.collect()}
    assert rows(got) == rows(want) and len(rows(got)) == 12
