"""The engine's own queries over the example tables, each with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.functions.columns import lookup, month_after, null_marks, one_hot, split_label, strip_prefix
from linkloom.operators import graph as G
from linkloom.operators import metrics as M
from linkloom.operators import packing as K
from linkloom.operators import pairs as P
from linkloom.operators import subgraph as S
from linkloom.operators import table as T
from linkloom.operators.timewindows import Stage, WindowSpec, build_element, map_static, map_windows, run_stages, time_map
from linkloom.plans import oracle as O
from linkloom.plans import trade as X
from linkloom.session import keeper
from linkloom.sources.tables import output_statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = O.DAY


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _r(*columns: str, digits: int = 4) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


# --- projection and filters -------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def op_select_pattern(s, d):
    return T.select(X.read(s, d, "customer"), ["c_custkey", {"pattern": "nation"}, {"pattern": "^c_acct", "regex": True}])


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def op_select_exclude(s, d):
    return T.select(X.read(s, d, "part"), [{"exclude": ["p_name", "p_type"]}])


@query("SELECT DISTINCT upper(o_orderstatus) AS status, year(o_orderdate) AS y FROM orders")
def op_select_expr(s, d):
    return T.select(X.read(s, d, "orders"), [{"expr": "upper(o_orderstatus)", "alias": "status"}, {"expr": "year(o_orderdate)", "alias": "y"}], distinct=True)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND (l_returnflag = 'R' OR l_discount < 0.02)")
def op_filter_tree(s, d):
    return T.where(X.read(s, d, "lineitem"), {"and": ["l_quantity > 30", {"or": ["l_returnflag = 'R'", "l_discount < 0.02"]}]}).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'), ('P', '2-HIGH'))")
def op_filter_tuples(s, d):
    return T.where_in(X.read(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], [("F", "1-URGENT"), ("O", "5-LOW"), ("P", "2-HIGH")]).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus_is_f, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_is_o FROM orders")
def op_one_hot(s, d):
    return X.read(s, d, "orders").select("o_orderkey", *one_hot("o_orderstatus", ["F", "O"]))


@query("SELECT event_id, coalesce(nullif(user_id, 7), 0) AS u, CAST(nullif(user_id, 7) IS NULL AS INTEGER) AS u_is_null FROM events")
def op_null_mark(s, d):
    return X.read(s, d, "events").select("event_id", F.nullif("user_id", F.lit(7)).alias("u")).select("event_id", *null_marks(["u"]))


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS url FROM pages")
def op_regex_strip(s, d):
    return strip_prefix(X.read(s, d, "pages").select("page_id", "url"), ["url"], "https?://")


_CASE = " ".join(f"WHEN CAST(o_orderdate AS DATE) >= DATE '{a}' AND CAST(o_orderdate AS DATE) < DATE '{b}' THEN '{n}'" for n, (a, b) in X.RANGES.items())


@query(f"SELECT * FROM (SELECT o_orderkey, CASE {_CASE} END AS sample_type FROM orders) WHERE sample_type IS NOT NULL")
def op_case_split(s, d):
    return X.read(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")).select("o_orderkey", split_label("day", X.RANGES).alias("sample_type")).where("sample_type is not null")


@query("SELECT c.c_custkey AS customer_id, c_nationkey FROM customer c")
def op_rename_ids(s, d):
    return T.rename_ids(X.read(s, d, "customer").select("c_custkey", F.col("c_name").alias("customer_id"), "c_nationkey"), [{"original": "c_custkey", "alias": "customer_id"}])


@query("SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, 0) AS v, CASE WHEN value > 50 THEN 1 ELSE 0 END AS null_mark_of_v FROM events")
def op_fill_nulls(s, d):
    return T.fill_nulls(X.read(s, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v")), ["v"])


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS f0, p_retailprice AS f1 FROM part")
def op_assemble(s, d):
    return T.assemble(X.read(s, d, "part"), ["p_size", "p_retailprice"], "x", ["p_partkey"]).select("p_partkey", F.col("x")[0].alias("f0"), F.col("x")[1].alias("f1"))


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS row_num FROM part")
def row_ids(s, d):
    return T.row_numbers(X.read(s, d, "part").select("p_partkey", "p_size"), "row_num", ["p_size", "p_partkey"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'pointer' WHEN 'view' THEN 'screen' END AS kind FROM events")
def op_lookup(s, d):
    codes = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(9)
    return X.read(s, d, "events").select("event_id", codes.alias("c")).select("event_id", lookup("c", {0: "pointer", 1: "screen"}).alias("kind"))


@query(f"SELECT o_orderkey, {O.month_after('o_orderdate')} AS date FROM orders")
def op_month_after(s, d):
    return X.read(s, d, "orders").select("o_orderkey", month_after("o_orderdate").alias("date"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(s, d):
    return T.join(X.read(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), X.read(s, d, "nation"), ["n_nationkey"]).select("c_custkey", "n_name")


@query("SELECT p_partkey, l_orderkey FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) ON p_partkey = l_partkey")
def join_left(s, d):
    return T.join(X.read(s, d, "part").select("p_partkey"), X.read(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey"), ["p_partkey"], "left")


@query("SELECT coalesce(a.k, b.k) AS k, n_customers, n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON a.k = b.k")
def join_outer_merge(s, d):
    a = X.read(s, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = X.read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return T.outer_merge([a, b], ["k"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(s, d):
    return T.join(X.read(s, d, "customer").select("c_custkey"), X.read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "semi")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)")
def join_anti(s, d):
    return T.join(X.read(s, d, "part").select("p_partkey"), X.read(s, d, "lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"], "anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(s, d):
    return T.join(X.read(s, d, "nation").select("n_name"), X.read(s, d, "region").select("r_name"), [], "cross", "right")


@query(f"WITH {O.ORD}, {O.ACTIVE} SELECT id, date FROM active")
def join_theta_dates(s, d):
    return X.active_customers(s, d, ["1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01"])


@query("SELECT DISTINCT a.l_suppkey AS u_node_id, b.l_suppkey AS v_node_id, a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey")
def join_self_pairs(s, d):
    return P.shared_pairs(X.read(s, d, "lineitem"), "l_suppkey", ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(s, d):
    return T.salted_join(X.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey")), X.read(s, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], 50).drop("s_suppkey")


# --- aggregation ------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(l_tax) AS count_l_tax, round(avg(l_tax), 4) AS mean_l_tax, round(sum(l_quantity), 4) AS sum_l_quantity, max(l_quantity) AS max_l_quantity, min(l_quantity) AS min_l_quantity, round(stddev_samp(l_quantity), 4) AS stddev_l_quantity, round(var_samp(l_quantity), 4) AS variance_l_quantity FROM lineitem GROUP BY 1")
def agg_functions(s, d):
    return T.aggregate(X.read(s, d, "lineitem"), ["l_returnflag"], {"l_tax": ["count", "mean"], "l_quantity": ["sum", "max", "min", "stddev", "variance"]}).select("l_returnflag", "count_l_tax", "max_l_quantity", "min_l_quantity", *_r("mean_l_tax", "sum_l_quantity", "stddev_l_quantity", "variance_l_quantity"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def agg_distinct_fallback(s, d):
    return T.aggregate(X.read(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT o_custkey, " + ", ".join(f"round(sum(CASE WHEN o_orderstatus = '{v}' THEN o_totalprice END), 2) AS sum_o_totalprice_{v}" for v in "FOP") + ", " + ", ".join(f"count(CASE WHEN o_orderstatus = '{v}' THEN 1 END) AS count_{v}" for v in "FOP") + " FROM orders GROUP BY 1")
def agg_pivot(s, d):
    out = T.aggregate(X.read(s, d, "orders"), ["o_custkey"], {"o_totalprice": ["sum"]}, ("o_orderstatus", ["F", "O", "P"]), True)
    return out.select("o_custkey", *_r(*[f"sum_o_totalprice_{v}" for v in "FOP"], digits=2), *[f"count_{v}" for v in "FOP"])


_SPECS = [WindowSpec("month", -36, 3, 12)]
_WIN = f"SELECT o_custkey, o_totalprice, CASE WHEN date >= DATE '1999-01-01' THEN 2 WHEN date >= DATE '1998-01-01' THEN 1 ELSE 0 END AS w FROM ord WHERE date >= DATE '1997-01-01' AND date < {DAY}"


def _mapped(s, d):
    return map_windows(X.orders(s, d), "date", [X.SNAPSHOT], _SPECS)


_IDS = [w[0] for w in _SPECS[0].windows()]


@query(f"WITH {O.ORD} SELECT o_custkey, {DAY} AS snapshot, round(sum(o_totalprice), 2) AS sum_o_totalprice, count(*) AS count FROM ({_WIN}) GROUP BY 1")
def agg_pipeline_drop(s, d):
    return run_stages(_mapped(s, d), [Stage(("o_custkey",), "drop", {"o_totalprice": ("sum",)}, True)], _IDS).select("o_custkey", "snapshot", *_r("sum_o_totalprice", digits=2), "count")


@query(f"WITH {O.ORD} SELECT o_custkey, {DAY} AS snapshot, CASE w WHEN 0 THEN '{_IDS[0]}' WHEN 1 THEN '{_IDS[1]}' ELSE '{_IDS[2]}' END AS window_id, max(o_totalprice) AS max_o_totalprice FROM ({_WIN}) GROUP BY 1, 3")
def agg_pipeline_keep(s, d):
    return run_stages(_mapped(s, d), [Stage(("o_custkey",), "keep", {"o_totalprice": ("max",)})], _IDS)


_PIVOT_SQL = ", ".join([f"coalesce(round(sum(CASE WHEN w = {i} THEN o_totalprice END), 2), 0) AS sum_o_totalprice_w{i}, coalesce(max(CASE WHEN w = {i} THEN o_totalprice END), 0) AS max_o_totalprice_w{i}, CAST(count(CASE WHEN w = {i} THEN 1 END) AS DOUBLE) AS count_w{i}" for i in range(3)])


@query(f"WITH {O.ORD} SELECT o_custkey AS c_custkey, {DAY} AS snapshot, {_PIVOT_SQL} FROM ({_WIN}) GROUP BY 1")
def agg_pipeline_pivot(s, d):
    out = X.SPENDING.build(X.orders(s, d), [X.SNAPSHOT])
    return out.select("c_custkey", "snapshot", *[F.round(c, 2).alias(c) if c.startswith("sum") else F.col(c) for c in X.SPENDING.features()])


@query("SELECT o_custkey, o_orderstatus, count(*) AS count FROM orders GROUP BY 1, 2")
def agg_group_count(s, d):
    return T.aggregate(X.read(s, d, "orders"), ["o_custkey", "o_orderstatus"], group_count=True)


@query("WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM part) SELECT p_partkey, round((p_size - lo) / (hi - lo), 6) AS p_size, round((p_retailprice - l2) / (h2 - l2), 6) AS p_retailprice, 0.5::DOUBLE AS one FROM part, b")
def agg_minmax_scale(s, d):
    part = X.read(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.lit(1.0).alias("one"))
    return T.minmax_scale(part, T.minmax_fit(part, ["p_size", "p_retailprice", "one"])).select("p_partkey", *_r("p_size", "p_retailprice", digits=6), "one")


@query("SELECT CAST(month(ts) AS INTEGER) AS m, count(*) AS row_count, CAST(count(event_id) * 8 + count(value) * 8 AS BIGINT) AS size_bytes, CAST(floor((count(event_id) * 8 + count(value) * 8) / 4096) + 1 AS INTEGER) AS num_files FROM events GROUP BY 1")
def io_output_statistics(s, d):
    return output_statistics(X.read(s, d, "events").select("event_id", "value", F.month("ts").alias("m")), ["m"], file_bytes=4096)


# --- samples and order ------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(concat_ws(':', '1', l_orderkey, l_linenumber, l_partkey))) <= 7")
def sample_hash_n(s, d):
    return T.sample_per_group(X.read(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct(), ["l_suppkey"], 7, ["l_orderkey", "l_linenumber", "l_partkey"], 1)


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws(':', '2', l_orderkey, l_linenumber, l_partkey))) <= 100")
def sample_skewed_n(s, d):
    return T.sample_skewed(X.read(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey").distinct(), ["l_returnflag"], 100, ["l_orderkey", "l_linenumber", "l_partkey"], 8, 2)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, md5(concat_ws(':', '0', c_custkey))) <= 3")
def topn_ordered(s, d):
    return T.top_per_group(X.read(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], {"c_acctbal": "desc"}, 3, ["c_custkey"])


@query("SELECT p_partkey FROM part WHERE CAST(concat('0x', substr(md5(concat_ws(':', '3', p_partkey)), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.3")
def sample_fraction(s, d):
    return T.sample_fraction(X.read(s, d, "part").select("p_partkey"), 0.3, ["p_partkey"], 3)


@query("SELECT c_custkey FROM customer ORDER BY md5(concat_ws(':', '4', c_custkey)), c_custkey LIMIT 40")
def sample_exact(s, d):
    return T.take_n(X.read(s, d, "customer").select("c_custkey"), 40, ["c_custkey"], 4)


@query(f"WITH {O.LIN} SELECT o_custkey AS u_node_id, l_partkey AS v_node_id, min(date) AS first_date FROM lin GROUP BY 1, 2")
def first_event(s, d):
    return X.first_purchases(s, d)


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws(':', '0', o_orderkey)), o_orderkey) - 1 AS INTEGER) AS path_no FROM orders")
def path_numbers(s, d):
    return P.numbered(X.read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "path_no").select("o_orderkey", "path_no")


# --- time windows and elements ----------------------------------------------------------------------------------------


@query("SELECT DATE '2000-01-01' AS snapshot, CAST(DATE '2000-01-01' + (o + k) * INTERVAL 1 MONTH AS DATE) AS mapped_date, concat('month_', o, '_12') AS window_id FROM (SELECT unnest([-36, -24, -12]) AS o), (SELECT unnest(range(12)) AS k)")
def tw_map(s, d):
    return time_map(s, [X.SNAPSHOT], _SPECS)


@query(f"WITH {O.ORD}, w AS (SELECT unnest([-12, -6, -12]) AS o, unnest([6, 6, 12]) AS n) SELECT concat('month_', o, '_', n) AS window_id, count(*) AS count FROM ord JOIN w ON date >= {DAY} + o * INTERVAL 1 MONTH AND date < {DAY} + (o + n) * INTERVAL 1 MONTH GROUP BY 1")
def tw_overlap(s, d):
    return map_windows(X.orders(s, d), "date", [X.SNAPSHOT], [WindowSpec("month", -12, 2, 6), WindowSpec("month", -12, 1, 12)]).groupBy("window_id").agg(F.count(F.lit(1)).alias("count"))


@query(f"SELECT n_nationkey, x.snapshot, 'static' AS window_id FROM nation, (SELECT unnest([DATE '1999-01-01', {DAY}]) AS snapshot) x")
def tw_static_replicate(s, d):
    return map_static(X.read(s, d, "nation").select("n_nationkey"), ["1999-01-01", X.SNAPSHOT])


@query(f"WITH {O.ORD} SELECT o_orderkey, {DAY} AS snapshot, concat('year_', year(date) - 2000, '_1') AS window_id FROM ord WHERE month(date) = 1 AND day(date) = 1 AND year(date) BETWEEN 1997 AND 1999")
def tw_year_unit(s, d):
    return map_windows(X.orders(s, d), "date", [X.SNAPSHOT], [WindowSpec("year", -3, 3, 1)]).select("o_orderkey", "snapshot", "window_id")


@query("SELECT event_id, DATE '2024-01-20' AS snapshot, concat('day_', -7 * (1 + (date_diff('day', CAST(ts AS DATE), DATE '2024-01-19') // 7)), '_7') AS window_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-06' AND DATE '2024-01-19'")
def tw_day_unit(s, d):
    return map_windows(X.read(s, d, "events").withColumn("day", F.col("ts").cast("date")), "day", ["2024-01-20"], [WindowSpec("day", -14, 2, 7)]).select("event_id", "snapshot", "window_id")


@query(f"SELECT o_orderkey, {DAY} AS snapshot, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1999-01-01' THEN 'month_-12_12' ELSE 'month_-24_12' END AS window_id FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND CAST(o_orderdate AS DATE) < {DAY}")
def tw_containment(s, d):
    return map_windows(X.read(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")), "day", [X.SNAPSHOT], [WindowSpec("month", -24, 2, 12)], contain=True).select("o_orderkey", "snapshot", "window_id")


_BASKET = f"""bas AS (SELECT o_custkey, w, l_partkey, sum(l_quantity) AS q FROM (SELECT *, CASE WHEN date >= DATE '1999-01-01' THEN 1 ELSE 0 END AS w FROM lin WHERE date >= DATE '1998-01-01' AND date < {DAY}) GROUP BY ALL)"""


@query(f"WITH {O.LIN}, {_BASKET} SELECT o_custkey AS c_custkey, {DAY} AS snapshot, " + ", ".join(f"coalesce(round(avg(CASE WHEN w = {i} THEN q END), 4), 0) AS mean_w{i}, coalesce(max(CASE WHEN w = {i} THEN q END), 0) AS max_w{i}, CAST(count(CASE WHEN w = {i} THEN 1 END) AS DOUBLE) AS parts_w{i}" for i in range(2)) + " FROM bas GROUP BY 1")
def tw_features(s, d):
    out = X.BASKETS.build(X.lines(s, d), [X.SNAPSHOT])
    return out.select("c_custkey", "snapshot", *[c for i in range(2) for c in (F.round(f"mean_sum_l_quantity_w{i}", 4).alias(f"mean_w{i}"), F.col(f"max_sum_l_quantity_w{i}").alias(f"max_w{i}"), F.col(f"count_w{i}").alias(f"parts_w{i}"))])


def _element(s, d):
    return build_element(["c_custkey"], [(X.SPENDING, X.orders(s, d)), (X.BASKETS, X.lines(s, d))], [X.SNAPSHOT])


@query(f"""WITH {O.LIN}, {_BASKET}, sp AS (SELECT o_custkey AS k, {", ".join(f"sum(CASE WHEN w = {i} THEN o_totalprice END) AS s{i}" for i in range(3))} FROM ({_WIN}) GROUP BY 1), ba AS (SELECT o_custkey AS k, max(CASE WHEN w = 1 THEN q END) AS m FROM bas GROUP BY 1)
SELECT coalesce(sp.k, ba.k) AS c_custkey, {DAY} AS snapshot, round(coalesce(s0, 0), 2) AS f0, round(coalesce(s2, 0), 2) AS f2, coalesce(m, 0) AS f12, CAST(17 AS INTEGER) AS n FROM sp FULL JOIN ba ON sp.k = ba.k""")
def el_merge_sources(s, d):
    out, meta = _element(s, d)
    at = {m["source"] + m["name"]: m["index"] for m in meta}
    v = F.col("feat_vector")
    return out.select("c_custkey", "snapshot", F.round(v[at["spendingsum_o_totalprice_w0"]], 2).alias("f0"), F.round(v[at["spendingsum_o_totalprice_w2"]], 2).alias("f2"), v[at["basketsmax_sum_l_quantity_w1"]].alias("f12"), F.size(v).alias("n"))


@query(f"WITH {O.ORD} SELECT o_custkey AS c_custkey, {DAY} AS snapshot, i, round(v, 2) AS v FROM (SELECT o_custkey, unnest(range(3)) AS i, unnest([" + ", ".join(f"coalesce(sum(CASE WHEN w = {i} THEN o_totalprice END), 0)" for i in range(3)) + f"]) AS v FROM ({_WIN}) GROUP BY 1)")
def el_node_features(s, d):
    out, _ = build_element(["c_custkey"], [(X.SPENDING, X.orders(s, d))], [X.SNAPSHOT])
    return out.select("c_custkey", "snapshot", F.posexplode(F.slice("feat_vector", 1, 3)).alias("i", "v")).select("c_custkey", "snapshot", F.col("i").cast("long").alias("i"), F.round("v", 2).alias("v"))


@query(f"WITH {O.LIN} SELECT DISTINCT o_orderkey, l_partkey, {DAY} AS snapshot FROM lin WHERE date >= DATE '1970-01-01' AND date < {DAY}")
def el_edge_dedup(s, d):
    from linkloom.operators.timewindows import FeatureSource

    source = FeatureSource("pairs", (), (Stage(("o_orderkey", "l_partkey")),), "date", (WindowSpec("month", -360, 1, 360),))
    return build_element(["o_orderkey", "l_partkey"], [(source, X.lines(s, d))], [X.SNAPSHOT])[0].drop("feat_vector")


# --- graph ------------------------------------------------------------------------------------------------------------


@query(O.select(O.INNER, "SELECT * FROM inner_e"))
def g_inner_edges(s, d):
    return X.inner(s, d).select(F.col("u_node_id").cast("long").alias("u_node_id"), F.col("v_node_id").cast("long").alias("v_node_id"), "u_node_type", "v_node_type", "edge_type", "date")


@query(O.select(O.OUTER, "SELECT * FROM outer_e"))
def g_outer_edges(s, d):
    return X.outer(s, d)


@query(O.select(f"{O.LIN},\n{O.SEEDS}", "SELECT * FROM u0 UNION ALL SELECT * FROM v0"))
def g_seeds(s, d):
    return X.customer_seeds(s, d).union(X.part_seeds(s, d))


def _walk(s, d, u: int, v: int):
    keep = keeper(s)
    e = keep("edges", X.outer_parts(s, d))
    return G.explore(X.customer_seeds(s, d), e, u, X.MAX_INSTANCE, None, X.SEED, G.noted(keep, "u")), G.explore(X.part_seeds(s, d), e, v, X.MAX_INSTANCE, None, X.SEED, G.noted(keep, "v"))


@query(O.select(O.explored(1, 1), "SELECT * FROM u1 UNION ALL SELECT * FROM v1"))
def g_hop1(s, d):
    u, v = _walk(s, d, 1, 1)
    return u[1].union(v[1])


@query(O.select(O.explored(2, 2), "SELECT * FROM u2 UNION ALL SELECT * FROM v2"))
def g_hop2(s, d):
    u, v = _walk(s, d, 2, 2)
    return u[2].union(v[2])


@query(O.select(O.explored(0, 2) + ",\n" + O.back(4), "SELECT * FROM vback4"))
def g_reverse(s, d):
    return G.backward(_walk(s, d, 0, 2)[1][2], 4, X.MAX_INSTANCE, X.SEED)


def _meet(k: int):
    f, b = G.split(k)

    @query(O.select(O.explored(f, b) + f",\n{O.back(k)},\n{O.met(k)},\n{O.bip(k)}", f"SELECT * FROM bip{k}"))
    def found(s, d):
        u, v = _walk(s, d, f, b)
        return keeper(s)(f"met_{k}", G.bipath_parts(u, v, k, X.MAX_INSTANCE, X.SEED))

    QUERIES[f"g_meet_k{k}"], ORACLES[f"g_meet_k{k}"] = QUERIES.pop("found"), ORACLES.pop("found")


for _k in (2, 3, 4):
    _meet(_k)


@query(O.select(O.ranking(4), "SELECT * EXCLUDE (tgt_pair_percent), round(tgt_pair_percent, 8) AS tgt_pair_percent FROM ranked"))
def g_rank_types(s, d):
    out = X.discovered(s, d)
    return out.withColumn("tgt_pair_percent", F.round("tgt_pair_percent", 8))


_NAME = "CASE {c} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in X.SCHEMA.node_names().items()) + " END"


@query(O.select(O.ranking(3), "SELECT hop_k, all_pair_count, " + ", ".join(f"{_NAME.format(c=f'node_{i}_type')} AS node_{i}_name" for i in range(4)) + " FROM ranked"))
def g_type_names(s, d):
    out = X.discovered(s, d, 3)
    return out.select("hop_k", "all_pair_count", *[lookup(f"node_{i}_type", X.SCHEMA.node_names()).alias(f"node_{i}_name") for i in range(4)])


_BEST = "best AS (SELECT * FROM ranked ORDER BY tgt_pair_percent DESC NULLS LAST, tgt_pair_count DESC, " + ", ".join(f"{c} NULLS FIRST" for c in O.types(4)) + " LIMIT 3)"


def _best(s, d):
    return G.top_types(X.discovered(s, d), 4, 3)


@query(O.select(f"{O.ranking(4)},\n{_BEST}", "SELECT hop_k, tgt_pair_count, all_pair_count, node_1_type, node_2_type, node_3_type FROM best"))
def topk_types(s, d):
    return _best(s, d).select("hop_k", "tgt_pair_count", "all_pair_count", "node_1_type", "node_2_type", "node_3_type")


# --- candidates -------------------------------------------------------------------------------------------------------


def _fixed_types(s) -> DataFrame:
    """Two path types: customer-order-supplier-part and customer-order-part-order-part."""
    rows = [(3, 1, 0, 3, 2, None, 0, 1, 0, 2, 1, 2, 3, 3, 2, None, None, None), (4, 1, 0, 2, 0, 2, 0, 1, 0, 1, 1, 2, 1, 3, 2, 1, 3, 4)]
    return s.createDataFrame(rows, "hop_k int, " + ", ".join(f"{c} int" for c in G.type_columns(4)))


_FIXED = "fixed AS (SELECT * FROM (VALUES (3, 1, 0, 3, 2, NULL, 0, 1, 0, 2, 1, 2, 3, 3, 2, NULL, NULL, NULL), (4, 1, 0, 2, 0, 2, 0, 1, 0, 1, 1, 2, 1, 3, 2, 1, 3, 4)) t(hop_k, " + ", ".join(O.types(4)) + "))"
_UPRE = "".join(f",\nupre{h} AS (SELECT DISTINCT {', '.join(O.types(h))} FROM fixed WHERE hop_k >= {2 * h - 1})" for h in (1, 2))


def _vpre(h: int) -> str:
    def at(name: str, place) -> str:
        return "CASE hop_k " + " ".join(f"WHEN {k} THEN {place(k)}" for k in range(2 * h, 5)) + f" END AS {name}"

    cols = [at(f"node_{i}_type", lambda k, i=i: f"node_{k - i}_type") for i in range(h + 1)]
    cols += [c for i in range(h) for c in (at(f"edge_{i}_type", lambda k, i=i: f"edge_{k - 1 - i}_type"), at(f"edge_{i}_u", lambda k, i=i: f"{k} - edge_{k - 1 - i}_u"), at(f"edge_{i}_v", lambda k, i=i: f"{k} - edge_{k - 1 - i}_v"))]
    return f",\nvpre{h} AS (SELECT DISTINCT {', '.join(cols)} FROM fixed WHERE hop_k >= {2 * h})"


_TYPED = f"{_FIXED}{_UPRE}{_vpre(1)}{_vpre(2)}"
_TYPED_WALK = ",\n".join([O.OUTER, O.SEEDS, _TYPED, O.hop("u", 1, "upre1"), O.hop("u", 2, "upre2"), O.hop("v", 1, "vpre1"), O.hop("v", 2, "vpre2")])
_CAND = ",\n".join([_TYPED_WALK, *[x for k in (3, 4) for x in (O.back(k), O.met(k, restrict="fixed"), O.bip(k), O.left_over(k))], "cand AS (SELECT DISTINCT u_node_id, v_node_id, date FROM (SELECT node_0_id AS u_node_id, node_3_id AS v_node_id, date FROM new3 UNION ALL SELECT node_0_id, node_4_id, date FROM new4))"])


@query(f"WITH {_FIXED}{_UPRE} SELECT * FROM upre2")
def c_type_prefix_u(s, d):
    return G.u_prefixes(_fixed_types(s), 2)


@query(f"WITH {_FIXED}{_vpre(2)} SELECT * FROM vpre2")
def c_type_prefix_v(s, d):
    return G.v_prefixes(_fixed_types(s), 2, 4)


def _candidates(s, d):
    """Edges and hops are used several times, so they are kept."""
    keep = keeper(s)
    return G.candidate_pairs(X.customer_seeds(s, d), X.part_seeds(s, d), keep("edges", X.outer_parts(s, d)), _fixed_types(s), 4, X.known(s, d), X.CUSTOMER, X.PART, X.MAX_INSTANCE, X.SEED, [3, 4], keep)


@query(f"WITH {_CAND} SELECT * FROM cand")
def c_pairs(s, d):
    return _candidates(s, d)


@query(O.select(f"{O.LIN},\n{O.KNOWN}", "SELECT * FROM known_all"))
def c_known_edges(s, d):
    return P.known_edges(X.first_purchases(s, d), X.RANGES, X.active_customers(s, d, ["1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01"]))


@query(O.select(f"{O.LIN},\n{O.KNOWN}", "SELECT * FROM exist"))
def c_exist_edges(s, d):
    return X.known(s, d)


@query(f"WITH {O.ORD}, {O.ACTIVE} SELECT id, date FROM active WHERE date = {DAY}")
def c_active(s, d):
    return X.active_customers(s, d)


# --- samples ----------------------------------------------------------------------------------------------------------

_POS = f"{_CAND},\npos AS (SELECT * FROM cand SEMI JOIN targets USING (u_node_id, v_node_id, date)),\nneg AS (SELECT * FROM cand ANTI JOIN targets USING (u_node_id, v_node_id, date))"
_LAB = _POS + ",\nlab AS (" + " UNION ALL ".join(f"SELECT *, 1 AS label, {r}::DOUBLE AS neg_ratio FROM pos UNION ALL SELECT *, 0, {r}::DOUBLE FROM (SELECT * FROM neg ORDER BY md5(concat_ws(':', 's/{r}', u_node_id, v_node_id, date)), u_node_id, v_node_id LIMIT {r} * (SELECT count(*) FROM pos))" for r in (1, 3)) + ")"


def _labelled(s, d):
    return P.labelled(keeper(s)("candidates", _candidates(s, d)), X.targets(s, d), [1, 3], None, X.SEED)


@query(f"WITH {_POS} SELECT * FROM pos")
def s_positive(s, d):
    return _labelled(s, d).where("neg_ratio = 1 and label = 1").select("u_node_id", "v_node_id", "date")


@query(f"WITH {_LAB} SELECT u_node_id, v_node_id, date FROM lab WHERE neg_ratio = 3 AND label = 0")
def s_negative(s, d):
    return _labelled(s, d).where("neg_ratio = 3 and label = 0").select("u_node_id", "v_node_id", "date")


@query(f"WITH {_LAB} SELECT neg_ratio, label, count(*) AS pair_count FROM lab GROUP BY 1, 2")
def s_labeled_ratios(s, d):
    return P.label_counts(_labelled(s, d))


def _bucket(n: int, seed: str, *c: str) -> str:
    return f"CAST(floor(CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', {', '.join(c)})), 1, 13)) AS BIGINT) / 4503599627370496.0 * {n}) AS INTEGER)"


@query(f"WITH {O.LIN},\n{O.KNOWN} SELECT u_node_id, v_node_id, date, {_bucket(3, 's/u', 'u_node_id')} * 2 + {_bucket(2, 's/v', 'v_node_id')} AS batch_id FROM targets")
def s_batches(s, d):
    return P.batches(X.targets(s, d).select("u_node_id", "v_node_id", "date"), 3, 2, X.SEED)


# --- subgraphs --------------------------------------------------------------------------------------------------------

_PAIRS_SQL = "pairs AS (SELECT u_node_id, v_node_id, date FROM targets)"
_PWALK = ",\n".join([
    O.OUTER, O.KNOWN, _TYPED, _PAIRS_SQL,
    f"u0 AS (SELECT DISTINCT u_node_id AS node_0_id, {X.CUSTOMER} AS node_0_type, 0 AS side, date FROM pairs)", f"v0 AS (SELECT DISTINCT v_node_id AS node_0_id, {X.PART} AS node_0_type, 1 AS side, date FROM pairs)",
    O.hop("u", 1, "upre1"), O.hop("u", 2, "upre2"), O.hop("v", 1, "vpre1"), O.hop("v", 2, "vpre2"), *[x for k in (3, 4) for x in (O.back(k), O.met(k, restrict="fixed", pairs="pairs"))],
])


def _pairs(s, d):
    return X.targets(s, d).select("u_node_id", "v_node_id", "date")


def _pair_walk(s, d):
    """The pairs' walks, each hop kept."""
    keep = keeper(s)
    return G.pair_walks(_pairs(s, d), keep("edges", X.outer_parts(s, d)), _fixed_types(s), 4, X.CUSTOMER, X.PART, X.MAX_INSTANCE, X.SEED, keep)


@query(f"WITH {_PWALK} SELECT node_0_id AS u_node_id, node_3_id AS v_node_id, 3 AS hop_k, node_1_id AS m1, node_2_id AS m2, CAST(NULL AS BIGINT) AS m3 FROM met3 UNION ALL SELECT node_0_id, node_4_id, 4, node_1_id, node_2_id, node_3_id FROM met4")
def x_pair_bipaths(s, d):
    keep = keeper(s)
    found = G.pair_bipaths(_pairs(s, d), keep("edges", X.outer_parts(s, d)), _fixed_types(s), 4, X.CUSTOMER, X.PART, X.MAX_INSTANCE, X.SEED, keep)
    parts = [found[k].select(F.col("node_0_id").alias("u_node_id"), F.col(f"node_{k}_id").alias("v_node_id"), F.lit(k).alias("hop_k"), "node_1_id", "node_2_id", F.col("node_3_id") if k > 3 else F.lit(None).cast("long")) for k in (3, 4)]
    return parts[0].union(parts[1]).toDF("u_node_id", "v_node_id", "hop_k", "m1", "m2", "m3")


_XN = "xn AS (" + " UNION ".join(f"SELECT node_{i}_type AS node_type, node_{i}_id AS node_id, date FROM {t}{h}" for t in "uv" for h in (1, 2) for i in range(h + 1)) + ")"


@query(f"WITH {_PWALK},\n{_XN} SELECT * FROM xn")
def x_unique_nodes(s, d):
    u, v = _pair_walk(s, d)
    return S.unique_elements({1: u[1].unionByName(v[1]), 2: u[2].unionByName(v[2])})[0]


def _xe(t: str, h: int, i: int) -> str:
    return f"SELECT edge_{i}_type AS edge_type, CASE WHEN edge_{i}_u = {i} THEN node_{i}_id ELSE node_{i + 1}_id END AS u_node_id, CASE WHEN edge_{i}_v = {i} THEN node_{i}_id ELSE node_{i + 1}_id END AS v_node_id, date FROM {t}{h}"


@query(f"WITH {_PWALK} " + " UNION ".join(_xe(t, h, i) for t in "uv" for h in (1, 2) for i in range(h)))
def x_unique_edges(s, d):
    u, v = _pair_walk(s, d)
    return S.unique_elements({1: u[1].unionByName(v[1]), 2: u[2].unionByName(v[2])})[1]


@query(f"WITH {_PWALK},\n{_XN} SELECT node_type, node_id, date, row_number() OVER (PARTITION BY node_type ORDER BY node_id, date) - 1 AS feat_id FROM xn")
def x_feat_ids(s, d):
    u, v = _pair_walk(s, d)
    return S.feature_ids(S.unique_elements({1: u[1].unionByName(v[1]), 2: u[2].unionByName(v[2])})[0], "node_type", ["node_id"])


@query(f"WITH {_PWALK} SELECT node_0_id AS seed_id, side, edge_0_type AS e0, edge_1_type AS e1, node_1_id AS n1, node_2_id AS n2, edge_1_u AS u1, edge_1_v AS v1 FROM (SELECT * FROM u2 UNION ALL SELECT * FROM v2)")
def x_seed_paths(s, d):
    u, v = _pair_walk(s, d)
    a = S.seed_paths(u[2].union(v[2]), 2)
    return a.select("seed_id", "side", *[F.col(c)[i].alias(n) for n, c, i in (("e0", "edge_type_array", 0), ("e1", "edge_type_array", 1), ("n1", "node_id_array", 0), ("n2", "node_id_array", 1), ("u1", "u_index_array", 1), ("v1", "v_index_array", 1))])


def _collected(s, d):
    u, v = _pair_walk(s, d)
    found = G.between(_pairs(s, d), u, v, _fixed_types(s), 4, X.MAX_INSTANCE, X.SEED)
    up = S.seed_paths(u[1], 1).unionByName(S.seed_paths(u[2], 2))
    vp = S.seed_paths(v[1], 1).unionByName(S.seed_paths(v[2], 2))
    return S.collect_pairs(_pairs(s, d), up, vp, S.bipath_arrays(found[3], 3).unionByName(S.bipath_arrays(found[4], 4)))


@query(f"""WITH {_PWALK}, every AS (SELECT q.*, 0 AS path_type, 1 AS hop_k, node_1_id AS first_node FROM pairs q JOIN u1 ON node_0_id = u_node_id UNION ALL SELECT q.*, 0, 2, node_1_id FROM pairs q JOIN u2 ON node_0_id = u_node_id
UNION ALL SELECT q.*, 1, 1, node_1_id FROM pairs q JOIN v1 ON node_0_id = v_node_id UNION ALL SELECT q.*, 1, 2, node_1_id FROM pairs q JOIN v2 ON node_0_id = v_node_id
UNION ALL SELECT node_0_id, node_3_id, date, 2, 3, node_1_id FROM met3 UNION ALL SELECT node_0_id, node_4_id, date, 2, 4, node_1_id FROM met4)
SELECT u_node_id, v_node_id, CAST(count(*) OVER (PARTITION BY u_node_id, v_node_id) AS INTEGER) AS path_count, path_type, hop_k, first_node FROM every""")
def x_pair_paths_flat(s, d):
    z = F.explode(F.arrays_zip("path_type_array", "hop_k_array", "paths_node_id_array"))
    return _collected(s, d).select("u_node_id", "v_node_id", "path_count", z.alias("z")).select("u_node_id", "v_node_id", "path_count", F.col("z.path_type_array").alias("path_type"), F.col("z.hop_k_array").alias("hop_k"), F.col("z.paths_node_id_array")[0].alias("first_node"))




@query(f"""WITH {_PWALK}, us AS (SELECT DISTINCT u_node_id FROM pairs), f AS (SELECT u_node_id, c_acctbal AS x FROM us JOIN customer ON c_custkey = u_node_id), b AS (SELECT min(x) AS lo, max(x) AS hi FROM f)
SELECT q.u_node_id, q.v_node_id, CAST(1 AS BIGINT) AS n, round((x - lo) / (hi - lo), 6) AS x FROM pairs q JOIN f USING (u_node_id), b""")
def x_pair_features_flat(s, d):
    pairs = _pairs(s, d)
    nodes = pairs.select(F.lit(X.CUSTOMER).alias("node_type"), F.col("u_node_id").alias("node_id"), "date").distinct()
    table = X.read(s, d, "customer").select(F.col("c_custkey").alias("node_id"), F.array("c_acctbal").alias("feat_vector"))
    own = S.with_features(nodes, table, ["node_id"], 1)
    own = S.feature_ids(S.scale(own, S.fit_scaler(own, 1)), "node_type", ["node_id"]).withColumn("element_key", S.element_key(0, "node_type"))
    used = pairs.join(own.select(F.col("node_id").alias("u_node_id"), "date", "element_key", "feat_id"), ["u_node_id", "date"])
    got = S.collect_features(used, own.select("element_key", "feat_id", "feat_vector"), [f"0_{X.CUSTOMER}"])
    return got.select("u_node_id", "v_node_id", F.col(f"e0_{X.CUSTOMER}_count").alias("n"), F.round(F.col(f"e0_{X.CUSTOMER}_feat_vector_array")[0][0], 6).alias("x"))


# --- packing and metrics ----------------------------------------------------------------------------------------------

_PATHS = "paths AS (SELECT l_orderkey AS sample, CAST(l_suppkey % 3 AS INTEGER) AS path_type, CAST(1 + l_partkey % 4 AS INTEGER) AS hop_k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS path_no FROM lineitem)"
_PACK = f"""{_PATHS}, a AS (SELECT *, CASE WHEN path_type = 2 THEN 2 * hop_k - 1 ELSE 2 * hop_k END AS token_len FROM paths),
b AS (SELECT *, (row_number() OVER (PARTITION BY sample, path_type ORDER BY token_len, path_no) - 1) % 2 AS path_group FROM a),
c AS (SELECT *, row_number() OVER w AS path_pos, CASE WHEN path_type = 2 THEN 3 ELSE 2 END + sum(token_len) OVER (w ROWS UNBOUNDED PRECEDING) AS fin FROM b WINDOW w AS (PARTITION BY sample, path_type, path_group ORDER BY token_len, path_no)),
packed AS (SELECT sample, path_type, CAST(path_group AS INTEGER) AS path_group, path_no, CAST(path_pos AS INTEGER) AS path_pos, hop_k, CAST(token_len AS INTEGER) AS token_len, CAST(fin - token_len AS INTEGER) AS "offset" FROM c WHERE fin <= 12)"""


def _lines_as_paths(s, d):
    from pyspark.sql import Window

    line = X.read(s, d, "lineitem")
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return line.select(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 3).cast("int").alias("path_type"), (F.col("l_partkey") % 4 + 1).cast("int").alias("hop_k"), no.cast("long").alias("path_no"))


@query(f"WITH {_PACK} SELECT * FROM packed")
def p_groups(s, d):
    return K.pack_paths(_lines_as_paths(s, d), 2, 12)


def _with_arrays(packed):
    inner = F.when(F.col("path_type") == 2, F.col("hop_k") - 1).otherwise(F.col("hop_k"))
    return packed.withColumn("node_type_array", F.array_repeat(F.lit(1), inner)).withColumn("edge_type_array", F.array_repeat(F.lit(0), F.col("hop_k"))).withColumn("u_index_array", F.sequence(F.lit(0), F.col("hop_k") - 1)).withColumn("v_index_array", F.sequence(F.lit(1), F.col("hop_k")))


def _pos(x: str) -> str:
    return f"CASE WHEN path_type <> 2 THEN {x} + 1 WHEN {x} = 0 THEN 1 WHEN {x} = hop_k THEN 2 ELSE {x} + 2 END"


@query(f"""WITH {_PACK}, nn AS (SELECT *, CASE WHEN path_type = 2 THEN hop_k - 1 ELSE hop_k END AS k FROM packed), n AS (SELECT *, unnest(range(k)) AS j FROM nn), e AS (SELECT *, unnest(range(hop_k)) AS j FROM nn)
SELECT sample, path_type, path_group, path_pos, CAST("offset" + j AS INTEGER) AS token_at, 0 AS is_edge, 1 AS element_type, CAST(j + CASE WHEN path_type = 2 THEN 3 ELSE 2 END AS INTEGER) AS node_pos, 0 AS u_pos, 0 AS v_pos FROM n
UNION ALL SELECT sample, path_type, path_group, path_pos, CAST("offset" + k + j AS INTEGER), 1, 0, 0, CAST({_pos("j")} AS INTEGER), CAST({_pos("(j + 1)")} AS INTEGER) FROM e""")
def p_tokens(s, d):
    return K.path_tokens(_with_arrays(K.pack_paths(_lines_as_paths(s, d), 2, 12)))


@query(f"WITH {_PACK} SELECT sample, path_type, path_group, CAST(row_number() OVER (PARTITION BY sample ORDER BY path_type, path_group) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT sample, path_type, path_group FROM packed)")
def p_group_to_sample(s, d):
    return K.group_to_sample(K.pack_paths(_lines_as_paths(s, d), 2, 12))


_SC = "sc AS (SELECT o_orderkey AS id, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS score, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"


def _scored(s, d):
    return X.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % 1000 / F.lit(1000.0)).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query(f"WITH {_SC} SELECT avg(label) AS precision_at_k FROM (SELECT label FROM sc ORDER BY score DESC, id LIMIT 100)")
def m_precision_at_k(s, d):
    return M.precision_at(_scored(s, d), 100, "id")


@query(f"WITH {_SC} SELECT round(sum(label) / (SELECT sum(label) FROM sc), 6) AS recall_at_percent FROM (SELECT label FROM sc ORDER BY score DESC, id LIMIT CAST(floor((SELECT count(*) FROM sc) * 5 / 100.0) AS BIGINT))")
def m_recall_at_pct(s, d):
    return M.recall_at_percent(_scored(s, d), 5, "id").select(*_r("recall_at_percent", digits=6))


@query(f"WITH {_SC}, st AS (SELECT score, sum(label) AS pos, count(*) AS n FROM sc GROUP BY 1), cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM st) SELECT round(sum(pos * cp / cn) / sum(pos), 6) AS pr_auc FROM cu")
def m_average_precision(s, d):
    return M.average_precision(_scored(s, d)).select(*_r("pr_auc", digits=6))


@query(f"WITH {_SC}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc) SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM r")
def m_roc_auc(s, d):
    return M.roc_auc(_scored(s, d)).select(*_r("roc_auc", digits=6))


@query(f"WITH {_SC}, p AS (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS q FROM sc) SELECT round(avg(-CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss FROM p")
def m_logloss(s, d):
    return M.log_loss(_scored(s, d)).select(*_r("log_loss", digits=6))


@query(f"WITH {_SC} SELECT round(avg((score - label) ** 2), 6) AS mse, round(avg(abs(score - label)), 6) AS mae, round(sqrt(avg((score - label) ** 2)), 6) AS rmse, round(avg(ln(1 + exp(score)) - score * label), 6) AS bce_logits FROM sc")
def m_errors(s, d):
    a = _scored(s, d)
    return M.errors(a).crossJoin(M.bce_logits(a)).select(*_r("mse", "mae", "rmse", "bce_logits", digits=6))


@query(f"WITH {_SC} SELECT id AS u_node_id, id AS v_node_id, {DAY} AS date, score AS prediction, label FROM sc ORDER BY score DESC, id LIMIT 25")
def topk_pairs(s, d):
    return P.best_pairs(_scored(s, d).select(F.col("id").alias("u_node_id"), F.col("id").alias("v_node_id"), F.to_date(F.lit(X.SNAPSHOT)).alias("date"), F.col("score").alias("prediction"), "label"), 25)


