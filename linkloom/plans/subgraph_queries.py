"""Queries of the pairs' subgraphs: elements with features, what seeds and pairs collect, whole rows, and batches of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import graph as G
from linkloom.operators import packing as K
from linkloom.operators import pairs as P
from linkloom.operators import subgraph as S
from linkloom.plans import oracle as O
from linkloom.plans import pipeline as L
from linkloom.plans import trade as X
from linkloom.plans.queries import _PWALK, _XN, DAY, _bucket, _fixed_types, _xe, query
from linkloom.session import keeper, scratch
from linkloom.sources.files import Files

ORDER_PART = X.SCHEMA.edge_index("order_part")
_XE = "xe AS (" + " UNION ".join(_xe(t, h, i) for t in "uv" for h in (1, 2) for i in range(h)) + ")"


def _scaled(x: str) -> str:
    return f"CASE WHEN min({x}) OVER () = max({x}) OVER () THEN 0.5 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


_FEATS = f"""{_PWALK},
{_XN},
{_XE},
qty AS (SELECT u_node_id, v_node_id, sum(l_quantity) AS q FROM xe JOIN lineitem ON l_orderkey = u_node_id AND l_partkey = v_node_id WHERE edge_type = {ORDER_PART} GROUP BY 1, 2),
feats AS (SELECT '0_{X.CUSTOMER}' AS element_key, node_id AS id_a, CAST(NULL AS BIGINT) AS id_b, row_number() OVER (ORDER BY node_id) - 1 AS feat_id, {_scaled("c_acctbal")} AS x FROM xn JOIN customer ON c_custkey = node_id WHERE node_type = {X.CUSTOMER}
UNION ALL SELECT '0_{X.PART}', node_id, NULL, row_number() OVER (ORDER BY node_id) - 1, {_scaled("p_retailprice")} FROM xn JOIN part ON p_partkey = node_id WHERE node_type = {X.PART}
UNION ALL SELECT '1_{ORDER_PART}', u_node_id, v_node_id, row_number() OVER (ORDER BY u_node_id, v_node_id) - 1, {_scaled("q")} FROM qty)"""


def _places(table: str, nodes: range, edges: range, keys: str) -> str:
    parts = [f"SELECT {keys}, '0_' || node_{i}_type AS element_key, node_{i}_id AS id_a, CAST(NULL AS BIGINT) AS id_b FROM {table}" for i in nodes]
    for i in edges:
        end = lambda w, i=i: f"CASE WHEN edge_{i}_{w} = {i} THEN node_{i}_id ELSE node_{i + 1}_id END"
        parts.append(f"SELECT {keys}, '1_' || edge_{i}_type, {end('u')}, {end('v')} FROM {table}")
    return " UNION ALL ".join(parts)


_WITH_FEATS = "JOIN feats f ON f.element_key = e.element_key AND f.id_a = e.id_a AND f.id_b IS NOT DISTINCT FROM e.id_b"
_SEEDEL = f"""{_FEATS},
seedel AS (SELECT DISTINCT seed, side, e.element_key, feat_id FROM (SELECT node_0_id AS seed, side, '0_' || node_0_type AS element_key, node_0_id AS id_a, CAST(NULL AS BIGINT) AS id_b FROM (SELECT * FROM u0 UNION ALL SELECT * FROM v0)
UNION ALL {" UNION ALL ".join(_places(f"{t}{h}", range(1, h + 1), range(h), "node_0_id, side") for t in "uv" for h in (1, 2))}) e {_WITH_FEATS})"""
_PAIREL = f"""{_SEEDEL},
pairel AS (SELECT u_node_id, v_node_id, element_key, feat_id FROM pairs JOIN seedel ON seed = u_node_id AND side = 0 UNION SELECT u_node_id, v_node_id, element_key, feat_id FROM pairs JOIN seedel ON seed = v_node_id AND side = 1
UNION SELECT u_node_id, v_node_id, e.element_key, feat_id FROM ({" UNION ALL ".join(_places(f"met{k}", range(1, k), range(k), f"node_0_id AS u_node_id, node_{k}_id AS v_node_id") for k in (3, 4))}) e {_WITH_FEATS})"""
_COUNTED = f"""pathn AS (SELECT u_node_id, v_node_id, count(*) AS n FROM (SELECT u_node_id, v_node_id FROM pairs JOIN u1 ON node_0_id = u_node_id UNION ALL SELECT u_node_id, v_node_id FROM pairs JOIN u2 ON node_0_id = u_node_id
UNION ALL SELECT u_node_id, v_node_id FROM pairs JOIN v1 ON node_0_id = v_node_id UNION ALL SELECT u_node_id, v_node_id FROM pairs JOIN v2 ON node_0_id = v_node_id
UNION ALL SELECT node_0_id, node_3_id FROM met3 UNION ALL SELECT node_0_id, node_4_id FROM met4) GROUP BY 1, 2)"""


def _walked(s, d, targets=None):
    """The pairs, their walks and the paths between them, each kept: all that follows uses them several times. targets: those of the pairs, if they are kept."""
    keep = keeper(s)
    rows = keep("lines", X.lines(s, d))
    pairs, types, edges = (keep("pairs", X.targets(s, d, None, rows)) if targets is None else targets).select("u_node_id", "v_node_id", "date"), _fixed_types(s), keep("edges", X.outer_parts(s, d, rows))
    forward, back = G.pair_walks(pairs, edges, types, 4, X.CUSTOMER, X.PART, X.MAX_INSTANCE, X.SEED, keep)
    whole = G.between(pairs, forward, back, types, 4, X.MAX_INSTANCE, X.SEED)
    return pairs, forward, back, {k: keep(f"between_{k}", whole[k]) for k in (3, 4)}


def _tables(s, d):
    """Vectors of customers, of parts, and of the edges from orders to parts."""
    day = F.to_date(F.lit(X.SNAPSHOT)).alias("date")
    customers = X.read(s, d, "customer").select(F.col("c_custkey").alias("node_id"), day, F.array("c_acctbal").alias("feat_vector"))
    parts = X.read(s, d, "part").select(F.col("p_partkey").alias("node_id"), day, F.array("p_retailprice", F.col("p_size").cast("double")).alias("feat_vector"))
    bought = X.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("u_node_id"), F.col("l_partkey").alias("v_node_id")).agg(F.array(F.sum("l_quantity")).alias("feat_vector")).withColumn("date", day)
    return {X.CUSTOMER: (customers, 1), X.PART: (parts, 2)}, {ORDER_PART: (bought, 1)}


def _features(s, d, forward, back):
    """All vectors, scaled by bounds that were fitted, saved and loaded again."""
    keep = keeper(s)
    nodes, edges = S.unique_elements({h: forward[h].unionByName(back[h]) for h in (1, 2)})
    of_nodes, of_edges = _tables(s, d)
    path, files = f"{scratch(s, 'scaler')}.json", Files(s)
    fitted = S.element_features(nodes, 0, of_nodes, None, keep)[1] | S.element_features(edges, 1, of_edges, None, keep)[1]
    S.save_scaler(files, path, fitted)
    bounds = S.load_scaler(files, path)
    return keep("features", S.element_features(nodes, 0, of_nodes, bounds)[0].union(S.element_features(edges, 1, of_edges, bounds)[0]))


@query(f"WITH {_FEATS} SELECT element_key, id_a, id_b, feat_id, round(x, 6) AS x FROM feats")
def x_element_features(s, d):
    _, forward, back, _ = _walked(s, d)
    return _features(s, d, forward, back).select("element_key", "id_a", "id_b", "feat_id", F.round(F.col("feat_vector")[0], 6).alias("x"))


@query(f"WITH {_SEEDEL} SELECT seed AS node_0_id, side, element_key, feat_id FROM seedel")
def x_seed_elements(s, d):
    _, forward, back, _ = _walked(s, d)
    both = {h: forward[h].unionByName(back[h]) for h in (1, 2)}
    return S.seed_elements(forward[0].union(back[0]), both, _features(s, d, forward, back)).drop("date")


@query(f"WITH {_PAIREL} SELECT * FROM pairel")
def x_pair_elements(s, d):
    pairs, forward, back, whole = _walked(s, d)
    features = _features(s, d, forward, back)
    both = {h: forward[h].unionByName(back[h]) for h in (1, 2)}
    return S.pair_elements(pairs, S.seed_elements(forward[0].union(back[0]), both, features), whole, features).drop("date")


@query(f"WITH {_PWALK} SELECT node_0_id, 2 AS hop_k, node_1_type AS t1, node_2_type AS t2, node_1_id AS n1, node_2_id AS n2, edge_0_type AS e0, edge_1_type AS e1, CASE WHEN edge_0_u = 0 THEN node_0_id ELSE node_1_id END AS u0, CASE WHEN edge_1_v = 1 THEN node_1_id ELSE node_2_id END AS v1 FROM u2")
def x_rebuilt_paths(s, d):
    """Paths taken apart into a row a place, dealt out, and put together again by position."""
    _, forward, _, _ = _walked(s, d)
    paths = forward[2].withColumn("path", F.xxhash64(*G.path_columns(2)))
    a = S.rebuild_paths(S.long_elements(paths, 2, ["node_0_id", "path"]).repartition(5, "pos"), ["node_0_id", "path"])
    cols = {"t1": ("node_type_array", 0), "t2": ("node_type_array", 1), "n1": ("node_id_array", 0), "n2": ("node_id_array", 1), "e0": ("edge_type_array", 0), "e1": ("edge_type_array", 1), "u0": ("edge_u_id_array", 0), "v1": ("edge_v_id_array", 1)}
    return a.select("node_0_id", "hop_k", *[F.col(c)[i].alias(n) for n, (c, i) in cols.items()])


def _shown_row(rows):
    keys = (f"0_{X.CUSTOMER}", f"0_{X.PART}", f"1_{ORDER_PART}")
    ids = F.aggregate(F.concat(*[F.coalesce(F.col(f"e{k}_feat_id_array"), F.array().cast("array<bigint>")) for k in keys]), F.lit(0).cast("long"), lambda a, x: a + x)
    held = F.size(F.col("paths_node_id_array"))
    some = F.when(F.coalesce(held, F.lit(0)) == F.col("path_count"), F.col("path_count")).otherwise(F.raise_error(F.lit("paths and their count differ")))
    return rows.select("u_node_id", "v_node_id", "sample_type", "u_node_feat_id", "v_node_feat_id", some.cast("int").alias("path_count"), *[F.col(f"e{k}_count").alias(n) for k, n in zip(keys, ("customers", "parts", "order_parts"), strict=True)], F.when(sum(F.col(f"e{k}_count") for k in keys) > 0, ids).alias("ids"))


@query(f"""WITH {_PAIREL},
{_COUNTED},
counted AS (SELECT u_node_id, v_node_id, count(*) FILTER (element_key = '0_{X.CUSTOMER}') AS a, count(*) FILTER (element_key = '0_{X.PART}') AS b, count(*) FILTER (element_key = '1_{ORDER_PART}') AS c, sum(feat_id) AS ids FROM pairel GROUP BY 1, 2)
SELECT p.u_node_id, p.v_node_id, s.sample_type, fu.feat_id AS u_node_feat_id, fv.feat_id AS v_node_feat_id, CAST(coalesce(n, 0) AS INTEGER) AS path_count, coalesce(a, 0) AS customers, coalesce(b, 0) AS parts, coalesce(c, 0) AS order_parts, ids
FROM pairs p JOIN targets s USING (u_node_id, v_node_id) LEFT JOIN feats fu ON fu.element_key = '0_{X.CUSTOMER}' AND fu.id_a = p.u_node_id LEFT JOIN feats fv ON fv.element_key = '0_{X.PART}' AND fv.id_a = p.v_node_id
LEFT JOIN pathn USING (u_node_id, v_node_id) LEFT JOIN counted USING (u_node_id, v_node_id)""")
def x_pair_rows(s, d):
    """Whole rows of pairs: ends' vectors, paths, elements and labels, each list shown by its length and the ids by their sum."""
    keep = keeper(s)
    targets = keep("targets", X.targets(s, d))
    pairs, forward, back, whole = _walked(s, d, targets)
    parts = L.pair_row_parts(pairs, forward, back, whole, _features(s, d, forward, back), X.CUSTOMER, X.PART, targets, keep)
    return keep("rows", [_shown_row(rows) for rows in parts])


@query(f"""WITH {_PWALK},
{_COUNTED} SELECT {_bucket(3, "s", "u_node_id", "v_node_id", "date")} AS batch_id, count(*) AS pairs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS paths FROM pairs LEFT JOIN pathn USING (u_node_id, v_node_id) GROUP BY 1""")
def x_pair_batches(s, d):
    """Rows written a batch at a time; after the first run one batch is lost, and the second run makes that one alone."""
    pairs, forward, back, whole = _walked(s, d)
    base = scratch(s, "batches")

    def make(part):
        arrays = lambda walks: S.seed_paths(walks[1], 1).unionByName(S.seed_paths(walks[2], 2))
        return S.collect_pairs(part, arrays(forward), arrays(back), S.bipath_arrays(whole[3], 3).unionByName(S.bipath_arrays(whole[4], 4)))

    L.subgraph_batches(L.Steps(s, base), "collected", pairs, 3, make, X.SEED)
    Files(s).delete(f"{base}/collected/batch_id=1")
    made = []
    rows = L.subgraph_batches(L.Steps(s, base), "collected", pairs, 3, lambda part: made.append(1) or make(part), X.SEED)
    assert len(made) == 1
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("path_count").cast("long").alias("paths"))


@query(f"WITH {_SEEDEL} SELECT u_node_id % 4 AS batch, element_key, feat_id, row_number() OVER (PARTITION BY u_node_id % 4, element_key ORDER BY feat_id) - 1 AS embed_id FROM (SELECT DISTINCT u_node_id, element_key, feat_id FROM pairs JOIN seedel ON seed = u_node_id AND side = 0) GROUP BY 1, 2, 3")
def p_unique_features(s, d):
    """Distinct vectors of each batch, here of the pairs with the same remainder."""
    pairs, forward, back, _ = _walked(s, d)
    features = _features(s, d, forward, back)
    own = S.seed_elements(forward[0], {h: forward[h] for h in (1, 2)}, features)
    used = pairs.join(own.select(F.col("node_0_id").alias("u_node_id"), "date", "element_key", "feat_id"), ["u_node_id", "date"])
    keys = (f"0_{X.CUSTOMER}", f"0_{X.PART}", f"1_{ORDER_PART}")
    rows = S.collect_features(used, features.select("element_key", "feat_id", "feat_vector"), keys).withColumn("batch", F.col("u_node_id") % 4)
    parts = [K.unique_features(rows, "batch", k).select("batch", F.lit(k).alias("element_key"), "feat_id", F.col("embed_id").cast("long").alias("embed_id")) for k in keys]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH p AS (SELECT l_orderkey AS sample, CAST(l_suppkey % 3 AS INTEGER) AS path_type, CAST(l_partkey % 2 AS INTEGER) AS path_group FROM lineitem), g AS (SELECT DISTINCT * FROM p)
SELECT sample, path_type, path_group, t AS token_at, t AS node_pos, CASE WHEN t = 0 THEN NULL WHEN t = 2 OR path_type = 1 THEN sample + 1000000 ELSE sample END AS feat_id FROM g, (SELECT unnest([0, 1, 2]) AS t) WHERE t < 2 OR path_type = 2""")
def p_frame_tokens(s, d):
    groups = X.read(s, d, "lineitem").select(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 3).cast("int").alias("path_type"), (F.col("l_partkey") % 2).cast("int").alias("path_group"))
    ends = X.read(s, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderkey").alias("u_node_feat_id"), (F.col("o_orderkey") + 1_000_000).alias("v_node_feat_id"))
    return K.frame_tokens(groups, ends)


@query("SELECT p_partkey, p_size, unnest(range(p_size)) AS i FROM part")
def p_grouped_arange(s, d):
    return K.grouped_arange(X.read(s, d, "part").select("p_partkey", "p_size"), "p_size", "i").withColumn("i", F.col("i").cast("long"))


_OWN = "own_e AS (SELECT o_custkey AS u_node_id, l_partkey AS v_node_id, min(date) AS first_date FROM lin JOIN orders o USING (o_orderkey, o_custkey) WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)"


def _own(s, d):
    """Parts of a customer's urgent orders, which here count as the customer's own."""
    urgent = X.lines(s, d).join(X.orders(s, d).where("o_orderpriority = '1-URGENT'").select("o_orderkey"), "o_orderkey", "left_semi")
    return P.first_events(urgent, "o_custkey", "l_partkey", "date")


@query(f"WITH {O.LIN},\n{O.KNOWN},\n{_OWN}, bought AS (SELECT DISTINCT l_partkey AS id, s.date FROM lin JOIN {O._SNAPS} s ON year(lin.date) BETWEEN year(s.date) - 1 AND year(s.date) - 1) SELECT * FROM known_all k WHERE NOT EXISTS (SELECT 1 FROM own_e o WHERE o.u_node_id = k.u_node_id AND o.v_node_id = k.v_node_id) AND EXISTS (SELECT 1 FROM bought b WHERE b.id = k.v_node_id AND b.date = k.date)")
def c_known_edges_own(s, d):
    """Known relations without own ones, between ends that were both active."""
    days = ["1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01"]
    return P.known_edges(X.first_purchases(s, d), X.RANGES, X.active_customers(s, d, days), P.active(X.lines(s, d), "l_partkey", "date", days, 1), _own(s, d))


@query(f"WITH {O.LIN},\n{O.KNOWN},\n{_OWN} SELECT DISTINCT u_node_id, v_node_id, {DAY} AS date FROM (SELECT * FROM first_e UNION ALL SELECT * FROM own_e) WHERE first_date < {DAY} AND u_node_id IN (SELECT id FROM active WHERE date = {DAY})")
def c_exist_edges_own(s, d):
    return P.existing_edges(X.first_purchases(s, d), [X.SNAPSHOT], X.active_customers(s, d), _own(s, d))


@query("SELECT CAST(d AS DATE) AS date, n AS sample_type FROM (VALUES ('train', DATE '1998-01-01', DATE '2000-01-01'), ('valid', DATE '2000-01-01', DATE '2000-07-01'), ('test', DATE '2000-07-01', DATE '2001-01-01'), ('infer', DATE '2001-01-01', DATE '2002-01-01')) r(n, a, b), (SELECT unnest(range(DATE '1990-01-01', DATE '2010-01-01', INTERVAL 1 YEAR)) AS d) WHERE d >= a AND d < b")
def c_year_starts(s, d):
    rows = [(day, n) for n, (a, b) in X.RANGES.items() for day in P.year_starts(a, b)]
    return s.createDataFrame(rows, "d string, sample_type string").select(F.to_date("d").alias("date"), "sample_type")


_CAPPED = O.ranking(3).replace("FROM targets) t ON", f"FROM (SELECT * FROM targets ORDER BY {O.md5('u_node_id', 'v_node_id', 'date')}, u_node_id, v_node_id LIMIT 50)) t ON")


@query(O.select(_CAPPED, "SELECT hop_k, tgt_pair_count, all_pair_count, node_1_type FROM ranked"))
def g_rank_capped_targets(s, d):
    """Path types ranked by at most fifty target pairs."""
    return X.discovered(s, d, 3, 50).select("hop_k", "tgt_pair_count", "all_pair_count", "node_1_type")
