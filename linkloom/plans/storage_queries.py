"""Queries that write tables and files and read them back, and those of publication records."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import table as T
from linkloom.plans import oracle as O
from linkloom.plans import pipeline as L
from linkloom.plans import publications as B
from linkloom.plans import trade as X
from linkloom.plans.queries import DAY, _bucket, query
from linkloom.plans.schema import GraphSchema
from linkloom.session import scratch
from linkloom.sources import batches as R
from linkloom.sources import tables as W
from linkloom.sources.files import Files


def _orders(s, d):
    return X.read(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("y"))


def _written(s, d, name):
    path = scratch(s, name)
    W.write_table(_orders(s, d), path, partition_columns=["o_orderstatus", "y"])
    return path


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1996, 1998)")
def io_partitions(s, d):
    """A table written by two partition columns, of which two partitions are read."""
    path = _written(s, d, "partitions")
    wanted = W.partition_instances({"o_orderstatus": ["F"], "y": [1996, 1998]}, ["o_orderstatus", "y"])
    return W.read_table(s, path, partition_columns=["o_orderstatus", "y"], instances=[(a, int(b)) for a, b in wanted])


@query("SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND year(o_orderdate) = 1996) GROUP BY ALL")
def io_cleanup(s, d):
    path = _written(s, d, "cleanup")
    W.cleanup_table(s, path, ["o_orderstatus", "y"], [("F", 1996)])
    return W.read_table(s, path).groupBy("o_orderstatus", "y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, y, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE total END AS total FROM (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)")
def io_overwrite(s, d):
    """Overwriting touches only the partitions that the rows have."""
    path = _written(s, d, "overwrite")
    again = _orders(s, d).where("o_orderstatus = 'O'").groupBy("o_orderstatus", "y").agg(F.min("o_orderkey").alias("o_orderkey"), F.min("o_custkey").alias("o_custkey")).withColumn("o_totalprice", F.lit(1.0))
    W.write_table(again.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "y"), path, partition_columns=["o_orderstatus", "y"])
    return W.read_table(s, path).groupBy("o_orderstatus", "y").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT * FROM (VALUES ('a=1/b=x', 0), ('a=1/b=y', 1), ('a=2/b=x', 2), ('a=2/b=y', 3)) t(path, i)")
def io_partition_paths(s, d):
    paths = [W.partition_path("base", ["a", "b"], v).removeprefix("base/") for v in W.partition_instances({"a": [1, 2], "b": ["x", "y"]}, ["a", "b"])]
    return s.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, i int")


@query("SELECT * FROM (VALUES ('2', 'first'), ('3', 'first'), ('1', 'forced'), ('2', 'forced'), ('3', 'forced')) t(part, run)")
def io_manifest(s, d):
    """Instances that are missing once the first of three is complete; all, if everything is to be made anew."""
    path, wanted = scratch(s, "manifest"), W.partition_instances([1, 2, 3], ["part"])
    W.Manifest(s).complete(path, ["part"], wanted[:1])
    rows = [(v[0], "first") for v in W.Manifest(s).missing(path, ["part"], wanted)] + [(v[0], "forced") for v in W.Manifest(s, force=True).missing(path, ["part"], wanted)]
    return s.createDataFrame(rows, "part string, run string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_csv(s, d):
    path = scratch(s, "csv")
    W.write_csv(X.read(s, d, "nation").orderBy("n_nationkey"), path)
    return W.read_table(s, path, "csv", "n_nationkey int, n_name string, n_regionkey int", header="true")


@query("SELECT * FROM (VALUES ('_SUCCESS', false), ('a.txt', true), ('folder', true), ('info.json', true)) t(name, found)")
def io_files(s, d):
    """Small files through the file system that the path's scheme names."""
    files, path = Files(s), scratch(s, "files")
    files.make_folder(f"{path}/folder")
    files.write_text(f"{path}/a.txt", "é\n")
    files.write_json(f"{path}/info.json", {"k": ["é", 1]})
    files.write_text(f"{path}/gone", "")
    files.delete(f"{path}/gone")
    if files.read_text(f"{path}/a.txt") != "é\n" or files.read_json(f"{path}/info.json") != {"k": ["é", 1]}:
        raise AssertionError("files differ from what was written")
    return s.createDataFrame([("_SUCCESS", files.exists(f"{path}/_SUCCESS"))] + [(n, True) for n in files.names(path)], "name string, found boolean")


_NUMBERED = f"""st AS (SELECT l_returnflag, CAST(floor(count(*) * 28 / 20000.0) + 1 AS INTEGER) AS num_files FROM lineitem GROUP BY 1), fi AS (SELECT *, CAST(coalesce(sum(num_files) OVER (ORDER BY l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS first FROM st)"""


def _numbered(s, d):
    lines = X.read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    stats = W.output_statistics(lines, ["l_returnflag"], {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4}, 20_000)
    return W.file_numbers(lines, stats, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["l_returnflag"], "f"), stats


_UNIT = "CAST(concat('0x', substr(md5(concat_ws(':', 'f', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(f"WITH {_NUMBERED} SELECT l_returnflag, CAST(first + floor({_UNIT} * num_files) AS INTEGER) AS file_no, count(*) AS n FROM lineitem JOIN fi USING (l_returnflag) GROUP BY ALL")
def io_file_numbers(s, d):
    return _numbered(s, d)[0].groupBy("l_returnflag", "file_no").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NUMBERED} SELECT l_returnflag, n, count(*) AS files FROM (SELECT l_returnflag, CAST(first + floor({_UNIT} * num_files) AS INTEGER) AS file_no, count(*) AS n FROM lineitem JOIN fi USING (l_returnflag) GROUP BY ALL) GROUP BY ALL")
def io_batched_write(s, d):
    """Numbered files, written five at a time: rows of each file as read back."""
    rows, stats = _numbered(s, d)
    path = scratch(s, "batched")
    n = stats.agg(F.sum("num_files").alias("n")).first()["n"]
    W.write_numbered(rows, path, n, partition_columns=["l_returnflag"], files_at_once=max(5, n // 4))
    each = s.read.parquet(path).groupBy("l_returnflag", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("l_returnflag", "n").agg(F.count(F.lit(1)).alias("files"))


@query(f"SELECT c_custkey, {DAY} AS snapshot, 'spending,spending,spending,spending,spending,spending,spending,spending,spending,baskets,baskets,baskets,baskets,baskets,baskets,baskets,baskets' AS sources, size FROM (SELECT o_custkey AS c_custkey, 17 AS size FROM orders WHERE {O.month_after('o_orderdate')} >= DATE '1997-01-01' AND {O.month_after('o_orderdate')} < {DAY} GROUP BY 1)")
def el_with_info(s, d):
    """An element built from two sources through staged tables, with the record of its features read back."""
    steps = L.Steps(s, scratch(s, "element"))
    table, info = L.element(steps, "customer", ["c_custkey"], [(X.SPENDING, X.orders(s, d)), (X.BASKETS, X.lines(s, d))], [X.SNAPSHOT])
    again, same = L.element(steps, "customer", ["c_custkey"], [(X.SPENDING, X.orders(s, d)), (X.BASKETS, X.lines(s, d))], [X.SNAPSHOT])
    counts = W.feature_counts(s, {"customer": f"{steps.base}/element/customer", "part": f"{steps.base}/element/part"})
    if same != info or [m["index"] for m in info] != list(range(len(info))) or counts != {"customer": 17, "part": 0}:
        raise AssertionError("the record of features changed")
    return again.select("c_custkey", F.to_date("snapshot").alias("snapshot"), F.lit(",".join(m["source"] for m in info)).alias("sources"), F.size("feat_vector").alias("size"))


@query("SELECT * FROM (VALUES (0, 'node', 'order', 'o_orderkey', NULL), (1, 'node', 'customer', 'c_custkey', NULL), (2, 'node', 'part', 'p_partkey', NULL), (3, 'node', 'supplier', 's_suppkey', NULL), (4, 'node', 'nation', 'n_nationkey', NULL), (0, 'edge', 'order_customer', 'order', 'customer'), (1, 'edge', 'order_part', 'order', 'part'), (2, 'edge', 'order_supplier', 'order', 'supplier'), (3, 'edge', 'part_supplier', 'part', 'supplier'), (4, 'edge', 'customer_nation', 'customer', 'nation')) t(i, kind, name, a, b)")
def g_schema(s, d):
    """The graph's types by index; a configuration that names an unknown type is refused."""
    try:
        GraphSchema.parse({"nodes": {"a": {"table": "t", "id_column": "i"}}, "edges": {"e": {"table": "t", "u_node": {"type": "a", "id_column": "i"}, "v_node": {"type": "b", "id_column": "j"}}}})
    except ValueError:
        pass
    else:
        raise AssertionError("an unknown node type was taken")
    g = X.SCHEMA
    rows = [(g.node_index(n.name), "node", n.name, n.id_column, None) for n in g.nodes] + [(g.edge_index(e.name), "edge", e.name, e.u_type, e.v_type) for e in g.edges]
    return s.createDataFrame(rows, "i int, kind string, name string, a string, b string")


# --- batches and predictions ------------------------------------------------------------------------------------------


@query(f"SELECT e AS epoch, o_orderkey, CASE e WHEN 0 THEN {_bucket(4, 'b/0', 'o_orderkey')} ELSE {_bucket(4, 'b/1', 'o_orderkey')} END AS batch_id, row_number() OVER (PARTITION BY e, CASE e WHEN 0 THEN {_bucket(4, 'b/0', 'o_orderkey')} ELSE {_bucket(4, 'b/1', 'o_orderkey')} END ORDER BY md5(concat_ws(':', 'b/' || e || '/order', o_orderkey))) AS place FROM orders, (SELECT unnest([0, 1]) AS e)")
def d_shuffled_batches(s, d):
    """Batches of two epochs, and each row's place in its batch."""
    orders = X.read(s, d, "orders").select("o_orderkey")
    parts = [R.shuffled_batches(orders, 4, ["o_orderkey"], e, "b").select(F.lit(e).alias("epoch"), "*") for e in (0, 1)]
    placed = [T.hash_ranked(p, "place", ["epoch", "batch_id"], ["o_orderkey"], f"b/{e}/order") for e, p in enumerate(parts)]
    return placed[0].union(placed[1]).select("epoch", "o_orderkey", "batch_id", F.col("place").cast("long").alias("place"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS resumed FROM orders")
def d_sequential_files(s, d):
    """Files read one after another; the second reader goes on where the first has stopped, so each row is read once."""
    path = scratch(s, "sequential")
    X.read(s, d, "orders").select("o_orderkey").repartition(4, "o_orderkey").write.parquet(path)
    got = []
    first = R.SequentialFiles(s, path)
    for f, part in first:
        got.append(part.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).first())
        first.done(f)
        if len(got) == 2:
            break
    left = [R.SequentialFiles(s, path, rank=r, workers=2) for r in (0, 1)]
    resumed = sorted(f for w in left for f in w.own) == sorted(first.own[2:])
    got += [part.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).first() for w in left for _, part in w]
    return s.createDataFrame([(sum(r["n"] for r in got), sum(r["keys"] or 0 for r in got), resumed)], "n long, keys long, resumed boolean")


@query("SELECT o_orderkey, round(o_totalprice / 500000.0, 9) AS prediction FROM orders")
def d_prediction_sink(s, d):
    """Predictions written in files of a thousand rows at most."""
    path = scratch(s, "predictions")
    R.write_predictions(X.read(s, d, "orders").select("o_orderkey", "o_totalprice"), path, 1000, F.round(F.col("o_totalprice") / 500000.0, 9))
    found = R.read_predictions(s, path)
    if found.groupBy("file").count().where("count > 1000").count():
        raise AssertionError("a file has too many rows")
    return found.select("o_orderkey", "prediction")


@query(f"SELECT date, count(*) AS n FROM (SELECT {O.month_after('o_orderdate')} AS date FROM orders) GROUP BY 1")
def st_feed_context(s, d):
    """Orders that arrive as files, flattened into a context table; a batch that is tried again counts once."""
    from linkloom.streaming.feed import feed_context

    base = scratch(s, "feed")
    X.read(s, d, "orders").select("o_orderkey", "o_orderdate").repartition(3, "o_orderkey").write.parquet(f"{base}/in")
    stream = s.readStream.schema("o_orderkey long, o_orderdate timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    for checkpoint in ("c", "again"):  # the second run starts without the first one's memory, as after a crash before its commit
        feed_context(stream, f"{base}/out", f"{base}/{checkpoint}", "o_orderdate").awaitTermination()
    return s.read.parquet(f"{base}/out").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


# --- publication records ----------------------------------------------------------------------------------------------

_KINDS = "list_value('article', 'book-chapter', 'preprint', 'dataset', 'review')"
_W = f"w AS (SELECT CAST(o_orderkey AS VARCHAR) AS work_id, {O.month_after('o_orderdate')} AS date, ({_KINDS})[1 + o_orderkey % 5] AS kind, o_custkey, o_orderkey FROM orders)"
_A = f"{_W}, a AS (SELECT work_id, date, 'a' || l_suppkey AS author_id, CASE l_linenumber % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'middle' ELSE 'last' END AS pos, CASE WHEN l_suppkey % 5 > 0 THEN 'i' || l_suppkey % 7 END AS institution_id, l_partkey, l_discount FROM w JOIN lineitem ON l_orderkey = o_orderkey)"


def _works(s, d):
    """Orders as publications: suppliers as authors, parts as topics and references, customers as sources."""
    line = X.read(s, d, "lineitem")
    position = F.when(F.col("l_linenumber") % 3 == 0, "first").when(F.col("l_linenumber") % 3 == 1, "middle").otherwise("last")
    author = F.struct(F.concat(F.lit("a"), "l_suppkey").alias("id"), F.lit("x").alias("display_name"))
    place = F.array(F.struct(F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("i"), F.col("l_suppkey") % 7)).alias("id"), F.lit("y").alias("display_name")))
    topic = F.struct(F.concat(F.lit("t"), "l_partkey").alias("id"), F.lit("z").alias("display_name"), F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("score"))
    nested = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(position.alias("author_position"), author.alias("author"), place.alias("institutions"))).alias("authorships"), F.collect_list(F.concat(F.lit("r"), "l_partkey")).alias("referenced_works"), F.collect_list(topic).alias("topics"))
    source = F.struct(F.concat(F.lit("s"), "o_custkey").alias("id"), F.lit("q").alias("display_name"), F.when(F.col("o_custkey") % 2 == 0, "journal").otherwise("book series").alias("type"), (F.col("o_custkey") % 3 == 0).alias("is_oa"), F.lit(None).cast("boolean").alias("is_in_doaj"))
    kinds = F.array(*[F.lit(k) for k in B.WORK_TYPES])
    works = X.read(s, d, "orders").join(nested, "o_orderkey", "left").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("title").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("type"), F.when(F.col("o_orderkey") % 3 == 0, "de").otherwise("en").alias("language"), "authorships", "referenced_works", F.struct(source.alias("source"), (F.col("o_custkey") % 4 == 0).alias("is_oa")).alias("primary_location"), "topics")
    path = scratch(s, "works")
    works.write.json(path)
    return B.dated(W.read_table(s, path, "json", B.SCHEMA))


@query(f"WITH {_W} SELECT work_id, date, {', '.join(f'CAST(kind = {chr(39)}{k}{chr(39)} AS INTEGER) AS type_is_{k.replace(chr(45), chr(95))}' for k in B.WORK_TYPES)}, CAST(o_orderkey % 3 <> 0 AS INTEGER) AS language_is_en FROM w")
def pub_basic(s, d):
    return B.basic(_works(s, d))


@query(f"WITH {_A} SELECT DISTINCT work_id, 'r' || l_partkey AS cited_work_id, date FROM a")
def pub_citations(s, d):
    return B.citations(_works(s, d))


@query(f"WITH {_A} SELECT work_id, author_id, date, {', '.join(f'max(CAST(pos = {chr(39)}{p}{chr(39)} AS INTEGER)) AS author_position_is_{p}' for p in B.POSITIONS)} FROM a GROUP BY 1, 2, 3")
def pub_authors(s, d):
    return B.authors(_works(s, d))


@query(f"WITH {_A} SELECT work_id, institution_id, date, {', '.join(f'count(*) FILTER (pos = {chr(39)}{p}{chr(39)}) AS {p}_author_count' for p in B.POSITIONS)} FROM a WHERE institution_id IS NOT NULL GROUP BY 1, 2, 3")
def pub_institutions(s, d):
    return B.institutions(_works(s, d))


@query(f"WITH {_A} SELECT author_id, institution_id, date, count(*) AS author_use_institution_count FROM a WHERE institution_id IS NOT NULL GROUP BY 1, 2, 3")
def pub_author_institutions(s, d):
    return B.author_institutions(_works(s, d))


@query(f"WITH {_A} SELECT work_id, 't' || l_partkey AS topic_id, date, CASE WHEN l_discount > 0.01 THEN l_discount ELSE 0.0 END AS topic_score, CAST(l_discount <= 0.01 AS INTEGER) AS topic_score_is_null FROM a")
def pub_topics(s, d):
    return B.topics(_works(s, d))


@query(f"WITH {_W} SELECT work_id, 's' || o_custkey AS source_id, date, CAST(o_custkey % 4 = 0 AS INTEGER) AS location_is_oa, CAST(o_custkey % 3 = 0 AS INTEGER) AS source_is_oa, CAST(o_custkey % 2 = 0 AS INTEGER) AS source_type_is_journal, CAST(o_custkey % 2 = 1 AS INTEGER) AS source_type_is_book_series FROM w")
def pub_sources(s, d):
    return B.sources(_works(s, d)).select("work_id", "source_id", "date", "location_is_oa", "source_is_oa", "source_type_is_journal", "source_type_is_book_series")
