"""Queries over the test tables that show each of the engine's operators, and SQL that gives the same rows.

Services are lookups (a join done by Spark) or small functions; each query has an engine of its own, so
what it counts doesn't depend on others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakmill.functions import stats
from oakmill.operators import approx
from oakmill.operators.rows import indexed
from oakmill.operators.services import ANY, FrameService, FunctionService, HTTPService
from oakmill.operators.vectors import ProxyIndex, VectorStore
from oakmill.plans.lineage import where_clauses
from oakmill.session import Engine

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents_engine(spark: SparkSession, d: str) -> Engine:
    """documents as blobs; ``doc_labels`` filled by a lookup, ``doc_size`` by a function of the text's length."""
    e = Engine(spark)
    e.register_blob_table("documents", _read(spark, d, "documents"), ["doc_id"])
    e.register_output_table("doc_labels", "doc_id long, quality int, toxic int", ["doc_id"], {"doc_id": "documents.doc_id"})
    e.register_output_table("doc_size", "doc_id long, size string", ["doc_id"], {"doc_id": "documents.doc_id"})
    e.register_inference_service(FrameService("labeler", _read(spark, d, "labels"), ["doc_id"], ["quality", "toxic"], cost=2.0))
    e.bind_inference_service("labeler", (["documents.doc_id"], ["doc_labels.quality", "doc_labels.toxic"]), {"documents.doc_id": "doc_labels.doc_id"})

    def size(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows.iloc[:, 1]
        return pd.DataFrame({"size": np.where(n > 2000, "long", np.where(n > 500, "middle", "short"))})

    e.register_inference_service(FunctionService("sizer", size, cost=1.0, preferred_batch_size=10_000))
    e.bind_inference_service("sizer", (["documents.doc_id", "documents.n_chars"], ["doc_size.size"]), {"documents.doc_id": "doc_size.doc_id"})
    return e


def orders_engine(spark: SparkSession, d: str) -> Engine:
    """orders as blobs (customers stored beside them); ``items`` looked up in lineitem, 0 to n rows for an order;
    ``item_flags`` made from items; ``order_tier`` from columns of orders and customers."""
    e = Engine(spark)
    e.register_table("customer", _read(spark, d, "customer"), ["c_custkey"])
    e.register_blob_table("orders", _read(spark, d, "orders"), ["o_orderkey"], {"o_custkey": "customer.c_custkey"})
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"), F.round(F.sum("l_extendedprice"), 2).alias("l_extendedprice")
    )
    columns = ["l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice"]
    e.register_output_table(
        "items", "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_extendedprice double", ["l_orderkey", "l_linenumber"], {"l_orderkey": "orders.o_orderkey"}
    )
    e.register_inference_service(FrameService("liner", lines, ["l_orderkey"], columns))
    e.bind_inference_service("liner", (["orders.o_orderkey"], [f"items.{c}" for c in columns]), {"orders.o_orderkey": "items.l_orderkey"})
    e.register_output_table(
        "item_flags", "f_orderkey long, f_linenumber int, flag string", ["f_orderkey", "f_linenumber"], {"f_orderkey": "items.l_orderkey", "f_linenumber": "items.l_linenumber"}
    )

    def flag(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"flag": np.where(rows.iloc[:, 2] == "R", "returned", np.where(rows.iloc[:, 3] > 40, "bulk", "plain"))})

    e.register_inference_service(FunctionService("flagger", flag, preferred_batch_size=10_000))
    e.bind_inference_service(
        "flagger",
        (["items.l_orderkey", "items.l_linenumber", "items.l_returnflag", "items.l_quantity"], ["item_flags.flag"]),
        {"items.l_orderkey": "item_flags.f_orderkey", "items.l_linenumber": "item_flags.f_linenumber"},
    )
    e.register_output_table("order_tier", "t_orderkey long, t_custkey long, tier string", ["t_orderkey"], {"t_orderkey": "orders.o_orderkey", "t_custkey": "customer.c_custkey"})

    def tier(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tier": np.where((rows.iloc[:, 2] > 150_000) & (rows.iloc[:, 3] == "BUILDING"), "gold", "base")})

    e.register_inference_service(FunctionService("tierer", tier, preferred_batch_size=10_000))
    e.bind_inference_service(
        "tierer",
        (["orders.o_orderkey", "customer.c_custkey", "orders.o_totalprice", "customer.c_mktsegment"], ["order_tier.tier"]),
        {"orders.o_orderkey": "order_tier.t_orderkey", "customer.c_custkey": "order_tier.t_custkey"},
    )
    return e


def vectors_engine(spark: SparkSession, d: str, buckets: int = 100) -> Engine:
    """embeddings as blobs with a proxy index; ``vec_labels`` by a lookup."""
    vectors = _read(spark, d, "embeddings")
    e = Engine(spark)
    e.register_blob_table("vectors", vectors.select("vec_id"), ["vec_id"])
    e.register_output_table("vec_labels", "vec_id long, label int", ["vec_id"], {"vec_id": "vectors.vec_id"})
    e.register_inference_service(FrameService("vec_labeler", vectors, ["vec_id"], ["label"], preferred_batch_size=100))
    e.bind_inference_service("vec_labeler", (["vectors.vec_id"], ["vec_labels.label"]), {"vectors.vec_id": "vec_labels.vec_id"})
    id_ = F.col("vec_id").alias("id")
    e.use_index(ProxyIndex(vectors.select(id_, "embedding"), buckets=buckets), "vectors", vectors.select(id_, "vec_id"))
    return e


LINES = """(SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice
 FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
FLAGS = f"(SELECT l_orderkey AS f_orderkey, l_linenumber AS f_linenumber, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity > 40 THEN 'bulk' ELSE 'plain' END AS flag FROM {LINES})"
LABELS = "(SELECT doc_id, quality, toxic FROM labels SEMI JOIN documents USING (doc_id))"
SIZES = "(SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'middle' ELSE 'short' END AS size FROM documents)"
TIERS = "(SELECT o_orderkey AS t_orderkey, c_custkey AS t_custkey, CASE WHEN o_totalprice > 150000 AND c_mktsegment = 'BUILDING' THEN 'gold' ELSE 'base' END AS tier FROM orders JOIN customer ON o_custkey = c_custkey)"


def over_documents(name: str, text: str, sql: str | None = None):
    """A query that is the same SQL in both, but for the inferred tables."""
    oracle = f"{sql or text} "
    for table, source in (("doc_labels", LABELS), ("doc_size", SIZES)):
        oracle = oracle.replace(f" {table} ", f" {source} ")
    query(name, oracle)(lambda spark, d: documents_engine(spark, d).execute(text))


def over_orders(name: str, text: str, sql: str | None = None):
    oracle = f"{sql or text} "
    for table, source in (("item_flags", FLAGS), ("items", LINES), ("order_tier", TIERS)):
        oracle = oracle.replace(f" {table} ", f" {source} ")
    query(name, oracle)(lambda spark, d: orders_engine(spark, d).execute(text))


# -- exact queries: lineage, staging, joins, subqueries

over_documents(
    "exact_filter_infer",
    "SELECT d.source, COUNT(*) AS n FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE q.quality = 1 AND d.n_chars > 500 GROUP BY d.source",
)
over_documents("exact_count_star", "SELECT COUNT(*) AS n FROM doc_labels l")
over_documents("exact_avg", "SELECT AVG(q.toxic) AS share, MIN(d.n_chars) AS least, MAX(d.n_chars) AS most FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id")
over_documents(
    "exact_agg_group",
    "SELECT s.size, COUNT(*) AS n, CAST(SUM(d.n_chars) AS BIGINT) AS chars, COUNT(DISTINCT d.source) AS sources FROM documents d JOIN doc_size s ON d.doc_id = s.doc_id GROUP BY s.size HAVING COUNT(*) > 1",
)
over_documents("infer_left_join", "SELECT d.doc_id, q.toxic FROM documents d LEFT JOIN doc_labels q ON d.doc_id = q.doc_id")
over_documents("infer_two_services", "SELECT d.doc_id, s.size, q.quality FROM documents d JOIN doc_size s ON d.doc_id = s.doc_id JOIN doc_labels q ON d.doc_id = q.doc_id WHERE s.size = 'long' AND q.quality = 1")
over_documents("comma_join", "SELECT d.doc_id, q.toxic FROM documents d, doc_labels q WHERE d.doc_id = q.doc_id AND d.lang = 'en'")
over_documents("right_join", "SELECT d.doc_id, q.toxic FROM doc_labels q RIGHT JOIN documents d ON d.doc_id = q.doc_id WHERE d.n_chars < 1000")
over_documents("nested_in_or_scalar", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM doc_labels WHERE toxic = 1) OR n_chars > (SELECT 3 * avg(n_chars) FROM documents)")
over_documents("nested_two_level", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM doc_labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM doc_size WHERE size = 'long'))")
over_documents("not_in_list", "SELECT d.doc_id FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE d.lang NOT IN ('en', 'fr') AND q.toxic IN (0)")
over_documents(
    "alias_in_where",
    "SELECT d.doc_id, d.n_chars AS chars, q.quality AS good FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE chars > 1000 AND good = 1",
    "SELECT d.doc_id, d.n_chars AS chars, q.quality AS good FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE d.n_chars > 1000 AND q.quality = 1",
)
over_documents("like_between_null", "SELECT d.doc_id, d.source FROM documents d LEFT JOIN doc_labels q ON d.doc_id = q.doc_id WHERE d.source LIKE 'src1%' AND d.n_chars BETWEEN 200 AND 4000 AND q.toxic IS NULL")
over_documents("cnf_or_and_not", "SELECT d.doc_id FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE (d.n_chars > 5000 OR (d.n_chars < 800 AND NOT d.lang = 'en')) AND NOT (q.toxic = 1 OR q.quality = 0)")
over_documents("case_in_where", "SELECT d.doc_id FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE CASE WHEN d.lang = 'en' THEN q.toxic ELSE q.quality END = 1")
over_documents("set_union_infer", "SELECT doc_id FROM doc_labels WHERE toxic = 1 UNION SELECT doc_id FROM doc_size WHERE size = 'long'")
over_documents("set_except_infer", "SELECT doc_id FROM doc_labels WHERE quality = 1 EXCEPT SELECT doc_id FROM doc_size WHERE size = 'short'")
over_documents("set_intersect_infer", "SELECT doc_id FROM doc_labels WHERE quality = 1 INTERSECT SELECT doc_id FROM doc_size WHERE size = 'middle'")
over_documents("cte_infer", "WITH bad AS (SELECT doc_id FROM doc_labels WHERE toxic = 1) SELECT d.lang, COUNT(*) AS n FROM documents d JOIN bad b ON d.doc_id = b.doc_id GROUP BY d.lang")
over_documents("derived_table", "SELECT t.lang, MAX(t.n) AS most FROM (SELECT d.lang, d.source, COUNT(*) AS n FROM documents d JOIN doc_size s ON d.doc_id = s.doc_id WHERE s.size = 'long' GROUP BY d.lang, d.source) t GROUP BY t.lang")
over_documents("window_over_infer", "SELECT d.doc_id, row_number() OVER (PARTITION BY s.size ORDER BY d.n_chars DESC, d.doc_id) AS place FROM documents d JOIN doc_size s ON d.doc_id = s.doc_id")
over_documents("distinct_expressions", "SELECT DISTINCT upper(d.lang) AS lang, s.size FROM documents d JOIN doc_size s ON d.doc_id = s.doc_id")
over_documents("rollup_infer", "SELECT d.lang, s.size, COUNT(*) AS n FROM documents d JOIN doc_size s ON d.doc_id = s.doc_id GROUP BY ROLLUP (d.lang, s.size)")
over_documents("exact_top", "SELECT d.doc_id, d.n_chars FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE q.toxic = 1 ORDER BY d.n_chars DESC, d.doc_id LIMIT 10 OFFSET 2")
over_documents("order_by_alias", "SELECT d.lang, COUNT(*) AS n FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id GROUP BY d.lang HAVING n > 2 ORDER BY n DESC")
over_documents("tuple_in", "SELECT d.doc_id FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE (q.quality, q.toxic) IN (SELECT quality, toxic FROM doc_labels WHERE toxic = 1)")
over_documents("ilike_infer", "SELECT d.doc_id, q.toxic FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE d.lang ILIKE 'E%' AND q.quality >= 1")
over_documents("full_join", "SELECT q.doc_id AS labelled, s.doc_id AS sized FROM doc_labels q FULL JOIN doc_size s ON q.doc_id = s.doc_id AND s.size = 'long'")
over_documents("exists_infer", "SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM doc_labels q WHERE q.doc_id = d.doc_id AND q.toxic = 1)")
over_orders("infer_chain", "SELECT f.flag, COUNT(*) AS n FROM orders o JOIN items i ON o.o_orderkey = i.l_orderkey JOIN item_flags f ON i.l_orderkey = f.f_orderkey AND i.l_linenumber = f.f_linenumber WHERE o.o_totalprice > 100000 AND i.l_quantity > 10 GROUP BY f.flag")
over_orders("infer_chain_only", "SELECT flag, COUNT(*) AS n FROM item_flags GROUP BY flag")
over_orders("infer_multi_table_input", "SELECT t.tier, COUNT(*) AS n FROM order_tier t JOIN orders o ON t.t_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY t.tier")
over_orders("infer_zero_output", "SELECT o.o_orderkey FROM orders o LEFT JOIN items i ON o.o_orderkey = i.l_orderkey WHERE i.l_orderkey IS NULL")
over_orders("join_left3", "SELECT c.c_mktsegment, COUNT(i.l_linenumber) AS lines, COUNT(DISTINCT o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN items i ON o.o_orderkey = i.l_orderkey GROUP BY c.c_mktsegment")
over_orders("per_blob_stats", "SELECT l_orderkey, SUM(l_quantity) AS q, COUNT(*) AS __num_items FROM items GROUP BY l_orderkey")
over_orders("blob_count", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'")


# -- user functions


def udf_engine(spark: SparkSession, d: str) -> Engine:
    e = orders_engine(spark, d)
    e.register_user_defined_function("greater", lambda a: a.max(axis=1), "double")
    e.register_user_defined_function("band", lambda a: [[int(v // 10), "high" if v > 25 else "low"] for v in a[0]], "tens int, word string")

    def series(a: pd.DataFrame) -> pd.DataFrame:
        rows = a.loc[a.index.repeat(a[0] % 4)]
        return pd.DataFrame({"k": rows.groupby(level=0).cumcount()}, index=pd.Index(rows.index.to_numpy()))

    e.register_user_defined_function("series", series, "k long")
    e.register_user_defined_function("is_even", lambda a: a[0] % 2 == 0, "boolean")

    async def waiting(a: pd.DataFrame) -> pd.Series:
        return a[0] * a[1]

    e.register_user_defined_function("times", waiting, "double")
    e.register_user_defined_function("one", lambda a: np.ones(len(a), dtype=int), "int")
    return e


def over_udfs(name: str, text: str, sql: str):
    query(name, f"{sql} ".replace(" items ", f" {LINES} "))(lambda spark, d: udf_engine(spark, d).execute(text))


over_udfs("udf_scalar", "SELECT l_orderkey, l_linenumber, GREATER(l_quantity, 20) AS g FROM items WHERE l_quantity > 5", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 20) AS g FROM items WHERE l_quantity > 5")
over_udfs("udf_compare", "SELECT l_orderkey FROM items WHERE greater(l_quantity, 30) = greater(l_quantity, l_linenumber) AND is_even(l_linenumber) = TRUE", "SELECT l_orderkey FROM items WHERE greatest(l_quantity, 30) = greatest(l_quantity, l_linenumber) AND l_linenumber % 2 = 0")
over_udfs("udf_multi_output", "SELECT l_orderkey, l_linenumber, band(l_quantity) AS (tens, word) FROM items", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) AS INTEGER) AS tens, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS word FROM items")
over_udfs("udf_unnamed_output", "SELECT l_orderkey, l_linenumber, band(l_quantity) FROM items WHERE band__1 = 'low'", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) AS INTEGER) AS band__0, 'low' AS band__1 FROM items WHERE l_quantity <= 25")
over_udfs("udf_table_valued", "SELECT l_orderkey, l_linenumber, series(l_linenumber) AS k FROM items", "SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber % 4)) AS k FROM items")
over_udfs("udf_filter_alias", "SELECT l_orderkey, times(l_quantity, 2) AS doubled FROM items WHERE doubled > 60", "SELECT l_orderkey, l_quantity * 2 AS doubled FROM items WHERE l_quantity * 2 > 60")
over_udfs("udf_no_argument", "SELECT l_orderkey, one() AS one FROM items WHERE l_quantity > 45", "SELECT l_orderkey, CAST(1 AS INTEGER) AS one FROM items WHERE l_quantity > 45")


@query("join_cross_udf", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE s.s_acctbal > 5000")
def join_cross_udf(spark: SparkSession, d: str) -> DataFrame:
    return pairs_engine(spark, d).execute("SELECT c.c_custkey, s.s_suppkey FROM customer c CROSS JOIN supplier s WHERE same(c.c_nationkey, s.s_nationkey) = TRUE AND s.s_acctbal > 5000")


@query("udf_join_on", "SELECT c.c_mktsegment, COUNT(*) AS n FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal GROUP BY c.c_mktsegment")
def udf_join_on(spark: SparkSession, d: str) -> DataFrame:
    e = pairs_engine(spark, d)
    found = e.execute("SELECT c.c_mktsegment, c.c_custkey FROM customer c JOIN supplier s ON same(c.c_nationkey, s.s_nationkey) = TRUE AND c.c_acctbal < s.s_acctbal")
    return found.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "composite_keys",
    """SELECT c.role, CASE WHEN length(c.text) > 200 THEN 'long' ELSE 'short' END AS kind, COUNT(*) AS n FROM conversations c WHERE c.turn < 5 GROUP BY ALL""",
)
def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Blobs with a key of two columns."""
    e = Engine(spark)
    e.register_blob_table("conversations", _read(spark, d, "conversations"), ["conv_id", "turn"])
    e.register_output_table("turn_kinds", "conv_id long, turn long, kind string", ["conv_id", "turn"], {"conv_id": "conversations.conv_id", "turn": "conversations.turn"})
    e.register_inference_service(FunctionService("kinder", lambda r: pd.DataFrame({"k": np.where(r.iloc[:, 2].str.len() > 200, "long", "short")})))
    keys = {"conversations.conv_id": "turn_kinds.conv_id", "conversations.turn": "turn_kinds.turn"}
    e.bind_inference_service("kinder", (["conversations.conv_id", "conversations.turn", "conversations.text"], ["turn_kinds.kind"]), keys)
    return e.execute("SELECT c.role, k.kind, COUNT(*) AS n FROM conversations c JOIN turn_kinds k ON c.conv_id = k.conv_id AND c.turn = k.turn WHERE k.turn < 5 GROUP BY c.role, k.kind")


def _post(url: str, headers: dict, body: dict) -> list[dict]:
    """Stands for a model server: tags for each event."""
    return [{"result": {"tags": [{"name": kind}, {"name": "big"}] if value > 50 else [{"name": kind}]}} for kind, value in zip(body["kinds"], body["values"])]


@query("http_service", "SELECT tag, COUNT(*) AS n FROM (SELECT event_type AS tag FROM events UNION ALL SELECT 'big' FROM events WHERE value > 50) GROUP BY tag")
def http_service(spark: SparkSession, d: str) -> DataFrame:
    """A service that posts JSON and reads any number of rows from a list in the answer."""
    e = Engine(spark)
    e.register_blob_table("events", _read(spark, d, "events"), ["event_id"])
    e.register_output_table("event_tags", "event_id long, tag string", ["event_id"], {"event_id": "events.event_id"})
    service = HTTPService("tagger", "http://models/tags", [("ids",), ("kinds",), ("values",)], [("result", "tags", ANY, "name")], batch=True, transport=_post)
    e.register_inference_service(service)
    e.bind_inference_service("tagger", (["events.event_id", "events.event_type", "events.value"], ["event_tags.tag"]), {"events.event_id": "event_tags.event_id"})
    return e.execute("SELECT tag, COUNT(*) AS n FROM event_tags GROUP BY tag")


def pairs_engine(spark: SparkSession, d: str) -> Engine:
    e = Engine(spark)
    e.register_blob_table("customer", _read(spark, d, "customer"), ["c_custkey"])
    e.register_blob_table("supplier", _read(spark, d, "supplier"), ["s_suppkey"])
    e.register_user_defined_function("same", lambda a: a[0] == a[1], "boolean")
    return e


# -- caching


@query(
    "cache_reuse",
    """SELECT 1 AS step, count(*) AS sent FROM documents WHERE n_chars < 1000
    UNION ALL SELECT 2, count(*) FROM documents WHERE n_chars >= 1000 AND n_chars < 2000 UNION ALL SELECT 3, 0""",
)
def cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Rows sent to a service by queries that overlap, and by one that is repeated."""
    e = documents_engine(spark, d)
    counts, before = [], 0
    for most in (1000, 2000, 2000):
        e.execute(f"SELECT d.doc_id, q.toxic FROM documents d JOIN doc_labels q ON d.doc_id = q.doc_id WHERE d.n_chars < {most}")
        counts.append(e.rows_sent["labeler"] - before)
        before = e.rows_sent["labeler"]
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(counts)], "step int, sent long")


@query("infer_results", f"SELECT doc_id AS \"documents.doc_id\", quality AS \"doc_labels.quality\", toxic AS \"doc_labels.toxic\", doc_id AS \"doc_labels.doc_id\" FROM {LABELS}")
def infer_results(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of a service for given inputs, some of them seen before."""
    e = documents_engine(spark, d)
    docs = _read(spark, d, "documents")
    e.inference.infer("labeler", docs.where("lang = 'en'").select("doc_id"))
    return e.inference.infer("labeler", docs.select("doc_id"), return_results=True)


# -- approximate aggregates


PILOT, PILOT_PAIRS = approx.PILOT, approx.PILOT_PAIRS


def _estimates(found: DataFrame, items: list[str]) -> DataFrame:
    """The estimates themselves, how many blobs they rest on, and of how many."""
    r = found.first()
    rows = [(i, round(r[i], 2), int(r["n_sampled"]), int(r["n_population"]), bool(r["exact"])) for i in items]
    return found.sparkSession.createDataFrame(rows, "item string, estimate double, n_sampled long, n_population long, exact boolean")


def _estimate_sql(sampled: str, size: str, pilot: int, items: int, error: float, few: int) -> str:
    """The whole estimate in SQL: moments of the pilot, Bennett's bound by Newton steps, the sample's size, the estimate.

    ``sampled`` gives ``r`` (a draw's number from 1), ``item`` and ``v``; ``size`` the population; quantiles of the pilot's
    fixed size are numbers. Up to ``few`` it is exact.
    """
    delta = 0.05 / items
    chi, z, ln = stats.chi2_ppf(delta / 2, pilot - 1), stats.normal_ppf(delta / 2), math.log(2 / delta)
    return f"""x AS ({sampled}), n AS ({size}),
    m AS (SELECT item, sum(v) / {pilot} AS mean, max(abs(v)) AS a, greatest(sum(v * v) / {pilot} - (sum(v) / {pilot}) ** 2, 0) * {pilot - 1} / {chi!r} AS var
          FROM x WHERE r <= {pilot} GROUP BY item),
    u AS (SELECT item, 0 AS k, sqrt(2 * y) + y AS u, y FROM (SELECT item, a * a * {ln!r} / ({pilot} * var) AS y FROM m)
          UNION ALL SELECT item, k + 1, u - ((1 + u) * ln(1 + u) - u - y) / ln(1 + u), y FROM u WHERE k < 40),
    need AS (SELECT max(1 + floor(({z!r} * sqrt(var) / ({error!r} * (abs(mean) - var / a * u))) ** 2)) AS more, min(abs(mean) - var / a * u) AS low FROM m JOIN u USING (item) WHERE k = 40),
    size AS (SELECT n, CASE WHEN n <= {few} OR coalesce(low, 0) <= 0 OR more + {pilot} >= n THEN n ELSE {pilot} + greatest({approx.LEAST}, more) END AS t FROM n, need)"""


def _approx(name: str, text: str, items: dict[str, str], error: float, source: str):
    """``items``: what each blob contributes, in SQL over ``source``."""
    names = ", ".join(f"'{i}'" for i in items)
    sampled = f"""SELECT p.r, unnest([{names}]) AS item, unnest([{", ".join(f"x{k}" for k in range(len(items)))}]) AS v
        FROM (SELECT l_orderkey AS key, {", ".join(f"CAST({v} AS DOUBLE) AS x{k}" for k, v in enumerate(items.values()))} FROM {source} GROUP BY 1)
        JOIN (SELECT o_orderkey AS key, row_number() OVER (ORDER BY md5('1234:' || o_orderkey), o_orderkey) AS r FROM orders) p USING (key)"""
    sql = f"""WITH RECURSIVE {_estimate_sql(sampled, "SELECT CAST(count(*) AS DOUBLE) AS n FROM orders", PILOT, len(items), error / 100, PILOT + approx.LEAST)}
    SELECT item, round(CASE WHEN t = n THEN sum(v) ELSE sum(v) FILTER (r <= t) / t * n END, 2) AS estimate, CAST(t AS BIGINT) AS n_sampled,
           CAST(n AS BIGINT) AS n_population, t = n AS exact FROM x, size GROUP BY item, t, n"""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _estimates(orders_engine(spark, d).execute(f"{text} ERROR_TARGET {error:g}% CONFIDENCE 95%"), list(items))


_approx("approx_sum", "SELECT SUM(l_quantity) AS total FROM items", {"total": "sum(l_quantity)"}, 10, LINES)
_approx("approx_count", "SELECT COUNT(*) AS n FROM orders o JOIN items i ON o.o_orderkey = i.l_orderkey WHERE i.l_quantity > 10", {"n": "count(*)"}, 10, f"{LINES} WHERE l_quantity > 10")
_approx(
    "approx_multi",
    "SELECT SUM(l_extendedprice) AS price, SUM(l_quantity) AS total, COUNT(*) AS n FROM items",
    {"price": "sum(l_extendedprice)", "total": "sum(l_quantity)", "n": "count(*)"}, 10, LINES,
)


@query("approx_avg")
def approx_avg(spark: SparkSession, d: str) -> DataFrame:
    """An average's sample depends on quantiles for as many rows as the pilot happens to have, which SQL can't tell; tests
    hold it to the exact average."""
    return orders_engine(spark, d).execute("SELECT AVG(l_quantity) AS mean FROM items ERROR_TARGET 5% CONFIDENCE 95%")


@query("approx_agg_fallback", "SELECT CAST(sum(s_acctbal) AS DOUBLE) AS total, TRUE AS exact FROM supplier")
def approx_agg_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Few blobs: the engine runs exactly."""
    found = pairs_engine(spark, d).execute("SELECT SUM(s_acctbal) AS total FROM supplier ERROR_TARGET 5% CONFIDENCE 95%")
    return found.select("total", "exact")


_DRAWN = "CAST(floor(CAST('0x' || substr(md5('1234:{salt}:' || id), 1, 13) AS BIGINT) / 4503599627370496.0 * {size}) AS BIGINT)"


@query(
    "approx_join_count",
    f"""WITH RECURSIVE s AS (SELECT (SELECT count(*) FROM customer) AS na, (SELECT count(*) FROM supplier) AS nb),
    {_estimate_sql(
        f"""SELECT id + 1 AS r, 'n' AS item, CAST(1 AS DOUBLE) AS v
        FROM (SELECT id, {_DRAWN.format(salt=1, size="na")} AS i, {_DRAWN.format(salt=2, size="nb")} AS j FROM (SELECT unnest(range(na * nb)) AS id, na, nb FROM s))
        JOIN (SELECT c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) USING (i)
        JOIN (SELECT s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS j FROM supplier) USING (j) WHERE c_nationkey = s_nationkey""",
        "SELECT CAST(na * nb AS DOUBLE) AS n FROM s", PILOT_PAIRS, 1, 0.1, PILOT_PAIRS)}
    SELECT 'n' AS item, round(CASE WHEN t = n THEN (SELECT count(*) FROM customer JOIN supplier ON c_nationkey = s_nationkey) ELSE (SELECT sum(v) FROM x WHERE r <= t) / t * n END, 2) AS estimate,
           CAST(t AS BIGINT) AS n_sampled, CAST(n AS BIGINT) AS n_population, t = n AS exact FROM size""",
)
def approx_join_count(spark: SparkSession, d: str) -> DataFrame:
    found = pairs_engine(spark, d).execute("SELECT COUNT(*) AS n FROM customer c CROSS JOIN supplier s WHERE same(c.c_nationkey, s.s_nationkey) = TRUE ERROR_TARGET 10% CONFIDENCE 95%")
    return _estimates(found, ["n"])


# -- proxies, recall targets, limits


@query("approx_select_recall")
def approx_select_recall(spark: SparkSession, d: str) -> DataFrame:
    """The rows found; which ones depends on draws. Tests hold their share of all to the target."""
    return vectors_engine(spark, d).execute("SELECT vec_id, label FROM vec_labels WHERE label = 3 RECALL_TARGET 90% CONFIDENCE 95%")


@query("limit_proxy", "SELECT label, least(10, count(*)) AS n FROM embeddings WHERE label = 4 GROUP BY label")
def limit_proxy(spark: SparkSession, d: str) -> DataFrame:
    found = vectors_engine(spark, d).execute("SELECT vec_id, label FROM vec_labels WHERE label = 4 LIMIT 10")
    return found.groupBy("label").agg(F.count_distinct("vec_id").alias("n"))


@query("limit_plain", "SELECT least(10, count(*)) AS n FROM labels SEMI JOIN documents USING (doc_id) WHERE toxic = 1")
def limit_plain(spark: SparkSession, d: str) -> DataFrame:
    """Without an index a limit is an exact query."""
    return documents_engine(spark, d).execute("SELECT doc_id FROM doc_labels WHERE toxic = 1 LIMIT 10").agg(F.count(F.lit(1)).alias("n"))


@query("ordering_by_selectivity", "SELECT vec_id, label, shade FROM (SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS shade FROM embeddings) WHERE label = 2 AND shade = 'even'")
def ordering_by_selectivity(spark: SparkSession, d: str) -> DataFrame:
    """Two services decide a condition each; the cheaper and more selective one runs first."""
    e = vectors_engine(spark, d)
    vectors = _read(spark, d, "embeddings")
    e.register_output_table("vec_shades", "vec_id long, shade string", ["vec_id"], {"vec_id": "vectors.vec_id"})
    shades = vectors.select("vec_id", F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("shade"))
    e.register_inference_service(FrameService("shader", shades, ["vec_id"], ["shade"], cost=5.0))
    e.bind_inference_service("shader", (["vectors.vec_id"], ["vec_shades.shade"]), {"vectors.vec_id": "vec_shades.vec_id"})
    return e.execute("SELECT v.vec_id, l.label, s.shade FROM vectors v JOIN vec_labels l ON v.vec_id = l.vec_id JOIN vec_shades s ON v.vec_id = s.vec_id WHERE l.label = 2 AND s.shade = 'even'")


REPS = 12
_WIDE = "[CAST(x AS DOUBLE) FOR x IN {}.embedding]"


def _farthest_sql(n: int) -> str:
    """Farthest points from the least id on, one step after the other."""
    steps = ["c1 AS (SELECT min(vec_id) AS id FROM embeddings)"]
    for k in range(1, n):
        near = f"list_distance({_WIDE.format('e')}, {_WIDE.format('c')})"
        before = f"least(d, {near})" if k > 1 else near
        source = f"d{k - 1} e" if k > 1 else "embeddings e"
        steps.append(f"d{k} AS (SELECT e.vec_id, e.embedding, {before} AS d FROM {source}, embeddings c WHERE c.vec_id = (SELECT id FROM c{k}))")
        steps.append(f"c{k + 1} AS (SELECT vec_id AS id FROM d{k} ORDER BY d DESC, vec_id LIMIT 1)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {k} AS step, id FROM c{k}" for k in range(1, n + 1))


@query("fpf_reps", f"SELECT id FROM ({_farthest_sql(REPS)})")
def fpf_reps(spark: SparkSession, d: str) -> DataFrame:
    """Farthest points, from a given first one."""
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    first = vectors.agg(F.min("id")).first()[0]
    index = ProxyIndex(vectors, buckets=REPS, share=1.0, first=(first,))
    return spark.createDataFrame(pd.DataFrame({"id": index.representatives().astype("int64")}))


@query(
    "proxy_scores",
    f"""WITH r AS (SELECT * FROM embeddings WHERE vec_id % 10 = 0), near AS (
      SELECT e.vec_id, r.vec_id AS rep, CAST(r.label = 3 AS INT) AS own, list_distance({_WIDE.format("e")}, {_WIDE.format("r")}) AS d FROM embeddings e, r
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, rep) AS place FROM near), five AS (SELECT *, d + 1e-8 AS w FROM ranked WHERE place <= 5)
    SELECT vec_id, round(coalesce(max(own) FILTER (rep = vec_id), (sum(w) * sum(own) - sum(own * w)) / ((count(*) - 1) * sum(w))), 6) AS score FROM five GROUP BY vec_id""",
)
def proxy_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score between 0 and 1 for each vector, from given representatives; those have their own."""
    e = vectors_engine(spark, d)
    e.index.index.set_representatives(_read(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("id")))
    text = "SELECT vec_id FROM vec_labels WHERE label = 3"
    return approx.proxy_scores(e, text, e.analysis(text)).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(
    "vector_topk",
    """SELECT query, CAST(rank AS INTEGER) AS rank, id FROM (
    SELECT q.vec_id AS query, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding, c.embedding) ** 2, 5), c.vec_id) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0) WHERE rank <= 3""",
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of each vector whose id is divisible by 20, among all."""
    store = VectorStore(spark)
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    store.create_index("v", vectors)
    return store.search("v", vectors.where("id % 20 = 0"), 3).select("query", "rank", "id")


@query("vector_ivf", SQL["vector_topk"])
def vector_ivf(spark: SparkSession, d: str) -> DataFrame:
    """The same from an inverted file whose cells are all searched; tests measure the recall of fewer."""
    store = VectorStore(spark)
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    store.create_index("v", vectors, kind="ivf", cells=16, probes=16)
    return store.search("v", vectors.where("id % 20 = 0"), 3).select("query", "rank", "id")


@query(
    "vector_filtered",
    """SELECT query, id FROM (
    SELECT q.vec_id AS query, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.embedding, c.embedding), 6), c.vec_id) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.label = 3) WHERE rank <= 4""",
)
def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    """By cosine, among the vectors that a condition keeps."""
    store = VectorStore(spark)
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    store.create_index("v", vectors, "cosine")
    return store.search("v", vectors.where("id % 20 = 0"), 4, where="label = 3").select("query", "id")


@query(
    "vector_upsert",
    """SELECT vec_id AS id, CASE WHEN label >= 6 THEN 'third' WHEN label >= 3 THEN 'second' ELSE 'first' END AS load FROM embeddings""",
)
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors come in three overlapping loads; the last of each id stays."""
    store = VectorStore(spark)
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    load = lambda condition, name: vectors.where(condition).withColumn("load", F.lit(name))
    store.create_index("v", load("label < 6", "first"))
    store.insert_data("v", load("label >= 3", "second"), upsert=True)
    store.insert_data("v", load("label >= 6", "third"), upsert=True)
    return store.data["v"].select("id", "load")


@query("blob_numbers", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents")
def blob_numbers(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id")
    return indexed(docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id"), "number")


@query(
    "predicate_cnf",
    """SELECT unnest([0, 1, 2, 3]) AS clause, unnest(['NOT a <= 800', 'NOT a >= 300', 'x > 500 OR y < 250', 'x > 500 OR y > 750']) AS atoms""",
)
def predicate_cnf(spark: SparkSession, d: str) -> DataFrame:
    clauses = where_clauses(spark, "(x > 500 OR (y < 250 AND y > 750)) AND NOT (b >= 300 OR b <= 800)", {"b": "a"})
    plain = sorted(" OR ".join(a.replace("(", "").replace(")", "") for a in c) for c in clauses)
    return spark.createDataFrame(list(enumerate(plain)), "clause int, atoms string")
