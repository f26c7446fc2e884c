"""The operators over the driver's tables, by key, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import documents as docs_fn, geo
from .functions.text import code_parts, composed, equal_but_for_case, similarity, trigrams
from .model.catalog import catalog
from .model.defs import Reference
from .operators import boxes, graph, ranking, reconcile, referential, search, temporal, textindex, trees, versions
from .plans.lineage import shared_folder
from .rules import keys, runner, templates
from .sources import stored
from .sources.tables import captured, driver_table as t
from .streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Checks.


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), true)")
def ck_enum(spark, sf):
    return t(spark, sf, "orders").filter(templates.enum("o_orderstatus", ["O", "F"])).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.07, true) OR NOT coalesce(l_tax <= 0.06, true)")
def ck_range(spark, sf):
    broken = templates.in_range("l_discount", 0.0, 0.07) | templates.in_range("l_tax", high=0.06)
    return t(spark, sf, "lineitem").filter(broken).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT coalesce(l_shipdate >= o_orderdate, true)")
def ck_ordered(spark, sf):
    both = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.filter(templates.ordered("o_orderdate", "l_shipdate")).select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


@query("SELECT doc_id, source FROM documents WHERE NOT coalesce(regexp_matches(source, '^src[0-9]$'), true)")
def ck_regex(spark, sf):
    return t(spark, sf, "documents").filter(templates.regex("source", r"^src[0-9]\z")).select("doc_id", "source")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT coalesce(c_custkey <> c_nationkey, true)")
def ck_not_same(spark, sf):
    return t(spark, sf, "customer").filter(templates.not_same("c_custkey", "c_nationkey")).select("c_custkey", "c_nationkey")


@query("SELECT doc_id FROM documents WHERE nullif(lang, 'en') IS NULL AND nullif(source, 'src1') IS NULL")
def ck_at_least_one(spark, sf):
    return t(spark, sf, "documents").filter(templates.at_least_one(F.nullif("lang", F.lit("en")), F.nullif("source", F.lit("src1")))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE nullif(lang, 'en') IS NOT NULL AND nullif(source, 'src1') IS NOT NULL")
def ck_at_most_one(spark, sf):
    return t(spark, sf, "documents").filter(templates.at_most_one(F.nullif("lang", F.lit("en")), F.nullif("source", F.lit("src1")))).select("doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce((o_orderstatus = 'F') = (CASE WHEN o_totalprice > 150000 THEN o_totalprice END IS NOT NULL), true)")
def ck_iff(spark, sf):
    return t(spark, sf, "orders").filter(templates.iff(F.col("o_orderstatus") == "F", F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice")))).select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, length(source)::INTEGER AS n FROM documents WHERE NOT coalesce(length(source) <= 4, true)")
def ck_length(spark, sf):
    return t(spark, sf, "documents").filter(templates.too_long("source", 4)).select("doc_id", F.length("source").alias("n"))


@query("""
SELECT 'user_id' AS column_name, count(*) FILTER (nullif(user_id, 7) IS NULL) AS nulls FROM events UNION ALL
SELECT 'event_type', count(*) FILTER (nullif(event_type, 'click') IS NULL) FROM events UNION ALL
SELECT 'value', count(*) FILTER (value IS NULL) FROM events""")
def nn_report(spark, sf):
    rules = {"user_id": F.nullif("user_id", F.lit(7)).isNull(), "event_type": F.nullif("event_type", F.lit("click")).isNull(), "value": F.col("value").isNull()}
    return runner.report(t(spark, sf, "events"), rules, "events").select(F.col("rule").alias("column_name"), F.col("violations").alias("nulls"))


@query("SELECT doc_id, lang, true AS is_active, 'unreviewed' AS validation_status FROM documents")
def default_fill(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang")
    return runner.filled(rows, {"lang": F.lit("und"), "is_active": F.lit(True), "validation_status": F.lit("unreviewed")})


@query("SELECT doc_id, 'current' AS currency_status, 'unreviewed' AS validation_status, 1::INTEGER AS row_version, '2026-01-02 03:04:05' AS created_at, '2026-01-02 03:04:05' AS updated_at FROM documents")
def catalog_defaults(spark, sf):
    """What core.resource declares for columns that a load lacks, by a clock that stands still."""
    rows = runner.filled(t(spark, sf, "documents").select("doc_id"), runner.defaults_of(catalog()["core.resource"], F.lit("2026-01-02 03:04:05").cast("timestamp")))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")})


@query("""
SELECT 'order_status_known' AS rule, 'orders' AS table_name, count(*) FILTER (NOT coalesce(o_orderstatus IN ('O', 'F'), true)) AS violations FROM orders UNION ALL
SELECT 'order_price_positive', 'orders', count(*) FILTER (NOT coalesce(o_totalprice >= 0, true)) FROM orders UNION ALL
SELECT 'discount_range', 'lineitem', count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 0.07, true)) FROM lineitem UNION ALL
SELECT 'tax_range', 'lineitem', count(*) FILTER (NOT coalesce(l_tax <= 0.06, true)) FROM lineitem UNION ALL
SELECT 'shipped_after_order', 'lineitem+orders', count(*) FILTER (NOT coalesce(l_shipdate >= o_orderdate, true)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def ck_report(spark, sf):
    orders, lines = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_shipdate", "o_orderdate")
    parts = [
        runner.report(orders, {"order_status_known": templates.enum("o_orderstatus", ["O", "F"]), "order_price_positive": templates.in_range("o_totalprice", 0)}, "orders"),
        runner.report(lines, {"discount_range": templates.in_range("l_discount", 0.0, 0.07), "tax_range": templates.in_range("l_tax", high=0.06)}, "lineitem"),
        runner.report(both, {"shipped_after_order": templates.ordered("o_orderdate", "l_shipdate")}, "lineitem+orders"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT coalesce(l_discount BETWEEN 0 AND 0.07, true) THEN 'discount_range' END, CASE WHEN NOT coalesce(l_tax <= 0.06, true) THEN 'tax_range' END) AS broken
FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.07, true) OR NOT coalesce(l_tax <= 0.06, true)""")
def ck_quarantine(spark, sf):
    rules = {"discount_range": templates.in_range("l_discount", 0.0, 0.07), "tax_range": templates.in_range("l_tax", high=0.06)}
    bad = runner.parted(t(spark, sf, "lineitem"), rules)[1]
    return bad.select("l_orderkey", "l_linenumber", F.array_join("broken_rules", ",").alias("broken"))


@query("SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN NULL ELSE value END AS value, CASE WHEN event_type = 'purchase' THEN NULL ELSE props END AS props FROM events")
def mask_sensitive(spark, sf):
    rows = t(spark, sf, "events").select("event_id", "event_type", "value", "props")
    return runner.masked(rows, F.coalesce(F.col("event_type") == "purchase", F.lit(False)), ["value", "props"])


# Unique keys.


@query("SELECT sha256(text) AS text_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def uq_single(spark, sf):
    return keys.repeated(t(spark, sf, "documents"), {"text_hash": F.sha2("text", 256)})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def uq_composite(spark, sf):
    return keys.repeated(t(spark, sf, "lineitem"), {c: F.col(c) for c in ("l_orderkey", "l_linenumber")})


@query("SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey, count(*) AS n FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def uq_nullable(spark, sf):
    return keys.repeated(t(spark, sf, "customer"), {"segment": F.nullif("c_mktsegment", F.lit("BUILDING")), "c_nationkey": F.col("c_nationkey")})


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1")
def uq_partial(spark, sf):
    return keys.repeated(t(spark, sf, "events"), {"user_id": F.col("user_id")}, F.col("event_type") == "signup")


@query("SELECT lower(p_name) AS name_key, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def uq_expr(spark, sf):
    return keys.repeated(t(spark, sf, "part"), {"name_key": F.lower("p_name")})


# References.


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def fk_dangling(spark, sf):
    parent = t(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return keys.dangling(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parent, "c_custkey")


@query("""
SELECT 'orders.o_custkey' AS reference, count(o_custkey) AS checked, count(*) FILTER (o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)) AS dangling FROM orders UNION ALL
SELECT 'lineitem.l_partkey', count(l_partkey), count(*) FILTER (l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)) FROM lineitem UNION ALL
SELECT 'labels.doc_id', count(doc_id), count(*) FILTER (doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) FROM labels""")
def fk_report(spark, sf):
    a = keys.dangling_count(t(spark, sf, "orders"), "o_custkey", t(spark, sf, "customer"), "c_custkey", "orders.o_custkey")
    b = keys.dangling_count(t(spark, sf, "lineitem"), "l_partkey", t(spark, sf, "part").filter("p_size <= 40"), "p_partkey", "lineitem.l_partkey")
    c = keys.dangling_count(t(spark, sf, "labels"), "doc_id", t(spark, sf, "documents").filter("lang = 'en'"), "doc_id", "labels.doc_id")
    return a.unionByName(b).unionByName(c)


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_childless(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_has_child(spark, sf):
    urgent = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_semi")


_EDGES = [
    Reference("nation", "n_regionkey", "region", "C"), Reference("customer", "c_nationkey", "nation", "C"),
    Reference("supplier", "s_nationkey", "nation", "N"), Reference("orders", "o_custkey", "customer", "R"),
]
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


def _deletion(spark, sf):
    tables = {n: t(spark, sf, n) for n in _KEYS}
    return referential.plan(tables, _KEYS, _EDGES, "region", tables["region"].filter("r_regionkey = 1").select("r_regionkey"))


@query("""
SELECT 'region' AS table_name, r_regionkey::BIGINT AS key FROM region WHERE r_regionkey = 1 UNION ALL
SELECT 'nation', n_nationkey::BIGINT FROM nation WHERE n_regionkey = 1 UNION ALL
SELECT 'customer', c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def ref_cascade(spark, sf):
    parts = [d.select(F.lit(name).alias("table_name"), F.col("key").cast("long").alias("key")) for name, d in _deletion(spark, sf).doomed.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)")
def ref_restrict(spark, sf):
    return _deletion(spark, sf).blocked[_EDGES[3]]


@query("SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier")
def ref_set_null(spark, sf):
    gone = t(spark, sf, "nation").filter("n_regionkey = 1")
    return referential.null_where_gone(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", gone, "n_nationkey")


# Joins.


@query("SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey")
def join_fk_inner(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderstatus")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_fk_left(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_subtype(spark, sf):
    return t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")


@query("SELECT p_brand, s_nationkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def join_bridge(spark, sf):
    bridge = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    both = bridge.join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"))


@query("SELECT c.p_partkey, p.p_partkey AS parent_key, p.p_name AS parent_name FROM part c JOIN part p ON p.p_partkey = c.p_partkey // 2")
def join_self_parent(spark, sf):
    part = t(spark, sf, "part")
    parent = part.select(F.col("p_partkey").alias("parent_key"), F.col("p_name").alias("parent_name"))
    return part.select("p_partkey", F.floor(F.col("p_partkey") / 2).cast("long").alias("parent_key")).join(parent, "parent_key").select("p_partkey", "parent_key", "parent_name")


_SPANS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS valid_from, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL 60 DAY END AS valid_to FROM orders"


def _spans(spark, sf):
    """Orders as validity intervals, some of them open."""
    return t(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("valid_from"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("valid_to"),
    )


@query(f"SELECT o_orderkey, c_name FROM ({_SPANS}) JOIN customer ON o_custkey = c_custkey WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1996-06-15') AND (valid_to IS NULL OR TIMESTAMP '1996-06-15' <= valid_to)")
def join_valid_at(spark, sf):
    at = F.lit("1996-06-15").cast("timestamp_ntz")
    rows = _spans(spark, sf).filter(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), at))
    return rows.join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(f"""
WITH s AS ({_SPANS})
SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey
WHERE (x.valid_from IS NULL OR y.valid_to IS NULL OR x.valid_from <= y.valid_to) AND (y.valid_from IS NULL OR x.valid_to IS NULL OR y.valid_from <= x.valid_to)""")
def join_overlap(spark, sf):
    return temporal.overlapping(_spans(spark, sf), "o_custkey", "o_orderkey", "valid_from", "valid_to")


@query(f"""
WITH s AS ({_SPANS}), e AS (SELECT event_id, user_id, ts - to_days((8200 + event_id % 2400)::INTEGER) AS moment FROM events)
SELECT o_orderkey, event_id FROM s JOIN e ON user_id = o_custkey WHERE (valid_from IS NULL OR valid_from <= moment) AND (valid_to IS NULL OR moment <= valid_to)""")
def join_valid_moments(spark, sf):
    """The orders that were valid at the moment of each event of their customer, moments being spread over the years of the orders."""
    back = F.make_dt_interval((F.lit(8200) + F.col("event_id") % 2400).cast("int"))
    moments = t(spark, sf, "events").select("event_id", "user_id", (F.col("ts") - back).alias("moment"))
    return temporal.covering(_spans(spark, sf), "o_custkey", "valid_from", "valid_to", moments, "user_id", "moment").select("span.o_orderkey", "point.event_id")


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS c_id, user_id, ts AS c_ts, value FROM events WHERE event_type = 'click'),
r AS (SELECT p.event_id, p.user_id, p.ts, c.value, c.c_ts, row_number() OVER (PARTITION BY p.event_id ORDER BY c_ts DESC NULLS LAST, c_id DESC NULLS LAST) AS n FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.c_ts <= p.ts)
SELECT event_id, user_id, ts, value AS as_of_value, c_ts AS as_of_click_ts FROM r WHERE n = 1""")
def join_asof(spark, sf):
    events = t(spark, sf, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"), "value")
    return temporal.as_of(left, right, "user_id", "ts", "click_ts", "value", "click_id")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AS kind, CASE WHEN event_id % 2 = 0 THEN event_id % 150 ELSE event_id % 10 END + 1 AS target FROM events)
SELECT event_id, kind, coalesce(c_name, s_name) AS name FROM e LEFT JOIN customer ON kind = 'customer' AND c_custkey = target LEFT JOIN supplier ON kind = 'supplier' AND s_suppkey = target""")
def join_polymorphic(spark, sf):
    even = F.col("event_id") % 2 == 0
    edges = t(spark, sf, "events").select("event_id", F.when(even, "customer").otherwise("supplier").alias("kind"), (F.when(even, F.col("event_id") % 150).otherwise(F.col("event_id") % 10) + 1).alias("target"))
    names = t(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("target"), F.col("c_name").alias("name"))
    names = names.unionByName(t(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("target"), F.col("s_name").alias("name")))
    return edges.join(names, ["kind", "target"], "left").select("event_id", "kind", "name")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS pk, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS sk FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(p_name, s_name) AS target_name FROM l LEFT JOIN part ON pk = p_partkey LEFT JOIN supplier ON sk = s_suppkey WHERE pk IS NOT NULL OR sk IS NOT NULL""")
def join_either(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("p_partkey"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey")).alias("s_suppkey"))
    rows = rows.filter("p_partkey is not null or s_suppkey is not null")
    both = rows.join(t(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "left").join(t(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
    return both.select("l_orderkey", "l_linenumber", F.coalesce("p_name", "s_name").alias("target_name"))


_TRIGRAMS_SQL = """
WITH n AS (SELECT DISTINCT item_id AS k, lower(text) AS s FROM benchmark),
w AS (SELECT k, unnest(regexp_split_to_array(s, '[^a-z0-9]+')) AS w FROM n),
g AS (SELECT DISTINCT k, substring('  ' || w || ' ', i::BIGINT, 3) AS t FROM w, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i) WHERE w <> ''),
c AS (SELECT k, count(*) AS n FROM g GROUP BY k)
"""


@query(_TRIGRAMS_SQL + """
SELECT x.k AS a_id, y.k AS b_id, round(count(*) / (cx.n + cy.n - count(*)), 9) AS similarity FROM g x JOIN g y ON x.t = y.t AND x.k < y.k JOIN c cx ON cx.k = x.k JOIN c cy ON cy.k = y.k
GROUP BY x.k, y.k, cx.n, cy.n HAVING count(*) / (cx.n + cy.n - count(*)) >= 0.3""")
def join_trigram(spark, sf):
    rows = t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return search.similar(rows, "id", "text", least=0.3, separators="[^a-z0-9]+").withColumn("similarity", F.round("similarity", 9))


@query("SELECT vec_id, label FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN 0.0 AND 0.2")
def bbox_range(spark, sf):
    boxes = spark.createDataFrame([(1, -0.1, 0.0, 0.1, 0.2)], "box int, west double, south double, east double, north double")
    points = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return search.points_in_boxes(points, "x", "y", F.broadcast(boxes), 0.1).select("vec_id", "label")


_BOXES = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (abs(embedding[3]) / (CASE WHEN vec_id % 50 = 0 THEN 1 ELSE 20 END))::DOUBLE AS r FROM embeddings"


def _places(spark, sf):
    """Points with a reach: mostly small, some wide."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return t(spark, sf, "embeddings").select("vec_id", e(0).alias("x"), e(1).alias("y"), (F.abs(F.col("embedding")[2]) / F.when(F.col("vec_id") % 50 == 0, 1).otherwise(20)).cast("double").alias("r"), e(3).alias("x2"), e(4).alias("y2"))


@query(f"WITH b AS ({_BOXES}) SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM b a JOIN b ON a.vec_id < b.vec_id AND a.x - a.r <= b.x + b.r AND b.x - b.r <= a.x + a.r AND a.y - a.r <= b.y + b.r AND b.y - b.r <= a.y + a.r")
def boxes_intersect(spark, sf):
    p = _places(spark, sf).select("vec_id", *(f.alias(n) for n, f in (("west", F.col("x") - F.col("r")), ("south", F.col("y") - F.col("r")), ("east", F.col("x") + F.col("r")), ("north", F.col("y") + F.col("r")))))
    return boxes.meeting(p, p).select(F.col("a.vec_id").alias("a_id"), F.col("b.vec_id").alias("b_id")).filter("a_id < b_id")


@query("""
WITH d AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (abs(embedding[3]) / (CASE WHEN vec_id % 50 = 0 THEN 1 ELSE 20 END))::DOUBLE AS r FROM embeddings UNION ALL SELECT vec_id, embedding[4]::DOUBLE, embedding[5]::DOUBLE, (abs(embedding[3]) / (CASE WHEN vec_id % 50 = 0 THEN 1 ELSE 20 END))::DOUBLE FROM embeddings)
SELECT DISTINCT a.vec_id AS a_id, b.vec_id AS b_id FROM d a JOIN d b ON a.vec_id < b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) <= a.r + b.r""")
def geometries_intersect(spark, sf):
    """Pairs of geometries of two squares on their corners, written as binary, read again and compared exactly."""

    def diamond(x: str, y: str):
        x, y, r = F.col(x), F.col(y), F.col("r")
        return F.array(F.array(x - r, y, x, y + r, x + r, y, x, y - r, x - r, y))

    rows = _places(spark, sf).select("vec_id", geo.wkb_of(F.lit(6), F.array(diamond("x", "y"), diamond("x2", "y2"))).alias("wkb"))
    shaped = rows.select("vec_id", geo.wkb_shape(F.col("wkb")).alias("shape"))
    return boxes.geometries_meeting(shaped, None, "vec_id", "shape").select(F.col("a").alias("a_id"), F.col("b").alias("b_id"))


@query("SELECT label, 4 AS kind, count(*)::INTEGER AS n_points, min(embedding[1])::DOUBLE AS west, min(embedding[2])::DOUBLE AS south, max(embedding[1])::DOUBLE AS east, max(embedding[2])::DOUBLE AS north FROM embeddings GROUP BY label")
def geometry_boxes(spark, sf):
    """The points of a label as one geometry of many parts, and what is read from it."""
    parts = F.collect_list(F.array(F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")))).alias("parts")
    rows = t(spark, sf, "embeddings").groupBy("label").agg(parts).select("label", geo.wkb_of(F.lit(4), F.col("parts")).alias("wkb"))
    read = rows.select("label", geo.wkb_kind(F.col("wkb")).alias("kind"), geo.wkb_shape(F.col("wkb")).alias("s"))
    return read.select("label", "kind", F.size("s.parts").alias("n_points"), "s.west", "s.south", "s.east", "s.north")


# Windows and order.


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1")
def win_latest(spark, sf):
    return versions.latest(t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)::INTEGER AS revision_no FROM orders")
def win_revision_no(spark, sf):
    return versions.numbered(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query("SELECT conv_id, after_no, before_no FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after_no, turn AS before_no FROM conversations) WHERE before_no - after_no > 1 UNION ALL SELECT o_custkey, after_no, before_no FROM (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after_no, o_orderkey AS before_no FROM orders) WHERE before_no - after_no > 1")
def win_gaps(spark, sf):
    """Turns that miss in a conversation (none should), and keys of orders between two of a customer's."""
    turns = versions.gaps(t(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn")), ["conv_id"], "turn")
    return turns.unionByName(versions.gaps(t(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn")), ["conv_id"], "turn"))


@query("SELECT from_state, event_type AS to_state, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS from_state FROM events) GROUP BY ALL")
def win_transition(spark, sf):
    rows = versions.transitions(t(spark, sf, "events"), ["user_id"], "event_type", [F.asc("ts"), F.asc("event_id")])
    return rows.groupBy("from_state", F.col("event_type").alias("to_state")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS delta FROM events")
def win_delta(spark, sf):
    return versions.deltas(t(spark, sf, "events"), ["user_id"], "value", [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "delta")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY ALL")
def win_pit_state(spark, sf):
    return versions.state_at(t(spark, sf, "events"), ["user_id", "event_type"], "ts", F.lit("2024-01-15").cast("timestamp_ntz"), "value", "event_id")


@query("SELECT o_custkey, o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS implied_end FROM orders")
def win_lead_end(spark, sf):
    return temporal.closed_by_next(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("""
WITH s AS (SELECT o_custkey, o_orderdate AS f, o_orderdate + INTERVAL 60 DAY AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR f > b THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY f, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT o_custkey, min(f) AS island_start, max(e) AS island_end, count(*) AS n_rows FROM i GROUP BY o_custkey, g""")
def win_islands(spark, sf):
    rows = t(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").alias("f"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("e"))
    return temporal.islands(rows, "o_custkey", "f", "e")


@query("SELECT event_id, user_id, k FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS k, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END DESC NULLS FIRST, event_id) AS n FROM events) WHERE n <= 2")
def sort_desc_nulls(spark, sf):
    rows = t(spark, sf, "events").withColumn("k", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_first("k"), "event_id"))
    return rows.withColumn("n", n).filter("n <= 2").select("event_id", "user_id", "k")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 20")
def topk_recent(spark, sf):
    return t(spark, sf, "events").select("event_id", "ts").orderBy(F.desc_nulls_last("ts"), F.desc("event_id")).limit(20)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def range_scan(spark, sf):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1995-03-31"))
    return t(spark, sf, "orders").filter(F.col("o_orderdate").between(low, high)).select("o_orderkey", "o_orderdate")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 2) NULLS LAST, n_name) AS place FROM nation")
def sort_vocab(spark, sf):
    """A place in one order over all rows; no task has them all."""
    region = F.nullif(F.col("n_regionkey"), F.lit(2))
    return ranking.numbered(t(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name"), [], [region.isNull(), region, F.col("n_name")], "place").select("n_nationkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_name NULLS LAST, p_partkey) AS place FROM part")
def sort_catalogue(spark, sf):
    return ranking.numbered(t(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), [], [F.col("p_brand"), F.col("p_name").isNull(), F.col("p_name"), F.col("p_partkey")], "place").select("p_partkey", "place")


# Aggregates.


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def agg_status_counts(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def agg_outcome_pivot(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT lang, count(*) FILTER (q = 'present') AS present, count(*) FILTER (q = 'not_recorded') AS not_recorded, count(*) AS total FROM (SELECT lang, CASE WHEN quality IS NULL THEN 'not_recorded' ELSE 'present' END AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang")
def agg_completeness(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id", "left").withColumn("q", F.when(F.col("quality").isNull(), "not_recorded").otherwise("present"))
    return rows.groupBy("lang").agg(F.count_if(F.col("q") == "present").alias("present"), F.count_if(F.col("q") == "not_recorded").alias("not_recorded"), F.count("*").alias("total"))


@query("SELECT l_suppkey, l_returnflag, l_linestatus, CAST(sum(l_quantity::DECIMAL(18, 2)) AS DOUBLE) AS total FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL")
def agg_measure_sum(spark, sf):
    rows = t(spark, sf, "lineitem").filter("l_quantity is not null")
    return rows.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
WITH i AS (SELECT l_partkey AS k, sum(l_quantity::DECIMAL(18, 2)) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), o AS (SELECT l_partkey AS k, sum(l_quantity::DECIMAL(18, 2)) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(i.k, o.k) AS l_partkey, CAST(coalesce(i.n, 0) AS DOUBLE) AS quantity_in, CAST(coalesce(o.n, 0) AS DOUBLE) AS quantity_out FROM i FULL JOIN o ON i.k = o.k""")
def agg_balance(spark, sf):
    """Both sides in one aggregate: no second scan and no join."""
    amount = F.col("l_quantity").cast("decimal(18,2)")
    rows = t(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    sums = [F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, amount)), F.lit(0)).cast("double").alias(n) for f, n in (("A", "quantity_in"), ("R", "quantity_out"))]
    return rows.groupBy("l_partkey").agg(*sums)


@query("SELECT l_orderkey, CAST(sum(l_discount::DECIMAL(18, 4)) AS DOUBLE) AS share, sum(l_discount::DECIMAL(18, 4)) > 0.2 AS over FROM lineitem GROUP BY l_orderkey")
def agg_share_sum(spark, sf):
    share = F.sum(F.col("l_discount").cast("decimal(18,4)"))
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(share.cast("double").alias("share"), (share > F.lit("0.2").cast("decimal(18,4)")).alias("over"))


@query("SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(18, 4) END), 0) AS DOUBLE) AS supports, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN value::DECIMAL(18, 4) END), 0) AS DOUBLE) AS contradicts, count(*) AS n FROM events GROUP BY user_id")
def agg_evidence(spark, sf):
    weight = F.col("value").cast("decimal(18,4)")
    sums = [F.coalesce(F.sum(F.when(F.col("event_type") == e, weight)), F.lit(0)).cast("double").alias(n) for e, n in (("purchase", "supports"), ("error", "contradicts"))]
    return t(spark, sf, "events").groupBy("user_id").agg(*sums, F.count("*").alias("n"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS score, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS flags FROM events GROUP BY user_id")
def agg_quality(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("score"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("flags"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def agg_ordered_list(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["role"]), ">").alias("roles"))


# Sets.


def _two_snapshots(spark, sf):
    orders = t(spark, sf, "orders")
    return orders.filter("o_orderstatus <> 'P'").select("o_custkey"), orders.filter("o_orderpriority <> '5-LOW'").select("o_custkey")


_A, _B = "SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P'", "SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW'"


@query(f"{_B} EXCEPT {_A}")
def set_added(spark, sf):
    old, new = _two_snapshots(spark, sf)
    return new.subtract(old)


@query(f"{_A} EXCEPT {_B}")
def set_removed(spark, sf):
    old, new = _two_snapshots(spark, sf)
    return old.subtract(new)


@query(f"{_A} INTERSECT {_B}")
def set_common(spark, sf):
    old, new = _two_snapshots(spark, sf)
    return old.intersect(new)


# Scalars.


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('Machinery')")
def lookup_ci(spark, sf):
    return t(spark, sf, "customer").filter(equal_but_for_case(F.col("c_mktsegment"), F.lit("Machinery"))).select("c_custkey", "c_mktsegment")


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/', 3) AS code FROM pages")
def code_parse(spark, sf):
    return t(spark, sf, "pages").select("page_id", *code_parts(F.col("url"), r"^(https?)://([^/]+)/([a-z]+)/", ["scheme", "host", "code"]))


@query(_TRIGRAMS_SQL.replace("benchmark", "(SELECT p_partkey AS item_id, p_name AS text FROM part UNION ALL SELECT -1, 'green part 42')") + """
, q AS (SELECT t FROM g WHERE k = -1)
SELECT c.k AS p_partkey, round(count(q.t) / (c.n + (SELECT count(*) FROM q) - count(q.t)), 9) AS similarity FROM c JOIN g ON g.k = c.k LEFT JOIN q ON q.t = g.t WHERE c.k <> -1 GROUP BY c.k, c.n""")
def sim_trigram(spark, sf):
    wanted = trigrams(F.lit("green part 42"), "[^a-z0-9]+")
    return t(spark, sf, "part").select("p_partkey", F.round(similarity(trigrams(F.col("p_name"), "[^a-z0-9]+"), wanted), 9).alias("similarity"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text LIKE 'The %'")
def search_like(spark, sf):
    return t(spark, sf, "documents").filter(F.col("text").ilike("%license%") | F.col("text").like("The %")).select("doc_id")


_PATTERNS = ["%license%", "The %", "%@%.com%", "%\\%%", "%onthe%ingly%", "%qzxj%"]


@query(" UNION ALL ".join(f"SELECT {i} AS pattern, doc_id FROM documents WHERE text LIKE '{p}' ESCAPE '\\'" for i, p in enumerate(_PATTERNS)))
def search_index(spark, sf):
    """Patterns looked up in an index of the whole texts."""
    folder = f"{shared_folder(spark.sparkContext)}/lattica-index-{uuid.uuid4().hex}"
    textindex.build(t(spark, sf, "documents"), "doc_id", "text", folder)
    found = [textindex.like(spark, folder, p).select(F.lit(i).alias("pattern"), F.col("id").alias("doc_id")) for i, p in enumerate(_PATTERNS)]
    return reduce(DataFrame.unionByName, found)


@query("SELECT p_partkey, concat_ws(' ', nullif(trim(p_brand), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_type END), ''), nullif(trim(p_size::VARCHAR), '')) AS composed FROM part")
def name_compose(spark, sf):
    return t(spark, sf, "part").select("p_partkey", composed(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_size").cast("string")).alias("composed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_explode(spark, sf):
    return docs_fn.fields(t(spark, sf, "events"), "props", ["event_id"])


@query("""
WITH e AS (SELECT event_id, user_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS old FROM events)
SELECT event_id, CAST(json_extract_string(old, '$.k') AS BIGINT) AS old_k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS new_k FROM e
WHERE old IS NOT NULL AND json_extract_string(old, '$.k') IS DISTINCT FROM json_extract_string(props, '$.k')""")
def json_diff(spark, sf):
    rows = t(spark, sf, "events").withColumn("old", F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("old is not null")
    k = [F.get_json_object(c, "$.k").cast("long").alias(n) for c, n in (("old", "old_k"), ("props", "new_k"))]
    return rows.filter(docs_fn.changed(F.col("old"), F.col("props"))).select("event_id", *k)


_FIELDS_SQL = r"""
WITH v AS (SELECT user_id, event_id, event_type AS e, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS n FROM events),
l AS (SELECT user_id, n, unnest(list_concat([{'path': '/type', 'value': '"' || e || '"'}, {'path': '/detail/k', 'value': k::VARCHAR}, {'path': '/x~1y~2z~0', 'value': (event_id % 4)::VARCHAR}],
  CASE WHEN k % 2 = 0 THEN [{'path': '/detail/even/half', 'value': (k // 2)::VARCHAR}] ELSE [] END, CASE k % 3 WHEN 0 THEN [{'path': '/tags', 'value': '[]'}] WHEN 1 THEN [{'path': '/tags#0', 'value': '1'}] ELSE [{'path': '/tags#0', 'value': '1'}, {'path': '/tags#1', 'value': '2'}] END), recursive := true) FROM v),
c AS (SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.n, a.n + 1) AS revision_no, coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind, a.value AS old_value, b.value AS new_value
  FROM l a FULL JOIN l b ON a.user_id = b.user_id AND a.n + 1 = b.n AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value)
"""


def _documents_of_users(spark, sf):
    """Every event as the next version of its user's document, with nested members, lists and a key of odd signs."""
    k = F.get_json_object("props", "$.k").cast("long")
    detail = F.struct(k.alias("k"), F.when(k % 2 == 0, F.struct(F.floor(k / 2).cast("long").alias("half"))).alias("even"))
    tags = F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (k % 3).cast("int"))
    document = F.to_json(F.struct(F.col("event_type").alias("type"), detail.alias("detail"), tags.alias("tags"), (F.col("event_id") % 4).alias("x/y#z~")))
    return t(spark, sf, "events").select("user_id", "ts", "event_id", document.alias("document"))


@query(_FIELDS_SQL + "SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM v WHERE v.user_id = c.user_id AND v.n = c.revision_no)")
def json_changes(spark, sf):
    return docs_fn.history(_documents_of_users(spark, sf), "user_id", [F.col("ts"), F.col("event_id")], "document")


@query(_FIELDS_SQL + r"""
SELECT user_id, '{"detail":{' || CASE WHEN k % 2 = 0 THEN '"even":{"half":' || k // 2 || '},' ELSE '' END || '"k":' || k || '},"tags":' || CASE k % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[1]' ELSE '[1,2]' END || ',"type":"' || e || '","x/y#z~":' || event_id % 4 || '}' AS document
FROM v WHERE n = (SELECT max(n) FROM v w WHERE w.user_id = v.user_id)""")
def json_replayed(spark, sf):
    """The changes of all versions, played back: each user's document as it is stored last."""
    return docs_fn.replayed(docs_fn.history(_documents_of_users(spark, sf), "user_id", [F.col("ts"), F.col("event_id")], "document"), "user_id")


@query("SELECT doc_id, sha256(text) AS payload_hash FROM documents")
def content_hash(spark, sf):
    return captured(t(spark, sf, "documents").select("doc_id", "text"), F.col("text")).drop("text")


@query("SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS microseconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def duration(spark, sf):
    both = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", (temporal.moments(F.col("l_shipdate")) - temporal.moments(F.col("o_orderdate"))).alias("microseconds"))


# Graphs.


def _tree(spark, sf):
    """Parts as a binary tree: the parent of key k is k // 2; what would be under 0 is a root."""
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))
    return part, part.filter("parent > 0").select(F.col("node").alias("child"), "parent")


_TREE_SQL = "WITH RECURSIVE tree AS (SELECT p_partkey AS node, p_partkey::VARCHAR AS path, 0 AS depth FROM part WHERE p_partkey // 2 <= 0 UNION ALL SELECT p.p_partkey, tree.path || '/' || p.p_partkey, tree.depth + 1 FROM part p JOIN tree ON p.p_partkey // 2 = tree.node AND p.p_partkey // 2 > 0)"


@query(_TREE_SQL + " SELECT node, path, depth FROM tree")
def tree_ancestors(spark, sf):
    nodes, edges = _tree(spark, sf)
    return graph.ancestor_paths(edges, nodes.select("node"))


@query("WITH RECURSIVE d AS (SELECT p_partkey AS node, 1 AS distance FROM part WHERE p_partkey // 2 = 3 UNION ALL SELECT p.p_partkey, d.distance + 1 FROM part p JOIN d ON p.p_partkey // 2 = d.node) SELECT node, distance FROM d")
def tree_descendants(spark, sf):
    nodes, edges = _tree(spark, sf)
    return trees.below(trees.labelled(edges, nodes), spark.range(3, 4).withColumnRenamed("id", "node")).select("node", "distance")


@query("""
WITH RECURSIVE w AS (SELECT p_partkey AS node, NULL::BIGINT AS parent, lpad(p_partkey::VARCHAR, 12, '0') AS path, 0 AS depth FROM part WHERE p_partkey // 2 <= 0 UNION ALL SELECT p.p_partkey, w.node, w.path || '/' || lpad(p.p_partkey::VARCHAR, 12, '0'), w.depth + 1 FROM part p JOIN w ON p.p_partkey // 2 = w.node AND w.node > 0)
SELECT node, parent, row_number() OVER (ORDER BY path) AS pre, row_number() OVER (ORDER BY path || '~') AS post, (SELECT count(*) FROM w x WHERE x.path = w.path OR x.path LIKE w.path || '/%') AS size, depth FROM w""")
def tree_labels(spark, sf):
    nodes, edges = _tree(spark, sf)
    return trees.labelled(edges, nodes)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey - 3 FROM orders WHERE o_orderkey % 4 = 0)")
def chain_head(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") - 3).alias("supersedes"))
    return graph.heads(rows, "o_orderkey", "supersedes").select("o_orderkey")


_LINES_SQL = "SELECT DISTINCT l_suppkey AS child, l_suppkey // 3 AS parent FROM lineitem WHERE l_suppkey // 3 > 0 UNION SELECT DISTINCT l_suppkey, l_suppkey // 5 FROM lineitem WHERE l_suppkey // 5 > 0"


def _derivations(spark, sf):
    """Samples made from samples in two ways: inputs and outputs of a process, joined by it."""
    lines = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("child")).distinct()
    both = lines.withColumn("parent", F.explode(F.array(*(F.floor(F.col("child") / n).cast("long") for n in (3, 5)))))
    return both.filter("parent > 0").distinct()


@query(f"WITH RECURSIVE e AS ({_LINES_SQL}), r AS (SELECT child, parent AS ancestor FROM e UNION SELECT r.child, e.parent FROM r JOIN e ON r.ancestor = e.child) SELECT child, ancestor FROM r")
def lineage_upstream(spark, sf):
    return graph.closure(_derivations(spark, sf)).select("child", "ancestor")


@query(f"WITH RECURSIVE e AS ({_LINES_SQL}), r AS (SELECT child, parent AS ancestor FROM e UNION SELECT r.child, e.parent FROM r JOIN e ON r.ancestor = e.child) SELECT child, count(*) AS n_sources, min(s_name) AS first_source FROM r JOIN supplier ON ancestor = s_suppkey GROUP BY child")
def provenance_closure(spark, sf):
    found = graph.closure(_derivations(spark, sf)).join(t(spark, sf, "supplier"), F.col("ancestor") == F.col("s_suppkey"))
    return found.groupBy("child").agg(F.count("*").alias("n_sources"), F.min("s_name").alias("first_source"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 1 THEN NULL ELSE p_partkey // 2 END AS parent FROM part WHERE p_partkey NOT IN (0, 5)),
l AS (SELECT node FROM n WHERE parent IS NULL UNION SELECT n.node FROM n JOIN l ON n.parent = l.node)
SELECT 'repeated_id' AS fault, count(*) AS n FROM (SELECT node FROM n GROUP BY node HAVING count(*) > 1) UNION ALL
SELECT 'missing_parent', count(*) FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM n) UNION ALL
SELECT 'not_linked', count(*) FROM (SELECT DISTINCT node FROM n) WHERE node NOT IN (SELECT node FROM l)""")
def tree_integrity(spark, sf):
    nodes = t(spark, sf, "part").filter("p_partkey not in (0, 5)").select("p_partkey", F.when(F.col("p_partkey") != 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent"))
    return graph.tree_faults(nodes, "p_partkey", "parent")


@query("SELECT p_partkey AS node, 4 AS cycle_length FROM part WHERE p_partkey <= 4 * (SELECT max(p_partkey) // 4 FROM part) AND p_partkey > 0")
def tree_cycles(spark, sf):
    """Rings of four: 1, 2, 3, 4 and so on; a last one that isn't full is a chain."""
    key = F.col("p_partkey")
    edges = t(spark, sf, "part").filter("p_partkey > 0").select(key.alias("child"), F.when(key % 4 == 0, key - 3).otherwise(key + 1).alias("parent"))
    return graph.on_cycles(edges)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, (p_partkey * p_partkey + p_size) % 1009 AS b FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size % 4 = 0),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def graph_components(spark, sf):
    """Parts that lead to others in two ways: which of them lead back to each other."""
    part = t(spark, sf, "part").select("p_partkey", "p_size")
    one = part.select(F.col("p_partkey").alias("child"), ((F.col("p_partkey") * F.col("p_partkey") + F.col("p_size")) % 1009).alias("parent"))
    two = part.filter("p_size % 4 = 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))
    return graph.strong_components(one.unionByName(two))


_BLENDS_SQL = "SELECT DISTINCT l_suppkey AS s, l_suppkey // 3 AS o, 0.75::DOUBLE AS p FROM lineitem WHERE l_suppkey // 3 > 0 UNION ALL SELECT DISTINCT l_suppkey, l_suppkey // 5, 0.125::DOUBLE FROM lineitem WHERE l_suppkey // 5 > 0"


@query(f"""
WITH RECURSIVE e AS ({_BLENDS_SQL}), w(sample, node, share) AS (SELECT s, s, 1.0::DOUBLE FROM (SELECT s FROM e UNION SELECT o FROM e) UNION ALL SELECT sample, o, share * p FROM w JOIN e ON s = node)
SELECT sample, node AS source, round(sum(share), 9) AS share FROM w WHERE node NOT IN (SELECT s FROM e) GROUP BY ALL""")
def lineage_shares(spark, sf):
    """What part of each sample comes from each source, some being lost on the way."""
    lines = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample")).distinct()
    kinds = F.explode(F.array(*(F.struct(F.floor(F.col("sample") / n).cast("long").alias("origin"), F.lit(p).alias("proportion")) for n, p in ((3, 0.75), (5, 0.125))))).alias("k")
    return graph.shares(lines.select("sample", kinds).select("sample", "k.*").filter("origin > 0")).withColumn("share", F.round("share", 9))


@query("SELECT DISTINCT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_regionkey = 2 AND o_orderstatus = 'F'")
def impact_set(spark, sf):
    places = t(spark, sf, "region").filter("r_regionkey = 2").join(t(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = places.join(t(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.join(t(spark, sf, "orders").filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey")).select("r_name", "n_name", "c_custkey", "o_orderkey").distinct()


_KINDS_SQL = "SELECT l_partkey AS a, l_suppkey AS b, CASE l_linenumber % 3 WHEN 0 THEN 'includes' WHEN 1 THEN 'overlaps' ELSE 'uncertain_relationship' END AS kind FROM lineitem"


@query(f"WITH e AS ({_KINDS_SQL}) SELECT a, b, kind FROM e UNION SELECT b, a, CASE kind WHEN 'includes' THEN 'included_in' ELSE kind END FROM e WHERE kind IN ('includes', 'overlaps')")
def edge_symmetrize(spark, sf):
    n = F.col("l_linenumber") % 3
    rows = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(n == 0, "includes").when(n == 1, "overlaps").otherwise("uncertain_relationship").alias("kind"))
    return graph.symmetrized(rows, "a", "b", "kind", {"includes": "included_in", "included_in": "includes", "overlaps": "overlaps", "congruent_with": "congruent_with", "disjoint_from": "disjoint_from"})


# Imports.


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id::VARCHAR || '/' || event_type END AS import_key FROM events WHERE event_id % 9 = 0 OR user_id::VARCHAR || '/' || event_type NOT IN (SELECT user_id::VARCHAR || '/' || event_type FROM events WHERE ts < TIMESTAMP '2024-01-03' AND event_id % 9 <> 0)")
def import_idempotent(spark, sf):
    events = t(spark, sf, "events").withColumn("import_key", F.when(F.col("event_id") % 9 != 0, F.concat_ws("/", F.col("user_id").cast("string"), "event_type")))
    done = events.filter(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"))
    return reconcile.not_yet_imported(events.select("event_id", "import_key"), done, "import_key").select("event_id", "import_key")


@query(r"""
WITH staged AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS text, lang AS kind, -1 AS turn FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT CASE WHEN conv_id % 13 = 0 THEN NULL ELSE conv_id END, text, role, turn FROM conversations),
g AS (SELECT *, CASE WHEN doc_id IS NULL OR length(text) < 40 THEN 'failed' WHEN kind IN ('es', 'system') THEN 'quarantined' END AS bad FROM staged),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bad ORDER BY turn NULLS FIRST, kind NULLS FIRST, text NULLS FIRST) AS n FROM g),
c AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents)
SELECT s.doc_id, CASE WHEN bad IS NOT NULL THEN bad WHEN s.n > 1 THEN 'duplicate' WHEN c.text_hash IS NULL THEN 'inserted' WHEN sha256(coalesce(s.text, '')) = c.text_hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM s LEFT JOIN c ON s.doc_id = c.doc_id
UNION ALL SELECT doc_id, 'skipped' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM staged WHERE doc_id IS NOT NULL)""")
def upsert_outcome(spark, sf):
    """Labelled documents with their spaces squeezed, and every turn under its conversation's number, against all documents as they are; short texts count as unreadable."""
    docs = t(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("kind"))
    labelled = docs.join(t(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    squeezed = labelled.withColumn("text", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))).withColumn("turn", F.lit(-1).cast("long"))
    own = F.when(F.col("conv_id") % 13 != 0, F.col("conv_id"))
    turns = t(spark, sf, "conversations").select(own.alias("doc_id"), "text", F.col("role").alias("kind"), F.col("turn").cast("long").alias("turn"))
    staged = squeezed.unionByName(turns)
    text = F.coalesce("text", F.lit(""))
    return reconcile.outcomes(captured(staged, text), captured(docs, text), "doc_id", "payload_hash", F.struct("turn", "kind", "text"), F.col("kind").isin("es", "system"), F.length("text") < 40)


@query("SELECT user_id, event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY ALL")
def first_last_seen(spark, sf):
    rows = t(spark, sf, "events").select("user_id", "event_type", F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"))
    return reconcile.merged_sightings(rows, ["user_id", "event_type"], "first_seen_at", "last_seen_at")


@query("SELECT user_id, event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_max(value, (ts, value)) AS value FROM events GROUP BY ALL")
def external_records(spark, sf):
    """Events in four batches that are not in the order of time, merged into a stored table; the last batch comes twice."""
    folder = f"{shared_folder(spark.sparkContext)}/lattica-records-{uuid.uuid4().hex}"
    rows = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"), "value")
    how = {"first_seen_at": "min", "last_seen_at": "max", "value": "last"}
    for k in (2, 0, 3, 1, 1):
        batch = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k)
        once = batch.groupBy("user_id", "event_type").agg(F.min("first_seen_at").alias("first_seen_at"), F.max(F.struct("last_seen_at", "value")).alias("l")).select("user_id", "event_type", "first_seen_at", "l.*")
        stored.merge(once, folder, ["user_id", "event_type"], how, "last_seen_at", 8)
    return stored.read(spark, folder, rows.drop("event_id").schema).drop("bucket")


@query("""
WITH n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 97 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 101 <> 0 UNION ALL SELECT -1 - p_partkey, p_name, p_size FROM part WHERE p_partkey % 89 = 0)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change, o.p_size AS old_size, n.p_size AS new_size
FROM part o FULL JOIN n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_size IS DISTINCT FROM n.p_size""")
def snapshot_difference(spark, sf):
    """Two snapshots of the parts, some of them changed, gone or new in the second."""
    folder = f"{shared_folder(spark.sparkContext)}/lattica-snapshots-{uuid.uuid4().hex}"
    old = t(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    new = old.filter(key % 101 != 0).withColumn("p_size", F.when(key % 97 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    new = new.unionByName(old.filter(key % 89 == 0).withColumn("p_partkey", -1 - key))
    versions = [stored.write_version(d, folder, ["p_partkey"]) for d in (old, new)]
    return stored.difference(spark, folder, old.schema, ["p_partkey"], *versions).select("p_partkey", "change", F.col("old.p_size").alias("old_size"), F.col("new.p_size").alias("new_size"))


@query("SELECT o_orderkey, o_orderstatus, count(*) AS n_lines, max(l_quantity) AS most FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def layout_join(spark, sf):
    """Orders and their lines laid out by their key: the join and the groups need no exchange."""
    name = f"lattica_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark.sparkContext)}/{name}"
    orders, lines = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), t(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    buckets = stored.buckets_for(orders, lines)
    orders = stored.write_bucketed(orders, f"{name}_orders", f"{folder}/orders", ["o_orderkey"], buckets)
    lines = stored.write_bucketed(lines, f"{name}_lines", f"{folder}/lines", ["l_orderkey"], buckets)
    both = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n_lines"), F.max("l_quantity").alias("most"))


# Questions that the model is shaped to answer.


@query("SELECT source, sum(chars)::BIGINT AS n_chars, count(*) AS n FROM (SELECT source, any_value(n_chars) AS chars FROM documents GROUP BY source, sha256(text)) GROUP BY source")
def distinct_payloads(spark, sf):
    """Each different payload of a source once."""
    rows = captured(t(spark, sf, "documents"), F.col("text")).groupBy("source", "payload_hash").agg(F.max("n_chars").alias("chars"))
    return rows.groupBy("source").agg(F.sum("chars").alias("n_chars"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, first_value(value) OVER w AS first_value, max(value) OVER w AS running_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING)")
def population_trend(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf, "events").select("event_id", "user_id", F.first("value").over(w).alias("first_value"), F.max("value").over(w).alias("running_max"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, count(DISTINCT l_suppkey) AS n_suppliers, max(p_size) AS largest FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY' GROUP BY c_custkey")
def accession_chain(spark, sf):
    """A chain of five tables down to one row for each start."""
    some = t(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    chain = some.join(t(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return chain.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.max("p_size").alias("largest"))


@query("SELECT a.conv_id, a.turn, a.role FROM conversations a WHERE a.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant')")
def review_backlog(spark, sf):
    """Rows that wait for an answer: later than the last one of the other kind."""
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "role")
    answered = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return rows.withColumn("answered", answered).filter("role = 'user' and (answered is null or answered <= turn)").drop("answered")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_ledger(spark, sf):
    """The events as a stream into daily counts; every batch is kept under its number, so a repeated one changes nothing."""
    source = spark.read.parquet(f"{sf}/events.parquet")
    folder = f"{shared_folder(spark.sparkContext)}/lattica-ledger-{uuid.uuid4().hex}"
    stream = ledger.records(spark, sf, source.schema, "events.parquet")
    counted = stream.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type", "day").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    ledger.ledger(counted, write, f"{folder}-checkpoint").awaitTermination()
    return spark.read.parquet(folder).groupBy("event_type", "day").agg(F.sum("n").alias("n"))


def _in_files(spark, sf):
    """The events in eight files that don't follow time, as a stream of one file a batch."""
    source = t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    folder = f"{shared_folder(spark.sparkContext)}/lattica-stream-{uuid.uuid4().hex}"
    source.repartition(8, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    return folder, ledger.records(spark, f"{folder}/in", source.schema, files=1)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark, sf):
    """Keys of events as a stream, each once whichever batch brings it first."""
    folder, stream = _in_files(spark, sf)
    keys = ledger.once(stream.withColumn("at", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "at", "60 days").select("user_id", "event_type")
    ledger.ledger(keys, ledger.updates(f"{folder}/out"), f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS n FROM events GROUP BY ALL")
def stream_sightings(spark, sf):
    """First and last event of a user's days, kept as state over batches that are not in order."""
    folder, stream = _in_files(spark, sf)
    seen = ledger.sightings(stream.withColumn("at", F.col("ts").cast("timestamp")), ["user_id"], "at", "60 days", "1 day")
    seen = seen.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen_at", "last_seen_at")), "n")
    ledger.ledger(seen, ledger.updates(f"{folder}/out"), f"{folder}/state", "update").awaitTermination()
    return ledger.newest(spark, f"{folder}/out", seen.schema, ["user_id", "day"])
