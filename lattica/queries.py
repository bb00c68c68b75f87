"""Queries over a folder of tables, each through the operators, with the SQL that says the same."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import aggregates as agg
from .operators import connections, lookups, relations, vectors
from .plans import codecs, ordering
from .plans.filters import Compiler
from .sources import tpch
from .sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


_CATALOGS: dict[tuple[str, str], Catalog] = {}


def _catalog(spark: SparkSession, folder: str) -> Catalog:
    """A folder's catalog, read once an application: its schemas take a job a table."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _CATALOGS:
        _CATALOGS[key] = tpch.catalog(spark, folder)
    return _CATALOGS[key]


def _query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[Catalog], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(_catalog(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return register


def _filtered(name: str, table: str, where: dict, columns: str, sql_where: str) -> None:
    """A filter's query: some columns of the rows that pass."""

    @_query(name, f"SELECT {columns} FROM {table} WHERE {sql_where}")
    def run(c: Catalog) -> DataFrame:
        t = c.table(table)
        return Compiler(c).where(t, where).apply(c.rows(t)).select(*columns.split(", "))


def _page(name: str, table: str, sql: str, show: str, **args) -> None:
    @_query(name, sql)
    def run(c: Catalog) -> DataFrame:
        t = c.table(table)
        given = {k: (v(c) if callable(v) else v) for k, v in args.items()}
        page = connections.connect(c, t, compiler=Compiler(c), **given)
        return page.page.limit(page.window.size).select(*show.split(", "))


# --- lookups and projections


@_query("lookup_pk", "SELECT * FROM orders WHERE o_orderkey = 7")
def _(c: Catalog) -> DataFrame:
    return lookups.by_key(c, c.table("orders"), {"oOrderkey": "7"})


@_query("lookup_composite_pk", "SELECT * FROM conversations WHERE conv_id = 3 AND turn = 1")
def _(c: Catalog) -> DataFrame:
    return lookups.by_key(c, c.table("conversations"), {"convId": "3", "turn": 1})


@_query("lookup_unique", "SELECT * FROM nation WHERE n_name = 'NATION_7'")
def _(c: Catalog) -> DataFrame:
    return lookups.by_key(c, c.table("nation"), {"nName": "NATION_7"})


@_query("lookup_node_id", "SELECT * FROM customer WHERE c_custkey = 12")
def _(c: Catalog) -> DataFrame:
    return lookups.by_node_id(c, codecs.node_id("Customer", [12]))[1]


@_query("lookup_foreign_key", "SELECT c.* FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = 5")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    key = lookups.by_key(c, t, {"oOrderkey": 5}).collect()[0]["o_custkey"]  # one row
    return lookups.parent_of(c, t.relation("oCustkeyRef"), [key])


@_query("lookup_batch", "SELECT * FROM customer WHERE c_custkey IN (1, 5, 9, 40)")
def _(c: Catalog) -> DataFrame:
    return lookups.batch(c, c.table("customer"), ["c_custkey"], [(1,), (5,), (9,), (40,), (5,), (None,)])


@_query("node_ids", "SELECT o_orderkey, to_base64(encode('[\"Order\",' || o_orderkey || ']')) AS id FROM orders")
def _(c: Catalog) -> DataFrame:
    return lookups.node_ids(c, c.table("orders")).select("o_orderkey", "id")


@_query("node_ids_composite", """SELECT conv_id, turn, to_base64(encode('["Conversation",' || conv_id || ',' || turn || ']')) AS id FROM conversations""")
def _(c: Catalog) -> DataFrame:
    return lookups.node_ids(c, c.table("conversations")).select("conv_id", "turn", "id")


@_query("lookup_single_by_id", "SELECT * FROM nation WHERE n_nationkey = 3")
def _(c: Catalog) -> DataFrame:
    t = c.table("nation")
    return lookups.by_node_id(c, codecs.node_id(t.type_name, [3]), t)[1]


_page("project_order_columns", "orders", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50", "o_orderkey, o_totalprice, o_orderstatus", first=50, columns=["o_totalprice", "o_orderstatus"])

# --- filters

_filtered("filter_eq", "customer", {"cMktsegment": {"eq": "BUILDING"}}, "c_custkey, c_name", "c_mktsegment = 'BUILDING'")
_filtered("filter_ne", "customer", {"cMktsegment": {"ne": "BUILDING"}}, "c_custkey, c_name", "c_mktsegment <> 'BUILDING'")
_filtered("filter_range", "orders", {"oTotalprice": {"gte": 1000.0, "lt": 200000.0}}, "o_orderkey, o_totalprice", "o_totalprice >= 1000 AND o_totalprice < 200000")
_filtered("filter_gt_lte", "part", {"pSize": {"gt": 10, "lte": 30}}, "p_partkey, p_size", "p_size > 10 AND p_size <= 30")
_filtered("filter_in", "orders", {"oOrderpriority": {"in": ["1-URGENT", "2-HIGH"]}}, "o_orderkey, o_orderpriority", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filtered("filter_not_in", "orders", {"oOrderpriority": {"notIn": ["1-URGENT", "2-HIGH"]}}, "o_orderkey, o_orderpriority", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_filtered("filter_in_empty", "orders", {"oOrderpriority": {"in": []}}, "o_orderkey", "FALSE")
_filtered("filter_not_in_empty", "orders", {"oOrderpriority": {"notIn": []}}, "o_orderkey", "TRUE")
_filtered("filter_like", "part", {"pName": {"like": "%widget"}}, "p_partkey, p_name", "p_name LIKE '%widget'")
_filtered("filter_not_like", "part", {"pName": {"notLike": "c%"}}, "p_partkey, p_name", "p_name NOT LIKE 'c%'")
_filtered("filter_is_null", "customer", {"cAcctbal": {"isNull": True}}, "c_custkey", "c_acctbal IS NULL")
_filtered("filter_is_not_null", "customer", {"cAcctbal": {"isNull": False}}, "c_custkey", "c_acctbal IS NOT NULL")
_filtered("filter_eq_null", "customer", {"cAcctbal": {"eq": None}}, "c_custkey", "c_acctbal IS NULL")
_filtered("filter_and_or_nested", "orders", {"OR": [{"AND": [{"oTotalprice": {"gt": 300000}}, {"oOrderstatus": {"eq": "F"}}]}, {"oTotalprice": {"lt": 50000}}]}, "o_orderkey, o_totalprice", "(o_totalprice > 300000 AND o_orderstatus = 'F') OR o_totalprice < 50000")
_filtered("filter_empty_members", "orders", {"OR": [{}, {"oTotalprice": {"lt": 50000}}], "AND": [{}]}, "o_orderkey", "o_totalprice < 50000")
_filtered("filter_datetime_range", "lineitem", {"lShipdate": {"gte": "1995-01-01T00:00:00Z", "lt": "1996-01-01T00:00:00Z"}}, "l_orderkey, l_linenumber, l_shipdate", "l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
_filtered("filter_sibling_and", "events", {"eventType": {"in": ["click", "view"]}, "userId": {"lt": 50}}, "event_id, event_type, user_id", "event_type IN ('click', 'view') AND user_id < 50")


@_query("filter_tuple_in", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN ((0, 0), (1, 1), (2, 0), (5, 2))")
def _(c: Catalog) -> DataFrame:
    return lookups.batch(c, c.table("conversations"), ["conv_id", "turn"], [(0, 0), (1, 1), (2, 0), (5, 2), (1, None)]).select("conv_id", "turn", "role")


# --- sets: comma-separated texts made of language and source

_SET = "(lang || ',' || source)"


def _set(name: str, op: str, v: object, sql: str) -> None:
    from .functions.kinds import Kind
    from .plans.filters import compare
    from .sources.catalog import Column

    @_query(name, f"SELECT doc_id, {_SET} AS tags FROM documents WHERE {sql}")
    def run(c: Catalog) -> DataFrame:
        rows = c.rows(c.table("documents")).select("doc_id", F.concat_ws(",", "lang", "source").alias("tags"))
        values = ("en", "de", "fr", "es", *(f"src{i}" for i in range(20)))
        return rows.where(compare(Column("tags", Kind.SET, values=values), F.col("tags"), op, v))


_has = lambda m: f"list_contains(string_split({_SET}, ','), '{m}')"
_set("set_has", "has", "de", _has("de"))
_set("set_has_any", "hasAnyOf", ["de", "src3"], f"({_has('de')} OR {_has('src3')})")
_set("set_has_any_empty", "hasAnyOf", [], "FALSE")
_set("set_has_all", "hasAllOf", ["en", "src1"], f"({_has('en')} AND {_has('src1')})")
_set("set_has_all_empty", "hasAllOf", [], "TRUE")
_set("set_has_none", "hasNoneOf", ["en", "src1"], f"NOT {_has('en')} AND NOT {_has('src1')}")
_set("set_eq", "eq", ["src2", "fr"], f"{_SET} = 'fr,src2'")
_set("set_ne", "ne", ["src2", "fr"], f"{_SET} <> 'fr,src2'")

# --- bytes, UUIDs, enums and booleans, on columns made of names


def _typed(name: str, table: str, make: Callable, column: object, op: str, v: object, columns: str, sql: str) -> None:
    from .plans.filters import compare

    @_query(name, f"SELECT {columns} FROM {table} WHERE {sql}")
    def run(c: Catalog) -> DataFrame:
        rows = c.rows(c.table(table)).withColumn("_v", make())
        return rows.where(compare(column, F.col("_v"), op, v)).select(*columns.split(", "))


def _add_typed() -> None:
    import base64
    import hashlib

    from .functions.kinds import Kind
    from .sources.catalog import Column

    h = [hashlib.md5(f"Customer#{i:09d}".encode()).hexdigest() for i in range(3)]
    raw, text = lambda: F.unhex(F.md5("c_name")), lambda: scalars.uuid_text(F.unhex(F.md5("c_name")))
    b64 = [base64.b64encode(bytes.fromhex(x)).decode() for x in h]
    one, some = f"md5(c_name) = '{h[1]}'", f"md5(c_name) IN ('{h[0]}', '{h[2]}')"
    uuid_bin, uuid_text_ = Column("u", Kind.UUID, binary=True), Column("u", Kind.UUID)
    for name, make, column, op, v, sql in (
        ("filter_bytes_eq", raw, Column("b", Kind.BYTES), "eq", b64[1], one),
        ("filter_bytes_in", raw, Column("b", Kind.BYTES), "in", [b64[0], b64[2]], some),
        ("filter_bytes_not_in", raw, Column("b", Kind.BYTES), "notIn", [b64[0], b64[2]], f"NOT {some}"),
        ("filter_uuid_binary_eq", raw, uuid_bin, "eq", h[1].upper(), one),
        ("filter_uuid_binary_in", raw, uuid_bin, "in", [h[0], h[2]], some),
        ("filter_uuid_text_ne", text, uuid_text_, "ne", h[1], f"NOT {one}"),
    ):
        _typed(name, "customer", make, column, op, v, "c_custkey, c_name", sql)
    _typed("filter_enum_in", "orders", lambda: F.col("o_orderstatus"), Column("e", Kind.ENUM, values=("O", "F", "P")), "in", ["O", "P"], "o_orderkey, o_orderstatus", "o_orderstatus IN ('O', 'P')")
    _typed("filter_boolean_eq", "orders", lambda: F.col("o_orderstatus") == "F", Column("b", Kind.BOOLEAN), "eq", True, "o_orderkey", "o_orderstatus = 'F'")
    _typed("filter_boolean_ne", "orders", lambda: F.col("o_orderstatus") == "F", Column("b", Kind.BOOLEAN), "ne", True, "o_orderkey", "o_orderstatus <> 'F'")


_add_typed()

# --- pages

_COLS = "o_orderkey, o_totalprice"
_page("page_default_order", "orders", f"SELECT {_COLS} FROM orders ORDER BY o_orderkey LIMIT 25", _COLS, first=25)
_page("page_order_desc", "orders", f"SELECT {_COLS} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", _COLS, first=25, order_by=[{"oTotalprice": "DESC"}])
_page("page_order_mixed", "orders", f"SELECT {_COLS} FROM orders ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", _COLS, first=25, order_by=[{"oOrderpriority": "ASC"}, {"oTotalprice": "DESC"}])
_page("page_filtered", "orders", f"SELECT {_COLS} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25", _COLS, first=25, where={"oOrderstatus": {"eq": "O"}}, order_by=[{"oOrderdate": "DESC"}])
_page("page_any_indexed", "events", "SELECT event_id, ts FROM events ORDER BY ts NULLS FIRST, event_id LIMIT 25", "event_id, ts", first=25, order_by=[{"ts": "ASC"}], policy=ordering.ANY_INDEXED)
_page("page_after_seek", "orders", f"SELECT {_COLS} FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25", _COLS, first=25, after=codecs.cursor("Order", "o_orderkey", ["ASC"], [100]))
_page("page_after_seek_mixed", "orders", f"SELECT {_COLS} FROM orders WHERE o_totalprice < 250000 OR (o_totalprice = 250000 AND o_orderkey > 10) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", _COLS, first=25, order_by=[{"oTotalprice": "DESC"}], after=codecs.cursor("Order", "o_totalprice,o_orderkey", ["DESC", "ASC"], [250000.0, 10]))
_page("page_last", "orders", f"SELECT {_COLS} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 25", _COLS, last=25, order_by=[{"oTotalprice": "ASC"}])
_page("page_before", "orders", f"SELECT {_COLS} FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 25", _COLS, last=25, before=codecs.cursor("Order", "o_orderkey", ["ASC"], [500]))
_page("page_composite_key", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 40", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity", first=40)


@_query("page_offset", f"SELECT {_COLS} FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    return connections.page_at(c, t, 10, 30).select(*_COLS.split(", "))


# --- counts and aggregates


@_query("connection_total_count", "SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000")
def _(c: Catalog) -> DataFrame:
    page = connections.connect(c, c.table("orders"), where={"oTotalprice": {"gt": 100000}})
    return agg.over(page.base, [agg.Aggregate("count")])


_ALL = {"count": True, "countDistinct": ["oCustkey", "oOrderstatus"], "avg": ["oTotalprice"], "sum": ["oTotalprice"], "min": ["oOrderdate", "oTotalprice"], "max": ["oOrderdate", "oOrderpriority"]}
_ALL_SQL = "count(*) AS count, count(DISTINCT o_custkey) AS countDistinct_o_custkey, count(DISTINCT o_orderstatus) AS countDistinct_o_orderstatus, round(avg(o_totalprice), 2) AS avg_o_totalprice, round(sum(o_totalprice), 2) AS sum_o_totalprice, min(o_orderdate) AS min_o_orderdate, min(o_totalprice) AS min_o_totalprice, max(o_orderdate) AS max_o_orderdate, max(o_orderpriority) AS max_o_orderpriority"


def _rounded(df: DataFrame) -> DataFrame:
    """Sums and averages depend on the order of adding in their last digits."""
    return df.select(*[F.round(x, 2).alias(x) if x.startswith(("avg_", "sum_")) else x for x in df.columns])


@_query("connection_aggregate", f"SELECT {_ALL_SQL} FROM orders WHERE o_totalprice > 100000")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    page = connections.connect(c, t, where={"oTotalprice": {"gt": 100000}})
    return _rounded(agg.over(page.base, agg.parse(t, _ALL)))


@_query("aggregate_empty", f"SELECT {_ALL_SQL} FROM orders WHERE o_totalprice < 0")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    return _rounded(agg.over(connections.connect(c, t, where={"oTotalprice": {"lt": 0}}).base, agg.parse(t, _ALL)))


@_query("aggregate_top_n", "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50)")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    return _rounded(agg.over_top(c.rows(t), agg.parse(t, {"sum": ["oTotalprice"]}), ordering.parse(t, [{"oOrderdate": "DESC"}]), 50))


@_query("aggregate_top_n_by_fk", "SELECT count(*) AS count, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM (SELECT * FROM orders WHERE o_custkey = 3 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 5 OFFSET 1)")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    rows = Compiler(c).where(t, {"oCustkey": {"eq": 3}}).apply(c.rows(t))
    return _rounded(agg.over_top(rows, agg.parse(t, {"avg": ["oTotalprice"]}), ordering.parse(t, [{"oOrderdate": "DESC"}]), 5, 1))


@_query("aggregate_by_fk", "SELECT o_custkey, count(*) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice, max(o_orderdate) AS max_o_orderdate FROM orders GROUP BY o_custkey")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    return _rounded(agg.by_key(c.rows(t), ["o_custkey"], agg.parse(t, {"sum": ["oTotalprice"], "max": ["oOrderdate"]})))


@_query("per_parent_count_aggregate", "SELECT c_custkey, coalesce(n, 0) AS count, s AS sum_o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey) ON o_custkey = c_custkey")
def _(c: Catalog) -> DataFrame:
    t = c.table("customer")
    return _rounded(relations.aggregate_by_parent(c, c.rows(t).select("c_custkey"), t.relation("orders"), {"sum": ["oTotalprice"]}, {"oTotalprice": {"gt": 400000}}))


@_query("many_to_many_count", "SELECT p_partkey, count(s_suppkey) AS count, max(s_acctbal) AS max_s_acctbal FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey")
def _(c: Catalog) -> DataFrame:
    t = c.table("part")
    return _rounded(relations.aggregate_by_parent(c, c.rows(t).select("p_partkey"), t.relation("suppliers"), {"max": ["sAcctbal"]}))


@_query("edge_list_count", "SELECT p_partkey, coalesce(n, 0) AS count, q AS sum_quantity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, round(sum(q), 2) AS q FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_partkey) ON l_partkey = p_partkey")
def _(c: Catalog) -> DataFrame:
    t = c.table("part")
    return _rounded(relations.aggregate_by_parent(c, c.rows(t).select("p_partkey"), t.relation("supplies"), {"sum": ["quantity"]}))


# --- relationship filters

_BIG = "SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000"
_filtered("rel_some", "customer", {"orders": {"some": {"oTotalprice": {"gt": 480000}}}}, "c_custkey", f"EXISTS ({_BIG})")
_filtered("rel_none", "customer", {"orders": {"none": {"oTotalprice": {"gt": 480000}}}}, "c_custkey", f"NOT EXISTS ({_BIG})")
_filtered("rel_some_and_none", "customer", {"orders": {"some": {"oTotalprice": {"gt": 480000}}, "none": {"oOrderstatus": {"eq": "P"}}}}, "c_custkey", f"EXISTS ({_BIG}) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_filtered("rel_none_childless", "orders", {"lineitems": {"none": {}}}, "o_orderkey", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_filtered("rel_is", "orders", {"oCustkeyRef": {"is": {"cMktsegment": {"eq": "BUILDING"}}}}, "o_orderkey", "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
_filtered("rel_is_null", "labels", {"doc": {"isNull": True}}, "doc_id", "NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)")
_filtered("rel_is_not_null", "labels", {"doc": {"isNull": False}}, "doc_id", "EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)")
_filtered("rel_unlabelled", "documents", {"labels": {"none": {}}}, "doc_id", "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
_filtered("rel_some_under_or", "customer", {"OR": [{"orders": {"some": {"oTotalprice": {"gt": 480000}}}}, {"cAcctbal": {"lt": 0}}]}, "c_custkey", f"EXISTS ({_BIG}) OR c_acctbal < 0")
_filtered("rel_none_under_or", "customer", {"OR": [{"events": {"none": {}}}, {"cAcctbal": {"gt": 9000}}]}, "c_custkey", "NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) OR c_acctbal > 9000")
_filtered("rel_m2m_some", "part", {"suppliers": {"some": {"sAcctbal": {"gt": 9000}, "sSuppkey": {"gte": 0}}}}, "p_partkey", "EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9000 AND s_suppkey >= 0)")
_filtered("rel_m2m_none", "part", {"suppliers": {"none": {"sAcctbal": {"gt": 9500}, "sSuppkey": {"gte": 0}}}}, "p_partkey", "NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9500 AND s_suppkey >= 0)")
_filtered("rel_edge_some", "part", {"supplies": {"some": {"quantity": {"gt": 60}}}}, "p_partkey", "EXISTS (SELECT 1 FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE l_partkey = p_partkey AND q > 60)")

# --- traversals


@_query("many_to_one_join", "SELECT o_orderkey, c_name AS customer_c_name, n_name AS nation_n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(c: Catalog) -> DataFrame:
    t = c.table("orders")
    one = relations.to_one(c, c.rows(t), t.relation("oCustkeyRef"), "customer_")
    nation = c.table("nation")
    rows = c.rows(nation).select(*[F.col(x.name).alias(f"nation_{x.name}") for x in nation.columns])
    return one.join(rows, F.col("customer_c_nationkey") == F.col("nation_n_nationkey"), "left").select("o_orderkey", "customer_c_name", "nation_n_name")


def _top(name: str, table: str, relation: str, order: list[dict] | None, limit: int, offset: int, columns: str, sql: str, where: dict | None = None) -> None:
    @_query(name, sql)
    def run(c: Catalog) -> DataFrame:
        t = c.table(table)
        r = t.relation(relation)
        by = ordering.parse(c.tables[r.target], order)
        return relations.top_by_parent(c, r, limit, offset, by, where).select(F.col("_parent_0").alias("parent"), F.col("_rn").cast("long").alias("rn"), *columns.split(", "))


_OVER = "row_number() OVER (PARTITION BY {p} ORDER BY {o}) AS rn"
_top("one_to_many_top_k", "customer", "orders", [{"oOrderdate": "DESC"}], 3, 0, "o_orderkey, o_orderdate", f"SELECT o_custkey AS parent, o_orderkey, o_orderdate, {_OVER.format(p='o_custkey', o='o_orderdate DESC NULLS LAST, o_orderkey')} FROM orders QUALIFY rn <= 3")
_top("one_to_many_offset", "customer", "orders", [{"oTotalprice": "ASC"}], 2, 2, "o_orderkey", f"SELECT o_custkey AS parent, o_orderkey, {_OVER.format(p='o_custkey', o='o_totalprice NULLS FIRST, o_orderkey')} FROM orders QUALIFY rn > 2 AND rn <= 4")
_top("one_to_many_filtered", "customer", "orders", None, 2, 0, "o_orderkey", f"SELECT o_custkey AS parent, o_orderkey, {_OVER.format(p='o_custkey', o='o_orderkey')} FROM orders WHERE o_totalprice > 200000 QUALIFY rn <= 2", {"oTotalprice": {"gt": 200000}})
_top("many_to_many_top_k", "part", "suppliers", None, 3, 0, "s_suppkey, s_name", f"SELECT l_partkey AS parent, s_suppkey, s_name, {_OVER.format(p='l_partkey', o='s_suppkey')} FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey QUALIFY rn <= 3")
_top("edge_list_top_k", "part", "supplies", None, 3, 0, "l_suppkey, quantity, n_lines", f"SELECT l_partkey AS parent, l_suppkey, quantity, n_lines, {_OVER.format(p='l_partkey', o='l_suppkey')} FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY ALL) QUALIFY rn <= 3")


@_query("nested_three_level", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS a FROM nation QUALIFY a <= 2),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS b FROM customer QUALIFY b <= 2)
SELECT r_name, n_name, c_name FROM region JOIN n ON n_regionkey = r_regionkey JOIN c ON c_nationkey = n_nationkey""")
def _(c: Catalog) -> DataFrame:
    region, nation = c.table("region"), c.table("nation")
    n = relations.top_by_parent(c, region.relation("nations"), 2, parents=c.rows(region)).drop("_rn").withColumnRenamed("_parent_0", "_r")
    k = relations.top_by_parent(c, nation.relation("customers"), 2, order=ordering.parse(c.table("customer"), [{"cAcctbal": "DESC"}]), parents=n)
    return c.rows(region).join(n, F.col("_r") == F.col("r_regionkey")).join(k, F.col("_parent_0") == F.col("n_nationkey")).select("r_name", "n_name", "c_name")


# --- vectors: the query is the vector of row 0

_COS = "1 - list_inner_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.v, q.v)))"
_L2 = "sqrt(list_sum([(e.embedding[i]::DOUBLE - q.v[i]) * (e.embedding[i]::DOUBLE - q.v[i]) for i in range(1, 65)]))"
_Q = "(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q"


def _vectors(name: str, sql: str, seek: bool = False, **args) -> None:
    @_query(name, sql)
    def run(c: Catalog) -> DataFrame:
        t = c.table("embeddings")
        v = [float(x) for x in lookups.by_key(c, t, {"vecId": 0}).collect()[0]["embedding"]]  # one row
        given = dict(args)
        if seek:
            s = vectors.search(c, t, "embedding", v, first=5, **args)
            last = s.rows.collect()[4]  # a page of five
            given["after"] = codecs.cursor(t.type_name, s.order, s.directions, [last["_distance"], last["vec_id"]])
        s = vectors.search(c, t, "embedding", v, **given)
        return s.rows.limit(s.size).select("vec_id", F.round("_distance", 6).alias("distance"))


_vectors("vector_cosine", f"SELECT vec_id, round({_COS}, 6) AS distance FROM embeddings e, {_Q} ORDER BY {_COS}, vec_id LIMIT 20", first=20)
_vectors("vector_l2", f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings e, {_Q} ORDER BY {_L2}, vec_id LIMIT 20", metric="L2", first=20)
_vectors("vector_filtered", f"SELECT vec_id, round({_COS}, 6) AS distance FROM embeddings e, {_Q} WHERE label = 3 ORDER BY {_COS}, vec_id LIMIT 10", where={"label": {"eq": 3}}, first=10)
_vectors("vector_after", f"SELECT vec_id, round({_COS}, 6) AS distance FROM embeddings e, {_Q} ORDER BY {_COS}, vec_id LIMIT 20 OFFSET 5", seek=True)

# --- scalar expressions


@_query("uuid_text_binary", "SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, upper(h) AS raw FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
def _(c: Catalog) -> DataFrame:
    h = F.unhex(F.md5("c_name"))
    text = scalars.uuid_text(h)
    return c.rows(c.table("customer")).select("c_custkey", text.alias("id"), F.hex(scalars.uuid_bytes(F.upper(text))).alias("raw"))


@_query("bytes_base64", "SELECT s_suppkey, to_base64(encode(s_name)) AS name FROM supplier")
def _(c: Catalog) -> DataFrame:
    from .functions.kinds import Kind

    return c.rows(c.table("supplier")).select("s_suppkey", scalars.shown(Kind.BYTES, F.encode("s_name", "UTF-8")).alias("name"))


@_query("enum_ordinal", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'O' WHEN 2 THEN 'F' WHEN 3 THEN 'P' END AS literal, nullif(list_position(['O', 'F', 'P'], o_orderstatus), 0)::BIGINT AS ordinal FROM orders")
def _(c: Catalog) -> DataFrame:
    values = ("O", "F", "P")
    return c.rows(c.table("orders")).select("o_orderkey", scalars.enum_literal(F.col("o_orderkey") % 4, values).alias("literal"), scalars.enum_ordinal(F.col("o_orderstatus"), values).alias("ordinal"))


@_query("enum_names", "SELECT * FROM (VALUES ('1-URGENT', 'VALUE_1_URGENT'), ('4-NOT SPECIFIED', 'VALUE_4_NOT_SPECIFIED'), ('a b', 'A_B'), ('A_B', 'A_B_2'), ('été', 'U00E9T_U00E9'), ('', 'VALUE')) AS t(value, name)")
def _(c: Catalog) -> DataFrame:
    names = scalars.enum_names(("1-URGENT", "4-NOT SPECIFIED", "a b", "A_B", "été", ""))
    return _rows_of(c, list(names.items()), "value string, name string")


@_query("set_canonical", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en,x' WHEN 'de' THEN 'de,x' ELSE 'x' END AS tags FROM documents")
def _(c: Catalog) -> DataFrame:
    given = F.array(F.lit("x"), F.col("lang"), F.lit("x"))
    return c.rows(c.table("documents")).select("doc_id", scalars.set_text(given, ("en", "de", "x")).alias("tags"))


@_query("json_extract", "SELECT event_id, props->>'$.page' AS page FROM events")
def _(c: Catalog) -> DataFrame:
    return c.rows(c.table("events")).select("event_id", scalars.json_value(F.col("props"), "$.page").alias("page"))


@_query("datetime_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(c: Catalog) -> DataFrame:
    from .functions.kinds import Kind

    return c.rows(c.table("orders")).select("o_orderkey", scalars.shown(Kind.DATETIME, F.col("o_orderdate")).alias("at"), scalars.shown(Kind.DATE, F.col("o_orderdate")).alias("day"))


@_query("bigint_decimal_text", "SELECT o_orderkey, o_custkey::VARCHAR AS customer, (o_totalprice::DECIMAL(12, 2))::VARCHAR AS price FROM orders")
def _(c: Catalog) -> DataFrame:
    from .functions.kinds import Kind

    return c.rows(c.table("orders")).select("o_orderkey", scalars.shown(Kind.BIGINT, F.col("o_custkey")).alias("customer"), scalars.shown(Kind.DECIMAL, F.col("o_totalprice").cast("decimal(12,2)")).alias("price"))


@_query("time_year_text", "SELECT event_id, lpad((ms // 3600)::VARCHAR, 2, '0') || ':' || lpad((ms // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms % 60)::VARCHAR, 2, '0') AS t, lpad((event_id % 2156)::VARCHAR, 4, '0') AS y FROM (SELECT event_id, event_id % 300000 AS ms FROM events)")
def _(c: Catalog) -> DataFrame:
    from .functions.kinds import Kind

    return c.rows(c.table("events")).select("event_id", scalars.shown(Kind.TIME, (F.col("event_id") % 300000) * 1_000_000).alias("t"), scalars.shown(Kind.YEAR, F.col("event_id") % 2156).alias("y"))


# --- roles and versions


@_query("role_scoped", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def _(c: Catalog) -> DataFrame:
    from .sources.catalog import Filters

    seen = c.for_role(Filters(allow_tables=("customer", "nation"), deny_columns=("customer.c_name", "c_acctbal", "c_nationkey")), {"customer": lambda df: df.where("c_acctbal > 0")})
    return seen.rows(seen.table("customer"))


def _written(c: Catalog) -> tuple:
    """Customers in a store of two versions: as they are, and after a request that updates, deletes and creates. The store is the session's own."""
    from .operators.mutations import Request
    from .sources.catalog import Index, build, infer
    from .sources.versions import VersionStore

    rows = c.rows(c.table("customer")).select("c_custkey", "c_name", "c_acctbal")
    spark = rows.sparkSession
    store = VersionStore(spark, f"{_folder(spark)}/lattica/members-{uuid.uuid4().hex[:12]}")
    m = store.manifest()
    store.add_table(m, "customer", rows, ("c_custkey",))
    store.commit(m, now=dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    t = infer("customer", rows, ("c_custkey",), indexes=(Index("n", ("c_name",), unique=True),))
    members = build([t], {t.key: lambda: store.read(store.manifest(), "customer")})
    r = Request(members, store)
    done = [
        r.update("customer", {"cCustkey": 1}, {"cAcctbal": -5.5}),
        r.delete("customer", {"cCustkey": 2}),
        r.create("customer", {"cCustkey": -7, "cName": "new", "cAcctbal": None}),
        r.update("customer", codecs.node_id("Customer", [-7]), {"cAcctbal": 1.25}),
    ]
    if any(x.error for x in done):
        raise RuntimeError(f"a write failed: {[x.error for x in done]}")
    r.finish()
    return members, store


def _folder(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return f"file://{tempfile.gettempdir()}"


@_query("as_of_version", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(c: Catalog) -> DataFrame:
    """The older of two versions, by its time."""
    from .operators.mutations import versioned

    members, store = _written(c)
    past = versioned(members, store, store.manifest(at=dt.datetime(2024, 2, 1)))
    return past.rows(past.table("customer"))


@_query("write_state", "SELECT c_custkey, c_name, CASE c_custkey WHEN 1 THEN -5.5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey <> 2 UNION ALL SELECT -7, 'new', 1.25")
def _(c: Catalog) -> DataFrame:
    """The state after an update, a deletion, a creation and an update of what was created."""
    members, _ = _written(c)
    return members.rows(members.table("customer"))


@_query("write_compacted", "SELECT c_custkey, c_name, CASE c_custkey WHEN 1 THEN -5.5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey <> 2 UNION ALL SELECT -7, 'new', 1.25")
def _(c: Catalog) -> DataFrame:
    members, store = _written(c)
    store.compact("customer")
    return members.rows(members.table("customer"))


@_query("write_errors", "SELECT * FROM (VALUES ('duplicate key', 'Conflict'), ('duplicate name', 'Conflict'), ('null key', 'Constraint'), ('key changed', 'InputValidation'), ('nothing deleted', 'NotFound'), ('table denied', 'Permission'), ('unknown field', 'InputValidation'), ('committed', 'no')) AS t(attempt, error)")
def _(c: Catalog) -> DataFrame:
    """Typed errors; any of them undoes its request."""
    from .operators.mutations import Request, Rules

    members, store = _written(c)
    tries = {
        "duplicate key": lambda r: r.create("customer", {"cCustkey": 1, "cName": "x"}),
        "duplicate name": lambda r: r.create("customer", {"cCustkey": -9, "cName": "new"}),
        "null key": lambda r: r.create("customer", {"cName": "x"}),
        "key changed": lambda r: r.update("customer", {"cCustkey": 1}, {"cCustkey": 3}),
        "nothing deleted": lambda r: r.delete("customer", {"cCustkey": 2}),
        "unknown field": lambda r: r.update("customer", {"cCustkey": 1}, {"nope": 3}),
    }
    before = store.manifest().version
    out = []
    for name, f in tries.items():
        r = Request(members, store)
        out.append((name, f(r).error[0]))
        r.finish()
    out.append(("table denied", Request(members, store, Rules(deny=("cust*",))).delete("customer", {"cCustkey": 1}).error[0]))
    return _rows_of(c, [*out, ("committed", "no" if store.manifest().version == before else "yes")], "attempt string, error string")


@_query("role_as_of", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def _(c: Catalog) -> DataFrame:
    """A role's policy on an older version, over a column that the role does not see."""
    from .operators.mutations import versioned
    from .sources.catalog import Filters

    members, store = _written(c)
    role = members.for_role(Filters(deny_columns=("c_acctbal",)), {"customer": lambda df: df.where("c_acctbal > 0")})
    past = versioned(role, store, store.manifest(1))
    return past.rows(past.table("customer"))


@_query("role_write_hidden", "SELECT * FROM (SELECT c_custkey, c_acctbal > 0 AS found FROM customer WHERE c_custkey IN (3, 4, 5, 6, 8, 9))")
def _(c: Catalog) -> DataFrame:
    """What a role's policy hides cannot be updated: each row, and whether an update found it."""
    from .operators.mutations import Request
    from .sources.catalog import Filters

    members, store = _written(c)
    role = members.for_role(Filters(), {"customer": lambda df: df.where("c_acctbal > 0")})
    r = Request(role, store)
    return _rows_of(c, [(i, r.update("customer", {"cCustkey": i}, {"cName": f"renamed {i}"}).row is not None) for i in (3, 4, 5, 6, 8, 9)], "c_custkey long, found boolean")


# --- generated columns, nulls, composite keys


@_query("generated_column", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice, year(o_orderdate)::BIGINT AS ordered FROM orders WHERE year(o_orderdate) = 1997 ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 40")
def _(c: Catalog) -> DataFrame:
    """Columns computed on read, filtered and ordered by."""
    from .functions.kinds import Kind
    from .sources.catalog import Column, Index, build

    t = c.table("orders")
    more = (Column("twice", Kind.FLOAT, generated=True, expression="o_totalprice * 2"), Column("ordered", Kind.BIGINT, generated=True, expression="cast(year(o_orderdate) as bigint)"))
    t = replace(t, columns=t.columns + more, indexes=(*t.indexes, Index("tw", ("twice",)), Index("oy", ("ordered",))), foreign_keys=(), relations=(), fields=(), type_name="", collection="", single="")
    made = build([t], {t.key: c.readers[t.key]})
    page = connections.connect(made, made.table("orders"), where={"ordered": {"eq": 1997}}, order_by=[{"twice": "DESC"}], first=40, compiler=Compiler(made))
    return page.page.limit(40).select("o_orderkey", F.round("twice", 2).alias("twice"), "ordered")


def _nulled(c: Catalog) -> Catalog:
    """Customers of one segment have no segment, and orders of every seventh customer no customer."""
    customer, orders = c.table("customer"), c.table("orders")
    made = {
        customer.key: lambda: c.rows(customer).withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))),
        orders.key: lambda: c.rows(orders).withColumn("o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))),
    }
    return replace(c, readers=c.readers | made)


_SEG, _CUS = "nullif(c_mktsegment, 'BUILDING')", "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END"


def _null_filter(name: str, where: dict, sql_where: str) -> None:
    @_query(name, f"SELECT c_custkey, s AS c_mktsegment FROM (SELECT c_custkey, {_SEG} AS s FROM customer) WHERE {sql_where}")
    def run(c: Catalog) -> DataFrame:
        c = _nulled(c)
        t = c.table("customer")
        return Compiler(c).where(t, where).apply(c.rows(t)).select("c_custkey", "c_mktsegment")


_null_filter("null_is_null", {"cMktsegment": {"isNull": True}}, "s IS NULL")
_null_filter("null_eq_null", {"cMktsegment": {"eq": None}}, "s IS NULL")
_null_filter("null_ne_null", {"cMktsegment": {"ne": None}}, "s IS NOT NULL")
_null_filter("null_ne_value", {"cMktsegment": {"ne": "MACHINERY"}}, "s <> 'MACHINERY'")
_null_filter("null_not_in", {"cMktsegment": {"notIn": ["MACHINERY", None]}}, "s NOT IN ('MACHINERY')")
_null_filter("null_not_like", {"cMktsegment": {"notLike": "M%"}}, "s NOT LIKE 'M%'")


def _null_page(name: str, sql: str, **args) -> None:
    @_query(name, f"SELECT c_custkey, s AS c_mktsegment FROM (SELECT c_custkey, {_SEG} AS s FROM customer) {sql}")
    def run(c: Catalog) -> DataFrame:
        c = _nulled(c)
        return connections.connect(c, c.table("customer"), first=60, compiler=Compiler(c), **args).page.limit(60).select("c_custkey", "c_mktsegment")


_ORDER = "c_mktsegment,c_custkey"
_null_page("null_page_first", "ORDER BY s NULLS FIRST, c_custkey LIMIT 60", order_by=[{"cMktsegment": "ASC"}])
_null_page("null_page_after_null", "WHERE s IS NOT NULL OR c_custkey > 40 ORDER BY s NULLS FIRST, c_custkey LIMIT 60", order_by=[{"cMktsegment": "ASC"}], after=codecs.cursor("Customer", _ORDER, ["ASC", "ASC"], [None, 40]))
_null_page("null_page_after_last", "WHERE s IS NULL ORDER BY c_custkey LIMIT 60", order_by=[{"cMktsegment": "DESC"}], after=codecs.cursor("Customer", _ORDER, ["DESC", "ASC"], ["", 0]))


@_query("null_rel_is_null", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_CUS} AS k FROM orders) WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k)")
def _(c: Catalog) -> DataFrame:
    c = _nulled(c)
    t = c.table("orders")
    return Compiler(c).where(t, {"oCustkeyRef": {"isNull": True}}).apply(c.rows(t)).select("o_orderkey")


@_query("null_aggregate_by_parent", f"SELECT c_custkey, count(o_orderkey) AS count FROM customer LEFT JOIN (SELECT o_orderkey, {_CUS} AS k FROM orders) ON k = c_custkey GROUP BY c_custkey")
def _(c: Catalog) -> DataFrame:
    c = _nulled(c)
    t = c.table("customer")
    return relations.aggregate_by_parent(c, c.rows(t).select("c_custkey"), t.relation("orders"), {"count": True})


@_query("composite_partition_top_k", "SELECT l_partkey AS part, l_suppkey AS supplier, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem QUALIFY rn <= 2")
def _(c: Catalog) -> DataFrame:
    """Lines of each part and supplier, numbered by a key of two columns."""
    from .sources.catalog import Rel, Relation

    key = ("l_partkey", "l_suppkey")
    r = Relation(Rel.TO_MANY, "lines", ("", "lineitem"), key, key)
    return relations.top_by_parent(c, r, 2).select(F.col("_parent_0").alias("part"), F.col("_parent_1").alias("supplier"), "l_orderkey", "l_linenumber", F.col("_rn").cast("long").alias("rn"))


@_query("composite_to_one", "SELECT l_orderkey, l_linenumber, l_quantity, quantity AS supply_quantity FROM lineitem JOIN (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) ON p = l_partkey AND s = l_suppkey")
def _(c: Catalog) -> DataFrame:
    from .sources.catalog import Rel, Relation

    key = ("l_partkey", "l_suppkey")
    r = Relation(Rel.TO_ONE, "supply", ("", "supply"), key, key)
    return relations.to_one(c, c.rows(c.table("lineitem")), r, "supply_").select("l_orderkey", "l_linenumber", "l_quantity", "supply_quantity")


# --- requests, guards, costs and the catalog


def _rows_of(c: Catalog, rows: list[tuple], schema: str) -> DataFrame:
    return c.rows(c.table("region")).sparkSession.createDataFrame(rows, schema)


@_query("graphql_nested", """
WITH c AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 6),
o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT c_name AS customer, o_orderkey::VARCHAR AS order_key, o_totalprice AS price, n AS total FROM c JOIN o ON o_custkey = c_custkey WHERE rn <= 2""")
def _(c: Catalog) -> DataFrame:
    from .operators.execute import Engine

    got = Engine(c).execute('{ customers(first: 6, where: {cMktsegment: {eq: "BUILDING"}}) { nodes { cName orders(first: 2, orderBy: [{oTotalprice: DESC}]) { totalCount nodes { oOrderkey oTotalprice } } } } }')
    rows = [(x["cName"], o["oOrderkey"], o["oTotalprice"], x["orders"]["totalCount"]) for x in got["data"]["customers"]["nodes"] for o in x["orders"]["nodes"]]
    return _rows_of(c, rows, "customer string, order_key string, price double, total long")


@_query("graphql_nested_last", """
WITH c AS (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 8), o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey::VARCHAR AS customer, o_orderkey::VARCHAR AS order_key, (3 - rn)::BIGINT AS place FROM c JOIN o ON o_custkey = c_custkey WHERE rn <= 2""")
def _(c: Catalog) -> DataFrame:
    """The last two orders of each customer: one window for all."""
    from .operators.execute import Engine

    got = Engine(c).execute("{ customers(first: 8) { nodes { cCustkey orders(last: 2) { nodes { oOrderkey } } } } }")
    rows = [(x["cCustkey"], o["oOrderkey"], n + 3 - len(x["orders"]["nodes"])) for x in got["data"]["customers"]["nodes"] for n, o in enumerate(x["orders"]["nodes"])]
    return _rows_of(c, rows, "customer string, order_key string, place long")


@_query("graphql_fragments_aliases", "SELECT 'a' AS alias, n_name AS name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation WHERE n_nationkey = 2 UNION ALL SELECT 'b', n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) FROM nation WHERE n_nationkey = 5")
def _(c: Catalog) -> DataFrame:
    from .operators.execute import Engine

    got = Engine(c).execute("query($k: BigInt!) { a: nation_by_nNationkey(nNationkey: $k) { ...N } b: nation_by_nNationkey(nNationkey: 5) { ...N skipped: nName @skip(if: true) } } fragment N on Nation { nName nRegionkeyRef { rName } }", {"k": 2})
    return _rows_of(c, [(k, v["nName"], v["nRegionkeyRef"]["rName"]) for k, v in got["data"].items() if "skipped" not in v], "alias string, name string, region string")


@_query("graphql_page_info", "SELECT count(*) > 5 AS has_next, false AS has_previous, count(*) AS total, 5::BIGINT AS shown FROM orders WHERE o_orderstatus = 'P'")
def _(c: Catalog) -> DataFrame:
    from .operators.execute import Engine

    x = Engine(c).execute('{ orders(first: 5, where: {oOrderstatus: {eq: "P"}}) { pageInfo { hasNextPage hasPreviousPage } totalCount edges { cursor } } }')["data"]["orders"]
    return _rows_of(c, [(x["pageInfo"]["hasNextPage"], x["pageInfo"]["hasPreviousPage"], x["totalCount"], len(x["edges"]))], "has_next boolean, has_previous boolean, total long, shown long")


@_query("vector_by_text", f"SELECT vec_id, round({_COS}, 6) AS distance FROM embeddings e, {_Q} ORDER BY {_COS}, vec_id LIMIT 5")
def _(c: Catalog) -> DataFrame:
    """A text is made a vector by the column's embedder; here one that answers with the vector of row 0."""
    t = c.table("embeddings")
    v = [float(x) for x in lookups.by_key(c, t, {"vecId": 0}).collect()[0]["embedding"]]  # one row
    named = replace(t, columns=tuple(replace(x, embedder="own") if x.name == "embedding" else x for x in t.columns))
    s = vectors.search(replace(c, tables=c.tables | {t.key: named}), named, "embedding", query_text="row 0", first=5, embedders={"own": lambda text: v})
    return s.rows.limit(s.size).select("vec_id", F.round("_distance", 6).alias("distance"))


@_query("guards", "SELECT * FROM (VALUES ('unindexed filter', true), ('unindexed relation filter', true), ('order without index', true), ('order not a prefix', true), ('first and last', true), ('negative first', true), ('cursor of another order', true), ('half a key', true), ('indexed filter', false), ('depth', true), ('vector of another length', true)) AS t(request, refused)")
def _(c: Catalog) -> DataFrame:
    from .plans.limits import Limits, Selection

    supplier, orders, customer = c.table("supplier"), c.table("orders"), c.table("customer")
    deep = Selection("a", {}, (Selection("b", {}, (Selection("c", {}),)),))
    tries = {
        "unindexed filter": lambda: Compiler(c).where(supplier, {"sAcctbal": {"gt": 1}}),
        "unindexed relation filter": lambda: Compiler(c).where(c.table("part"), {"suppliers": {"some": {"nope": {"gt": 1}}}}),
        "order without index": lambda: ordering.parse(supplier, [{"sAcctbal": "ASC"}]),
        "order not a prefix": lambda: ordering.parse(c.table("events"), [{"ts": "ASC"}]),
        "first and last": lambda: connections.connect(c, orders, first=1, last=1),
        "negative first": lambda: connections.connect(c, orders, first=-1),
        "cursor of another order": lambda: connections.connect(c, orders, after=codecs.cursor("Order", "o_totalprice", ["ASC"], [1.0])),
        "half a key": lambda: lookups.by_key(c, c.table("conversations"), {"convId": 1}),
        "indexed filter": lambda: Compiler(c).where(customer, {"cAcctbal": {"gt": 1}}),
        "depth": lambda: Limits(depth=2).check(deep),
        "vector of another length": lambda: vectors.search(c, c.table("embeddings"), "embedding", [1.0, 2.0]),
    }

    def refused(f: Callable) -> bool:
        try:
            f()
        except ValueError:
            return True
        return False

    return _rows_of(c, [(k, refused(f)) for k, f in tries.items()], "request string, refused boolean")


@_query("cost_estimates", "SELECT * FROM (VALUES ('nested', 4, 56, 33), ('page', 2, 4, 3)) AS t(request, depth, rows, complexity)")
def _(c: Catalog) -> DataFrame:
    from .plans import graphql
    from .plans.limits import cost

    out = []
    for name, text in (("nested", "{ users(limit: 2) { posts(limit: 3) { comments(limit: 4) { id } } } }"), ("page", "{ users(first: 2) { nodes { id } pageInfo { hasNextPage } totalCount } }")):
        d = graphql.parse(text)
        got = cost(graphql.selection(graphql.fields(d.operation().selections, d, {})[0], d, {}))
        out.append((name, got.depth, got.rows, got.complexity))
    return _rows_of(c, out, "request string, depth int, rows int, complexity int")


@_query("catalog_relations", "SELECT * FROM (VALUES " + ", ".join(f"('{o}', '{k}', '{f}', '{t}')" for o, k, f, t in (
    # fixed values: what the declared keys of the folder's tables give
    ("customer", "many_to_one", "cNationkeyRef", "nation"), ("customer", "one_to_many", "events", "events"), ("customer", "one_to_many", "orders", "orders"),
    ("documents", "one_to_many", "labels", "labels"), ("events", "many_to_one", "user", "customer"), ("labels", "many_to_one", "doc", "documents"),
    ("lineitem", "many_to_one", "lOrderkeyRef", "orders"), ("lineitem", "many_to_one", "lPartkeyRef", "part"), ("lineitem", "many_to_one", "lSuppkeyRef", "supplier"),
    ("nation", "many_to_one", "nRegionkeyRef", "region"), ("nation", "one_to_many", "customers", "customer"), ("nation", "one_to_many", "suppliers", "supplier"),
    ("orders", "many_to_one", "oCustkeyRef", "customer"), ("orders", "one_to_many", "lineitems", "lineitem"), ("part", "one_to_many", "lineitems", "lineitem"),
    ("part", "many_to_many", "suppliers", "supplier"), ("part", "edge_list", "supplies", "supply"), ("region", "one_to_many", "nations", "nation"),
    ("supplier", "many_to_one", "sNationkeyRef", "nation"), ("supplier", "one_to_many", "lineitems", "lineitem"), ("supplier", "many_to_many", "parts", "part"), ("supplier", "edge_list", "supplies", "supply"),
    ("supply", "many_to_one", "part", "part"), ("supply", "many_to_one", "supplier", "supplier"),
)) + ") AS t(owner, kind, field, target)")
def _(c: Catalog) -> DataFrame:
    """The relationships that the declared keys give."""
    return _rows_of(c, [(t.name, r.kind.value, r.field, r.target[1]) for t in c.tables.values() for r in t.relations], "owner string, kind string, field string, target string")


@_query("catalog_types", "SELECT * FROM (VALUES ('Order', 'oOrderkey', 'BigInt!'), ('Order', 'oTotalprice', 'Float'), ('Order', 'oOrderdate', 'DateTime'), ('Order', 'oOrderstatus', 'String')) AS t(type, field, kind)")
def _(c: Catalog) -> DataFrame:
    """Field types as introspection tells them."""
    from .operators.execute import Engine

    got = Engine(c).execute('{ __type(name: "Order") { fields { name type { name ofType { name } } } } }')["data"]["__type"]["fields"]
    kinds = [(f["name"], f["type"]["name"] or f"{f['type']['ofType']['name']}!") for f in got]
    return _rows_of(c, [("Order", n, k) for n, k in kinds if n in ("oOrderkey", "oTotalprice", "oOrderdate", "oOrderstatus")], "type string, field string, kind string")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Orders over 1000, dearest first, a page of 25, each with its customer and three line items' quantity."""
    c = tpch.catalog(spark, folder, junctions=False)
    t = c.table("orders")
    page = connections.connect(c, t, where={"oTotalprice": {"gt": 1000}}, order_by=[{"oTotalprice": "DESC"}], first=25, compiler=Compiler(c))
    rows = relations.to_one(c, page.page.limit(25), t.relation("oCustkeyRef"), "customer_")
    lines = relations.top_by_parent(c, t.relation("lineitems"), 3, parents=page.page.limit(25)).groupBy("_parent_0").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    return rows.join(lines, F.col("_parent_0") == F.col("o_orderkey"), "left").select("o_orderkey", "o_totalprice", "o_orderdate", "customer_c_name", "quantity", "lines")
