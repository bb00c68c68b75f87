import datetime as dt

import pytest

from lattica.operators import aggregates as agg
from lattica.operators import connections, lookups, relations, vectors
from lattica.operators.execute import Engine
from lattica.plans import codecs, filters, graphql, limits, ordering
from lattica.plans.filters import Compiler
from lattica.sources.catalog import Index, build, infer


@pytest.fixture(scope="module")
def nulls(spark):
    """Rows with nulls and ties in the sort column."""
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3, f"n{i % 5}") for i in range(23)], "k int, v int, name string")
    t = infer("things", df, ("k",), indexes=(Index("i", ("v",)), Index("j", ("name", "v"))))
    return build([t], {t.key: lambda: df})


@pytest.mark.parametrize("order", [None, [{"v": "ASC"}], [{"v": "DESC"}], [{"name": "DESC"}, {"v": "ASC"}]])
@pytest.mark.parametrize("size", [4, 23])
def test_pages_make_the_whole(nulls, order, size):
    t = nulls.table("things")
    whole = [r.k for r in nulls.rows(t).orderBy(*ordering.parse(t, order).expressions()).collect()]
    got, after = [], None
    while True:
        c = connections.connect(nulls, t, order_by=order, first=size, after=after)
        got += [r.k for r in c.rows]
        assert c.page_info["hasPreviousPage"] == (after is not None)
        if not c.page_info["hasNextPage"]:
            break
        after = c.page_info["endCursor"]
    assert got == whole
    back, before = [], None
    while True:
        c = connections.connect(nulls, t, order_by=order, last=size, before=before)
        back = [r.k for r in c.rows] + back
        if not c.page_info["hasPreviousPage"]:
            break
        before = c.page_info["startCursor"]
    assert back == whole


def test_window_arguments():
    for bad in ({"first": 1, "last": 1}, {"after": "a", "before": "b"}, {"before": "b"}, {"last": 1, "after": "a"}, {"first": -1}, {"first": 1.5}):
        with pytest.raises(limits.BadWindow):
            limits.window(**bad)
    assert limits.window(first=1000).size == 100 and limits.window(first=0).size == 0 and limits.window().size == 100 and limits.window(first=1, after="").after is None


@pytest.mark.parametrize("bad", [[], [{}], [{"k": "ASC", "v": "ASC"}], [{"k": "UP"}], [{"x": "ASC"}], [{"v": "ASC"}, {"v": "ASC"}], [{"v": "ASC"}, {"name": "ASC"}]])
def test_orders_refused(nulls, bad):
    with pytest.raises(ordering.BadOrder):
        ordering.parse(nulls.table("things"), bad)


def test_order_policy(nulls):
    t = nulls.table("things")
    assert ordering.parse(t, [{"v": "ASC"}, {"name": "ASC"}], ordering.ANY_INDEXED).name == "v,name,k"
    assert ("name", "v") in ordering.allowed_prefixes(t) and ordering.indexed_fields(t) == ["k", "v", "name"]


def test_null_semantics(nulls):
    t = nulls.table("things")
    n = lambda w: Compiler(nulls).where(t, w).apply(nulls.rows(t)).count()
    assert n({"v": {"isNull": True}}) == n({"v": {"eq": None}}) == 6
    assert n({"v": {"ne": 1}}) + n({"v": {"eq": 1}}) == 17
    assert n({"v": {"notIn": []}}) == 23 and n({"v": {"in": []}}) == 0 and n({"v": {"in": [None, 1]}}) == n({"v": {"eq": 1}})
    assert n({"OR": []}) == n({"AND": [{}]}) == n({}) == 23 and n({"OR": [{}, {"v": {"eq": 1}}]}) == n({"v": {"eq": 1}})


@pytest.mark.parametrize("bad", [{"x": {"eq": 1}}, {"v": 1}, {"v": {"like": "a"}}, {"v": {"gt": None}}, {"v": {"isNull": 1}}, {"OR": {"v": {}}}, {"v": {"in": 1}}, {"v": {"eq": "a"}}, [1]])
def test_filters_refused(nulls, bad):
    with pytest.raises(filters.BadFilter):
        Compiler(nulls).where(nulls.table("things"), bad)


def test_relationship_filters_refused(catalog):
    c = Compiler(catalog)
    for bad in ({"orders": {"some": {"lineitems": {"some": {}}}}}, {"orders": {"is": {}}}, {"orders": {"some": 1}}):
        with pytest.raises(filters.BadFilter):
            c.where(catalog.table("customer"), bad)
    with pytest.raises(filters.BadFilter):
        c.where(catalog.table("orders"), {"oCustkeyRef": {"is": {}, "isNull": True}})


def test_index_guard(catalog):
    t = catalog.table("supplier")
    with pytest.raises(filters.BadFilter):
        Compiler(catalog).where(t, {"sAcctbal": {"gt": 1}})
    Compiler(catalog, check_indexes=False).where(t, {"sAcctbal": {"gt": 1}})
    Compiler(catalog).where(t, {"OR": [{"sAcctbal": {"gt": 1}}, {"sSuppkey": {"eq": 1}}]})


def test_some_and_none_partition(catalog):
    t, c = catalog.table("customer"), Compiler(catalog)
    for where in ({"oTotalprice": {"gt": 450000}}, {}):
        some = c.where(t, {"orders": {"some": where}}).apply(catalog.rows(t)).count()
        none = c.where(t, {"orders": {"none": where}}).apply(catalog.rows(t)).count()
        assert some + none == catalog.rows(t).count()


@pytest.mark.parametrize("owner, name", [("customer", "orders"), ("part", "suppliers"), ("part", "supplies")])
def test_batch_equals_single(catalog, owner, name):
    t = catalog.table(owner)
    r = t.relation(name)
    parents = [x[0] for x in catalog.rows(t).select(r.columns[0]).orderBy(r.columns[0]).limit(4).collect()]
    many = {}
    for x in relations.top_by_parent(catalog, r, 3).orderBy("_parent_0", "_rn").collect():
        many.setdefault(x["_parent_0"], []).append(x.asDict())
    for p in parents:
        one = connections.connect_parent(catalog, r, [p], first=3)
        keys = catalog.tables[r.target].primary_key
        assert [[x[k] for k in keys] for x in one.rows] == [[x[k] for k in keys] for x in many.get(p, [])]
    assert connections.connect_parent(catalog, r, [None]).rows == []


def test_aggregate_shapes(catalog):
    t = catalog.table("orders")
    c = connections.connect(catalog, t, where={"oTotalprice": {"lt": 0}})
    assert c.aggregate({"avg": ["oTotalprice"], "min": ["oOrderdate"]}) == {"count": 0, "min": {"o_orderdate": None}} and c.total_count == 0
    for bad in ({"avg": ["oOrderdate"]}, {"median": ["oTotalprice"]}, {"sum": ["nope"]}):
        with pytest.raises(agg.BadAggregate):
            agg.parse(t, bad)


def test_lookups_refused(catalog):
    with pytest.raises(lookups.BadLookup):
        lookups.by_key(catalog, catalog.table("orders"), {"oCustkey": 1})
    with pytest.raises(codecs.BadToken):
        lookups.by_node_id(catalog, codecs.node_id("Customer", [1]), catalog.table("orders"))
    assert lookups.parent_of(catalog, catalog.table("orders").relation("oCustkeyRef"), [None]) is None
    assert lookups.batch(catalog, catalog.table("orders"), ["o_orderkey"], [(None,)]).count() == 0


def test_vector_pages(catalog):
    t = catalog.table("embeddings")
    v = [0.1] * 64
    whole = [x.vec_id for x in vectors.search(catalog, t, "embedding", v, first=40).rows.limit(40).collect()]
    got, after = [], None
    for _ in range(5):
        s = vectors.search(catalog, t, "embedding", v, first=8, after=after)
        page = s.rows.collect()[:8]
        got += [x.vec_id for x in page]
        after = codecs.cursor(t.type_name, s.order, s.directions, [page[-1]._distance, page[-1].vec_id])
    assert got == whole
    for bad in ({"vector": v, "first": 0}, {}, {"vector": v, "query_text": "x"}, {"vector": v[:3]}, {"query_text": "x"}, {"vector": v, "metric": "DOT"}, {"vector": v, "last": 2}):
        with pytest.raises(vectors.BadSearch):
            vectors.search(catalog, t, "embedding", **bad)


def test_cost():
    s = limits.Selection
    inner = s("users", {"limit": 2}, (s("posts", {"limit": 3}, (s("comments", {"limit": 4}, (s("id", {}),)),)),))
    assert limits.cost(inner) == limits.Cost(4, 56, 33)
    page = s("users", {"first": 2}, (s("nodes", {}, (s("id", {}),)), s("pageInfo", {}, (s("hasNextPage", {}),)), s("totalCount", {})))
    assert limits.cost(page) == limits.Cost(2, 4, 3)
    with pytest.raises(limits.TooCostly):
        limits.Limits(depth=3).check(inner)


def test_graphql_reading():
    d = graphql.parse('query A($n: Int = 3, $w: W!) @d { a: x(first: $n, w: {k: [1, -2.5e1, "q\\"", E, null, true]}) { ...F ... on T @skip(if: true) { z } ... @include(if: true) { y } } } fragment F on T { y u }')
    op = d.operation("A")
    v = graphql.bind(op, {"w": 1})
    f = graphql.fields(op.selections, d, v)[0]
    assert f.key == "a" and graphql.arguments(f, v) == {"first": 3, "w": {"k": [1, -25.0, 'q"', "E", None, True]}}
    assert [x.name for x in graphql.fields(f.selections, d, v, ("T",))] == ["y", "u"]
    for bad in ("", "{", "{}", "query { a(b:) }", "{ a } }", "fragment F on T { a }", "{ a(x: 1, x: 2) }"):
        with pytest.raises(graphql.SyntaxProblem):
            graphql.parse(bad)
    with pytest.raises(graphql.SyntaxProblem):
        graphql.bind(op, {})
    loop = graphql.parse("{ ...F } fragment F on T { ...F }")
    with pytest.raises(graphql.SyntaxProblem):
        graphql.fields(loop.operation().selections, loop, {})
    assert graphql.operation_hash("{ a,b }") == graphql.operation_hash("{a b} # c") != graphql.operation_hash("{ b a }")


def test_graphql_answers(catalog):
    e = Engine(catalog)
    got = e.execute("query($k: BigInt!) { one: order_by_oOrderkey(oOrderkey: $k) { ...O } customers(first: 2) { nodes { cName orders(first: 1) { totalCount nodes { oOrderkey } pageInfo { hasNextPage } } last: orders(last: 1) { nodes { oOrderkey } } } } } fragment O on Order { id oTotalprice oCustkeyRef { cCustkey cNationkeyRef { nName } } }", {"k": 5})
    assert "errors" not in got
    one = got["data"]["one"]
    assert e.execute("query($i: ID!) { node(id: $i) { ... on Order { oTotalprice } } }", {"i": one["id"]})["data"]["node"]["oTotalprice"] == one["oTotalprice"]
    for c in got["data"]["customers"]["nodes"]:
        o = c["orders"]
        assert o["pageInfo"]["hasNextPage"] == (o["totalCount"] > 1) and len(c["last"]["nodes"]) == 1
    deep = "{ regions { nodes { nations { nodes { customers { nodes { orders { nodes { lineitems { nodes { lQuantity } } } } } } } } } } }"
    assert "depth" in e.execute(deep)["errors"][0]["message"]
    assert e.execute("{ nope { a } }")["errors"] and e.execute("{ orders { nodes { nope } } }")["data"] == {"orders": None}
    assert e.execute("{ orders { nodes { oOrderkey } } }", role="x")["errors"]


def test_declared_moments():
    from lattica.functions.scalars import ValueProblem
    from lattica.sources.versions import as_of

    now = dt.datetime(2024, 1, 2)
    assert as_of(offset_seconds=-60, now=now) == dt.datetime(2024, 1, 1, 23, 59) and as_of("2024-01-01T00:00:00Z", now=now) == dt.datetime(2024, 1, 1)
    for bad in ({}, {"time_": "2024-01-01T00:00:00Z", "offset_seconds": 0}, {"offset_seconds": 1}, {"time_": "2025-01-01T00:00:00Z"}, {"time_": "x"}):
        with pytest.raises(ValueProblem):
            as_of(**bad, now=now)


def test_databases_by_graphql(spark):
    """Two databases: roots are grouped by database, types carry its name, and a foreign key crosses over."""
    from lattica.sources.catalog import ForeignKey

    orders = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    ships = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "id int, order_id int")
    tables = [infer("orders", orders, ("id",), database="shop"), infer("shipments", ships, ("id",), database="logistics", foreign_keys=(ForeignKey(("order_id",), ("shop", "orders"), ("id",)),))]
    c = build(tables, {tables[0].key: lambda: orders, tables[1].key: lambda: ships})
    got = Engine(c).execute("{ shop { orders { nodes { name shipments { totalCount nodes { databaseId order { name } } } } } } logistics { shipment_by_databaseId(databaseId: 9) { __typename order { name } } } }")
    assert "errors" not in got
    assert [(o["name"], o["shipments"]["totalCount"], [s["order"]["name"] for s in o["shipments"]["nodes"]]) for o in got["data"]["shop"]["orders"]["nodes"]] == [("a", 2, ["a", "a"]), ("b", 1, ["b"])]
    assert got["data"]["logistics"]["shipment_by_databaseId"] == {"__typename": "LogisticShipment", "order": {"name": "b"}}


def test_spark_catalog(spark):
    from lattica.sources.catalog import from_spark_catalog

    spark.sql("create database if not exists lt_db")
    spark.range(3).selectExpr("id", "concat('n', id) name").write.mode("overwrite").saveAsTable("lt_db.things")
    try:
        c = from_spark_catalog(spark, "lt_db", {"things": {"primary_key": ("id",)}})
        assert connections.connect(c, c.table("things"), first=2).has_more
    finally:
        spark.sql("drop database lt_db cascade")


def test_pages_of_all_parents_take_one_query(spark, catalog):
    """last, before and after of a nested page run one window for all parents, and agree with pages of one parent."""
    e = Engine(catalog)
    t = catalog.table("customer")
    r = t.relation("orders")
    first = connections.connect_parent(catalog, r, [1], first=1)
    place = first.cursor(first.rows[0])
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("nested"))
    for args, single in ((f'first: 2, after: "{place}"', {"first": 2, "after": place}), ("last: 2", {"last": 2}), (f'last: 2, before: "{place}"', {"last": 2, "before": place})):
        spark.sparkContext.setJobGroup("nested", args)
        before = jobs()
        got = e.execute(f"{{ customers(first: 12) {{ nodes {{ cCustkey a: orders({args}) {{ nodes {{ oOrderkey }} pageInfo {{ hasNextPage hasPreviousPage startCursor }} }} b: orders({args}) {{ nodes {{ oOrderkey }} }} }} }} }}")
        assert "errors" not in got and jobs() - before <= 8
        spark.sparkContext._jsc.sc().clearJobGroup()
        for c in got["data"]["customers"]["nodes"][:4]:
            one = connections.connect_parent(catalog, r, [int(c["cCustkey"])], **single)
            assert [int(x["oOrderkey"]) for x in c["a"]["nodes"]] == [x["o_orderkey"] for x in one.rows] and c["b"]["nodes"] == c["a"]["nodes"]
            assert c["a"]["pageInfo"] == {k: v for k, v in one.page_info.items() if k != "endCursor"}


def test_selected_columns_are_read(catalog):
    """Lookups, to-one rows and nested pages read what is selected."""
    from pyspark.sql.classic.dataframe import DataFrame

    e, seen = Engine(catalog), []
    plain = DataFrame.collect
    try:
        DataFrame.collect = lambda self: (seen.append(set(self.columns)), plain(self))[1]
        got = e.execute("{ order_by_oOrderkey(oOrderkey: 5) { oTotalprice oCustkeyRef { cName orders(first: 1) { nodes { oOrderdate } } } } }")
    finally:
        DataFrame.collect = plain
    assert "errors" not in got
    assert seen == [{"o_orderkey", "o_totalprice", "o_custkey"}, {"c_custkey", "c_name"}, {"_parent_0", "o_orderkey", "o_orderdate", "_rn"}]


def test_introspection(catalog):
    e = Engine(catalog)
    got = e.execute('{ __schema { queryType { name } mutationType { name } types { kind name fields { name type { kind name ofType { kind name ofType { name } } } args { name } } inputFields { name type { name } } enumValues { name } } directives { name } } a: __type(name: "Order") { kind fields { name } interfaces { name } } b: __type(name: "Nope") { name } }')
    assert "errors" not in got
    types = {t["name"]: t for t in got["data"]["__schema"]["types"]}
    assert got["data"]["__schema"]["queryType"]["name"] == "Query" and got["data"]["__schema"]["mutationType"] is None and got["data"]["b"] is None
    roots = {f["name"]: f for f in types["Query"]["fields"]}
    assert {"orders", "order", "order_by_oOrderkey", "nation_by_nName", "node", "searchEmbeddingsByEmbeddingVector"} <= set(roots) and "partSuppliers" not in roots
    assert {a["name"] for a in roots["orders"]["args"]} == {"first", "after", "last", "before", "where", "orderBy", "orderByPolicy"}
    assert {"lineitems", "oCustkeyRef", "id"} <= {f["name"] for f in got["data"]["a"]["fields"]} and got["data"]["a"]["interfaces"] == [{"name": "Node"}]
    assert {"AND", "OR", "lineitems", "oTotalprice"} <= {f["name"] for f in types["OrderWhere"]["inputFields"]}

    def named(t):
        while t.get("ofType"):
            t = t["ofType"]
        return t["name"]

    assert all(named(f["type"]) is None or named(f["type"]) in types for t in types.values() for f in t["fields"] or ())


def test_generated_columns(spark):
    """Computed on read, filtered, ordered and looked up like any other; files need not hold them."""
    from lattica.functions.kinds import Kind
    from lattica.sources.catalog import Column, Table

    C = Column
    df = spark.createDataFrame([(1, "a", '{"city": "Oslo"}', 2.0, 3), (2, "b", '{"city": "Rome"}', 1.5, 4), (3, "c", None, 1.0, 1)], "id int, name string, info string, price double, quantity int")
    t = Table("places", (C("id", Kind.INT, nullable=False), C("name", Kind.STRING), C("info", Kind.JSON), C("price", Kind.FLOAT), C("quantity", Kind.INT), C("city", Kind.STRING, generated=True, expression="get_json_object(info, '$.city')"), C("total", Kind.FLOAT, generated=True, expression="price * quantity")), ("id",), (Index("c", ("city",)), Index("t", ("total",)), Index("u", ("city", "name"), unique=True)))
    e = Engine(build([t], {t.key: lambda: df}))
    got = e.execute('{ places(where: {city: {in: ["Oslo", "Rome"]}}, orderBy: [{total: DESC}]) { nodes { name city total } aggregate { sum { total } } } place_by_city_name(city: "Rome", name: "b") { total } }')
    assert got == {"data": {"places": {"nodes": [{"name": "a", "city": "Oslo", "total": 6.0}, {"name": "b", "city": "Rome", "total": 6.0}], "aggregate": {"sum": {"total": 12.0}}}, "place_by_city_name": {"total": 6.0}}}
