import datetime as dt

import pytest

from lattica.functions.kinds import Kind
from lattica.operators.execute import Engine
from lattica.operators.mutations import Request, Rules
from lattica.plans import codecs
from lattica.sources.catalog import Column, Filters, ForeignKey, Index, Table, build
from lattica.sources.versions import CommitConflict, NoVersion, VersionStore


@pytest.fixture
def shop(spark, tmp_path):
    """Categories, products, tags and their junction, one version old."""
    C = Column
    tables = [
        Table("categories", (C("id", Kind.INT, nullable=False, auto=True), C("name", Kind.STRING, nullable=False)), ("id",), (Index("u", ("name",), unique=True),)),
        Table("products", (C("id", Kind.INT, nullable=False, auto=True), C("category_id", Kind.INT, nullable=False), C("sku", Kind.STRING, nullable=False), C("price", Kind.FLOAT)), ("id",), (Index("u", ("sku",), unique=True),), (ForeignKey(("category_id",), ("", "categories"), ("id",)),)),
        Table("tags", (C("id", Kind.INT, nullable=False), C("label", Kind.STRING)), ("id",)),
        Table("product_tags", (C("product_id", Kind.INT, nullable=False), C("tag_id", Kind.INT, nullable=False)), ("product_id", "tag_id"), (), (ForeignKey(("product_id",), ("", "products"), ("id",)), ForeignKey(("tag_id",), ("", "tags"), ("id",)))),
    ]
    data = {"categories": ("id int, name string", [(1, "a"), (2, "b")]), "products": ("id int, category_id int, sku string, price double", [(1, 1, "s1", 5.0), (2, 1, "s2", None)]), "tags": ("id int, label string", [(1, "x"), (2, "y")]), "product_tags": ("product_id int, tag_id int", [(1, 1)])}
    store = VersionStore(spark, f"file://{tmp_path}/store")
    m = store.manifest()
    for t in tables:
        schema, rows = data[t.name]
        store.add_table(m, t.name, spark.createDataFrame(rows, schema), t.primary_key, 10)
    store.commit(m, now=dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    catalog = build(tables, {t.key: (lambda n=t.name: store.read(store.manifest(), n)) for t in tables})
    return catalog, store


def test_create_update_delete(shop):
    catalog, store = shop
    r = Request(catalog, store)
    made = r.create("products", {"sku": "s3", "category": {"connect": {"name": "b"}}, "price": 1, "tags": {"connect": [{"databaseId": 2}]}})
    assert made.error is None and made.row["id"] == 10 and made.row["category_id"] == 2
    assert r.update("products", {"databaseId": 10}, {"price": 2.5}).row["price"] == 2.5
    assert r.update("products", {"databaseId": 10}, {}).row["price"] == 2.5  # a read, of what was just written
    assert r.update("products", {"databaseId": 99}, {"price": 1.0}) .row is None
    assert r.delete("products", {"databaseId": 2}).error is None
    assert r.finish().version == 2
    assert sorted((x.id, x.price) for x in catalog.rows(catalog.table("products")).collect()) == [(1, 5.0), (10, 2.5)]
    assert catalog.rows(catalog.table("product_tags")).count() == 2
    store.compact("products")
    assert sorted(x.id for x in catalog.rows(catalog.table("products")).collect()) == [1, 10]
    assert store.read(store.manifest(1), "products").count() == 2
    assert store.read(store.manifest(at=dt.datetime(2024, 6, 1)), "products").count() == 2
    with pytest.raises(NoVersion):
        store.manifest(at=dt.datetime(2023, 1, 1))


def test_nested_create(shop):
    catalog, store = shop
    r = Request(catalog, store)
    made = r.create("categories", {"name": "new", "products": {"create": [{"sku": "n1"}, {"sku": "n2"}]}})
    assert made.row["id"] == 10 and r.finish()
    assert {x.category_id for x in catalog.rows(catalog.table("products")).where("sku like 'n%'").collect()} == {10}


@pytest.mark.parametrize(
    "run, kind",
    [
        (lambda r: r.create("products", {"sku": "s1", "categoryId": 1}), "Conflict"),
        (lambda r: r.create("products", {"sku": "s9", "categoryId": 77}), "Constraint"),
        (lambda r: r.create("products", {"sku": "s9"}), "Constraint"),
        (lambda r: r.create("products", {"sku": None, "categoryId": 1}), "Constraint"),
        (lambda r: r.create("products", {"sku": 5, "categoryId": 1}), "InputValidation"),
        (lambda r: r.create("products", {"zip": 5}), "InputValidation"),
        (lambda r: r.create("products", {"sku": "s9", "category": {"connect": {"name": "zz"}}}), "NotFound"),
        (lambda r: r.create("product_tags", {"productId": 1, "tagId": 2}), "Permission"),
        (lambda r: r.create("tags", {"databaseId": 9}), "Permission"),
        (lambda r: r.update("products", {"databaseId": 1}, {"databaseId": 5}), "InputValidation"),
        (lambda r: r.update("products", {"databaseId": 1}, {"sku": "s2"}), "Conflict"),
        (lambda r: r.delete("products", {"databaseId": 99}), "NotFound"),
        (lambda r: r.delete("categories", {"databaseId": 1}), "Constraint"),
        (lambda r: r.delete("products", "???"), "InputValidation"),
    ],
)
def test_errors_undo_all(shop, run, kind):
    catalog, store = shop
    r = Request(catalog, store, Rules(deny=frozenset(["tags"])))
    assert r.create("categories", {"name": "kept?"}).error is None
    assert run(r).error[0] == kind
    assert r.finish() is None and catalog.rows(catalog.table("categories")).count() == 2


def test_second_writer_fails(shop):
    catalog, store = shop
    a, b = Request(catalog, store), Request(catalog, store)
    a.create("categories", {"name": "p"})
    b.create("categories", {"name": "q"})
    a.finish()
    with pytest.raises(CommitConflict):
        b.finish()


def test_by_graphql(shop):
    catalog, store = shop
    e = Engine(catalog, store)
    got = e.execute('mutation { a: createCategory(input: {name: "g"}) { __typename ... on CreateCategorySuccess { category { id name } } } }')
    assert got["data"]["a"]["__typename"] == "CreateCategorySuccess" and got["data"]["a"]["category"]["name"] == "g"
    got = e.execute('mutation { b: createCategory(input: {name: "h"}) { __typename } c: createCategory(input: {name: "h"}) { __typename ... on MutationError { message } } }')
    assert got["data"]["c"]["__typename"] == "ConflictError" and got["data"]["c"]["message"]
    assert e.execute("{ categories { totalCount } }")["data"]["categories"]["totalCount"] == 3
    past = e.execute('{ categories @asOf(time: "2024-02-01T00:00:00Z") { totalCount nodes { name products { totalCount } } } }')["data"]["categories"]
    assert past["totalCount"] == 2 and past["nodes"][0]["products"]["totalCount"] == 2
    assert e.execute('{ categories @asOf(time: "2999-02-01T00:00:00Z") { totalCount } }')["errors"]


@pytest.fixture
def ward(spark, tmp_path):
    """Rows of two owners under a policy, and two tables of one name in two databases, two versions old."""
    C = Column
    things = Table("things", (C("id", Kind.INT, nullable=False), C("owner", Kind.STRING), C("note", Kind.STRING), C("size", Kind.INT), C("area", Kind.INT, generated=True, expression="size * size")), ("id",), (Index("o", ("owner",)), Index("a", ("area",), unique=True)), database="da")
    other = Table("things", (C("id", Kind.INT, nullable=False), C("word", Kind.STRING)), ("id",), database="db")
    store = VersionStore(spark, f"file://{tmp_path}/ward")
    m = store.manifest()
    store.add_table(m, "da.things", spark.createDataFrame([(1, "me", "mine", 1), (2, "you", "hidden", 2)], "id int, owner string, note string, size int"), ("id",))
    store.add_table(m, "db.things", spark.createDataFrame([(1, "b1")], "id int, word string"), ("id",))
    store.commit(m, now=dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    readers = {t.key: (lambda n=f"{t.database}.things": store.read(store.manifest(), n)) for t in (things, other)}
    catalog = build([things, other], readers)
    roles = {"me": catalog.for_role(Filters(), {("da", "things"): lambda df: df.where("owner = 'me'")})}
    return Engine(catalog, store, roles=roles, check_indexes=False), store


def test_policies_hold_for_versions_and_writes(ward):
    e, store = ward
    all_ = "{ da { things %s { totalCount nodes { note area } } } db { things %s { nodes { word } } } }"
    for moment in ("", '@asOf(time: "2024-02-01T00:00:00Z")'):
        got = e.execute(all_ % (moment, moment), role="me")
        assert got == {"data": {"da": {"things": {"totalCount": 1, "nodes": [{"note": "mine", "area": 1}]}}, "db": {"things": {"nodes": [{"word": "b1"}]}}}}
        assert e.execute(all_ % (moment, moment))["data"]["da"]["things"]["totalCount"] == 2
    t = e.catalog.tables["da", "things"]
    hidden, own = codecs.node_id(t.type_name, [2]), codecs.node_id(t.type_name, [1])
    got = e.execute(f'mutation {{ update{t.type_name}(id: "{hidden}", set: {{note: "x"}}) {{ __typename ... on Update{t.type_name}Success {{ entity {{ note }} }} }} }}', role="me")
    assert "errors" not in got, got
    assert got["data"][f"update{t.type_name}"]["entity"] is None and store.manifest().version == 1
    got = e.execute(f'mutation {{ delete{t.type_name}(id: "{hidden}") {{ __typename }} }}', role="me")
    assert got["data"][f"delete{t.type_name}"]["__typename"] == "NotFoundError" and store.manifest().version == 1
    got = e.execute(f'mutation {{ update{t.type_name}(id: "{own}", set: {{note: "new", size: 3}}) {{ ... on Update{t.type_name}Success {{ entity {{ note area }} }} }} }}', role="me")
    assert got["data"][f"update{t.type_name}"]["entity"] == {"note": "new", "area": 9} and store.manifest().version == 2
    # keys hold for hidden rows too, generated ones included
    got = e.execute(f'mutation {{ create{t.type_name}(input: {{databaseId: 2}}) {{ __typename }} }}', role="me")
    assert got["data"][f"create{t.type_name}"]["__typename"] == "ConflictError"
    got = e.execute(f'mutation {{ create{t.type_name}(input: {{databaseId: 5, size: 2}}) {{ __typename }} }}', role="me")
    assert got["data"][f"create{t.type_name}"]["__typename"] == "ConflictError"
    with pytest.raises(KeyError):
        e.catalog.for_role(Filters(), {"nothing": lambda df: df})


@pytest.mark.parametrize("text", ['mutation { createTag(input: {databaseId: 9}) @asOf(offsetSeconds: -10) { __typename } }', "{ categories { nodes { products @asOf(offsetSeconds: -10) { totalCount } } } }", "{ categories { nodes { ...F } } } fragment F on Category { products @asOf(offsetSeconds: -10) { totalCount } }", "query @asOf(offsetSeconds: -10) { categories { totalCount } }", "{ ... @asOf(offsetSeconds: -10) { categories { totalCount } } }"])
def test_moments_stand_on_root_fields(shop, text):
    catalog, store = shop
    assert "only allowed on root" in Engine(catalog, store).execute(text)["errors"][0]["message"] and store.manifest().version == 1


def test_writes_denied_by_pattern(shop):
    catalog, store = shop
    e = Engine(catalog, store, rules=Rules(deny=("ta*",), deny_columns=("products.price", "name")))
    got = e.execute('{ m: __type(name: "Mutation") { fields { name } } p: __type(name: "UpdateProductSetInput") { inputFields { name } } }')["data"]
    names = {f["name"] for f in got["m"]["fields"]}
    assert "updateProduct" in names and not any("Tag" in n for n in names) and "createCategory" not in names and [f["name"] for f in got["p"]["inputFields"]] == ["categoryId", "sku"]
    assert e.execute("mutation { deleteTag(id: \"x\") { __typename } }")["errors"]
    r = Request(catalog, store, e.rules)
    assert r.create("categories", {"name": "x"}).error[0] == "Permission" and r.update("products", {"databaseId": 1}, {"price": 3.0}).error[0] == "InputValidation"
    hidden = catalog.for_role(Filters(deny_columns=("products.sku",)))
    assert Request(hidden, store).create("products", {"categoryId": 1}).error[0] == "Permission"
