import pytest

from lattica.functions.kinds import Kind
from lattica.sources.catalog import Column, Filters, ForeignKey, Index, Junction, Overrides, Rel, Table, build, junction
from lattica.sources.naming import Names, Taken, camel, pascal


def C(name, kind=Kind.INT, null=False, **k):
    return Column(name, kind, nullable=null, **k)


def make(*tables, **k):
    return build(tables, {t.key: (lambda: None) for t in tables}, **k)


USERS = Table("users", (C("id"), C("name", Kind.STRING)), ("id",))
ROLES = Table("roles", (C("id"), C("name", Kind.STRING)), ("id",))
FK = (ForeignKey(("user_id",), ("", "users"), ("id",)), ForeignKey(("role_id",), ("", "roles"), ("id",)))


@pytest.mark.parametrize("one, many", [("user", "users"), ("category", "categories"), ("box", "boxes"), ("person", "people"), ("day", "days"), ("status", "statuses"), ("news", "news"), ("branch", "branches"), ("orderItem", "orderItems")])
def test_plurals(one, many):
    n = Names()
    assert n.plural(one) == many and n.singular(many) == one and n.plural(many) == many


def test_names():
    assert camel("user_name") == "userName" and pascal("order_items") == "OrderItems" and camel("2fa") == "_2Fa"
    n = Names(types={"x": "Custom"}, plurals={"staff": "staffers"})
    assert n.type_name("query") == "Query_" and n.type_name("x") == "Custom" and n.plural("staff") == "staffers"
    assert n.to_one("created_by_user_id") == "createdByUser" and n.to_many("posts", "author_id", False) == "authorPosts"
    t = Taken()
    assert [t.give("a", "1"), t.give("a", "2"), t.give("a", "3"), t.give("a", "4", "Ref"), t.give("a", "1")] == ["a", "a2", "a3", "aRef", "a"]


def test_one_to_many_names():
    posts = Table("posts", (C("id"), C("author_id"), C("editor_id")), ("id",), foreign_keys=(ForeignKey(("author_id",), ("", "users"), ("id",)), ForeignKey(("editor_id",), ("", "users"), ("id",))))
    c = make(USERS, posts)
    assert [(r.kind, r.field) for r in c.table("posts").relations] == [(Rel.TO_ONE, "author"), (Rel.TO_ONE, "editor")]
    assert [r.field for r in c.table("users").relations] == ["authorPosts", "editorPosts"]
    assert c.table("users").fields == (("databaseId", "id"), ("name", "name"))


def test_pure_junction():
    j = Table("user_roles", (C("user_id"), C("role_id")), ("user_id", "role_id"), foreign_keys=FK)
    assert junction(j) is Junction.PURE
    c = make(USERS, ROLES, j)
    r = c.table("users").relation("roles")
    assert r.kind is Rel.THROUGH and r.near_columns == ("user_id",) and r.far_columns == ("role_id",)
    assert c.table("roles").relation("users").kind is Rel.THROUGH and c.table("user_roles").relations == ()


def test_attribute_junction():
    j = Table("assignments", (C("user_id"), C("role_id"), C("since", Kind.DATE)), ("user_id", "role_id"), foreign_keys=FK)
    c = make(USERS, ROLES, j)
    assert c.table("users").relation("assignments").kind is Rel.EDGES
    assert [r.field for r in c.table("assignments").relations] == ["user", "role"]


@pytest.mark.parametrize("columns, key, fks", [((C("user_id", null=True), C("role_id")), (), FK), ((C("id"), C("user_id"), C("role_id")), ("id",), FK), ((C("user_id"), C("role_id")), ("user_id", "role_id"), FK[:1])])
def test_no_junction(columns, key, fks):
    assert junction(Table("x", columns, key, foreign_keys=fks)) is None


def test_junction_by_unique_index():
    j = Table("x", (C("id"), C("user_id"), C("role_id")), ("id",), (Index("u", ("user_id", "role_id"), unique=True),), FK)
    assert junction(j) is Junction.ATTRIBUTES


def test_clash_with_column():
    posts = Table("posts", (C("id"), C("user"), C("user_id")), ("id",), foreign_keys=(ForeignKey(("user_id",), ("", "users"), ("id",)),))
    assert make(USERS, posts).table("posts").relations[0].field == "userRef"


def test_filters_and_overrides():
    t = Table("t", (C("id"), C("secret", Kind.STRING), C("flag"), C("u", Kind.BYTES)), ("id",), (Index("i", ("flag", "secret")),))
    c = make(t, Table("hidden", (C("id"),), ("id",)), Table("v", (C("id"),), view=True), filters=Filters(deny_tables=("hid*",), deny_columns=("t.secret",)), overrides=Overrides(uuid=("t.u",), boolean=("*.flag",)))
    t = c.table("t")
    assert [x.name for x in t.columns] == ["id", "flag", "u"] and t.indexes == () and set(c.tables) == {("", "t")}
    assert t.column("u").kind is Kind.UUID and t.column("u").binary and t.column("flag").kind is Kind.BOOLEAN


def test_databases():
    orders = Table("orders", (C("id"),), ("id",), database="shop")
    ships = Table("shipments", (C("id"), C("order_id")), ("id",), foreign_keys=(ForeignKey(("order_id",), ("shop", "orders"), ("id",)),), database="logistics")
    c = make(orders, ships)
    assert c.namespaced and c.table("shipments").type_name == "LogisticShipment" and c.table("orders").relations[0].field == "shipments"


def test_fingerprint():
    a, b = make(USERS), make(Table("users", (*USERS.columns, C("x")), ("id",)))
    assert a.fingerprint() == make(USERS).fingerprint() != b.fingerprint()


def test_watcher():
    from lattica.streaming.watch import Watcher

    state = [make(USERS)]
    seen = []
    w = Watcher(lambda: state[0], seen.append, first=10, most=20)
    assert not w.poll() and w.wait == 15 and not w.poll() and w.wait == 20
    state[0] = make(USERS, ROLES)
    assert w.poll() and w.wait == 10 and len(seen) == 1 and w.current is state[0]
    state[0] = None
    assert not w.poll() and w.errors and w.current is seen[0]
