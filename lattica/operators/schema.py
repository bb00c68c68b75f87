"""The GraphQL types that a catalog gives, as introspection tells of them."""

from __future__ import annotations

from ..functions.kinds import Kind
from ..functions.scalars import enum_names
from ..plans import graphql
from ..plans.graphql import Document, Field
from ..plans.ordering import ANY_INDEXED, PREFIX
from ..sources.catalog import Catalog, Column, Junction, Rel, Table
from . import vectors
from .aggregates import FUNCTIONS
from .mutations import Rules, required

_BUILT_IN = ("Int", "Float", "String", "Boolean", "ID")


def _upper(name: str) -> str:
    return name[:1].upper() + name[1:]


def value_type(t: Table, c: Column) -> str:
    """The name of a column's type; enums have one of their own."""
    if c.kind in (Kind.ENUM, Kind.SET):
        name = f"{t.type_name}{_upper(t.field_of(c.name))}" if c.values else "String"
        return f"[{name}!]" if c.kind is Kind.SET else name
    return "[Float!]" if c.kind is Kind.VECTOR else c.kind.value


def _field(name: str, kind: str, args: list | None = None, description: str = "") -> dict:
    return {"name": name, "type": kind, "args": args or [], "description": description or None}


def _object(name: str, fields: list[dict], interfaces: tuple = (), description: str = "") -> dict:
    return {"kind": "OBJECT", "name": name, "description": description or None, "fields": fields, "interfaces": list(interfaces)}


def _input(name: str, fields: list[dict]) -> dict:
    return {"kind": "INPUT_OBJECT", "name": name, "description": None, "inputFields": fields}


class _Types:
    def __init__(self, catalog: Catalog):
        self.catalog, self.all = catalog, {}

    def add(self, t: dict) -> str:
        self.all.setdefault(t["name"], t)
        return t["name"]

    def enum(self, name: str, values: list[str]) -> str:
        return self.add({"kind": "ENUM", "name": name, "description": None, "enumValues": values})

    def filter(self, t: Table, c: Column) -> str:
        """Operators of a column's kind, on its type."""
        one = value_type(t, c)
        if c.kind is Kind.SET:
            one = one.strip("[]!")
        many = f"[{one}!]"
        kinds = {"isNull": "Boolean", "in": many, "notIn": many, "has": one, "hasAnyOf": many, "hasAllOf": many, "hasNoneOf": many}
        own = c.kind is Kind.SET
        return self.add(_input(f"{one}{'Set' if own else ''}Filter", [_field(op, many if own and op in ("eq", "ne") else kinds.get(op, one)) for op in sorted(c.kind.operators)]))

    def where(self, t: Table) -> str:
        name = f"{t.type_name}Where"
        if name not in self.all:
            out = _input(name, [])
            self.all[name] = out
            out["inputFields"] += [_field(f, self.filter(t, t.column(c))) for f, c in t.fields if t.column(c).kind.operators]
            out["inputFields"] += [_field(x, f"[{name}!]") for x in ("AND", "OR")]
            for r in t.relations:
                target = self.catalog.tables[r.target]
                inner = self.scalar_where(target)
                ops = [_field("is", inner), _field("isNull", "Boolean")] if r.kind is Rel.TO_ONE else [_field("some", inner), _field("none", inner)]
                out["inputFields"].append(_field(r.field, self.add(_input(f"{t.type_name}{_upper(r.field)}RelationFilter", ops))))
        return name

    def scalar_where(self, t: Table) -> str:
        name = f"{t.type_name}ScalarWhere"
        if name not in self.all:
            out = _input(name, [])
            self.all[name] = out
            out["inputFields"] += [_field(f, self.filter(t, t.column(c))) for f, c in t.fields if t.column(c).kind.operators]
            out["inputFields"] += [_field(x, f"[{name}!]") for x in ("AND", "OR")]
        return name

    def page_args(self, t: Table) -> list[dict]:
        self.enum("OrderDirection", ["ASC", "DESC"])
        self.enum("OrderByPolicy", [PREFIX, ANY_INDEXED])
        order = self.add(_input(f"{t.type_name}OrderBy", [_field(f, "OrderDirection") for f, c in t.fields if c in t.indexed]))
        sizes = [_field("first", "Int"), _field("after", "String"), _field("last", "Int"), _field("before", "String")]
        return [*sizes, *([] if t.view else [_field("where", self.where(t))]), _field("orderBy", f"[{order}!]"), _field("orderByPolicy", "OrderByPolicy")]

    def connection(self, t: Table) -> str:
        self.add(_object("PageInfo", [_field("hasNextPage", "Boolean!"), _field("hasPreviousPage", "Boolean!"), _field("startCursor", "String"), _field("endCursor", "String")]))
        edge = self.add(_object(f"{t.type_name}Edge", [_field("cursor", "String!"), _field("node", f"{t.type_name}!")]))
        parts = [_field("count", "Int!")]
        for function in FUNCTIONS:
            fits = [(f, t.column(c)) for f, c in t.fields if t.column(c).kind.comparable and (t.column(c).kind.numeric or function not in ("avg", "sum"))]
            if fits:
                kind = lambda c: "Int" if function == "countDistinct" else "Float" if function in ("avg", "sum") else value_type(t, c)  # noqa: B023, E731
                parts.append(_field(function, self.add(_object(f"{t.type_name}{_upper(function)}", [_field(f, kind(c)) for f, c in fits]))))
        totals = self.add(_object(f"{t.type_name}Aggregate", parts))
        return self.add(_object(f"{t.type_name}Connection", [_field("edges", f"[{edge}!]!"), _field("nodes", f"[{t.type_name}!]!"), _field("pageInfo", "PageInfo!"), _field("totalCount", "Int!"), _field("aggregate", f"{totals}!")]))

    def row(self, t: Table) -> str:
        out = _object(t.type_name, [_field("id", "ID!")] if t.primary_key and not any(f == "id" for f, _ in t.fields) else [], ("Node",) if t.primary_key else (), t.comment)
        if self.add(out) and self.all[t.type_name] is not out:
            return t.type_name
        for f, c in t.fields:
            col = t.column(c)
            if col.kind in (Kind.ENUM, Kind.SET) and col.values:
                self.enum(f"{t.type_name}{_upper(f)}", list(enum_names(col.values).values()))
            out["fields"].append(_field(f, value_type(t, col) + ("" if col.nullable else "!"), description=col.comment))
        for r in t.relations:
            target = self.catalog.tables[r.target]
            if r.kind is Rel.TO_ONE:
                out["fields"].append(_field(r.field, target.type_name))
            elif target.primary_key:
                out["fields"].append(_field(r.field, f"{self.connection(target)}!", self.page_args(target)))
        return t.type_name

    def roots(self, t: Table, require_vector_index: bool) -> list[dict]:
        out = []
        if t.primary_key:
            out += [_field(t.collection, f"{self.connection(t)}!", self.page_args(t)), _field(t.single, t.type_name, [_field("id", "ID!")])]
        for key in [t.primary_key, *t.uniques]:
            if key:
                out.append(_field(f"{t.single}_by_" + "_".join(t.field_of(c) for c in key), t.type_name, [_field(t.field_of(c), f"{value_type(t, t.column(c))}!") for c in key]))
        for c in vectors.searchable(t, require_vector_index):
            self.enum("VectorDistanceMetric", list(vectors.METRICS))
            edge = self.add(_object(f"{t.type_name}VectorEdge", [_field("cursor", "String!"), _field("node", f"{t.type_name}!"), _field("distance", "Float!"), _field("rank", "Int!")]))
            page = self.add(_object(f"{t.type_name}VectorConnection", [_field("edges", f"[{edge}!]!"), _field("nodes", f"[{t.type_name}!]!"), _field("pageInfo", "PageInfo!")]))
            args = [_field("vector", "[Float!]"), *([_field("queryText", "String")] if c.embedder else []), _field("metric", "VectorDistanceMetric"), _field("first", "Int"), _field("after", "String"), _field("where", self.where(t))]
            out.append(_field(f"search{_upper(t.collection)}By{_upper(t.field_of(c.name))}Vector", f"{page}!", args))
        return out

    def writes(self, t: Table, rules: Rules) -> list[dict]:
        out, entity = [], t.type_name[:1].lower() + t.type_name[1:]
        needed = {c.name for c in required(t)}
        writable = [(f, t.column(c)) for f, c in t.fields if rules.column(t, t.column(c))]
        key = {"id": "ID!"}

        def field(verb: str, args: list[dict]) -> dict:
            done = self.add(_object(f"{verb}{t.type_name}Success", [_field(entity, t.type_name)]))
            union = self.add({"kind": "UNION", "name": f"{verb}{t.type_name}Result", "description": None, "possibleTypes": [done, *ERRORS]})
            return _field(f"{verb.lower()}{t.type_name}", f"{union}!", args)

        if not rules.lacking(t):
            by = {r.columns[0] for r in t.relations if r.kind is Rel.TO_ONE}  # may be given by connect instead
            inner = [_field(f, value_type(t, c) + ("!" if c.name in needed and c.name not in by else "")) for f, c in writable]
            for r in t.relations:
                target = self.catalog.tables[r.target]
                if r.kind in (Rel.TO_ONE, Rel.THROUGH):
                    keys = [_field("id", "ID"), *(_field(target.field_of(c), value_type(target, target.column(c))) for k in target.uniques for c in k)]
                    one = self.add(_input(f"{target.type_name}ConnectInput", list({x["name"]: x for x in keys}.values())))
                    nested = self.add(_input(f"{t.type_name}{_upper(r.field)}ConnectInput", [_field("connect", f"[{one}!]" if r.kind is Rel.THROUGH else one)]))
                    inner.append(_field(r.field, nested))
                elif rules.table(self.catalog, target) and not rules.lacking(target):
                    inner.append(_field(r.field, self.add(_input(f"Create{t.type_name}{_upper(r.field)}NestedInput", [_field("create", f"[Create{target.type_name}Input!]")]))))
            out.append(field("Create", [_field("input", self.add(_input(f"Create{t.type_name}Input", inner)) + "!")]))
        settable = [_field(f, value_type(t, c)) for f, c in writable if c.name not in t.primary_key]
        if settable:
            out.append(field("Update", [_field("id", key["id"]), _field("set", self.add(_input(f"Update{t.type_name}SetInput", settable)))]))
        out.append(field("Delete", [_field("id", key["id"])]))
        return out


ERRORS = tuple(f"{x}Error" for x in ("InputValidation", "Conflict", "Constraint", "NotFound", "Permission"))


def types(catalog: Catalog, rules: Rules | None = None, require_vector_index: bool = True) -> dict[str, dict]:
    """All types by name; with rules, those of mutations too."""
    out = _Types(catalog)
    for name in (*_BUILT_IN, *sorted({c.kind.value for t in catalog.tables.values() for c in t.columns} - {*_BUILT_IN, "Enum", "Set", "Vector"})):
        out.add({"kind": "SCALAR", "name": name, "description": None})
    queries = [_field("node", "Node", [_field("id", "ID!")])]
    grouped: dict[str, list] = {}
    shown = [t for t in catalog.tables.values() if catalog.junction(t) is not Junction.PURE]
    for t in shown:
        out.row(t)
    for t in shown:
        grouped.setdefault(t.database, []).extend(out.roots(t, require_vector_index))
    for database, fields in grouped.items():
        if catalog.namespaced:
            own = out.add(_object(f"{catalog.names.type_name(database)}Query", fields))
            queries.append(_field(catalog.names.field(database), f"{own}!"))
        else:
            queries += fields
    out.add(_object("Query", queries))
    out.add({"kind": "INTERFACE", "name": "Node", "description": None, "fields": [_field("id", "ID!")], "possibleTypes": [t.type_name for t in shown if t.primary_key]})
    if rules is not None:
        writes = [w for t in shown if rules.table(catalog, t) for w in out.writes(t, rules)]
        if writes:
            out.add(_object("Mutation", writes))
            for e in ERRORS:
                out.add(_object(e, [_field("message", "String!")], ("MutationError",)))
            out.add({"kind": "INTERFACE", "name": "MutationError", "description": None, "fields": [_field("message", "String!")], "possibleTypes": list(ERRORS)})
    return out.all


DIRECTIVES = (
    {"name": "include", "locations": ["FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"], "args": [_field("if", "Boolean!")], "description": None},
    {"name": "skip", "locations": ["FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"], "args": [_field("if", "Boolean!")], "description": None},
    {"name": "asOf", "locations": ["FIELD"], "args": [_field("time", "DateTime"), _field("offsetSeconds", "Int")], "description": None},
)


def introspect(all_types: dict[str, dict], f: Field, doc: Document, variables: dict) -> object:
    """What __schema or __type(name:) selects."""
    own = lambda x: graphql.fields(x.selections, doc, variables)

    def reference(text: str, x: Field) -> dict | None:
        if text.endswith("!"):
            return wrapped("NON_NULL", text[:-1], x)
        if text.startswith("["):
            return wrapped("LIST", text[1:-1], x)
        return shown(all_types[text], x)

    def wrapped(kind: str, inner: str, x: Field) -> dict:
        return {y.key: {"kind": kind, "__typename": "__Type", "ofType": reference(inner, y) if y.name == "ofType" else None}.get(y.name) for y in own(x)}

    def member(m: dict, x: Field, typename: str) -> dict:
        out = {}
        for y in own(x):
            if y.name == "type":
                out[y.key] = reference(m["type"], y)
            elif y.name == "args":
                out[y.key] = [member(a, y, "__InputValue") for a in m["args"]]
            else:
                out[y.key] = {"name": m["name"], "description": m.get("description"), "isDeprecated": False, "locations": m.get("locations"), "__typename": typename}.get(y.name)
        return out

    def shown(t: dict, x: Field) -> dict:
        out = {}
        for y in own(x):
            if y.name in ("fields", "inputFields"):
                out[y.key] = [member(m, y, "__Field" if y.name == "fields" else "__InputValue") for m in t[y.name]] if y.name in t else None
            elif y.name == "enumValues":
                out[y.key] = [member({"name": v}, y, "__EnumValue") for v in t["enumValues"]] if "enumValues" in t else None
            elif y.name in ("interfaces", "possibleTypes"):
                out[y.key] = [shown(all_types[n], y) for n in t[y.name] if n in all_types] if y.name in t else None
            else:
                out[y.key] = {"kind": t["kind"], "name": t["name"], "description": t.get("description"), "__typename": "__Type"}.get(y.name)
        return out

    if f.name == "__type":
        t = all_types.get(graphql.arguments(f, variables).get("name"))
        return shown(t, f) if t else None
    out: dict = {}
    for x in own(f):
        if x.name == "types":
            out[x.key] = [shown(all_types[n], x) for n in sorted(all_types)]
        elif x.name in ("queryType", "mutationType"):
            t = all_types.get("Query" if x.name == "queryType" else "Mutation")
            out[x.key] = shown(t, x) if t else None
        elif x.name == "directives":
            out[x.key] = [member(d, x, "__Directive") for d in DIRECTIVES]
        else:
            out[x.key] = {"__typename": "__Schema"}.get(x.name)
    return out
