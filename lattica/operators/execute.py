"""Runs GraphQL requests over a catalog: one query a relationship and level, never one a row; equal fields of a level share one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions import scalars
from ..plans import codecs, graphql, ordering
from ..plans.filters import Compiler
from ..plans.graphql import Document, Field, Inline, Spread
from ..plans.limits import DEFAULT_PAGE, Limits, window
from ..sources.catalog import Catalog, Junction, Rel, Relation, Table
from ..sources.versions import VersionStore, as_of, stored
from . import aggregates as agg
from . import connections, lookups, mutations, schema, vectors
from .relations import aggregate_by_parent, parent_names, top_by_parent

_PAGE = {"first", "after", "last", "before", "where", "orderBy", "orderByPolicy"}


class RequestProblem(ValueError):
    """A field or argument that the schema does not have."""


@dataclass
class Engine:
    """store: where writes go and older versions are read from; catalogs: by role, else `catalog` for all."""

    catalog: Catalog
    store: VersionStore | None = None
    limits: Limits = field(default_factory=Limits)
    default_page: int = DEFAULT_PAGE
    check_indexes: bool = True
    require_vector_index: bool = True
    rules: mutations.Rules = field(default_factory=mutations.Rules)
    embedders: dict[str, Callable[[str], list[float]]] = field(default_factory=dict)
    roles: dict[str, Catalog] = field(default_factory=dict)

    def execute(self, text: str, variables: dict | None = None, operation: str | None = None, role: str | None = None) -> dict:
        """{"data": ...} and, where fields failed, {"errors": [...]}; a failed field is null."""
        try:
            if role is not None and role not in self.roles:
                raise RequestProblem(f"no schema for role {role}")
            doc = graphql.parse(text)
            op = doc.operation(operation)
            bound = graphql.bind(op, variables)
            catalog = self.roles[role] if role is not None else self.catalog
            roots = graphql.fields(op.selections, doc, bound)
            _check_moments(op, doc, catalog)
            run = _Run(self, catalog, doc, bound)
            return run.mutation(roots) if op.kind == "mutation" else run.query(roots)
        except (ValueError, KeyError, LookupError) as e:
            return {"data": None, "errors": [{"message": str(e)}]}


def _check_moments(op: graphql.Operation, doc: Document, catalog: Catalog) -> None:
    """@asOf stands on the root fields of queries only: those of a database's group, where roots are grouped."""

    def walk(selections: list, depth: int, seen: frozenset) -> None:
        for s in selections:
            allowed = op.kind == "query" and depth in ((0, 1) if catalog.namespaced else (0,))
            if "asOf" in s.directives and not (allowed and isinstance(s, graphql.Field)):
                raise RequestProblem("@asOf is only allowed on root query fields")
            if isinstance(s, graphql.Field):
                walk(s.selections, depth + 1, seen)
            elif isinstance(s, Inline):
                walk(s.selections, depth, seen)
            elif isinstance(s, Spread) and s.name in doc.fragments and s.name not in seen:
                walk(doc.fragments[s.name].selections, depth, seen | {s.name})

    walk(op.selections, 0, frozenset())
    if "asOf" in op.directives:
        raise RequestProblem("@asOf is only allowed on root query fields")


class _Run:
    def __init__(self, engine: Engine, catalog: Catalog, doc: Document, variables: dict):
        self.engine, self.catalog, self.doc, self.variables = engine, catalog, doc, variables
        self.compiler = Compiler(catalog, engine.check_indexes)
        self.errors: list[dict] = []
        self.memo: dict = {}  # what equal fields of one level share

    def fields(self, f: Field, *on: str) -> list[Field]:
        return graphql.fields(f.selections, self.doc, self.variables, on)

    def args(self, f: Field) -> dict:
        return graphql.arguments(f, self.variables)

    # --- roots

    def query(self, roots: list[Field]) -> dict:
        data = {}
        for f in roots:
            data[f.key] = self._guarded(f, self.catalog)
        return {"data": data} | ({"errors": self.errors} if self.errors else {})

    def _guarded(self, f: Field, catalog: Catalog) -> object:
        try:
            run = self
            if "asOf" in f.directives:
                run = self._past(f)
            return run._root(f)
        except (ValueError, KeyError, LookupError) as e:
            self.errors.append({"message": str(e), "path": [f.key]})
            return None

    def _past(self, f: Field) -> _Run:
        """The same request over an older version; all below the field inherits it."""
        if self.engine.store is None:
            raise RequestProblem("no versions are kept")
        given = graphql.resolve(f.directives["asOf"], self.variables)
        at = as_of(given.get("time"), given.get("offsetSeconds"), dt.datetime.now(dt.UTC).replace(tzinfo=None))
        past = mutations.versioned(self.catalog, self.engine.store, self.engine.store.manifest(at=at))
        run = _Run(self.engine, past, self.doc, self.variables)
        run.errors = self.errors
        return run

    def _root(self, f: Field) -> object:
        if f.name == "__typename":
            return "Query"
        if f.name in ("__schema", "__type"):
            return schema.introspect(self._types(), f, self.doc, self.variables)
        if self.catalog.namespaced:
            inner = {k: t for k, t in self.catalog.tables.items() if self.catalog.names.field(k[0]) == f.name}
            if inner:
                out = {}
                for x in self.fields(f):
                    run = self._past(x) if "asOf" in x.directives else self
                    out[x.key] = run._table_root(x, inner)
                return out
        return self._table_root(f, self.catalog.tables)

    def _table_root(self, f: Field, tables: dict) -> object:
        if f.name == "node":
            t, rows = lookups.by_node_id(self.catalog, self._only(f, "id")["id"])
            return self._one(f, t, rows, check=False)
        for t in tables.values():
            if self.catalog.junction(t) is Junction.PURE:
                continue
            if f.name == t.collection and t.primary_key:
                self.engine.limits.check(graphql.selection(f, self.doc, self.variables), self.engine.default_page)
                return self._connection(f, t)
            if f.name == t.single and t.primary_key:
                _, rows = lookups.by_node_id(self.catalog, self._only(f, "id")["id"], t)
                return self._one(f, t, rows, check=False)
            if f.name.startswith(f"{t.single}_by_"):
                for key in [t.primary_key, *t.uniques]:
                    if key and f.name == f"{t.single}_by_" + "_".join(t.field_of(c) for c in key):
                        return self._one(f, t, lookups.by_key(self.catalog, t, self.args(f)))
            for c in vectors.searchable(t, self.engine.require_vector_index):
                name = t.field_of(c.name)
                if f.name in (f"search{x[:1].upper()}{x[1:]}By{name[:1].upper()}{name[1:]}Vector" for x in (t.collection, t.type_name)):
                    self.engine.limits.check(graphql.selection(f, self.doc, self.variables), self.engine.default_page)
                    return self._vector(f, t, c.name)
        raise RequestProblem(f"no field {f.name}")

    def _types(self) -> dict:
        return schema.types(self.catalog, self.engine.rules if self.engine.store is not None else None, self.engine.require_vector_index)

    def _only(self, f: Field, *names: str) -> dict:
        """The arguments, which must be just these."""
        args = self.args(f)
        if set(args) != set(names):
            raise RequestProblem(f"{f.name}: takes {', '.join(names)}")
        return args

    def _one(self, f: Field, t: Table, rows, check: bool = True) -> dict | None:
        if check:
            self.engine.limits.check(graphql.selection(f, self.doc, self.variables), self.engine.default_page)
        got = rows.select(*self._read(self.fields(f, t.type_name, "Node"), t)).collect()  # one row
        return self._rows(f, t, [got[0].asDict()])[0] if got else None

    # --- connections

    def _page_args(self, f: Field) -> dict:
        args = self.args(f)
        if unknown := set(args) - _PAGE:
            raise RequestProblem(f"{f.name}: unknown arguments {', '.join(sorted(unknown))}")
        out = {k: args[k] for k in ("first", "after", "last", "before", "where") if k in args}
        return out | {"order_by": args.get("orderBy"), "policy": args.get("orderByPolicy", ordering.PREFIX), "default": self.engine.default_page, "compiler": self.compiler}

    def _node_fields(self, f: Field) -> list[Field]:
        out = []
        for x in self.fields(f):
            if x.name == "nodes":
                out.append(x)
            elif x.name == "edges":
                out += [y for y in self.fields(x) if y.name == "node"]
        return out

    def _columns(self, f: Field, t: Table) -> list[str]:
        """Columns that the selection of nodes needs: its own, the key, and the local side of relationships."""
        return self._read([x for n in self._node_fields(f) for x in self.fields(n, t.type_name, "Node")], t)

    def _read(self, chosen: list[Field], t: Table, more: tuple[str, ...] = ()) -> list[str]:
        """Columns that fields of a row need, with the key and `more`."""
        wanted = {*t.primary_key, *more}
        for x in chosen:
            c = next((c for fl, c in t.fields if fl == x.name), None)
            r = t.relation(x.name)
            if c is not None:
                wanted.add(c)
            elif r is not None:
                wanted |= set(r.columns)
        return [c.name for c in t.columns if c.name in wanted]

    def _aggregate_selection(self, f: Field) -> dict:
        out: dict = {}
        for x in self.fields(f):
            if x.name == "count":
                out["count"] = True
            elif x.name != "__typename":
                out.setdefault(x.name, []).extend(y.name for y in self.fields(x) if y.name != "__typename")
        return out

    def _show_aggregate(self, f: Field, t: Table, got: dict) -> dict:
        out = {}
        for x in self.fields(f):
            if x.name == "count":
                out[x.key] = got["count"]
            else:
                part = {}
                for y in self.fields(x):
                    c = t.column_of(y.name)
                    v = got.get(x.name, {}).get(c.name)
                    part[y.key] = scalars.api(c.kind, v, c.values) if x.name in ("min", "max") else v
                out[x.key] = part
        return out

    def _connection(self, f: Field, t: Table) -> dict:
        key = ("page", t.key, repr(sorted(self.args(f).items())))
        columns = self._columns(f, t)
        if key not in self.memo or not set(columns) <= self.memo[key][1]:
            self.memo[key] = connections.connect(self.catalog, t, columns=columns, **self._page_args(f)), set(columns)
        c = self.memo[key][0]
        return self._show_connection(f, t, c)

    def _show_connection(self, f: Field, t: Table, c: connections.Connection, count: Callable[[], int] | None = None, aggregate: Callable[[dict], dict] | None = None) -> dict:
        out: dict = {}
        chosen = self.fields(f)
        asked = next((self._aggregate_selection(x) for x in chosen if x.name == "aggregate"), None)
        totals = (aggregate or c.aggregate)(asked) if asked is not None else None  # first, as it brings the count
        for x in chosen:
            if x.name == "nodes":
                out[x.key] = self._rows(x, t, [r.asDict() for r in c.rows])
            elif x.name == "edges":
                edges: list[dict] = [{} for _ in c.rows]
                for y in self.fields(x):
                    values = [c.cursor(r) for r in c.rows] if y.name == "cursor" else self._rows(y, t, [r.asDict() for r in c.rows])
                    for e, v in zip(edges, values, strict=True):
                        e[y.key] = v
                out[x.key] = edges
            elif x.name == "pageInfo":
                info = c.page_info
                out[x.key] = {y.key: info[y.name] for y in self.fields(x)}
            elif x.name == "totalCount":
                out[x.key] = totals["count"] if totals else (count() if count else c.total_count)
            elif x.name == "aggregate":
                out[x.key] = self._show_aggregate(x, t, totals)
            elif x.name == "__typename":
                out[x.key] = f"{t.type_name}Connection"
            else:
                raise RequestProblem(f"no field {x.name} on a connection")
        return out

    # --- rows and what hangs on them

    def _rows(self, f: Field, t: Table, rows: list[dict]) -> list[dict]:
        out: list[dict] = [{} for _ in rows]
        for x in self.fields(f, t.type_name, "Node"):
            if x.name == "__typename":
                values: list = [t.type_name] * len(rows)
            elif x.name == "id" and not any(fl == "id" for fl, _ in t.fields):
                values = [codecs.node_id(t.type_name, [r[k] for k in t.primary_key]) for r in rows]
            elif any(fl == x.name for fl, _ in t.fields):
                c = t.column_of(x.name)
                values = [scalars.api(c.kind, r[c.name], c.values) for r in rows]
            elif (r := t.relation(x.name)) is not None:
                values = self._related(x, r, rows)
            else:
                raise RequestProblem(f"no field {x.name} on {t.type_name}")
            for o, v in zip(out, values, strict=True):
                o[x.key] = v
        return out

    def _related(self, f: Field, r: Relation, parents: list[dict]) -> list:
        keys = [tuple(p[c] for c in r.columns) for p in parents]
        whole = list(dict.fromkeys(k for k in keys if all(v is not None for v in k)))
        t = self.catalog.tables[r.target]
        if r.kind is Rel.TO_ONE:
            if not whole:
                return [None] * len(parents)
            read = self._read(self.fields(f, t.type_name, "Node"), t, r.target_columns)
            key = ("one", r.field, r.target, tuple(whole), tuple(read))
            if key not in self.memo:
                self.memo[key] = [x.asDict() for x in lookups.batch(self.catalog, t, list(r.target_columns), whole).select(*read).collect()]  # a row for each of a page's keys
            got = self.memo[key]
            shown = dict(zip([tuple(x[c] for c in r.target_columns) for x in got], self._rows(f, t, got), strict=True))
            return [shown.get(k) for k in keys]
        args = self._page_args(f)
        w = window(args.get("first"), args.get("after"), args.get("last"), args.get("before"), args["default"])
        order = ordering.parse(t, args["order_by"], args["policy"])
        counts: dict[str, dict] = {}

        def totals(selection: dict) -> dict[tuple, dict]:
            """Aggregates of all parents in one query."""
            name = repr(sorted(selection.items()))
            if name not in counts:
                frame = self._keys(whole, r)
                asked = agg.parse(t, selection)
                found = {}
                if frame is not None:
                    for row in aggregate_by_parent(self.catalog, frame, r, selection, args.get("where"), self.compiler).collect():
                        got: dict = {"count": row["count"]}
                        for a in asked[1:]:
                            if row[a.name] is not None or a.function not in ("avg", "sum"):
                                got.setdefault(a.function, {})[a.column] = row[a.name]
                        found[tuple(row[c] for c in r.columns)] = got
                counts[name] = found
            return counts[name]

        # one window for all parents, whichever way it is read and wherever it begins: the cursor is the same for all
        columns = self._columns(f, t)
        memo = ("many", r.field, r.target, r.junction, tuple(whole), tuple(columns), repr(sorted(self.args(f).items())))
        if memo not in self.memo:
            read = order.reversed() if w.backward else order
            cursor = w.before if w.backward else w.after
            seek = codecs.cursor_values(codecs.read_cursor(cursor, t.type_name, order.name, list(order.directions)), list(order.columns)) if cursor else None
            grouped: dict[tuple, list] = {}
            frame = self._keys(whole, r)
            if frame is not None:
                got = top_by_parent(self.catalog, r, w.size + 1, 0, read, args.get("where"), frame, self.compiler, seek, columns)
                names = parent_names(len(r.columns))
                for row in sorted(got.collect(), key=lambda x: x["_rn"]):  # a page a parent and one row
                    grouped.setdefault(tuple(row[n] for n in names), []).append(row)
            self.memo[memo] = grouped
        grouped = self.memo[memo]
        pages = {k: _Fetched(t, None, None, order, w, grouped.get(k, [])) for k in dict.fromkeys(keys)}
        empty = {"count": 0}
        return [self._show_connection(f, t, pages[k], lambda k=k: totals({"count": True}).get(k, empty)["count"], lambda s, k=k: totals(s).get(k, empty)) for k in keys]

    def _keys(self, whole: list[tuple], r: Relation):
        """Parents' keys as a table with the types of the relationship's columns."""
        if not whole:
            return None
        owner = next(t for t in self.catalog.tables.values() if r in t.relations)
        types = self.catalog.rows(owner).schema
        from pyspark.sql import functions as F

        spark = self.catalog.rows(owner).sparkSession
        return spark.createDataFrame(whole, list(r.columns)).select(*[F.col(c).cast(types[c].dataType).alias(c) for c in r.columns])

    # --- vectors

    def _vector(self, f: Field, t: Table, column: str) -> dict:
        args = self.args(f)
        s = vectors.search(self.catalog, t, column, args.pop("vector", None), args.pop("queryText", None), args.pop("metric", "COSINE"), args.pop("first", None), args.pop("after", None) or None, args.pop("where", None), self.compiler, self.engine.embedders, require_index=self.engine.require_vector_index, **args)
        got = [x.asDict() for x in s.rows.collect()]  # a page and one row
        page = got[: s.size]
        if any(x[vectors.DISTANCE] is None for x in page):
            raise RequestProblem("a distance is null")
        cursors = [codecs.cursor(t.type_name, s.order, s.directions, [x[vectors.DISTANCE], *(x[c.name] for c in s.key)]) for x in page]
        out: dict = {}
        for x in self.fields(f):
            if x.name == "nodes":
                out[x.key] = self._rows(x, t, page)
            elif x.name == "edges":
                edges: list[dict] = [{} for _ in page]
                for y in self.fields(x):
                    plain = {"cursor": cursors, "distance": [p[vectors.DISTANCE] for p in page], "rank": list(range(1, len(page) + 1))}
                    for e, v in zip(edges, plain[y.name] if y.name in plain else self._rows(y, t, page), strict=True):
                        e[y.key] = v
                out[x.key] = edges
            elif x.name == "pageInfo":
                info = {"hasNextPage": len(got) > s.size, "hasPreviousPage": bool(self.args(f).get("after")), "startCursor": cursors[0] if cursors else None, "endCursor": cursors[-1] if cursors else None}
                out[x.key] = {y.key: info[y.name] for y in self.fields(x)}
            else:
                raise RequestProblem(f"no field {x.name} on a vector connection")
        return out

    # --- writes

    def mutation(self, roots: list[Field]) -> dict:
        """Fields run in order on one request's staged state; it is committed if none failed."""
        if self.engine.store is None:
            raise RequestProblem("the catalog is read-only")
        request = mutations.Request(self.catalog, self.engine.store, self.engine.rules)
        data = {}
        for f in roots:
            data[f.key] = self._write(f, request)
        request.finish()
        return {"data": data}

    def _write(self, f: Field, request: mutations.Request) -> dict:
        args = self.args(f)
        for t in self.catalog.tables.values():
            for verb in ("create", "update", "delete"):
                if f.name == f"{verb}{t.type_name}" and self.engine.rules.table(self.catalog, t):
                    if verb == "create":
                        got = request.create(t.key, args["input"])
                    elif verb == "update":
                        got = request.update(t.key, args["id"], args.get("set") or {})
                    else:
                        got = request.delete(t.key, args["id"])
                    return self._outcome(f, t, got, request)
        raise RequestProblem(f"no mutation {f.name}")

    def _outcome(self, f: Field, t: Table, got: mutations.Result, request: mutations.Request) -> dict:
        kind = f"{got.error[0]}Error" if got.error else f"{f.name[:1].upper()}{f.name[1:]}Success"
        entity = t.type_name[:1].lower() + t.type_name[1:]
        readers = {k: (lambda x=x: request.rows(x)) if stored(k) in request.manifest.tables else self.catalog.readers[k] for k, x in self.catalog.tables.items()}
        staged = _Run(self.engine, replace(self.catalog, readers=readers), self.doc, self.variables)
        out: dict = {}
        for x in self.fields(f, kind, "MutationError" if got.error else kind):
            if x.name == "__typename":
                out[x.key] = kind
            elif x.name == "message":
                out[x.key] = got.error[1] if got.error else None
            elif x.name in (entity, "entity"):
                out[x.key] = staged._rows(x, t, [got.row])[0] if got.row is not None else None
        return out


class _Fetched(connections.Connection):
    """A page whose rows came with those of other parents."""

    def __init__(self, t, base, page, order, w, rows):
        super().__init__(t, base, page, order, w)
        self.__dict__["_fetched"] = rows
