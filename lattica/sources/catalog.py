"""The catalog: tables with keys, indexes and foreign keys, the relationships that follow, and where rows are.

Parquet has no keys, so they are declared here beside the Spark schema. Declared indexes only decide what may
be filtered, sorted and looked up, as in a database that would need them.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import Kind, from_spark, from_sql
from .naming import Names, Taken

TableKey = tuple[str, str]  # database, table


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    nullable: bool = True
    generated: bool = False
    auto: bool = False
    has_default: bool = False
    values: tuple[str, ...] = ()
    dim: int | None = None
    comment: str = ""
    embedder: str | None = None  # names the model of a column that is embedded from text
    binary: bool = False  # a UUID kept as sixteen bytes
    expression: str | None = None  # SQL over the stored columns that a generated column is computed by

    @classmethod
    def sql(cls, name: str, declared: str, **more) -> Column:
        """From a declared SQL type: its values, dimension and width included."""
        inner = declared[declared.index("(") + 1 : declared.rindex(")")] if "(" in declared else ""
        kind = from_sql(declared)
        if kind in (Kind.ENUM, Kind.SET):
            more["values"] = tuple(x.strip().strip("'\"") for x in inner.split(","))
        if kind is Kind.VECTOR and inner.strip().isdigit():
            more["dim"] = int(inner)
        return cls(name, kind, **more)


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    vector: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: TableKey
    target_columns: tuple[str, ...]
    name: str = ""


class Rel(Enum):
    TO_ONE = "many_to_one"
    TO_MANY = "one_to_many"
    THROUGH = "many_to_many"
    EDGES = "edge_list"


@dataclass(frozen=True)
class Relation:
    """columns are the owner's; target_columns pair with them, or with far_columns by way of a junction."""

    kind: Rel
    field: str
    target: TableKey
    columns: tuple[str, ...]
    target_columns: tuple[str, ...]
    junction: TableKey | None = None
    near_columns: tuple[str, ...] = ()  # the junction's, towards the owner
    far_columns: tuple[str, ...] = ()  # the junction's, towards the target


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    database: str = ""
    view: bool = False
    comment: str = ""
    relations: tuple[Relation, ...] = ()
    type_name: str = ""
    collection: str = ""
    single: str = ""
    fields: tuple[tuple[str, str], ...] = ()  # API field, column
    unseen: tuple[str, ...] = ()  # columns that filters hide and a new row would need

    @property
    def key(self) -> TableKey:
        return self.database, self.name

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def field_of(self, column: str) -> str:
        return next(f for f, c in self.fields if c == column)

    def column_of(self, field_name: str) -> Column | None:
        """By API field, or by the column's own name."""
        for f, c in self.fields:
            if f == field_name:
                return self.column(c)
        return next((c for c in self.columns if c.name == field_name), None)

    def relation(self, field_name: str) -> Relation | None:
        return next((r for r in self.relations if r.field == field_name), None)

    @property
    def indexed(self) -> set[str]:
        """Columns of any index, in any place."""
        return {c for i in self.indexes if not i.vector for c in i.columns} | set(self.primary_key)

    @property
    def ordered_indexes(self) -> list[tuple[str, ...]]:
        return ([self.primary_key] if self.primary_key else []) + [i.columns for i in self.indexes if not i.vector]

    @property
    def uniques(self) -> list[tuple[str, ...]]:
        return [i.columns for i in self.indexes if i.unique and i.columns != self.primary_key]


class Junction(Enum):
    PURE = "pure"
    ATTRIBUTES = "attributes"


def junction(t: Table) -> Junction | None:
    """Two foreign keys to different tables, none of their columns nullable, all together under a key or unique index."""
    if t.view or len(t.foreign_keys) != 2 or t.foreign_keys[0].target == t.foreign_keys[1].target:
        return None
    used = [c for f in t.foreign_keys for c in f.columns]
    if any(t.column(c).nullable for c in used):
        return None
    if not any(set(used) <= set(k) for k in [t.primary_key, *t.uniques] if k):
        return None
    return Junction.PURE if {c.name for c in t.columns} == set(used) else Junction.ATTRIBUTES


@dataclass(frozen=True)
class Filters:
    """Patterns of what is shown; what is denied wins. Columns are matched as table.column or column."""

    allow_tables: tuple[str, ...] = ("*",)
    deny_tables: tuple[str, ...] = ()
    allow_columns: tuple[str, ...] = ("*",)
    deny_columns: tuple[str, ...] = ()
    views: bool = False

    def table(self, t: Table) -> bool:
        hit = lambda ps: any(fnmatch.fnmatchcase(t.name.lower(), p.lower()) for p in ps)
        return (self.views or not t.view) and hit(self.allow_tables) and not hit(self.deny_tables)

    def column(self, t: Table, c: str) -> bool:
        hit = lambda ps: any(fnmatch.fnmatchcase(x.lower(), p.lower()) for p in ps for x in (c, f"{t.name}.{c}"))
        return hit(self.allow_columns) and not hit(self.deny_columns)


@dataclass(frozen=True)
class Overrides:
    """Kinds set by pattern of table.column."""

    uuid: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    integer: tuple[str, ...] = ()

    def apply(self, t: Table, c: Column) -> Column:
        hit = lambda ps: any(fnmatch.fnmatchcase(f"{t.name}.{c.name}".lower(), p.lower()) for p in ps)
        if hit(self.uuid):
            if c.kind not in (Kind.BYTES, Kind.STRING, Kind.UUID):
                raise ValueError(f"{t.name}.{c.name} cannot hold a UUID")
            return replace(c, kind=Kind.UUID, binary=c.binary or c.kind is Kind.BYTES)
        if hit(self.integer) and c.kind is Kind.BOOLEAN:
            return replace(c, kind=Kind.INT)
        if hit(self.boolean) and c.kind is Kind.INT:
            return replace(c, kind=Kind.BOOLEAN)
        return c


@dataclass
class Catalog:
    """Tables with names and relationships, a reader for each table's rows, and policies that hold whatever the reader."""

    tables: dict[TableKey, Table]
    readers: dict[TableKey, Callable[[], DataFrame]]
    names: Names = field(default_factory=Names)
    policies: dict[TableKey, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def table(self, name: str | TableKey) -> Table:
        if isinstance(name, tuple):
            return self.tables[name]
        found = [t for t in self.tables.values() if name in (t.name, f"{t.database}.{t.name}", t.type_name, t.collection)]
        if len({t.key for t in found}) != 1:
            raise KeyError(f"{'ambiguous' if found else 'unknown'} table: {name}")
        return found[0]

    def rows(self, t: Table) -> DataFrame:
        """The table's visible columns, in declared order, of the rows that the policy admits."""
        return self.seen(t, self.readers[t.key]()).select(*[c.name for c in t.columns])

    def seen(self, t: Table, stored: DataFrame) -> DataFrame:
        """Stored rows that the policy admits, all columns, generated ones computed. Every read goes through here."""
        return self.computed(t, self.policies[t.key](stored) if t.key in self.policies else stored)

    def computed(self, t: Table, stored: DataFrame) -> DataFrame:
        """Stored rows with their generated columns, whatever a file may hold for those."""
        made = {c.name: F.expr(c.expression) for c in t.columns if c.expression}
        return stored.withColumns(made) if made else stored

    def junction(self, t: Table) -> Junction | None:
        return junction(t)

    def fingerprint(self) -> str:
        """Changes when anything structural does."""
        said = sorted(json.dumps([t.database, t.name, t.view, t.primary_key, [[c.name, c.kind.value, c.nullable, c.generated, c.expression, c.values, c.dim] for c in t.columns], [[i.name, i.columns, i.unique, i.vector] for i in t.indexes], [[f.columns, f.target, f.target_columns] for f in t.foreign_keys]]) for t in self.tables.values())
        return hashlib.sha256("\n".join(said).encode()).hexdigest()

    @property
    def namespaced(self) -> bool:
        return len({t.database for t in self.tables.values()}) > 1

    def for_role(self, filters: Filters, policies: dict[str | TableKey, Callable[[DataFrame], DataFrame]] | None = None) -> Catalog:
        """What a role sees: a filtered schema, and rows by policy (by table, or database and table). Policies hold for older versions and writes too."""
        policies = policies or {}
        if unknown := [k for k in policies if k not in self.tables and not any(k == t[1] for t in self.tables)]:
            raise KeyError(f"policies of unknown tables: {unknown}")

        def both(k: TableKey, own: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            return (lambda df: own(self.policies[k](df))) if k in self.policies else own

        chosen = {k: policies.get(k, policies.get(k[1])) for k in self.tables}
        bare = [replace(t, relations=(), fields=(), type_name="", collection="", single="") for t in self.tables.values()]
        out = build(bare, dict(self.readers), self.names, filters)
        return replace(out, policies=dict(self.policies) | {k: both(k, own) for k, own in chosen.items() if own is not None})


def infer(name: str, df: DataFrame, primary_key: Iterable[str] = (), **more) -> Table:
    """A table from a Spark schema; key columns are not nullable."""
    pk = tuple(primary_key)
    columns = tuple(Column(f.name, from_spark(f.dataType), nullable=f.nullable and f.name not in pk) for f in df.schema)
    return Table(name, columns, pk, **more)


def _filtered(t: Table, filters: Filters) -> Table:
    shown = {c.name for c in t.columns if filters.column(t, c.name)}
    return replace(
        t,
        unseen=t.unseen + tuple(c.name for c in t.columns if c.name not in shown and not (c.nullable or c.has_default or c.auto or c.generated)),
        columns=tuple(c for c in t.columns if c.name in shown),
        primary_key=t.primary_key if set(t.primary_key) <= shown else (),
        indexes=tuple(i for i in t.indexes if set(i.columns) <= shown),
        foreign_keys=tuple(f for f in t.foreign_keys if set(f.columns) <= shown),
    )


def build(tables: Iterable[Table], readers: dict[TableKey, Callable[[], DataFrame]], names: Names | None = None, filters: Filters | None = None, overrides: Overrides | None = None) -> Catalog:
    """Filter, override, derive relationships and give names."""
    names, filters, overrides = names or Names(), filters or Filters(), overrides or Overrides()
    kept = {t.key: _filtered(t, filters) for t in tables if filters.table(t)}
    kept = {k: replace(t, columns=tuple(overrides.apply(t, c) for c in t.columns), foreign_keys=tuple(f for f in t.foreign_keys if f.target in kept and set(f.target_columns) <= {c.name for c in kept[f.target].columns})) for k, t in kept.items()}
    many = len({k[0] for k in kept}) > 1
    types, roots = Taken(), Taken()
    out: dict[TableKey, Table] = {}
    taken: dict[TableKey, Taken] = {}
    for k, t in sorted(kept.items()):
        prefix = names.type_name(t.database) if many else ""
        fields, own = [], Taken()
        own.give("id", "#node")
        for c in t.columns:
            f = names.field(c.name)
            if f == "id":
                f = "databaseId" if t.primary_key else "id"
                while f in own.names and f != "id":
                    f += "_raw"
                if f == "id":
                    own.names.pop("id")
            fields.append((own.give(f, f"column:{c.name}"), c.name))
        taken[k] = own
        scope = f"{t.database}:" if many else ""
        out[k] = replace(t, type_name=types.give(prefix + names.type_name(t.name), str(k)), collection=roots.give(scope + names.collection(t.name), str(k)).removeprefix(scope), single=names.single(t.name), fields=tuple(fields))
    relations: dict[TableKey, list[Relation]] = {k: [] for k in out}

    def add(owner: TableKey, r: Relation) -> None:
        suffix = "Ref" if r.kind is Rel.TO_ONE else "Rel"
        name = taken[owner].give(r.field, f"relation:{len(relations[owner])}:{r.kind}:{r.target}:{r.columns}:{r.junction}", suffix)
        relations[owner].append(replace(r, field=name))

    for k, t in sorted(out.items()):
        j = junction(t)
        if j is Junction.PURE:
            continue
        for f in t.foreign_keys:
            name = names.single(f.target[1]) if j else names.to_one(f.columns[0])
            add(k, Relation(Rel.TO_ONE, name, f.target, f.columns, f.target_columns))
    for k, t in sorted(out.items()):
        if t.view or junction(t):
            continue
        for f in t.foreign_keys:
            if len(f.columns) == 1:
                only = sum(g.target == f.target for g in t.foreign_keys) == 1
                add(f.target, Relation(Rel.TO_MANY, names.to_many(t.name, f.columns[0], only), k, f.target_columns, f.columns))
    for k, t in sorted(out.items()):
        j = junction(t)
        if j is None:
            continue
        left, right = sorted(t.foreign_keys, key=lambda f: f.target[::-1])
        ends = [out[left.target], out[right.target]]
        if not all(e.primary_key for e in ends) or any(len(f.columns) != len(out[f.target].primary_key) for f in (left, right)):
            continue
        for a, b in ((left, right), (right, left)):
            name = names.through(t.name, left.target[1], right.target[1], b.target[1], j is Junction.ATTRIBUTES)
            if j is Junction.PURE:
                add(a.target, Relation(Rel.THROUGH, name, b.target, a.target_columns, b.target_columns, k, a.columns, b.columns))
            else:
                add(a.target, Relation(Rel.EDGES, name, k, a.target_columns, a.columns, k, a.columns, b.columns))
    final = {k: replace(t, relations=tuple(relations[k])) for k, t in out.items()}
    return Catalog(final, {k: readers[k] for k in final}, names)


def from_spark_catalog(spark: SparkSession, database: str, keys: dict[str, dict] | None = None) -> Catalog:
    """All tables and views of a Spark database; keys: what to declare for each table (primary_key, indexes, foreign_keys)."""
    keys, tables, readers = keys or {}, [], {}
    for found in spark.catalog.listTables(database):
        name = f"{database}.{found.name}"
        t = infer(found.name, spark.table(name), database=database, view="VIEW" in (found.tableType or ""), comment=found.description or "", **keys.get(found.name, {}))
        tables.append(t)
        readers[t.key] = lambda name=name: spark.table(name)
    return build(tables, readers)
