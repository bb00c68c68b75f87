"""Writes: create, update and delete of single rows, with nested rows and links, all of a request or none.

Spark enforces no keys, so uniqueness, references and nullability are asked of the staged state before a commit.
Failures of one mutation are returned as typed errors; any error undoes the whole request.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans import codecs
from ..plans.filters import literal
from ..sources.catalog import Catalog, Column, Junction, Rel, Relation, Table
from ..sources.versions import Manifest, VersionStore, stored


class MutationError(Exception):
    """kind: InputValidation, Conflict, Constraint, NotFound or Permission."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Rules:
    """Patterns of what may be written; what is denied wins. Columns are matched as table.column or column.

    Views, pure junctions and tables without a key are never written.
    """

    allow: tuple[str, ...] = ("*",)
    deny: tuple[str, ...] | frozenset[str] = ()
    allow_columns: tuple[str, ...] = ("*",)
    deny_columns: tuple[str, ...] = ()

    def table(self, catalog: Catalog, t: Table) -> bool:
        hit = lambda ps: any(fnmatch.fnmatchcase(t.name.lower(), p.lower()) for p in ps)
        return bool(t.primary_key) and not t.view and catalog.junction(t) is not Junction.PURE and hit(self.allow) and not hit(self.deny)

    def column(self, t: Table, c: Column) -> bool:
        hit = lambda ps: any(fnmatch.fnmatchcase(x.lower(), p.lower()) for p in ps for x in (c.name, f"{t.name}.{c.name}"))
        return not c.generated and not c.expression and hit(self.allow_columns) and not hit(self.deny_columns)

    def lacking(self, t: Table) -> list[str]:
        """Columns that a new row needs and no input can give."""
        return [*t.unseen, *(c.name for c in required(t) if not self.column(t, c))]

    def check(self, catalog: Catalog, t: Table, creating: bool = False) -> None:
        if not self.table(catalog, t):
            raise MutationError("Permission", f"{t.name} cannot be written")
        if creating and (lacking := self.lacking(t)):
            raise MutationError("Permission", f"{t.name} has required columns that no input covers: {', '.join(lacking)}")


def required(t: Table) -> list[Column]:
    return [c for c in t.columns if not (c.nullable or c.has_default or c.auto or c.generated or c.expression)]


@dataclass
class Result:
    """row is null where an update found nothing; error is a pair of kind and message."""

    row: dict | None = None
    error: tuple[str, str] | None = None


@dataclass
class Request:
    """One request's staged writes. Reads inside it see them.

    Rows that a policy hides cannot be changed, deleted, connected to or returned; keys and references are checked
    against all rows, as they hold for all.
    """

    catalog: Catalog
    store: VersionStore
    rules: Rules = field(default_factory=Rules)

    def __post_init__(self) -> None:
        self.manifest: Manifest = self.store.manifest()
        self.staged: dict[str, list[tuple[dict, bool]]] = {}
        self.failed = False

    # --- the staged state

    def rows(self, t: Table) -> DataFrame:
        """All rows as stored and staged, with no policy."""
        base = self.store.read(self.manifest, stored(t.key))
        changes = {tuple(r[k] for k in t.primary_key): (r, gone) for r, gone in self.staged.get(stored(t.key), ())}
        if not changes:
            return base
        spark = self.store.spark
        schema = base.schema
        keys = spark.createDataFrame([list(k) for k in changes], [f"_k{i}" for i in range(len(t.primary_key))])
        keys = keys.select(*[F.col(f"_k{i}").cast(schema[k].dataType).alias(f"_k{i}") for i, k in enumerate(t.primary_key)])
        kept = base.join(F.broadcast(keys), [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(t.primary_key)], "left_anti")
        live = [tuple(r.get(f.name) for f in schema) for r, gone in changes.values() if not gone]
        return kept.union(spark.createDataFrame(live, schema)) if live else kept

    def _find(self, t: Table, values: dict[str, object], every: bool = False) -> dict | None:
        """The row with these values, of those that the policy admits or of every one."""
        rows = self.catalog.computed(t, self.rows(t)) if every else self.catalog.seen(t, self.rows(t))
        parts = [F.col(n).isNull() if v is None else F.col(n) == literal(t.column(n), v) for n, v in values.items()]
        got = rows.where(reduce(lambda a, b: a & b, parts)).limit(1).collect()
        return got[0].asDict() if got else None

    # --- checks

    def _parse(self, t: Table, given: dict, updating: bool) -> dict:
        out = {}
        for name, v in given.items():
            c = t.column_of(name)
            if c is None:
                raise MutationError("InputValidation", f"unknown field {name} of {t.name}")
            if not self.rules.column(t, c) or updating and c.name in t.primary_key:
                raise MutationError("InputValidation", f"{name} cannot be written")
            try:
                out[c.name] = scalars.parse(c.kind, v, c.values, c.dim)
            except scalars.ValueProblem as e:
                raise MutationError("InputValidation", f"{name}: {e}") from None
            if out[c.name] is None and not c.nullable and not c.auto:
                raise MutationError("Constraint", f"{name} must not be null")
        return out

    def _complete(self, t: Table, row: dict) -> dict:
        """The row with its generated columns, where a key has some."""
        if not any(c.expression for c in t.columns):
            return row
        schema = self.rows(t).schema
        one = self.store.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)
        return row | self.catalog.computed(t, one).collect()[0].asDict()

    def _unique(self, t: Table, row: dict, itself: tuple | None = None) -> None:
        row = self._complete(t, row)
        for columns in [t.primary_key, *t.uniques]:
            values = {c: row.get(c) for c in columns}
            if any(v is None for v in values.values()):
                continue
            found = self._find(t, values, every=True)
            if found and tuple(found[k] for k in t.primary_key) != itself:
                raise MutationError("Conflict", f"{t.name} has a row with this {', '.join(columns)} already")

    def _references(self, t: Table, row: dict) -> None:
        for f in t.foreign_keys:
            values = [row.get(c) for c in f.columns]
            if any(v is None for v in values):
                continue
            if self._find(self.catalog.tables[f.target], dict(zip(f.target_columns, values, strict=True)), every=True) is None:
                raise MutationError("Constraint", f"{t.name} refers to a row of {f.target[1]} that does not exist")

    def _stage(self, t: Table, row: dict, gone: bool = False) -> None:
        self.staged.setdefault(stored(t.key), []).append((row, gone))

    # --- writes

    def _create(self, t: Table, given: dict, fixed: dict | None = None) -> dict:
        self.rules.check(self.catalog, t, creating=True)
        own, nested, links = {}, [], []
        for name, v in given.items():
            r = t.relation(name)
            if r is None or t.column_of(name) is not None:
                own[name] = v
            elif r.kind is Rel.TO_ONE:
                own |= {t.field_of(c): x for c, x in self._connect(t, r, v, given).items()}
            else:
                (links if r.kind is Rel.THROUGH else nested).append((r, v))
        row = {c.name: None for c in t.columns} | self._parse(t, own, False) | (fixed or {})
        entry = self.manifest.tables[stored(t.key)]
        for c in t.columns:
            if c.auto and row[c.name] is None:
                row[c.name] = entry["next"]
            if c.auto and isinstance(row[c.name], int):
                entry["next"] = max(entry["next"], row[c.name] + 1)
        if lacking := [c.name for c in required(t) if row.get(c.name) is None]:
            raise MutationError("Constraint", f"{t.name} needs {', '.join(lacking)}")
        self._unique(t, row)
        self._references(t, row)
        self._stage(t, row)
        row = self._complete(t, row)
        for r, items in nested:
            self._nest(row, r, items)
        for r, items in links:
            self._link(row, r, items)
        return row

    def _connect(self, t: Table, r: Relation, v: dict, given: dict) -> dict:
        """{"connect": {"id": ...}} or by one whole unique key: the foreign key's values."""
        if not isinstance(v, dict) or set(v) != {"connect"}:
            raise MutationError("InputValidation", f"{r.field}: takes connect")
        if clash := [c for c in r.columns if t.field_of(c) in given]:
            raise MutationError("InputValidation", f"{r.field}: {', '.join(clash)} is given too")
        found = self._target(self.catalog.tables[r.target], v["connect"])
        return {mine: found[their] for mine, their in zip(r.columns, r.target_columns, strict=True)}

    def _target(self, t: Table, by: dict) -> dict:
        if not isinstance(by, dict) or not by:
            raise MutationError("InputValidation", "connect takes an id or one unique key")
        if set(by) == {"id"} and t.column_of("id") is None:
            name, raw = codecs.read_node_id(by["id"])
            if name != t.type_name:
                raise MutationError("InputValidation", f"the id is of {name}, not of {t.type_name}")
            columns = [t.column(k) for k in t.primary_key]
            values = dict(zip(t.primary_key, codecs.key_values(columns, raw), strict=True))
        else:
            values = self._parse(t, by, False)
            if set(values) not in [set(k) for k in [t.primary_key, *t.uniques]]:
                raise MutationError("InputValidation", "connect takes an id or one unique key")
        found = self._find(t, values)
        if found is None:
            raise MutationError("NotFound", f"no such row of {t.name}")
        return found

    def _nest(self, parent: dict, r: Relation, items: dict) -> None:
        """{"create": [...]}: rows of the other side that point here."""
        if not isinstance(items, dict) or set(items) != {"create"}:
            raise MutationError("InputValidation", f"{r.field}: takes create")
        child = self.catalog.tables[r.target]
        for x in items["create"]:
            if any(child.field_of(c) in x for c in r.target_columns):
                raise MutationError("InputValidation", f"{r.field}: the key of the parent is not given")
            self._create(child, x, {c: parent[p] for c, p in zip(r.target_columns, r.columns, strict=True)})

    def _link(self, parent: dict, r: Relation, items: dict) -> None:
        """{"connect": [...]}: rows of the junction to rows that exist."""
        if not isinstance(items, dict) or set(items) != {"connect"}:
            raise MutationError("InputValidation", f"{r.field}: takes connect")
        j = self.catalog.tables[r.junction]
        for by in items["connect"]:
            other = self._target(self.catalog.tables[r.target], by)
            row = {n: parent[p] for n, p in zip(r.near_columns, r.columns, strict=True)} | {f: other[c] for f, c in zip(r.far_columns, r.target_columns, strict=True)}
            self._unique(j, row)
            self._stage(j, row)

    def _key(self, t: Table, ident: str | dict) -> dict:
        if isinstance(ident, dict):
            return {t.column_of(n).name: scalars.parse(t.column_of(n).kind, v) for n, v in ident.items()}
        name, raw = codecs.read_node_id(ident)
        if name != t.type_name:
            raise MutationError("InputValidation", f"the id is of {name}, not of {t.type_name}")
        return dict(zip(t.primary_key, codecs.key_values([t.column(k) for k in t.primary_key], raw), strict=True))

    def _update(self, t: Table, ident: str | dict, given: dict) -> dict | None:
        self.rules.check(self.catalog, t)
        key = self._key(t, ident)
        changes = self._parse(t, given, True)
        found = self._find(t, key)
        if found is None or not changes:
            return found
        row = found | changes
        self._unique(t, row, tuple(found[k] for k in t.primary_key))
        self._references(t, row)
        self._stage(t, row)
        return self._complete(t, row)

    def _delete(self, t: Table, ident: str | dict) -> dict:
        self.rules.check(self.catalog, t)
        found = self._find(t, self._key(t, ident))
        if found is None:
            raise MutationError("NotFound", f"no such row of {t.name}")
        for other in self.catalog.tables.values():
            for f in other.foreign_keys:
                if f.target == t.key and stored(other.key) in self.manifest.tables and self._find(other, {c: found[p] for c, p in zip(f.columns, f.target_columns, strict=True)}, every=True):
                    raise MutationError("Constraint", f"rows of {other.name} refer to this row")
        self._stage(t, found, True)
        return found

    def _attempt(self, run) -> Result:
        try:
            return Result(run())
        except MutationError as e:
            self.failed = True
            return Result(error=(e.kind, str(e)))
        except (codecs.BadToken, scalars.ValueProblem) as e:
            self.failed = True
            return Result(error=("InputValidation", str(e)))

    def create(self, table: str | tuple[str, str], given: dict) -> Result:
        return self._attempt(lambda: self._create(self.catalog.table(table), given))

    def update(self, table: str | tuple[str, str], ident: str | dict, given: dict) -> Result:
        """An empty change is a read; a row that does not exist gives null, not an error."""
        return self._attempt(lambda: self._update(self.catalog.table(table), ident, given))

    def delete(self, table: str | tuple[str, str], ident: str | dict) -> Result:
        return self._attempt(lambda: self._delete(self.catalog.table(table), ident))

    def finish(self) -> Manifest | None:
        """Commit all, or nothing if anything failed."""
        if self.failed or not self.staged:
            return None
        for table, rows in self.staged.items():
            self.store.add_delta(self.manifest, table, rows)
        return self.store.commit(self.manifest)


def versioned(catalog: Catalog, store: VersionStore, manifest: Manifest) -> Catalog:
    """The catalog over the rows of one version; its policies hold for those too."""
    return replace(catalog, readers={k: (lambda n=stored(k): store.read(manifest, n)) if stored(k) in manifest.tables else f for k, f in catalog.readers.items()})
