"""The filter language: nested objects to one Column, relationship filters to correlated EXISTS.

{"price": {"gt": 1}, "OR": [{"name": {"like": "a%"}}, {}], "customer": {"is": {...}}, "orders": {"some": {...}}}
Sibling keys are ANDed; AND and OR take lists, of which empty members are skipped; a list without members
filters nothing. null in eq and ne means IS NULL and IS NOT NULL; an empty `in` admits nothing, an empty notIn all.
Catalyst turns an EXISTS under AND into a semi or anti join, under OR into an existence join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.kinds import Kind
from ..sources.catalog import Catalog, Column, Rel, Relation, Table, TableKey

#: Row-value lists up to this length are sent to all tasks; longer ones are joined as Spark sees fit.
SMALL_LIST = 10_000


class BadFilter(ValueError):
    """A filter that the table does not admit."""


@dataclass
class Filter:
    """condition is None where nothing is filtered; used: columns by table, join keys included; outer: columns that subqueries refer to."""

    condition: Expr | None = None
    used: dict[TableKey, set[str]] = field(default_factory=dict)
    outer: set[str] = field(default_factory=set)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.condition is None:
            return df
        # subqueries see the outer columns under names of their own, as both sides may have a column of one name
        names = {f"_out_{c}": F.col(c) for c in sorted(self.outer)}
        return df.withColumns(names).where(self.condition).drop(*names) if names else df.where(self.condition)


def literal(column: Column, v: object) -> Expr:
    """A parsed value as an expression of the column's stored form."""
    if column.kind is Kind.DATETIME:
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    if column.kind is Kind.UUID and column.binary:
        return F.unhex(F.lit(str(v).replace("-", ""))) if not isinstance(v, (bytes, bytearray)) else F.lit(bytearray(v))
    if column.kind is Kind.BYTES:
        return F.lit(bytearray(v))
    return F.lit(v)


def _value(column: Column, v: object) -> object:
    try:
        return scalars.parse(column.kind, v, column.values, column.dim)
    except scalars.ValueProblem as e:
        raise BadFilter(f"{column.name}: {e}") from None


def _each(column: Column, v: object) -> list:
    if not isinstance(v, (list, tuple)):
        raise BadFilter(f"{column.name}: a list is needed")
    return [_value(column, x) for x in v]


def _members(column: Column, v: object) -> list[str]:
    if not isinstance(v, (list, tuple)):
        raise BadFilter(f"{column.name}: a list is needed")
    v = scalars.from_api(column.kind, v, column.values)
    if unknown := [x for x in v if column.values and x not in column.values]:
        raise BadFilter(f"{column.name}: not members of the set: {unknown}")
    return list(v)


def _and(parts: Iterable[Expr]) -> Expr | None:
    parts = list(parts)
    return reduce(lambda a, b: a & b, parts) if parts else None


def _or(parts: Iterable[Expr]) -> Expr | None:
    parts = list(parts)
    return reduce(lambda a, b: a | b, parts) if parts else None


def compare(column: Column, c: Expr, op: str, v: object) -> Expr:
    """One operator on one column."""
    if op not in column.kind.operators:
        raise BadFilter(f"{column.name}: no operator {op} on {column.kind.value}")
    if op == "isNull":
        if not isinstance(v, bool):
            raise BadFilter(f"{column.name}: isNull takes a boolean")
        return c.isNull() if v else c.isNotNull()
    has = lambda m: F.find_in_set(F.lit(m), c) > 0
    if op == "has":
        return has(_members(column, [v])[0])
    if op == "hasAnyOf":
        return _or(has(m) for m in _members(column, v)) if v else F.lit(False)
    if op == "hasAllOf":
        return _and(has(m) for m in _members(column, v)) if v else F.lit(True)
    if op == "hasNoneOf":
        return _and(~has(m) for m in _members(column, v)) if v else F.lit(True)
    if op in ("in", "notIn"):
        vs = [literal(column, x) for x in _each(column, v) if x is not None]
        if not vs:
            return F.lit(op == "notIn")
        return c.isin(*vs) if op == "in" else ~c.isin(*vs)
    parsed = _value(column, v)
    if parsed is None:
        if op == "eq":
            return c.isNull()
        if op == "ne":
            return c.isNotNull()
        raise BadFilter(f"{column.name}: {op} takes no null")
    if op in ("like", "notLike"):
        return c.like(parsed) if op == "like" else ~c.like(parsed)
    x = literal(column, parsed)
    return {"eq": c == x, "ne": c != x, "lt": c < x, "lte": c <= x, "gt": c > x, "gte": c >= x}[op]


class Compiler:
    """Compiles filters of one catalog's tables."""

    def __init__(self, catalog: Catalog, check_indexes: bool = True):
        self.catalog, self.check_indexes = catalog, check_indexes

    def where(self, table: Table, where: dict | None) -> Filter:
        """The filter, refused if a table it names has no indexed column in it (see check_indexes)."""
        out = Filter()
        if where is not None and not isinstance(where, dict):
            raise BadFilter("a filter is an object")
        if where:
            if table.view:
                raise BadFilter("views take no filter")
            self._outer: set[str] = set()
            out.condition = self._object(table, where, F.col, out.used, True)
            out.outer = self._outer
            if self.check_indexes:
                for key, used in out.used.items():
                    t = self.catalog.tables[key]
                    if used and not used & t.indexed:
                        raise BadFilter(f"the filter on {t.name} touches no indexed column")
        return out

    def _object(self, table: Table, where: dict, name: Callable[[str], Expr], used: dict, relations: bool) -> Expr | None:
        parts = []
        for key, v in where.items():
            if key in ("AND", "OR"):
                if not isinstance(v, (list, tuple)) or any(not isinstance(x, dict) for x in v):
                    raise BadFilter(f"{key} takes a list of filters")
                found = [x for x in (self._object(table, m, name, used, relations) for m in v) if x is not None]
                joined = _and(found) if key == "AND" else _or(found)
                if joined is not None:
                    parts.append(joined)
                continue
            if (column := table.column_of(key)) is not None:
                if not isinstance(v, dict):
                    raise BadFilter(f"{key}: operators are given as an object")
                used.setdefault(table.key, set()).add(column.name)
                parts += [compare(column, name(column.name), op, x) for op, x in v.items()]
            elif (relation := table.relation(key)) is not None:
                if not relations:
                    raise BadFilter(f"{key}: a relationship filter cannot hold another")
                made = self._relation(table, relation, v, name, used)
                if made is not None:
                    parts.append(made)
            else:
                raise BadFilter(f"unknown column {key} of {table.name}")
        return _and(parts)

    def _relation(self, table: Table, r: Relation, v: object, name: Callable[[str], Expr], used: dict) -> Expr | None:
        if not isinstance(v, dict):
            raise BadFilter(f"{r.field}: an object is needed")
        one = r.kind is Rel.TO_ONE
        allowed = {"is", "isNull"} if one else {"some", "none"}
        if set(v) - allowed:
            raise BadFilter(f"{r.field}: takes {' or '.join(sorted(allowed))}")
        if one and len(v) > 1:
            raise BadFilter(f"{r.field}: is and isNull exclude each other")
        parts = []
        for op, inner in v.items():
            if op == "isNull":
                if not isinstance(inner, bool):
                    raise BadFilter(f"{r.field}: isNull takes a boolean")
                found = self._exists(table, r, {}, used)
                parts.append(~found if inner else found)
            else:
                if not isinstance(inner, dict):
                    raise BadFilter(f"{r.field}: a filter is an object")
                found = self._exists(table, r, inner, used)
                parts.append(~found if op == "none" else found)
        return _and(parts)

    def _exists(self, table: Table, r: Relation, where: dict, used: dict) -> Expr:
        """Rows of the other side that match and pass `where`, whose columns are renamed apart from the outer ones."""
        target = self.catalog.tables[r.target]
        used.setdefault(table.key, set()).update(r.columns)
        inner = lambda c: F.col(f"_in_{c}")
        rows = self.catalog.rows(target)
        rows = rows.select(*[F.col(c).alias(f"_in_{c}") for c in rows.columns])
        seen: dict[TableKey, set[str]] = {}
        condition = self._object(target, where, inner, seen, False)
        seen.setdefault(target.key, set()).update(r.target_columns)
        for k, cs in seen.items():
            used.setdefault(k, set()).update(cs)
        if condition is not None:
            rows = rows.where(condition)
        if r.kind is Rel.THROUGH:
            j = self.catalog.rows(self.catalog.tables[r.junction])
            j = j.select(*[F.col(c).alias(f"_j_{c}") for c in (*r.near_columns, *r.far_columns)])
            rows = j.join(rows, [F.col(f"_j_{f}") == F.col(f"_in_{t}") for f, t in zip(r.far_columns, r.target_columns, strict=True)])
            theirs = [f"_j_{c}" for c in r.near_columns]
        else:
            theirs = [f"_in_{c}" for c in r.target_columns]
        for mine, their in zip(r.columns, theirs, strict=True):
            self._outer.add(mine)
            rows = rows.where(F.col(their) == F.col(f"_out_{mine}").outer())
        return rows.exists()


def tuple_in(df: DataFrame, columns: list[str], tuples: list[tuple]) -> DataFrame:
    """Rows whose columns equal one of the tuples, as a semi join with keys cast to the columns' types. Tuples with a null match nothing."""
    keys = list(dict.fromkeys(t for t in tuples if all(v is not None for v in t)))
    if not keys:
        return df.where(F.lit(False))
    if len(columns) == 1:
        return df.where(F.col(columns[0]).isin(*[k[0] for k in keys])) if len(keys) <= 1000 else _semi(df, columns, keys)
    return _semi(df, columns, keys)


def _semi(df: DataFrame, columns: list[str], keys: list[tuple]) -> DataFrame:
    named = df.sparkSession.createDataFrame(keys, [f"_k{i}" for i in range(len(columns))])
    named = named.select(*[F.col(f"_k{i}").cast(df.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(columns)])
    if len(keys) <= SMALL_LIST:
        named = F.broadcast(named)
    return df.join(named, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)], "left_semi")
