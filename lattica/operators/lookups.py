"""Single rows: by primary key, by a unique index, by node id, by foreign key; and batches of keys."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Kind
from ..plans import codecs
from ..plans.filters import _value, literal, tuple_in
from ..sources.catalog import Catalog, Relation, Table


class BadLookup(ValueError):
    """Arguments that are not the whole of a key."""


def by_columns(catalog: Catalog, t: Table, values: dict[str, object]) -> DataFrame:
    """Rows equal in all the columns given; values are parsed as the columns' kinds ask. Equalities reach the scan."""
    parts = []
    for name, v in values.items():
        c = t.column_of(name)
        if c is None:
            raise BadLookup(f"unknown column {name}")
        v = _value(c, v)
        if v is None:
            raise BadLookup(f"{name} must not be null")
        parts.append(F.col(c.name) == literal(c, v))
    return catalog.rows(t).where(reduce(lambda a, b: a & b, parts)).limit(1)


def by_key(catalog: Catalog, t: Table, values: dict[str, object]) -> DataFrame:
    """By the whole primary key or a whole unique index."""
    names = {t.column_of(n).name if t.column_of(n) else n for n in values}
    if not any(names == set(k) for k in [t.primary_key, *t.uniques] if k):
        raise BadLookup(f"{', '.join(sorted(names))} is no key of {t.name}")
    return by_columns(catalog, t, values)


def by_node_id(catalog: Catalog, token: str, expected: Table | None = None) -> tuple[Table, DataFrame]:
    """The table that the id names, which must be `expected` if given, and its row."""
    name, raw = codecs.read_node_id(token)
    t = next((t for t in catalog.tables.values() if t.type_name == name), None)
    if t is None or not t.primary_key:
        raise codecs.BadToken(f"unknown type {name}")
    if expected is not None and t.key != expected.key:
        raise codecs.BadToken(f"the id is of {name}, not of {expected.type_name}")
    columns = [t.column(k) for k in t.primary_key]
    parts = [F.col(c.name) == literal(c, v) for c, v in zip(columns, codecs.key_values(columns, raw), strict=True)]
    return t, catalog.rows(t).where(reduce(lambda a, b: a & b, parts)).limit(1)


def parent_of(catalog: Catalog, r: Relation, values: list) -> DataFrame | None:
    """The row a to-one relationship leads to; none without a query if a key value is null."""
    if any(v is None for v in values):
        return None
    t = catalog.tables[r.target]
    parts = [F.col(c) == literal(t.column(c), v) for c, v in zip(r.target_columns, values, strict=True)]
    return catalog.rows(t).where(reduce(lambda a, b: a & b, parts)).limit(1)


def batch(catalog: Catalog, t: Table, columns: list[str], tuples: list[tuple]) -> DataFrame:
    """Rows whose columns are among the tuples, in one semi join."""
    return tuple_in(catalog.rows(t), columns, tuples)


def node_ids(catalog: Catalog, t: Table, name: str = "id") -> DataFrame:
    """The table's columns and each row's node id, as codecs.node_id gives it."""
    parts = [F.lit(json.dumps(t.type_name))]
    for k in t.primary_key:
        c = t.column(k)
        if c.kind in (Kind.INT, Kind.BIGINT):
            parts.append(F.col(k).cast("string"))
        elif c.kind in (Kind.STRING, Kind.ENUM, Kind.SET):
            # a quoted text; beyond ASCII codecs writes escapes, which read back alike
            parts.append(F.regexp_extract(F.to_json(F.struct(F.col(k).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
        else:
            raise BadLookup(f"no node ids over {c.kind.value} keys")
    joined = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return catalog.rows(t).withColumn(name, F.base64(F.encode(joined, "UTF-8")))
