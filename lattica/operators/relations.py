"""Relationships of many parents at once: one join and one window a level, whatever the number of parents.

The filter is applied before rows are numbered, so it reaches the scan; the bound on the row number is one that
Spark turns into a group limit before the shuffle, so a parent with very many rows sends few of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import ordering
from ..plans.filters import Compiler
from ..plans.ordering import Order
from ..sources.catalog import Catalog, Rel, Relation, Table
from . import aggregates as agg

ROW = "_rn"


def parent_names(n: int) -> list[str]:
    return [f"_parent_{i}" for i in range(n)]


def to_one(catalog: Catalog, parents: DataFrame, r: Relation, prefix: str) -> DataFrame:
    """Parents with the target's columns, null where there is none. The target's key is unique, so no parent multiplies."""
    t = catalog.tables[r.target]
    rows = catalog.rows(t).select(*[F.col(c.name).alias(prefix + c.name) for c in t.columns])
    return parents.join(rows, [F.col(a) == F.col(prefix + b) for a, b in zip(r.columns, r.target_columns, strict=True)], "left")


def rows_by_parent(catalog: Catalog, r: Relation, where: dict | None = None, compiler: Compiler | None = None) -> tuple[Table, DataFrame]:
    """The relationship's rows that pass `where`, each with the key of its parent in _parent_0, ..."""
    compiler = compiler or Compiler(catalog, check_indexes=False)
    t = catalog.tables[r.target]
    rows = compiler.where(t, where).apply(catalog.rows(t))
    if r.kind is Rel.THROUGH:
        names = parent_names(len(r.near_columns))
        j = catalog.rows(catalog.tables[r.junction])
        j = j.select(*[F.col(c).alias(n) for c, n in zip(r.near_columns, names, strict=True)], *[F.col(c).alias(f"_far_{i}") for i, c in enumerate(r.far_columns)])
        joined = rows.join(j, [F.col(c) == F.col(f"_far_{i}") for i, c in enumerate(r.target_columns)])
        return t, joined.select(*names, *rows.columns)
    names = parent_names(len(r.target_columns))
    return t, rows.select(*[F.col(c).alias(n) for c, n in zip(r.target_columns, names, strict=True)], "*").where(" and ".join(f"{n} is not null" for n in names))


def top_by_parent(
    catalog: Catalog, r: Relation, limit: int, offset: int = 0, order: Order | None = None, where: dict | None = None, parents: DataFrame | None = None, compiler: Compiler | None = None,
    seek: list | None = None, columns: Iterable[str] | None = None,
) -> DataFrame:
    """At most `limit` rows of each parent after `offset`, numbered in _rn; of `parents` (their key columns) only, if given.

    seek: order values that the rows stand after; columns: what is read beside key and order, all if not given.
    """
    t, rows = rows_by_parent(catalog, r, where, compiler)
    names = [c for c in rows.columns if c.startswith("_parent_")]
    order = order or ordering.parse(t, None)
    if seek is not None:
        rows = rows.where(order.after(seek))
    if columns is not None:
        needed = {*columns, *t.primary_key, *(c.name for c in order.columns)}
        rows = rows.select(*names, *[c.name for c in t.columns if c.name in needed])
    if parents is not None:
        keys = parents.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(r.columns)]).distinct()
        rows = rows.join(keys, [F.col(n) == F.col(f"_key_{i}") for i, n in enumerate(names)], "left_semi")
    numbered = rows.withColumn(ROW, F.row_number().over(W.partitionBy(*names).orderBy(*order.expressions())))
    return numbered.where(F.col(ROW) <= offset + limit).where(F.col(ROW) > offset)


def aggregate_by_parent(catalog: Catalog, parents: DataFrame, r: Relation, selection: dict, where: dict | None = None, compiler: Compiler | None = None) -> DataFrame:
    """Each parent with aggregates over its rows that pass `where`; paging has no part in it."""
    t, rows = rows_by_parent(catalog, r, where, compiler)
    names = [c for c in rows.columns if c.startswith("_parent_")]
    return agg.by_parent(parents, list(r.columns), rows, names, agg.parse(t, selection))
