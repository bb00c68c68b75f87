"""Orders of pages: their validation, the unique order that follows, and the place after a cursor.

Nulls stand first ascending and last descending, which is Spark's default and that of the databases imitated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F

from ..sources.catalog import Column, Table
from .filters import literal

PREFIX, ANY_INDEXED = "INDEX_PREFIX_ONLY", "ALLOW_NON_PREFIX"


class BadOrder(ValueError):
    """An order that the table does not admit."""


@dataclass(frozen=True)
class Order:
    columns: tuple[Column, ...]
    directions: tuple[str, ...]

    @property
    def name(self) -> str:
        return ",".join(c.name for c in self.columns)

    def reversed(self) -> Order:
        return Order(self.columns, tuple("ASC" if d == "DESC" else "DESC" for d in self.directions))

    def expressions(self, prefix: str = "") -> list[Expr]:
        return [F.col(prefix + c.name).asc_nulls_first() if d == "ASC" else F.col(prefix + c.name).desc_nulls_last() for c, d in zip(self.columns, self.directions, strict=True)]

    def after(self, values: list, prefix: str = "") -> Expr:
        """Rows that stand after `values`: equal in the first k columns and later in the next, for some k."""
        ways, equal = [], []
        for c, d, v in zip(self.columns, self.directions, values, strict=True):
            x = F.col(prefix + c.name)
            if v is None:
                later = x.isNotNull() if d == "ASC" else F.lit(False)
                same = x.isNull()
            else:
                y = literal(c, v)
                later = x > y if d == "ASC" else x < y
                if d == "DESC" and c.nullable:
                    later = later | x.isNull()
                same = x == y
            ways.append(reduce(lambda a, b: a & b, [*equal, later]))
            equal.append(same)
        return reduce(lambda a, b: a | b, ways)


def allowed_prefixes(t: Table) -> list[tuple[str, ...]]:
    """Column lists that an order may have: what begins an index or the key."""
    return sorted({ix[: n + 1] for ix in t.ordered_indexes for n in range(len(ix))})


def indexed_fields(t: Table) -> list[str]:
    return [f for f, c in t.fields if c in t.indexed]


def parse(t: Table, order_by: list[dict] | None, policy: str = PREFIX) -> Order:
    """[{"field": "ASC"}, ...] completed by the primary key, ascending; without it, the key alone."""
    if not t.primary_key:
        raise BadOrder(f"{t.name} has no primary key, so its pages have no order")
    columns, directions = [], []
    if order_by is not None:
        if not isinstance(order_by, (list, tuple)) or not order_by:
            raise BadOrder("orderBy must not be empty")
        if policy not in (PREFIX, ANY_INDEXED):
            raise BadOrder(f"unknown policy {policy}")
        for clause in order_by:
            if not isinstance(clause, dict) or len(clause) != 1:
                raise BadOrder("each orderBy clause has one field")
            name, direction = next(iter(clause.items()))
            c = t.column_of(name)
            if c is None:
                raise BadOrder(f"unknown field {name}")
            if str(direction).upper() not in ("ASC", "DESC"):
                raise BadOrder(f"{name}: the direction is ASC or DESC")
            if c.name in columns:
                raise BadOrder(f"{name} occurs twice")
            if c.name not in t.indexed:
                raise BadOrder(f"{name} is not indexed")
            columns.append(c.name)
            directions.append(str(direction).upper())
        if policy == PREFIX and tuple(columns) not in allowed_prefixes(t):
            raise BadOrder(f"no index begins with {', '.join(columns)}")
    for k in t.primary_key:
        if k not in columns:
            columns.append(k)
            directions.append("ASC")
    return Order(tuple(t.column(c) for c in columns), tuple(directions))
