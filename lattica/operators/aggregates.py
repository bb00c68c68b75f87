"""Aggregates of a filtered table: count, distinct counts, averages, sums, least and greatest, whole or for each parent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import Order
from ..sources.catalog import Table

FUNCTIONS = ("countDistinct", "avg", "sum", "min", "max")


class BadAggregate(ValueError):
    """An aggregate that the column's kind does not have."""


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None

    @property
    def name(self) -> str:
        return "count" if self.function == "count" else f"{self.function}_{self.column}"

    def expression(self) -> Expr:
        c = F.col(self.column) if self.column else None
        if self.function == "count":
            e = F.count(F.lit(1))
        elif self.function == "countDistinct":
            e = F.count_distinct(c)
        elif self.function == "avg":
            e = F.avg(c.cast("double"))
        elif self.function == "sum":
            e = F.sum(c.cast("double"))
        else:
            e = F.min(c) if self.function == "min" else F.max(c)
        return e.alias(self.name)


def parse(t: Table, selection: dict) -> list[Aggregate]:
    """{"count": True, "avg": ["price"], ...} checked against the table; the count always comes first."""
    out = [Aggregate("count")]
    for function, fields in selection.items():
        if function == "count":
            continue
        if function not in FUNCTIONS:
            raise BadAggregate(f"unknown aggregate {function}")
        for f in fields:
            c = t.column_of(f)
            if c is None:
                raise BadAggregate(f"unknown field {f}")
            if function in ("avg", "sum") and not c.kind.numeric or not c.kind.comparable:
                raise BadAggregate(f"no {function} of {c.kind.value} column {f}")
            a = Aggregate(function, c.name)
            if a not in out:
                out.append(a)
    return out


def over(base: DataFrame, aggregates: list[Aggregate]) -> DataFrame:
    """One row. Of no rows: count 0, all else null."""
    return base.agg(*[a.expression() for a in aggregates])


def over_top(base: DataFrame, aggregates: list[Aggregate], order: Order, limit: int, offset: int = 0) -> DataFrame:
    """Over the rows from offset on, `limit` of them, in an order."""
    rows = base.orderBy(*order.expressions())
    return over((rows.offset(offset) if offset else rows).limit(limit), aggregates)


def by_key(base: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """A row for each value of the keys, in two phases, partial before the shuffle."""
    return base.groupBy(*keys).agg(*[a.expression() for a in aggregates])


def by_parent(parents: DataFrame, parent_keys: list[str], base: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """A row for each parent, those without rows too: aggregated first, so the join meets one row a parent."""
    found = by_key(base, keys, aggregates)
    found = found.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(a.name) for a in aggregates])
    joined = parents.join(found, [F.col(p) == F.col(f"_a_{k}") for p, k in zip(parent_keys, keys, strict=True)], "left")
    zero = [F.coalesce(a.name, F.lit(0).cast("long")).alias(a.name) if a.function in ("count", "countDistinct") else F.col(a.name) for a in aggregates]
    return joined.select(*parents.columns, *zero)
