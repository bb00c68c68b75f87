"""Pages of a table: filtered, ordered, cut at a cursor; with counts and aggregates made only when asked for."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalars import natural
from ..plans import codecs, ordering
from ..plans.filters import Compiler
from ..plans.limits import DEFAULT_PAGE, MAX_PAGE, Window, window
from ..plans.ordering import PREFIX, Order
from ..sources.catalog import Catalog, Relation, Table
from . import aggregates as agg
from .relations import parent_names, rows_by_parent


@dataclass
class Connection:
    """page and base are lazy; rows, page info and counts run on first use, once."""

    table: Table
    base: DataFrame  # all rows that pass the filter: cursors and sizes have no part in it
    page: DataFrame  # in the order asked for, one row more than the page if there is one
    order: Order
    window: Window
    _counts: dict = field(default_factory=dict)

    @cached_property
    def _fetched(self) -> list[Row]:
        return self.page.collect()  # a page's rows and one

    @cached_property
    def rows(self) -> list[Row]:
        """The page, in the order asked for."""
        got = self._fetched[: self.window.size]
        return got[::-1] if self.window.backward else got

    @property
    def has_more(self) -> bool:
        return len(self._fetched) > self.window.size

    def cursor(self, row: Row) -> str:
        return codecs.cursor(self.table.type_name, self.order.name, list(self.order.directions), [row[c.name] for c in self.order.columns])

    @property
    def page_info(self) -> dict:
        """On the side that was not read, whether there is more is told by the cursor given."""
        w = self.window
        return {
            "hasNextPage": w.before is not None if w.backward else self.has_more,
            "hasPreviousPage": self.has_more if w.backward else w.after is not None,
            "startCursor": self.cursor(self.rows[0]) if self.rows else None,
            "endCursor": self.cursor(self.rows[-1]) if self.rows else None,
        }

    @property
    def total_count(self) -> int:
        if "count" not in self._counts:
            self._counts["count"] = self.base.count()
        return self._counts["count"]

    def aggregate(self, selection: dict) -> dict:
        """All aggregates in one pass; the count they bring serves total_count too. Sums and averages of nothing are left out."""
        asked = agg.parse(self.table, selection)
        if len(asked) == 1:
            return {"count": self.total_count}
        row = agg.over(self.base, asked).collect()[0]
        self._counts["count"] = row["count"]
        out: dict = {"count": row["count"]}
        for a in asked[1:]:
            if row[a.name] is not None or a.function not in ("avg", "sum"):
                out.setdefault(a.function, {})[a.column] = row[a.name]
        return out


def _page(base: DataFrame, t: Table, order: Order, w: Window, columns: list[str] | None) -> DataFrame:
    read = order.reversed() if w.backward else order
    rows = base
    if cursor := (w.before if w.backward else w.after):
        texts = codecs.read_cursor(cursor, t.type_name, order.name, list(order.directions))
        rows = rows.where(read.after(codecs.cursor_values(texts, list(order.columns))))
    if columns is not None:
        needed = set(columns) | {c.name for c in order.columns}
        rows = rows.select(*[c.name for c in t.columns if c.name in needed])
    return rows.orderBy(*read.expressions()).limit(w.size + 1)


def connect(
    catalog: Catalog, t: Table, where: dict | None = None, order_by: list[dict] | None = None, policy: str = PREFIX, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None,
    columns: list[str] | None = None, compiler: Compiler | None = None, default: int = DEFAULT_PAGE, most: int = MAX_PAGE,
) -> Connection:
    """A page of a table. columns: what is read beside key and order; all if not given."""
    w = window(first, after, last, before, default, most)
    order = ordering.parse(t, order_by, policy)
    base = (compiler or Compiler(catalog, check_indexes=False)).where(t, where).apply(catalog.rows(t))
    return Connection(t, base, _page(base, t, order, w, columns), order, w)


def page_at(catalog: Catalog, t: Table, limit: int, offset: int, where: dict | None = None, order_by: list[dict] | None = None, policy: str = PREFIX, compiler: Compiler | None = None) -> DataFrame:
    """The rows at a place counted from the first, for callers without a cursor; all rows before are sorted too."""
    order = ordering.parse(t, order_by, policy)
    rows = (compiler or Compiler(catalog, check_indexes=False)).where(t, where).apply(catalog.rows(t))
    return rows.orderBy(*order.expressions()).offset(natural(offset, "offset")).limit(natural(limit, "limit"))


def connect_parent(
    catalog: Catalog, r: Relation, key: list, where: dict | None = None, order_by: list[dict] | None = None, policy: str = PREFIX, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None,
    columns: list[str] | None = None, compiler: Compiler | None = None, default: int = DEFAULT_PAGE, most: int = MAX_PAGE,
) -> Connection:
    """A page of one parent's rows; empty without a query on the relationship if the key holds a null."""
    w = window(first, after, last, before, default, most)
    t, rows = rows_by_parent(catalog, r, where, compiler)
    order = ordering.parse(t, order_by, policy)
    if any(v is None for v in key):
        base = rows.where(F.lit(False))
    else:
        base = rows
        for n, v in zip(parent_names(len(key)), key, strict=True):
            base = base.where(F.col(n) == F.lit(v))
    base = base.drop(*parent_names(len(key)))
    return Connection(t, base, _page(base, t, order, w, columns), order, w)
