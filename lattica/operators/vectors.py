"""Rows nearest to a vector, by exact distance, one page after another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.kinds import Kind
from ..plans import codecs, ordering
from ..plans.filters import Compiler
from ..plans.limits import DEFAULT_NEIGHBOURS, MAX_NEIGHBOURS
from ..sources.catalog import Catalog, Column, Table

METRICS = {"COSINE": scalars.cosine_distance, "L2": scalars.l2_distance}
DISTANCE = "_distance"


class BadSearch(ValueError):
    """Search arguments that make no sense."""


@dataclass
class Search:
    """rows: one more than asked for, if there is one, with _distance; order: how cursors name it."""

    rows: DataFrame
    size: int
    order: str
    key: list[Column]
    directions: list[str]


def searchable(t: Table, require_index: bool = True) -> list[Column]:
    """Vector columns with an index, of tables with a key."""
    with_index = {c for i in t.indexes if i.vector for c in i.columns}
    return [c for c in t.columns if c.kind is Kind.VECTOR and t.primary_key and (not require_index or c.name in with_index)]


def search(
    catalog: Catalog, t: Table, column: str, vector: object = None, query_text: str | None = None, metric: str = "COSINE", first: int | None = None, after: str | None = None, where: dict | None = None,
    compiler: Compiler | None = None, embedders: dict[str, Callable[[str], list[float]]] | None = None, default: int = DEFAULT_NEIGHBOURS, most: int = MAX_NEIGHBOURS, require_index: bool = True, **other: object,
) -> Search:
    """Nearest first, ties by key. `where` applies before distances; only forward pages exist."""
    c = next((c for c in searchable(t, require_index) if c.name == column or t.field_of(c.name) == column), None)
    if c is None:
        raise BadSearch(f"{column} of {t.name} cannot be searched")
    if other:
        raise BadSearch(f"unknown arguments: {', '.join(sorted(other))}")
    try:
        size = scalars.natural(default if first is None else first, "first")
    except scalars.ValueProblem as e:
        raise BadSearch(str(e)) from None
    if size == 0:
        raise BadSearch("first must be positive")
    size = min(size, most)
    if metric not in METRICS:
        raise BadSearch(f"unknown metric {metric}")
    if (vector is None) == (query_text is None):
        raise BadSearch("give exactly one of vector and queryText")
    if query_text is not None:
        if c.embedder is None or c.embedder not in (embedders or {}):
            raise BadSearch(f"{column} takes no text")
        if not query_text.strip():
            raise BadSearch("queryText must not be empty")
        vector = embedders[c.embedder](query_text)
    try:
        v = scalars.vector(vector, c.dim)
    except scalars.ValueProblem as e:
        raise BadSearch(str(e)) from None
    key = [t.column(k) for k in t.primary_key]
    rows = (compiler or Compiler(catalog, check_indexes=False)).where(t, where).apply(catalog.rows(t))
    rows = rows.withColumn(DISTANCE, METRICS[metric](F.col(c.name), F.array(*map(F.lit, v))))
    order = ordering.Order((Column(DISTANCE, Kind.FLOAT), *key), ("ASC",) * (len(key) + 1))
    name = f"{metric}:{order.name}"
    if after:
        distance, ks = codecs.vector_cursor_values(codecs.read_cursor(after, t.type_name, name, list(order.directions)), key)
        rows = rows.where(order.after([distance, *ks]))
    return Search(rows.orderBy(*order.expressions()).limit(size + 1), size, name, key, list(order.directions))
