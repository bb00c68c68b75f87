"""The kinds of column values: SQL type names and Spark types to kinds, and what each kind allows."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    INT = "Int"
    BIGINT = "BigInt"
    FLOAT = "Float"
    DECIMAL = "Decimal"
    BOOLEAN = "Boolean"
    STRING = "String"
    ENUM = "Enum"
    SET = "Set"
    JSON = "JSON"
    BYTES = "Bytes"
    UUID = "UUID"
    DATE = "Date"
    DATETIME = "DateTime"
    TIME = "Time"
    YEAR = "Year"
    VECTOR = "Vector"

    @property
    def numeric(self) -> bool:
        """Whether sums and averages are defined."""
        return self in (Kind.INT, Kind.BIGINT, Kind.FLOAT, Kind.DECIMAL)

    @property
    def comparable(self) -> bool:
        """Whether minima, maxima and distinct counts are defined."""
        return self not in (Kind.JSON, Kind.VECTOR)

    @property
    def operators(self) -> frozenset[str]:
        """Filter operators of the kind; none where it cannot be filtered."""
        equal = {"eq", "ne", "isNull"}
        listed = equal | {"in", "notIn"}
        ranged = listed | {"lt", "lte", "gt", "gte"}
        if self in (Kind.JSON, Kind.VECTOR):
            return frozenset()
        if self is Kind.BOOLEAN:
            return frozenset(equal)
        if self is Kind.SET:
            return frozenset(equal | {"has", "hasAnyOf", "hasAllOf", "hasNoneOf"})
        if self in (Kind.ENUM, Kind.BYTES, Kind.UUID):
            return frozenset(listed)
        if self is Kind.STRING:
            return frozenset(ranged | {"like", "notLike"})
        return frozenset(ranged)


# SQL type names by kind.
_NAMES = {
    Kind.INT: "tinyint smallint mediumint int integer serial bit",
    Kind.BIGINT: "bigint",
    Kind.FLOAT: "float double real",
    Kind.DECIMAL: "decimal numeric",
    Kind.BOOLEAN: "bool boolean",
    Kind.JSON: "json",
    Kind.ENUM: "enum",
    Kind.SET: "set",
    Kind.VECTOR: "vector",
    Kind.BYTES: "binary varbinary tinyblob blob mediumblob longblob",
    Kind.DATE: "date",
    Kind.DATETIME: "datetime timestamp",
    Kind.TIME: "time",
    Kind.YEAR: "year",
}
_BY_NAME = {n: k for k, names in _NAMES.items() for n in names.split()}


def from_sql(declared: str) -> Kind:
    """The kind of a declared SQL type. tinyint(1) is a boolean; unknown types are strings."""
    m = re.match(r"\s*([a-z]+)\s*(?:\(([^)]*)\))?", declared.lower())
    if m is None:
        return Kind.STRING
    if m.group(1) == "tinyint" and (m.group(2) or "").strip() == "1":
        return Kind.BOOLEAN
    return _BY_NAME.get(m.group(1), Kind.STRING)


def from_spark(t: T.DataType) -> Kind:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return Kind.INT
    if isinstance(t, T.LongType):
        return Kind.BIGINT
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return Kind.FLOAT
    if isinstance(t, T.DecimalType):
        return Kind.DECIMAL
    if isinstance(t, T.BooleanType):
        return Kind.BOOLEAN
    if isinstance(t, T.BinaryType):
        return Kind.BYTES
    if isinstance(t, T.DateType):
        return Kind.DATE
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Kind.DATETIME
    if isinstance(t, T.DayTimeIntervalType):
        return Kind.TIME
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return Kind.VECTOR
    if isinstance(t, (T.StructType, T.MapType, T.VariantType, T.ArrayType)):
        return Kind.JSON
    return Kind.STRING
