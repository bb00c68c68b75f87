"""Opaque texts for clients: cursors (a place in an order) and node ids (a type and a key)."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import json
import math
from decimal import Decimal

from ..functions import scalars
from ..functions.kinds import Kind
from ..sources.catalog import Column

VERSION = 2


class BadToken(ValueError):
    """A cursor or id that cannot be read or belongs elsewhere."""


def _text(v: object) -> str | None:
    """A value as text that parse() reads back exactly; None for null, unlike any text."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode()
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, float):
        return repr(v)
    return format(v, "f") if isinstance(v, Decimal) else str(v)


def value(column: Column, text: str | None) -> object:
    if text is None:
        return None
    if column.kind is Kind.TIME:
        return scalars.integer(text)
    if column.kind is Kind.YEAR:
        return int(text)
    if column.kind is Kind.UUID and column.binary:
        return base64.b64decode(text)
    if column.kind in (Kind.SET, Kind.ENUM):
        return text
    if column.kind is Kind.BOOLEAN:
        return scalars.boolean(text)
    return scalars.parse(column.kind, text)


def _seal(payload: object) -> str:
    return base64.b64encode(json.dumps(payload, separators=(",", ":")).encode()).decode()


def _open(token: str, what: str) -> object:
    try:
        return json.loads(base64.b64decode(token, validate=True))
    except (binascii.Error, ValueError):
        raise BadToken(f"invalid {what}") from None


def cursor(type_name: str, order: str, directions: list[str], values: list) -> str:
    """The place after `values` in an order, bound to the type, the order's name and its directions."""
    return _seal({"v": VERSION, "t": type_name, "k": order, "d": [d.upper() for d in directions], "vals": [_text(v) for v in values]})


def read_cursor(token: str, type_name: str, order: str, directions: list[str]) -> list[str | None]:
    """The values as texts, if the cursor was made for just this."""
    p = _open(token, "cursor")
    if not isinstance(p, dict) or p.get("v") != VERSION or not p.get("t") or not p.get("k"):
        raise BadToken("invalid cursor")
    if not isinstance(p.get("d"), list) or not isinstance(p.get("vals"), list) or not p["d"] or len(p["d"]) != len(p["vals"]):
        raise BadToken("invalid cursor: directions and values differ in number")
    for name, mine, got in (("type", type_name, p["t"]), ("order", order, p["k"]), ("directions", [d.upper() for d in directions], [str(d).upper() for d in p["d"]])):
        if mine != got:
            raise BadToken(f"the cursor's {name} is {got}, not {mine}")
    return p["vals"]


def cursor_values(texts: list[str | None], columns: list[Column]) -> list:
    if len(texts) != len(columns):
        raise BadToken("the cursor has a different number of values")
    try:
        return [value(c, t) for c, t in zip(columns, texts, strict=True)]
    except (ValueError, binascii.Error) as e:
        raise BadToken(f"invalid cursor value: {e}") from None


def vector_cursor_values(texts: list[str | None], key: list[Column]) -> tuple[float, list]:
    """A distance, then the key."""
    try:
        distance = float(texts[0])  # type: ignore[arg-type]
    except (TypeError, ValueError, IndexError):
        raise BadToken("invalid cursor distance") from None
    if not math.isfinite(distance):
        raise BadToken("invalid cursor distance")
    return distance, cursor_values(texts[1:], key)


def node_id(type_name: str, key: list) -> str:
    return _seal([type_name, *[v if isinstance(v, int) and not isinstance(v, bool) else _text(v) for v in key]])


def read_node_id(token: str) -> tuple[str, list]:
    p = _open(token, "id")
    if not isinstance(p, list) or len(p) < 2 or not isinstance(p[0], str) or not p[0]:
        raise BadToken("invalid id")
    return p[0], p[1:]


def key_values(columns: list[Column], raw: list) -> list:
    """An id's values as the key's columns need them."""
    if len(raw) != len(columns):
        raise BadToken("the id has a different number of key values")
    if any(v is None for v in raw):
        raise BadToken("the id lacks a key value")
    return cursor_values([v if isinstance(v, str) else _text(v) for v in raw], columns)
