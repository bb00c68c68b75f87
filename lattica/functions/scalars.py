"""Values on their way in and out: validation in Python for arguments, Column expressions for rows."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import json
import math
import re
import uuid as _uuid
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import Kind


class ValueProblem(ValueError):
    """An argument that its column's kind does not admit."""


_INT32 = (-(1 << 31), (1 << 31) - 1)
_INT64 = (-(1 << 63), (1 << 63) - 1)


def integer(v: object, bounds: tuple[int, int] = _INT64) -> int:
    """An integer, given as one, as an integral float or as a string of digits."""
    if isinstance(v, bool):
        raise ValueProblem(f"not an integer: {v!r}")
    if isinstance(v, float):
        if not v.is_integer():
            raise ValueProblem(f"not an integer: {v!r}")
        v = int(v)
    elif isinstance(v, str):
        if not re.fullmatch(r"[+-]?\d+", v.strip()):
            raise ValueProblem(f"not an integer: {v!r}")
        v = int(v)
    if not isinstance(v, int):
        raise ValueProblem(f"not an integer: {v!r}")
    if not bounds[0] <= v <= bounds[1]:
        raise ValueProblem(f"out of range: {v}")
    return v


def natural(v: object, name: str = "value") -> int:
    """A non-negative 32-bit integer."""
    v = integer(v, _INT32)
    if v < 0:
        raise ValueProblem(f"{name} must be non-negative")
    return v


def decimal(v: object) -> Decimal:
    try:
        out = Decimal(str(v).strip())
    except InvalidOperation:
        raise ValueProblem(f"not a decimal: {v!r}") from None
    if isinstance(v, bool) or not out.is_finite():
        raise ValueProblem(f"not a decimal: {v!r}")
    return out


def boolean(v: object) -> bool:
    """Tolerant: numbers by being non-zero, empty strings false, words and digits by what they say."""
    if isinstance(v, (bool, int, float)):
        return bool(v)
    text = (v.decode("latin1") if isinstance(v, (bytes, bytearray)) else str(v)).strip().lower()
    if text in ("", "0", "false", "f", "no", "\x00"):
        return False
    if text in ("1", "true", "t", "yes", "\x01"):
        return True
    try:
        return float(text) != 0
    except ValueError:
        raise ValueProblem(f"not a boolean: {v!r}") from None


def date(v: object) -> dt.date:
    """YYYY-MM-DD, or a date-time of which the date is taken."""
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    try:
        return dt.date.fromisoformat(str(v)[:10]) if len(str(v)) == 10 else date_time(v).date()
    except ValueError:
        raise ValueProblem(f"not a date: {v!r}") from None


def date_time(v: object) -> dt.datetime:
    """RFC 3339 text, as a UTC time without a zone."""
    if isinstance(v, dt.datetime):
        out = v
    elif isinstance(v, dt.date):
        out = dt.datetime(v.year, v.month, v.day)
    else:
        try:
            out = dt.datetime.fromisoformat(str(v).strip())
        except ValueError:
            raise ValueProblem(f"not a date-time: {v!r}") from None
    return out.astimezone(dt.UTC).replace(tzinfo=None) if out.tzinfo else out


#: Largest time of day or duration: 838:59:59.
TIME_HOURS = 838


def time_micros(v: object) -> int:
    """Signed microseconds of a time up to 838:59:59.999999: h:m, h:m:s, or digits read from the right as hhmmss."""
    text = str(v).strip()
    m = re.fullmatch(r"([+-]?)(?:(\d+):(\d{1,2})(?::(\d{1,2}))?|(\d{1,6}))(?:\.(\d{1,6}))?", text)
    if m is None:
        raise ValueProblem(f"not a time: {v!r}")
    sign, h, mi, s, digits, fraction = m.groups()
    if digits is not None:
        n = int(digits)
        h, mi, s = n // 10000, n // 100 % 100, n % 100
    else:
        h, mi, s = int(h), int(mi), int(s or 0)
    if mi > 59 or s > 59 or h > TIME_HOURS:
        raise ValueProblem(f"not a time: {v!r}")
    out = ((h * 60 + mi) * 60 + s) * 1_000_000 + int((fraction or "").ljust(6, "0"))
    return -out if sign == "-" else out


def time_text(micros: int | None) -> str | None:
    if micros is None:
        return None
    whole, part = divmod(abs(micros), 1_000_000)
    out = f"{'-' if micros < 0 else ''}{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"
    return out + (f".{part:06d}".rstrip("0") if part else "")


def year(v: object) -> int:
    """Four digits, or a number from 0 to 2155."""
    if isinstance(v, str) and not re.fullmatch(r"\d{4}", v):
        raise ValueProblem(f"not a year: {v!r}")
    out = integer(v)
    if not 0 <= out <= 2155:
        raise ValueProblem(f"not a year: {v!r}")
    return out


def bytes_(v: object) -> bytes:
    """Standard base64 text."""
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    try:
        return base64.b64decode(str(v), validate=True)
    except (binascii.Error, ValueError):
        raise ValueProblem("bytes must be base64 text") from None


def uuid(v: object) -> str:
    """Lower-case canonical form; hyphens, braces and a urn prefix are optional."""
    try:
        return str(_uuid.UUID(bytes=bytes(v)) if isinstance(v, (bytes, bytearray)) else _uuid.UUID(str(v)))
    except ValueError:
        raise ValueProblem(f"not a UUID: {v!r}") from None


def canonical_set(values: object, allowed: tuple[str, ...]) -> str:
    """Members without repeats, in the order of their declaration, joined by commas."""
    if isinstance(values, str) or not hasattr(values, "__iter__"):
        raise ValueProblem("a set is given as a list")
    given = set(values)
    if unknown := given - set(allowed):
        raise ValueProblem(f"not members of the set: {sorted(map(str, unknown))}")
    return ",".join(x for x in allowed if x in given)


def canonical_sets(lists: list, allowed: tuple[str, ...]) -> list[str]:
    return [canonical_set(x, allowed) for x in lists]


def vector(v: object, dim: int | None = None) -> list[float]:
    """Finite numbers, given as a list or as JSON text, of the declared length where one is known."""
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            raise ValueProblem("a vector is a list of numbers") from None
    if not isinstance(v, (list, tuple)) or not v or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in v):
        raise ValueProblem("a vector is a non-empty list of numbers")
    out = [float(x) for x in v]
    if not all(map(math.isfinite, out)):
        raise ValueProblem("a vector's values must be finite")
    if dim is not None and len(out) != dim:
        raise ValueProblem(f"the vector has {len(out)} dimensions, the column {dim}")
    return out


def json_text(v: object) -> str:
    if isinstance(v, str):
        try:
            json.loads(v)
        except ValueError:
            raise ValueProblem("not JSON text") from None
        return v
    return json.dumps(v)


def parse(kind: Kind, v: object, values: tuple[str, ...] = (), dim: int | None = None) -> object:
    """An argument as the Python value that stands for it in expressions; None stays None."""
    if v is None:
        return None
    if kind is Kind.INT:
        return integer(v, _INT32)
    if kind is Kind.FLOAT:
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            try:
                return float(str(v))
            except ValueError:
                raise ValueProblem(f"not a number: {v!r}") from None
        return float(v)
    if kind in (Kind.ENUM, Kind.SET):
        v = from_api(kind, v, values)
    if kind is Kind.ENUM:
        if values and v not in values:
            raise ValueProblem(f"not a value of the enum: {v!r}")
        return v
    if kind is Kind.SET:
        return canonical_set(v, values)
    if kind is Kind.VECTOR:
        return vector(v, dim)
    plain = {Kind.BIGINT: integer, Kind.DECIMAL: decimal, Kind.BOOLEAN: boolean, Kind.DATE: date, Kind.DATETIME: date_time, Kind.TIME: time_micros, Kind.YEAR: year, Kind.BYTES: bytes_, Kind.UUID: uuid, Kind.JSON: json_text}
    if kind in plain:
        return plain[kind](v)
    if not isinstance(v, str):
        raise ValueProblem(f"not a string: {v!r}")
    return v


def show(kind: Kind, v: object, values: tuple[str, ...] = ()) -> object:
    """A stored value as it goes to a client."""
    if v is None:
        return None
    if kind in (Kind.BIGINT, Kind.DECIMAL):
        return format(v, "f") if isinstance(v, Decimal) else str(v)
    if kind is Kind.BOOLEAN:
        return boolean(v)
    if kind is Kind.BYTES:
        return base64.b64encode(bytes(v)).decode()
    if kind is Kind.UUID:
        return uuid(v)
    if kind is Kind.DATE:
        return v.isoformat() if not isinstance(v, dt.datetime) else v.date().isoformat()
    if kind is Kind.DATETIME:
        return date_time(v).isoformat() + "Z"
    if kind is Kind.TIME:
        return time_text(v if isinstance(v, int) else round(v.total_seconds() * 1_000_000))
    if kind is Kind.YEAR:
        return f"{int(v):04d}"
    if kind is Kind.SET:
        return v if isinstance(v, list) else [x.strip() for x in str(v).split(",") if x.strip()]
    if kind is Kind.ENUM and isinstance(v, int) and values:
        return values[v - 1] if 1 <= v <= len(values) else None
    if kind is Kind.JSON:
        return v if isinstance(v, str) else json.dumps(v)
    return v


def enum_names(values: tuple[str, ...]) -> dict[str, str]:
    """API names of an enum's values, by value: upper-case letters and digits of ASCII, one underscore for a run of others,
    the code point of characters beyond ASCII; numbered where two would be equal."""
    out: dict[str, str] = {}
    taken: dict[str, int] = {}
    for v in values:
        parts = re.sub(r"[^\x00-\x7f]", lambda m: f"\0U{ord(m[0]):0{4 if ord(m[0]) <= 0xFFFF else 6}X}", v)
        base = re.sub(r"\0", "_", re.sub(r"[^A-Z0-9\0]+", "_", parts.upper()))
        base = re.sub(r"__+", "_", base).strip("_") or "VALUE"
        base = f"VALUE_{base}" if base[0].isdigit() else base
        name = base
        while name in taken:
            taken[base] += 1
            name = f"{base}_{taken[base]}"
        taken[name] = 1
        out[v] = name
    return out


def api(kind: Kind, v: object, values: tuple[str, ...] = ()) -> object:
    """show(), with the API names of enum values and set members."""
    shown = show(kind, v, values)
    if kind in (Kind.ENUM, Kind.SET) and values and shown is not None:
        names = enum_names(values)
        return [names.get(x, x) for x in shown] if isinstance(shown, list) else names.get(shown, shown)
    return shown


def from_api(kind: Kind, v: object, values: tuple[str, ...]) -> object:
    """An enum value or set members given by API name as they are declared; what is declared stays as it is."""
    if kind not in (Kind.ENUM, Kind.SET) or not values:
        return v
    if isinstance(v, (list, tuple)):
        return [from_api(kind, x, values) for x in v]
    own = {n: x for x, n in enum_names(values).items()}
    return v if v in values or not isinstance(v, str) else own.get(v, v)


# --- expressions over rows


def uuid_text(c: Column) -> Column:
    """Sixteen bytes as canonical text."""
    h = F.lower(F.hex(c))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def uuid_bytes(c: Column) -> Column:
    """Text as sixteen bytes; null where it is no UUID."""
    h = F.regexp_replace(F.lower(c), "[-{}]|urn:uuid:", "")
    return F.when(h.rlike("^[0-9a-f]{32}$"), F.unhex(h))


def json_value(c: Column, path: str) -> Column:
    """The value at a path of JSON text, as text; null where there is none or the text is no JSON."""
    return F.get_json_object(c, path)


def set_members(c: Column) -> Column:
    """Comma-separated text as an array, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def set_text(members: Column, allowed: tuple[str, ...]) -> Column:
    """An array as canonical text."""
    return F.array_join(F.array_intersect(F.array(*map(F.lit, allowed)), members), ",")


def enum_literal(ordinal: Column, values: tuple[str, ...]) -> Column:
    """A one-based ordinal as its literal; null where out of range."""
    return F.when((ordinal >= 1) & (ordinal <= len(values)), F.element_at(F.array(*map(F.lit, values)), ordinal.cast("int")))


def enum_ordinal(literal: Column, values: tuple[str, ...]) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), literal), F.lit(0).cast("long"))


def micros_text(c: Column) -> Column:
    """Signed microseconds as [-]hh:mm:ss, with a fraction where there is one."""
    a = F.abs(c)
    s, part = F.floor(a / 1_000_000), F.pmod(a, F.lit(1_000_000))
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    whole = F.concat(F.when(c < 0, "-").otherwise(""), F.concat_ws(":", two(F.floor(s / 3600)), two(F.pmod(F.floor(s / 60), F.lit(60))), two(F.pmod(s, F.lit(60)))))
    return F.when(part > 0, F.concat(whole, F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 6, "0"), "0+$", ""))).otherwise(whole)


def shown(kind: Kind, c: Column, values: tuple[str, ...] = ()) -> Column:
    """show() as an expression."""
    if kind in (Kind.BIGINT, Kind.DECIMAL):
        return c.cast("string")
    if kind is Kind.BOOLEAN:
        return c.cast("boolean")
    if kind is Kind.BYTES:
        return F.base64(c)
    if kind is Kind.DATE:
        return F.date_format(c, "yyyy-MM-dd")
    if kind is Kind.DATETIME:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind is Kind.TIME:
        return micros_text(c)
    if kind is Kind.YEAR:
        return F.lpad(c.cast("string"), 4, "0")
    if kind is Kind.SET:
        return set_members(c)
    return c


# --- vectors


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; null where a length is zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(size > 0, F.lit(1.0) - _dot(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
