import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattica.functions import scalars as s
from lattica.functions.kinds import Kind, from_sql
from lattica.plans import codecs
from lattica.sources.catalog import Column


@pytest.mark.parametrize("declared, kind", [("tinyint(1)", Kind.BOOLEAN), ("TINYINT(4)", Kind.INT), ("bigint(20) unsigned", Kind.BIGINT), ("decimal(10,2)", Kind.DECIMAL), ("enum('a','b')", Kind.ENUM), ("set('a','b')", Kind.SET), ("vector(8)", Kind.VECTOR), ("varbinary(16)", Kind.BYTES), ("mediumtext", Kind.STRING), ("year", Kind.YEAR), ("geometry", Kind.STRING), ("timestamp(6)", Kind.DATETIME)])
def test_kind_of_sql_type(declared, kind):
    assert from_sql(declared) is kind


def test_declared_values_and_dimension():
    assert Column.sql("c", "enum('a','b')").values == ("a", "b")
    assert Column.sql("c", "vector(8)").dim == 8


@pytest.mark.parametrize("text, out", [("12:30", "12:30:00"), ("838:59:59", "838:59:59"), ("5", "00:00:05"), ("130", "00:01:30"), ("12345", "01:23:45"), ("-00:00:00", "00:00:00"), ("-1:02:03.5", "-01:02:03.5")])
def test_time(text, out):
    assert s.time_text(s.time_micros(text)) == out


@pytest.mark.parametrize("text", ["839:00:00", "12:60:00", "1:2:3:4", "", "x", "1234567", "99"])
def test_time_refused(text):
    with pytest.raises(s.ValueProblem):
        s.time_micros(text)


@pytest.mark.parametrize("kind, bad", [(Kind.INT, 1 << 31), (Kind.INT, True), (Kind.BIGINT, 1.5), (Kind.BIGINT, 1 << 63), (Kind.DECIMAL, "1,5"), (Kind.DECIMAL, "NaN"), (Kind.YEAR, 2156), (Kind.YEAR, "99"), (Kind.BYTES, "@@"), (Kind.UUID, "xyz"), (Kind.DATE, "2020-13-01"), (Kind.VECTOR, [float("nan")]), (Kind.VECTOR, []), (Kind.STRING, 5)])
def test_refused(kind, bad):
    with pytest.raises(s.ValueProblem):
        s.parse(kind, bad)


def test_forms():
    assert s.parse(Kind.DATE, "2020-02-03T23:00:00Z") == dt.date(2020, 2, 3)
    assert s.parse(Kind.DATETIME, "2020-02-03T01:00:00+02:00") == dt.datetime(2020, 2, 2, 23)
    assert s.parse(Kind.BIGINT, "9007199254740993") == 9007199254740993
    assert s.parse(Kind.DECIMAL, "1e2") == Decimal(100)
    assert s.parse(Kind.UUID, "{0123456789ABCDEF0123456789ABCDEF}") == "01234567-89ab-cdef-0123-456789abcdef"
    assert s.canonical_set(["c", "a", "c"], ("a", "b", "c")) == "a,c"
    assert s.show(Kind.SET, "a, c,") == ["a", "c"]
    assert s.show(Kind.ENUM, 2, ("x", "y")) == "y"
    assert [s.boolean(v) for v in ("", "0", "1", 2, b"\x01", "true")] == [False, False, True, True, True, True]


_ANY = st.one_of(st.tuples(st.just(Kind.BIGINT), st.integers(-(1 << 63), (1 << 63) - 1)), st.tuples(st.just(Kind.STRING), st.text()), st.tuples(st.just(Kind.FLOAT), st.floats(allow_nan=False, allow_infinity=False)), st.tuples(st.just(Kind.BYTES), st.binary()), st.tuples(st.just(Kind.DATETIME), st.datetimes()), st.tuples(st.just(Kind.DATE), st.dates()), st.tuples(st.just(Kind.BOOLEAN), st.booleans()), st.tuples(st.just(Kind.DECIMAL), st.decimals(allow_nan=False, allow_infinity=False, places=4)), st.tuples(st.just(Kind.STRING), st.none()))


@given(st.lists(_ANY, min_size=1, max_size=4))
def test_cursor_round_trip(pairs):
    columns = [Column(f"c{i}", k) for i, (k, _) in enumerate(pairs)]
    values = [v for _, v in pairs]
    d = ["ASC", "DESC", "ASC", "DESC"][: len(pairs)]
    token = codecs.cursor("T", "k", d, values)
    assert codecs.cursor_values(codecs.read_cursor(token, "T", "k", d), columns) == values


@pytest.mark.parametrize("change", [("U", "k", ["ASC"]), ("T", "l", ["ASC"]), ("T", "k", ["DESC"]), ("T", "k", ["ASC", "ASC"])])
def test_cursor_belongs_to_its_order(change):
    token = codecs.cursor("T", "k", ["ASC"], [1])
    with pytest.raises(codecs.BadToken):
        codecs.read_cursor(token, *change)


@pytest.mark.parametrize("token", ["", "!!", "e30=", "W10=", "WyJUIl0="])
def test_broken_tokens(token):
    with pytest.raises(codecs.BadToken):
        codecs.read_cursor(token, "T", "k", ["ASC"])
    with pytest.raises(codecs.BadToken):
        codecs.read_node_id(token)


def test_node_id_round_trip():
    columns = [Column("a", Kind.BIGINT), Column("b", Kind.STRING), Column("c", Kind.DATE)]
    name, raw = codecs.read_node_id(codecs.node_id("Thing", [5, "x", dt.date(2020, 1, 2)]))
    assert name == "Thing" and codecs.key_values(columns, raw) == [5, "x", dt.date(2020, 1, 2)]


def test_expressions(spark):
    from pyspark.sql import functions as F

    row = spark.sql("select unhex('0123456789abcdef0123456789abcdef') b, 'a, c,,' s, 2 o, -3723500000L t").select(s.uuid_text(F.col("b")).alias("u"), F.hex(s.uuid_bytes(s.uuid_text(F.col("b")))).alias("h"), s.set_members(F.col("s")).alias("m"), s.enum_literal(F.col("o"), ("x", "y")).alias("e"), s.enum_ordinal(F.lit("y"), ("x", "y")).alias("n"), s.enum_ordinal(F.lit("z"), ("x", "y")).alias("z"), s.micros_text(F.col("t")).alias("t")).collect()[0]
    assert row.u == "01234567-89ab-cdef-0123-456789abcdef" and row.h.lower() == "0123456789abcdef0123456789abcdef"
    assert row.m == ["a", "c"] and row.e == "y" and row.n == 2 and row.z is None and row.t == "-01:02:03.5"


def test_enum_names():
    values = ("1-URGENT", "a b", "A_B", "été", "", "--", "x-é")
    names = s.enum_names(values)
    assert list(names.values()) == ["VALUE_1_URGENT", "A_B", "A_B_2", "U00E9T_U00E9", "VALUE", "VALUE_2", "X_U00E9"]
    assert s.api(Kind.ENUM, 2, values) == "A_B" and s.api(Kind.SET, "a b,été", values) == ["A_B", "U00E9T_U00E9"] and s.api(Kind.ENUM, None, values) is None
    assert s.parse(Kind.ENUM, "A_B_2", values) == "A_B" and s.parse(Kind.ENUM, "a b", values) == "a b" and s.parse(Kind.SET, ["VALUE_1_URGENT", "a b"], values) == "1-URGENT,a b"
    with pytest.raises(s.ValueProblem):
        s.parse(Kind.ENUM, "A_B_3", values)
