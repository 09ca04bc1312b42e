"""Coercion against the same rules written in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from goldseam.functions import coerce as C
from goldseam.functions.casts import calendar_years, lenient_date, lenient_time, strict_boolean, strict_number

EDGES = [
    None, "", " ", "\t", "   ", "TRUE", " y ", "0", "maybe", "1", "Yes", "no", "3.7", "-3.7", " 4 ", "\t4\n", "1e3",
    "1_000", "1__0", "_1", "1_", "1d", "2f", "inf", "-Infinity", "nan", "NaN", "-0", "+5", ".5", "5.", ".", "e5", "1e",
    "1e+2", "0x10", "0x1p3", "12345678901234567890", "9007199254740993", "9223372036854775807", "1e999", "--1", "1 2",
    "é", " wide ", "x\u001fy", "a\x1c", "1,5", "1e1_0", "café ",
]


def python_float(text):
    try:
        return float(text.strip())
    except ValueError:
        return None


def expect(text, kind):
    if text is None or text == "":
        return None
    if kind == "bool":
        return text.strip().lower() in ("true", "1", "yes", "t", "y")
    if kind == "str":
        return text.strip()
    number = python_float(text)
    if kind == "float" or number is None:
        return number
    if math.isnan(number) or math.isinf(number):
        return None
    try:
        exact = int(text.strip())  # plain digits keep every digit
    except ValueError:
        exact = int(number)
    return exact if -(2**63) <= exact < 2**63 else None  # a wider column takes the rest


def same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a):
        return math.isnan(b)
    return a == b


@pytest.mark.parametrize("kind", ["bool", "int", "float", "str"])
def test_text_rules(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", C.coerce(F.col("t"), kind).alias("v")).collect()}
    wrong = [(t, got[i], expect(t, kind)) for i, t in enumerate(EDGES) if not same(got[i], expect(t, kind))]
    assert wrong == []


def strict(text, kind):
    """Database rules: truth of the text, whole numbers only, no stripping."""
    if text is None:
        return None
    if kind == "bool":
        return bool(text)
    if kind == "str":
        return text
    try:
        value = int(text) if kind == "int" else float(text)
    except ValueError:
        return None
    return None if kind == "int" and abs(value) >= 2**63 else value


@pytest.mark.parametrize("kind", ["bool", "int", "float", "str"])
def test_strict_rules(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", C.coerce_strict(F.col("t"), kind).alias("v")).collect()}
    wrong = [(t, got[i], strict(t, kind)) for i, t in enumerate(EDGES) if not same(got[i], strict(t, kind))]
    assert wrong == []


def test_strict_on_stored_numbers(spark):
    df = spark.createDataFrame([(3.7,), (-3.7,), (0.0,), (None,)], "x double")
    got = df.select(C.strict_int(F.col("x"), "float"), C.strict_bool(F.col("x"), "float")).collect()
    assert [tuple(r) for r in got] == [(3, True), (-3, True), (0, False), (None, None)]


def test_wide_integers(spark):
    df = spark.createDataFrame([("12345678901234567890",), ("-7.9",), ("1e20",), ("x",)], "t string")
    got = [r[0] for r in df.select(C.coerce_wide_int(F.col("t"))).collect()]
    assert [None if v is None else int(v) for v in got] == [12345678901234567890, -7, 10**20, None]


def test_lenient_casts(spark):
    df = spark.createDataFrame(
        [("2020-02-30", "13:00"), ("2020-1-5", "9:05:07"), ("", "13:00 UTC-6"), (None, "24:00"), ("2020-12-31", None)],
        "d string, t string",
    )
    got = df.select(lenient_date(F.col("d")).cast("string"), lenient_time(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        (None, "13:00:00"), ("2020-01-05", "09:05:07"), (None, None), (None, None), ("2020-12-31", None),
    ]


def test_strict_casts(spark):
    good = spark.createDataFrame([("1.5", "true"), ("-1.5", "f"), (None, None)], "n string, b string")
    got = good.select(strict_number(F.col("n")), strict_boolean(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2, True), (-2, False), (None, None)]
    bad = spark.createDataFrame([("45+2",)], "n string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(strict_number(F.col("n"))).collect()


def test_calendar_years_counts_year_numbers(spark):
    df = spark.sql("select date'1999-12-31' as born, date'2000-01-01' as at")
    assert df.select(calendar_years(F.col("born"), F.col("at"))).first()[0] == 1


def test_whole_numbers_keep_their_digits(spark):
    values = ["9007199254740993", "9223372036854775807", "9223372036854775808", "98765432109876543210"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    narrow = [r[0] for r in df.select(C.coerce_int(F.col("t"))).collect()]
    wide = [int(r[0]) for r in df.select(C.coerce_wide_int(F.col("t"))).collect()]
    assert narrow == [int(values[0]), int(values[1]), None, None]
    assert wide == [int(v) for v in values]


def test_retyping_more_columns_needs_no_more_patterns(spark):
    """Numbers are parsed by one expression per kind, whatever the number of columns."""
    from goldseam.operators.infer import retype

    names = {f"c{i}": ("int", "float", "wide")[i % 3] for i in range(12)}
    frame = spark.createDataFrame([tuple(f" {i}.0" for i in range(12))], list(names))
    patterns = lambda n: str(retype(frame, dict(list(names.items())[:n]))._jdf.queryExecution().executedPlan()).count("RLIKE")
    assert patterns(3) and patterns(12) == patterns(3)
    assert [float(v) for v in retype(frame, names).first()] == list(map(float, range(12)))
