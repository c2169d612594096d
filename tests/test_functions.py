from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions import amounts, codes, dates, ratios


def evaluate(spark, values, expression, ddl="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def dec(*values):
    return [None if v is None else Decimal(v) for v in values]


def test_to_amount(spark):
    values = ["12.5", " 7 ", None, "x", "", "1,000", "-3", "1e2"]
    assert evaluate(spark, values, amounts.to_amount) == dec(
        "12.50", "7.00", "0.00", None, None, None, "-3.00", "100.00"
    )
    zeros = evaluate(spark, values, lambda c: amounts.to_amount(c, bad_as_zero=True))
    assert zeros[3] == zeros[4] == zeros[5] == Decimal("0.00")


@pytest.mark.parametrize(
    ("negative", "expected"),
    [
        (amounts.PLAIN, ("1234", None, None, "0", "0", None, None, "-5", "3", None, None)),
        (amounts.PARENTHESES, ("1234", "-1234", None, "0", "0", None, None, "-5", "3", "-7", None)),
        (amounts.TRAILING_MINUS, ("1234", None, "-1234", "0", "0", None, None, "-5", "3", None, "-12")),
    ],
)
def test_erp_amounts(spark, negative, expected):
    values = ["1,234", "(1,234)", "1,234-", "-", None, "", "junk", "-5", "\t3　", "( 7)", "1-2-"]
    values[9] = "(7)"
    result = evaluate(spark, values, lambda c: amounts.parse_erp_amount(c, negative))
    assert result == [None if v is None else Decimal(v).quantize(Decimal("0.01")) for v in expected]


def test_two_trailing_minus_signs_alone_are_unreadable(spark):
    parse = lambda c: amounts.parse_erp_amount(c, amounts.TRAILING_MINUS)
    assert evaluate(spark, ["--", " - ", "5--"], parse) == dec(None, "0.00", "-5.00")


def test_unknown_negative_format():
    with pytest.raises(ValueError):
        amounts.parse_erp_amount(F.lit("1"), "other")


cents = st.integers(min_value=-(10**15), max_value=10**15)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cents, min_size=1, max_size=200))
def test_written_amounts_read_back(spark, values):
    def write(c, kind):
        text = f"{abs(Decimal(c) / 100):,.2f}"
        if c >= 0:
            return text
        return {"parentheses": f"({text})", "trailing_minus": f"{text}-", "plain": f"-{text}"}[kind]

    for kind in (amounts.PLAIN, amounts.PARENTHESES, amounts.TRAILING_MINUS):
        texts = [write(c, kind) for c in values]
        read = evaluate(spark, texts, lambda c: amounts.parse_erp_amount(c, kind))  # noqa: B023
        assert read == [Decimal(c) / 100 for c in values]


def test_strict_amount(spark):
    assert evaluate(spark, ["1,234.5", None], amounts.strict_amount) == dec("1234.50", None)
    with pytest.raises(Exception, match="not a number"):
        evaluate(spark, ["12x"], amounts.strict_amount)


def test_scale_and_marker(spark):
    df = spark.createDataFrame(
        [("S", Decimal("5")), ("H", Decimal("5")), (None, Decimal("5")), ("S", None)],
        "m string, a decimal(18,2)",
    )
    signed = df.select(
        amounts.sign_by_marker(F.col("a"), F.col("m")),
        amounts.sign_by_marker(F.col("a"), F.col("m"), null_is_debit=True),
        amounts.scale_hundred(F.col("a")),
    ).collect()
    assert [tuple(r) for r in signed] == [
        tuple(dec("5.00", "5.00", "500.00")),
        tuple(dec("-5.00", "-5.00", "500.00")),
        tuple(dec("-5.00", "5.00", "500.00")),
        (None, None, None),
    ]


def test_canonical_code(spark):
    values = ["00123", "123.0", "123.7", "-9.9", "A12", " 7 ", None, "", "12345678901234567890123"]
    assert evaluate(spark, values, codes.canonical_code) == [
        "123", "123", "123", "-9", "A12", "7", "0", "", "12345678901234567890123",
    ]


def test_keys_and_labels(spark):
    df = spark.createDataFrame([("1", "a/b:c"), ("1", None), (None, "x")], "c string, n string")
    keys = df.select(codes.account_key(F.col("c"), F.col("n")).alias("k"))
    assert [r.k for r in keys.collect()] == ["1_a/b:c", "1_", "_x"]
    assert [r.k for r in keys.select(codes.file_label(F.col("k")).alias("k")).collect()][0] == "1_a_b_c"


def test_posting_date(spark):
    values = ["20230131", "2023-01-31", None, "99999999"]
    fallback = dt.date(2022, 1, 1)
    assert evaluate(spark, values, lambda c: dates.posting_date(c, "yyyyMMdd")) == [
        dt.date(2023, 1, 31), fallback, fallback, fallback,
    ]


def test_fiscal_month(spark):
    days = [dt.date(2023, m, 15) for m in (1, 3, 4, 12)]
    assert evaluate(spark, days, dates.fiscal_month, "v date") == [1, 3, 4, 12]
    april = evaluate(spark, days, lambda c: dates.fiscal_month(c, 4), "v date")
    assert april == [10, 12, 1, 9]


def test_change_ratio(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (5.0, 0.0), (-5.0, 0.0), (5.0, -2.0), (0.0, 3.0), (None, 1.0), (1.0, None)],
        "c double, b double",
    )
    result = [r[0] for r in df.select(ratios.change_ratio(F.col("c"), F.col("b"))).collect()]
    assert result == [0.0, 1.0, 1.0, -2.5, 0.0, None, None]


def test_millions_are_cut_toward_zero(spark):
    values = [Decimal("1999999.99"), Decimal("-1999999.99"), Decimal("-10.00")]
    assert evaluate(spark, values, ratios.whole_millions, "v decimal(18,2)") == [1, -1, 0]
