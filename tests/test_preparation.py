from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.operators import checks, cleansing, joins, mapping
from tallywright.operators.mapping import KEYIN, MAP, MapRule
from tallywright.plans.prepare import LedgerRules, join_years, prepare_ledger, prepare_trial_balance
from tallywright.schema import ACCOUNT_MAP, LEDGER, conform
from helpers import records


@pytest.fixture(scope="module")
def account_map(spark):
    rows = [
        ("100.0", "cash", "10", "liquid", "BS"),
        ("0200", "sales", "40", "revenue", "PL"),
        ("300", "odd", None, None, "PL"),
    ]
    return spark.createDataFrame(rows, ACCOUNT_MAP)


def test_apply_map(spark):
    df = spark.createDataFrame([("1", "x")], ["a.b", "c d"])
    rules = [MapRule(MAP, "a.b", "code"), MapRule(MAP, "c d", "name"), MapRule(KEYIN, "CY", "year")]
    out = mapping.apply_map(df, rules)
    assert out.columns == ["code", "name", "year"]
    assert records(out) == [("1", "x", "CY")]


def test_apply_map_last_rule_wins_and_missing_columns_are_named(spark):
    df = spark.createDataFrame([("1", "2")], ["a", "b"])
    rules = [MapRule(MAP, "a", "x"), MapRule(KEYIN, "k", "x"), MapRule(MAP, "b", "x")]
    assert records(mapping.apply_map(df, rules)) == [("k",)]
    with pytest.raises(ValueError, match="nope"):
        mapping.apply_map(df, [MapRule(MAP, "nope", "x")])


def test_rules_and_flags_from_tables(spark):
    table = spark.createDataFrame(
        [("MAP", "a", "x"), ("KEYIN", "CY", "y"), ("note", "z", "z")], ["how", "from", "to"]
    )
    assert mapping.rules_from(table, "how", "from", "to") == [
        MapRule(MAP, "a", "x"), MapRule(KEYIN, "CY", "y"),
    ]
    flags = spark.createDataFrame([("split_amount", "O"), ("stamp_year", None)], ["f", "c"])
    assert mapping.flags_from(flags) == {"split_amount"}


def test_rename_trim_drop(spark):
    df = spark.createDataFrame([(1, 2)], [" a ", "b"])
    trimmed = mapping.trim_headers(df)
    assert trimmed.columns == ["a", "b"]
    assert mapping.rename(trimmed, {"a": "c"}).columns == ["c", "b"]
    assert mapping.drop_columns(trimmed, "a").columns == ["b"]
    with pytest.raises(ValueError):
        mapping.rename(trimmed, {"zz": "c"})


def test_amount_steps(spark):
    df = spark.createDataFrame(
        [(Decimal(5),), (Decimal(-3),), (Decimal(0),), (None,)], "amount decimal(18,2)"
    )
    split = cleansing.split_amount(df)
    assert records(split, "debit", "credit") == [(0.0, 0.0), (0.0, 0.0), (0.0, 3.0), (5.0, 0.0)]
    back = cleansing.compose_amount(cleansing.negate_credit(split.na.drop().drop("amount")))
    assert records(back, "amount") == [(-3.0,), (0.0,), (5.0,)]


def test_flags_need_known_names_and_a_year(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    with pytest.raises(ValueError):
        cleansing.apply_flags(df, {"stamp_year"})
    with pytest.raises(ValueError):
        cleansing.apply_flags(df, {"unknown"})


def test_numeric_columns_are_not_reparsed(spark):
    df = spark.createDataFrame([(1.5, None), (None, "2")], "amount double, debit string")
    out = cleansing.coerce_amounts(df)
    assert records(out) == [(0.0, 2.0), (1.5, 0.0)]


def test_echoed_headers_and_period(spark):
    df = spark.createDataFrame([("BLDAT",), ("2023-01-01",), (None,)], "d string")
    assert records(cleansing.drop_echoed_headers(df, "d", "BLDAT")) == [("2023-01-01",), (None,)]
    days = df.select(F.expr("try_to_date(d)").alias("posting_date"))
    assert cleansing.period_filter(days, "2023-01-01", "2023-12-31").count() == 1
    assert records(cleansing.outside_period(days, "2023-01-01", "2023-12-31")) == [(1, 2)]


def test_defaulted_dates_are_marked(spark):
    df = spark.createDataFrame([("20230415",), ("bad",)], "posting_date string")
    out = cleansing.parse_posting_date(df, "yyyyMMdd", "2020-05-01", first_month=4)
    assert records(out.select("fiscal_month", "date_defaulted")) == [(1, False), (2, True)]


def test_account_map_join(spark, account_map):
    gl = spark.createDataFrame([("100",), ("200",), ("300",), ("999",), (None,)], "account_code string")
    mapped = joins.attach_account_map(gl, account_map)
    assert records(mapped, "account_code", "detail_name", "fs_name") == [
        ("0", None, None),
        ("100", "cash", "liquid"),
        ("200", "sales", "revenue"),
        ("300", "odd", None),
        ("999", None, None),
    ]
    assert records(joins.unmapped_accounts(gl, account_map)) == [("0",), ("300",), ("999",)]
    named = joins.attach_account_names(gl, account_map)
    assert ("100", "cash") in records(named, "account_code", "account_name")


def test_headers_join(spark):
    lines = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "doc string, item string")
    headers = spark.createDataFrame([("1", "SA"), ("1", "SA"), ("3", "KR")], "doc string, kind string")
    joined = joins.attach_headers(lines, headers, ["doc"])
    assert records(joined, "doc", "item", "kind") == [
        ("1", "a", "SA"), ("1", "b", "SA"), ("2", "c", None),
    ]
    assert records(checks.repeated_keys(headers, ["doc"])) == [("1", 2)]


def test_headers_that_differ_multiply_lines(spark):
    lines = spark.createDataFrame([("1", "a")], "doc string, item string")
    headers = spark.createDataFrame([("1", "SA"), ("1", "KR")], "doc string, kind string")
    assert joins.attach_headers(lines, headers, ["doc"]).count() == 2


def test_prepare_ledger(spark, account_map):
    raw = spark.createDataFrame(
        [
            ("1", "0100", "cash", "20230105", "10", None),
            ("2", "200.0", "sales", "bad", "-4", "V1"),
            ("3", "999", None, "20230301", "junk", "V2"),
        ],
        "doc string, code string, name string, day string, amt string, cp string",
    )
    rules = [
        MapRule(MAP, "doc", "journal_no"),
        MapRule(MAP, "code", "account_code"),
        MapRule(MAP, "name", "account_name"),
        MapRule(MAP, "day", "posting_date"),
        MapRule(MAP, "amt", "amount"),
        MapRule(MAP, "cp", "counterparty"),
    ]
    seen = []

    def client_step(df):
        seen.append(df.columns)
        return df

    prepared = prepare_ledger(
        raw,
        rules,
        account_map,
        LedgerRules(
            date_pattern="yyyyMMdd",
            flags={"stamp_year", "split_amount", "name_from_map"},
            year_label="CY",
            client_step=client_step,
        ),
    )
    declared = spark.createDataFrame([], LEDGER).dtypes
    assert seen and prepared.rows.dtypes[: len(declared)] == declared
    assert "date_defaulted" in prepared.rows.columns
    assert records(
        prepared.rows, "account_key", "fiscal_month", "counterparty", "amount", "debit", "credit"
    ) == [
        ("100_cash", 1, "NA", 10.0, 10.0, 0.0),
        ("200_sales", 1, "V1", -4.0, 0.0, 4.0),
        ("999_", 3, "V2", None, 0.0, 0.0),
    ]
    assert records(prepared.unmapped) == [("999",)]
    assert records(prepared.defects) == [(3, 1, 1, 0, 6.0)]
    prepared.rows.collect()
    assert prepared.seen.get["line_count"] == 3 and prepared.seen.get["defaulted_dates"] == 1
    both = join_years(prepared.rows, prepared.rows)
    assert both.count() == 6


def test_prepare_trial_balance(spark, account_map):
    raw = spark.createDataFrame(
        [("100", "cash", "5", None, "3", "x"), ("0200", "sales", "7", "1", "2", "")],
        "code string, name string, end string, start string, same string, two string",
    )
    rules = [
        MapRule(MAP, a, b)
        for a, b in zip(
            raw.columns,
            ("account_code", "account_name", "closing", "prior_closing", "prior_same_period",
             "prior2_closing"),
        )
    ]
    tb = prepare_trial_balance(raw, rules, account_map).rows
    assert records(tb, "account_key", "cy", "py", "py1") == [
        ("100_cash", 5.0, 0.0, None), ("200_sales", 7.0, 2.0, None),
    ]


def test_conform_adds_missing_columns(spark):
    df = conform(spark.createDataFrame([("5",)], "amount string"), LEDGER)
    assert df.dtypes == spark.createDataFrame([], LEDGER).dtypes
    assert df.first().amount == Decimal("5.00")


def test_observed_rows(spark):
    observed, seen = checks.observe_rows(spark.range(7), "lines")
    observed.collect()
    assert seen.get == {"row_count": 7}
    assert records(checks.row_counts({"a": spark.range(2), "b": spark.range(0)})) == [("a", 2), ("b", 0)]
