"""Nothing is lost without a word: maps, text lines, amounts and levels that do not fit."""

from __future__ import annotations

from decimal import Decimal

import pytest
from helpers import ledger, records
from pyspark.sql import functions as F

from tallywright.functions import amounts
from tallywright.operators import joins, levels, mapping, totals
from tallywright.operators.mapping import KEYIN, MAP, MapRule
from tallywright.plans.prepare import LedgerRules, prepare_ledger, unmapped_in
from tallywright.schema import MAP_COLUMNS
from tallywright.settings import FS_LINE
from tallywright.sources import readers
from tallywright.sources.readers import SET_ASIDE, TextOptions


def test_maps_have_no_size_limit_and_no_conflicts(spark):
    many = [("MAP", "a", "x"), ("KEYIN", "KRW", "currency"), ("NOTE", "whatever", "x")] * 4000
    table = spark.createDataFrame(many, "method string, asis string, tobe string")
    assert set(mapping.rules_from(table)) == {MapRule(MAP, "a", "x"), MapRule(KEYIN, "KRW", "currency")}
    assert len(mapping.rules_from(table)) == 2
    conflict = spark.createDataFrame([("MAP", "a", "x"), ("MAP", "b", "x")], table.schema)
    with pytest.raises(ValueError, match="x"):
        mapping.rules_from(conflict)
    flags = spark.createDataFrame([("stamp_year", "O")] * 20_000 + [("other", None)], "flag string, on string")
    assert mapping.flags_from(flags) == {"stamp_year"}


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("123", 1), ("0123", 2), ("9", 3), (None, 4)], "account_code string, n int")


def test_copies_in_an_account_map_count_once(spark, lines):
    rows = [("0123", "cash", "10", "line", "BS"), ("123", "cash", "10", "line", "BS"), (None, "a", "1", "b", "BS"),
            (None, "c", "1", "b", "BS")]
    account_map = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in MAP_COLUMNS))
    assert joins.attach_account_map(lines, account_map).count() == 4
    assert joins.attach_account_names(lines, account_map).count() == 4
    assert records(joins.repeated_map_codes(account_map)) == [("123", 2, 1)]


def test_differing_rows_of_one_account_are_refused(spark, lines):
    rows = [("0123", "cash", "10", "line", "BS"), ("123", "cash", "11", "other", "BS")]
    account_map = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in MAP_COLUMNS))
    with pytest.raises(Exception, match="different rows for 123"):
        joins.attach_account_map(lines, account_map).collect()
    assert records(joins.repeated_map_codes(account_map)) == [("123", 2, 2)]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lines_that_do_not_fit(spark, tmp_path):
    file = write(tmp_path / "a.txt", "doc|item|note\n1|2|fine\n2|6|free|text with pipe\n3|4\n5|6|good\n")
    plain = TextOptions(sep="|")
    for read in (readers.read_text, readers.read_text_files):
        with pytest.raises(Exception, match="too many or too few fields"):
            read(spark, file, plain).collect()
        with pytest.raises(Exception, match="too many or too few fields"):
            read(spark, file, plain, columns=["doc"]).collect()
        apart = read(spark, file, TextOptions(sep="|", bad_lines=SET_ASIDE))
        assert records(apart) == [("1", "2", "fine"), ("5", "6", "good")]
        assert apart.count() == 2 and records(apart, "doc") == [("1",), ("5",)]
    rejected = readers.rejected_lines(spark, file, plain)
    assert rejected.count() == 2 and records(rejected, "line") == [("2|6|free|text with pipe",), ("3|4",)]
    assert all(r.file.endswith("a.txt") for r in rejected.collect())
    with pytest.raises(ValueError, match="bad_lines"):
        TextOptions(bad_lines="ignore")


def test_repeated_and_empty_headings_are_told_apart(spark, tmp_path):
    file = write(tmp_path / "a.txt", "amt|amt||amt\n1|2|3|4\n")
    for read in (readers.read_text, readers.read_text_files):
        df = read(spark, file, TextOptions(sep="|"))
        assert df.columns == ["amt", "amt.1", "_c2", "amt.2"] and records(df.toDF(*"abcd")) == [("1", "2", "3", "4")]


def test_headings_below_a_title(spark, tmp_path):
    file = write(tmp_path / "a.txt", "Title of the year|\n code | name\n1|x\n2|y\n")
    options = TextOptions(sep="|", quoting=False)
    assert records(readers.read_titled_text(spark, file, ["code", "name"], options)) == [("1", "x"), ("2", "y")]
    other = write(tmp_path / "b.txt", "Title|\ncode|title\n1|x\n")
    with pytest.raises(ValueError, match="b.txt"):
        readers.read_titled_text(spark, other, ["code", "name"], options)


def test_amounts_are_rounded_once_and_counted(spark):
    df = spark.createDataFrame([("1.2345",), ("0.004",), ("12",), ("x",), ("9" * 20,)], "t string")
    parsed = df.withColumn("a", amounts.parse_erp_amount(F.col("t")))
    got = parsed.select(
        "t",
        amounts.settled(amounts.scale_hundred(F.col("a"))).alias("scaled"),
        amounts.changed_by_settling(F.col("a")).alias("changed"),
    ).collect()
    assert {r.t: r.scaled for r in got} == {
        "1.2345": Decimal("123.45"), "0.004": Decimal("0.40"), "12": Decimal("1200.00"), "x": None, "9" * 20: None,
    }
    assert {r.t for r in got if r.changed} == {"1.2345", "0.004", "9" * 20}
    for bad in ("1.005", "9" * 20, "x"):
        with pytest.raises(Exception, match="not a number"):
            spark.createDataFrame([(bad,)], "t string").select(amounts.strict_amount(F.col("t"))).collect()


def test_lines_that_month_reports_leave_out(spark):
    gl = ledger(spark, [("a", "CY", 1, "v", 5), ("a", None, 1, "v", 7), ("a", "Y9", 1, "v", 8),
                        ("a", "CY", None, "v", 9), ("a", "PY", 13, "v", 10), ("a", "PY", 13, "v", 1)])
    assert records(totals.left_out_lines(gl)) == [
        ("no month", 1, 9.0), ("no year", 1, 7.0), ("other month", 2, 11.0), ("other year", 1, 8.0),
    ]


def test_unmapped_accounts_have_one_line_on_both_sides(spark):
    gl = ledger(spark, [("a", "CY", 1, "v", 5), ("b", "CY", 1, "v", 7)]).withColumns(
        {"fs_code": F.when(F.col("account_code") == "a", "10"), "fs_name": F.lit("cash"), "bs_pl": F.lit("BS")}
    )
    keyed = levels.ledger_at_level(gl, FS_LINE)
    assert records(keyed, "account_code", "amount") == [("10", 5.0), ("UNMAPPED", 7.0)]


def test_a_ledger_and_its_counts_take_one_scan(spark, tmp_path):
    raw = str(tmp_path / "raw")
    rows = [("1", "100", "1.005", "20220105"), ("2", "200", "4", "bad"), ("3", "999", "x", "20220301")]
    names = "doc string, account string, amt string, day string"
    spark.createDataFrame(rows, names).write.parquet(raw)
    account_map = spark.createDataFrame(
        [("100", "cash", "10", "line", "BS"), ("200", "sales", "20", "line2", "PL")],
        ", ".join(f"{c} string" for c in MAP_COLUMNS),
    )
    pairs = [("doc", "journal_no"), ("account", "account_code"), ("amt", "amount"), ("day", "posting_date"),
             ("doc", "counterparty"), ("day", "own_column")]
    rules = [MapRule(MAP, a, b) for a, b in pairs] + [MapRule(KEYIN, "KRW", "currency")]
    prepared = prepare_ledger(
        spark.read.parquet(raw), rules, account_map,
        LedgerRules(date_pattern="yyyyMMdd", year_label="CY", flags={"stamp_year", "name_from_map"}),
    )
    plan = prepared.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 1
    prepared.rows.write.parquet(str(tmp_path / "out"))
    seen = prepared.seen.get
    assert (seen["line_count"], seen["defaulted_dates"], seen["unreadable_amounts"], seen["changed_amounts"]) == (3, 1, 1, 1)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {"currency", "own_column", "date_defaulted"} <= set(stored.columns)
    assert records(unmapped_in(stored)) == [("999",)]
