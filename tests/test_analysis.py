from __future__ import annotations

import random
from dataclasses import replace
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import brute_corridor, ledger, money, records
from tallywright.operators import (
    checks,
    corridor as corridors,
    drilldown,
    levels,
    monthly as months,
    narrative,
    ranking,
    scoping,
    totals,
)
from tallywright.plans.reconciliation import reconciliation
from tallywright.schema import TRIAL_BALANCE, conform
from tallywright.settings import FS_LINE, Settings

SETTINGS = Settings(pm=1000, ctt=10)


def trial_balance(spark, rows):
    """Rows of (code, class, closing, prior_closing, prior_same_period, prior2, t1, t2)."""
    full = [
        (c, f"name {c}", f"{c}_name {c}", money(a), money(b), money(d), money(e), k, c[:1],
         f"line {c[:1]}", t1, t2)
        for c, k, a, b, d, e, t1, t2 in rows
    ]
    ddl = (
        "account_code string, account_name string, account_key string, closing decimal(18,2), "
        "prior_closing decimal(18,2), prior_same_period decimal(18,2), "
        "prior2_closing decimal(18,2), bs_pl string, fs_code string, fs_name string, t1 string, "
        "t2 string"
    )
    return conform(spark.createDataFrame(full, ddl), TRIAL_BALANCE)


# ---------------------------------------------------------------- totals and corridor


def test_month_spine_is_complete_and_leaves_other_months_out(spark):
    gl = ledger(spark, [("a", "CY", 3, "p", 5), ("a", "PY", 3, "p", 2), ("a", "CY", 13, "p", 9),
                        ("a", "Y1", 4, "p", 7), ("a", "CY", None, "p", 1)])
    spine = totals.month_spine(totals.monthly_totals(gl))
    rows = records(spine, "fiscal_month", "cy", "py")
    assert rows == [(m, 5.0 if m == 3 else 0.0, 2.0 if m == 3 else 0.0) for m in range(1, 13)]


def test_months_present_ascend(spark):
    gl = ledger(spark, [("a", "CY", m, "p", 1) for m in (12, 2, 7, 2)] + [("a", "PY", 1, "p", 1),
                                                                         ("a", "CY", None, "p", 1)])
    assert [r[0] for r in totals.months_present(gl).collect()] == [2, 7, 12]


def test_year_pivot_keeps_missing_years_null(spark):
    gl = ledger(spark, [("a", "CY", 1, "p", 5), ("b", "PY", 1, "p", 2), ("b", "PY", 2, "p", 1)])
    assert records(totals.account_year_pivot(gl), "account_code", "cy", "py") == [
        ("a", 5.0, None), ("b", None, 3.0),
    ]


def test_corridor_against_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (acct, rng.choice(["CY", "PY"]), rng.randint(1, 12), "p", round(rng.gauss(0, 60), 2))
        for acct in "abcdef"
        for _ in range(40)
    ]
    rows += [("a", "CY", 6, "p", 5000), ("g", "CY", 4, "p", 50), ("h", "CY", 4, "p", 5)]
    rows += [("i", "CY", 1, "p", 0), ("j", "PY", 2, "p", 70), ("j", "PY", 3, "p", 70)]
    gl = pd.DataFrame(rows, columns="account_code year_label fiscal_month cp amount".split())
    result = corridors.corridor(totals.monthly_totals(ledger(spark, rows)), SETTINGS).toPandas()
    assert sorted(set(result.account_code)) == list("abcdefghij")
    for account in "abcdefghij":
        mine = result[result.account_code == account].sort_values("fiscal_month")
        expected = brute_corridor(gl, account, 10)
        assert list(mine.cy_flag) == list(expected.cy_flag), account
        assert list(mine.py_flag) == list(expected.py_flag), account
        assert [float(x) for x in mine.cy] == pytest.approx(list(expected.cy))
        if account == "i":
            assert mine.upper.isna().all()
        else:
            assert list(mine.upper) == pytest.approx(list(expected.upper))
            assert list(mine.lower) == pytest.approx(list(expected.lower))


def test_single_month_sits_on_its_own_bounds_and_is_flagged(spark):
    gl = ledger(spark, [("a", "CY", 4, "p", 50), ("b", "CY", 4, "p", 10)])
    rows = corridors.corridor(totals.monthly_totals(gl), SETTINGS).filter("fiscal_month = 4")
    assert records(rows, "account_code", "upper", "lower", "cy_flag") == [
        ("a", 50.0, 50.0, "O"), ("b", 10.0, 10.0, "X"),
    ]
    assert records(corridors.abnormal_months(rows), "account_code", "fiscal_month") == [("a", 4)]


# ---------------------------------------------------------------- scoping


def test_scope_rules(spark):
    tb = trial_balance(spark, [
        ("zero", "BS", 0, 0, 0, 0, "A", "B"),
        ("new", "BS", 50, 0, 0, 0, "A", "B"),
        ("gone", "BS", 0, 50, 0, 0, "A", "C"),
        ("ctt", "BS", 110, 100, 0, 0, None, "C"),
        ("edge", "BS", 1000, 800, 0, 0, "A", None),
        ("small", "BS", 1000, 900, 0, 0, "A", "C"),
        ("cap", "BS", 9000, 8500, 0, 0, "A", "C"),
        ("under", "BS", 9000, 8501, 0, 0, "A", "C"),
        ("pl", "PL", 30, 999, 60, 7, "P", "Q"),
    ])
    compared = scoping.comparative_columns(tb)
    assert records(compared.filter("account_code = 'pl'"), "cy", "py", "py1") == [(30.0, 60.0, 7.0)]
    default = scoping.scope(compared, SETTINGS)
    flags = dict(records(default, "account_code", "in_scope"))
    assert flags == {"zero": "X", "new": "O", "gone": "O", "ctt": "X", "edge": "O", "small": "O",
                     "cap": "O", "under": "O", "pl": "O"}
    strict = scoping.scope(compared, replace(SETTINGS, ratio_limit=0.2))
    flags = dict(records(strict, "account_code", "in_scope"))
    assert (flags["small"], flags["edge"], flags["cap"], flags["under"]) == ("X", "O", "O", "X")
    ratios = dict(records(default, "account_code", "change_ratio"))
    assert (ratios["zero"], ratios["new"], ratios["gone"]) == (0.0, 1.0, -1.0)
    chosen = scoping.accounts_in_scope(default)
    assert ("gone_name gone",) in records(chosen, "account_key") and chosen.count() == 7


def test_tier_totals_stay_null_for_a_null_tier(spark):
    tb = trial_balance(spark, [
        ("a", "BS", 10, 0, 0, 0, "A", "B"), ("b", "BS", 20, 0, 0, 0, "A", "C"),
        ("c", "BS", 40, 0, 0, 0, None, "C"), ("d", "BS", 5, 0, 0, 0, "D", None),
    ])
    explained = scoping.explain_tiers(scoping.scope(scoping.comparative_columns(tb), SETTINGS))
    assert records(
        explained, "account_code", "t1_change", "t2_change", "t1_explain_ratio", "t2_explain_ratio"
    ) == [
        ("a", 30.0, 10.0, 10 / 30, 1.0),
        ("b", 30.0, 60.0, 2.0, 20 / 60),
        ("c", None, 60.0, None, 40 / 60),
        ("d", 5.0, None, None, None),
    ]


# ---------------------------------------------------------------- ranks and drill-down


def test_rank_all_against_pandas(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice([0, 0, 0, 5, rng.randint(0, 10**12)]) / 100)
            for _ in range(600)]
    rows += [("a", v / 100) for v in (1, 9, 10, 11, 99, 100, 101, 999, 1000, 1001, 1009, 1010)]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank(method="min", ascending=False)
    df = spark.createDataFrame([(g, money(v)) for g, v in rows], "g string, v decimal(28,2)")
    got = records(ranking.rank_all(df, ["g"], "v"), "g", "v", "rank")
    assert got == sorted((g, v, int(r)) for g, v, r in pdf.itertuples(index=False))


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_top_ranks_against_pandas(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice("abcd"), rng.randint(1, 8)) for _ in range(80)] + [("e", 1), ("f", None)]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank(method="min", ascending=False)
    expected = pdf[pdf.r <= limit]
    df = spark.createDataFrame([(g, money(v)) for g, v in rows], "g string, v decimal(18,2)")
    got = records(ranking.top_ranks(df, ["g"], "v", limit), "g", "v", "rank")
    assert got == sorted((g, float(v), int(r)) for g, v, r in expected.itertuples(index=False))


def test_a_flood_of_equal_lines_is_kept_whole(spark):
    df = spark.range(5000).selectExpr("'g' AS g", "CAST(7 AS decimal(18,2)) AS v")
    assert ranking.top_ranks(df, ["g"], "v", 3).filter("rank = 1").count() == 5000
    assert ranking.rank_all(df, ["g"], "v").filter("rank = 1").count() == 5000


def test_contribution_rules(spark):
    gl = ledger(spark, [
        ("a", "CY", 1, "p", 10), ("a", "CY", 1, "q", 90),     # 0.1 exactly: dropped
        ("a", "CY", 2, "p", 50), ("a", "CY", 2, "q", -50), ("a", "CY", 2, "r", 0),  # nets to 0
        ("a", "PY", 1, "p", -30), ("a", "PY", 1, "q", 10),    # -20 in all
    ])
    month_totals = drilldown.month_totals(totals.monthly_totals(gl))
    kept = drilldown.contributing_lines(gl, month_totals, SETTINGS)
    assert records(kept, "year_label", "fiscal_month", "amount", "month_total", "contribution") == [
        ("CY", 1, 90.0, 100.0, 0.9),
        ("CY", 2, -50.0, 0.0, None),
        ("CY", 2, 50.0, 0.0, None),
        ("PY", 1, -30.0, -20.0, 1.5),
        ("PY", 1, 10.0, -20.0, 0.5),
    ]


def test_four_lines_that_share_rank_three_all_stay(spark):
    gl = ledger(spark, [("a", "CY", 1, str(i), v) for i, v in enumerate([50, 40, 20, 20, 20, 20, -90, 11])])
    month_totals = drilldown.month_totals(totals.monthly_totals(gl))
    top = drilldown.top_lines(drilldown.contributing_lines(gl, month_totals, SETTINGS), SETTINGS)
    assert records(top, "amount", "rank") == [(-90.0, 1), (40.0, 3), (50.0, 2)]
    tied = ledger(spark, [("a", "CY", 1, str(i), v) for i, v in enumerate([50, 40, 20, 20, 20, 20])])
    month_totals = drilldown.month_totals(totals.monthly_totals(tied))
    top = drilldown.top_lines(drilldown.contributing_lines(tied, month_totals, SETTINGS), SETTINGS)
    assert records(top, "amount", "rank") == [
        (20.0, 3), (20.0, 3), (20.0, 3), (20.0, 3), (40.0, 2), (50.0, 1),
    ]


def test_first_counterparty_on_ties_is_the_lowest(spark):
    gl = ledger(spark, [("a", "CY", 1, p, v) for p, v in (("z", 9), ("b", -9), ("c", 1))])
    ranked = ranking.rank_all(totals.counterparty_totals(gl), drilldown.MONTH, "abs_difference")
    assert records(drilldown.top_counterparty(ranked), "counterparty", "rank") == [("b", 1)]


def test_drill_down_is_part_of_the_ledger(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["CY", "PY"]), rng.randint(1, 12), rng.choice("pqr"),
             rng.randint(-40, 60)) for _ in range(300)] + [("a", "CY", 5, "p", 4000)]
    gl = ledger(spark, rows)
    rows_of = corridors.corridor(totals.monthly_totals(gl), SETTINGS)
    flagged = {r[:2] for r in records(corridors.abnormal_months(rows_of), "account_code", "fiscal_month")}
    assert ("a", 5) in flagged
    lines = records(drilldown.line_drilldown(gl, rows_of, SETTINGS), "journal_no", "account_code", "fiscal_month")
    assert lines and {(a, m) for _, a, m in lines} <= flagged
    assert all(rows[int(j)][0] == a and rows[int(j)][2] == m for j, a, m in lines)
    parties = records(drilldown.counterparty_drilldown(gl, rows_of), "account_code", "fiscal_month", "cy", "py")
    assert {(a, m) for a, m, _, _ in parties} == flagged
    total = sum(cy + py for _, _, cy, py in parties)
    assert total == sum(v for a, _, m, _, v in rows if (a, m) in flagged)


# ---------------------------------------------------------------- reports and levels


def balances_and_ledger(spark):
    gl = ledger(spark, [("a", "CY", 2, "p", 5), ("a", "CY", 4, "p", 7), ("b", "CY", 1, "p", 3),
                        ("only gl", "CY", 1, "p", 2), ("a", "PY", 2, "p", 50)])
    tb = trial_balance(spark, [("a", "BS", 112, 100, 0, 50, "T", "T"), ("b", "PL", 4, 9, 9, 0, "T", "T"),
                               ("only tb", "BS", 1, 1, 0, 1, "T", "T")])
    return gl, scoping.scope(scoping.comparative_columns(tb), SETTINGS)


def test_balance_report_rolls_forward(spark):
    gl, tb = balances_and_ledger(spark)
    report = months.balance_report(totals.monthly_totals(gl), tb)
    assert records(report, "account_code", "py", "m01", "m03", "m12", "cy", "roll_diff") == [
        ("a", 100.0, 100.0, 105.0, 112.0, 112.0, 0.0),
        ("b", 0.0, 3.0, 3.0, 3.0, 4.0, 1.0),
        ("only gl", 0.0, 2.0, 2.0, 2.0, None, None),
        ("only tb", 1.0, 1.0, 1.0, 1.0, 1.0, 0.0),
    ]


def test_closing_periods_become_columns_when_posted(spark):
    gl = ledger(spark, [("a", "CY", 2, "p", 5), ("a", "CY", 13, "p", -4), ("a", "CY", 15, "p", 2),
                        ("a", "PY", 14, "p", 9), ("b", "CY", 17, "p", 6), ("b", "CY", None, "p", 1)])
    tb = trial_balance(spark, [("a", "PL", 3, 0, 0, 0, "T", "T"), ("b", "PL", 0, 0, 0, 0, "T", "T")])
    tb = scoping.scope(scoping.comparative_columns(tb), SETTINGS)
    monthly = totals.monthly_totals(gl, last_period=16)
    # 14 holds postings of the prior year only, 17 is no period: neither is a column.
    assert months.ledger_periods(monthly) == (*range(1, 13), 13, 15)
    report = months.period_balance_report(monthly, tb)
    assert [c for c in report.columns if c.startswith("m")] == [f"m{m:02d}" for m in (*range(1, 13), 13, 15)]
    assert records(report, "account_code", "m12", "m13", "m15", "cy", "roll_diff") == [
        ("a", 5.0, 1.0, 3.0, 3.0, 0.0), ("b", 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    # The twelve months alone leave the closing postings out of the roll-forward.
    twelve = months.balance_report(monthly, tb)
    assert records(twelve.where("account_code = 'a'"), "m12", "roll_diff") == [(5.0, -2.0)]
    left = records(totals.left_out_lines(gl), "reason", "line_count", "amount")
    assert left == [("no month", 1, 1.0), ("other month", 4, 13.0)]


def test_ledger_without_closing_postings_has_twelve_months(spark):
    gl, tb = balances_and_ledger(spark)
    monthly = totals.monthly_totals(gl, last_period=16)
    assert months.ledger_periods(monthly) == tuple(range(1, 13))
    assert months.period_balance_report(monthly, tb).columns == months.balance_report(monthly, tb).columns
    empty = monthly.limit(0)
    assert months.ledger_periods(empty) == tuple(range(1, 13))
    assert months.period_balance_report(empty, tb).count() == 3


def test_running_balance_in_long_form(spark):
    gl, tb = balances_and_ledger(spark)
    long = months.running_balance(totals.monthly_totals(gl), tb)
    assert records(long, "account_code", "fiscal_month", "movement", "balance") == [
        ("a", 2, 5.0, 105.0), ("a", 4, 7.0, 112.0), ("b", 1, 3.0, 3.0), ("only gl", 1, 2.0, 2.0),
    ]


def test_reconciliation_finds_breaks(spark):
    gl, tb = balances_and_ledger(spark)
    result = reconciliation(tb, gl)
    rows = records(result, "account_code", "year_label", "difference", "status")
    assert rows == [
        ("a", "CY", 0.0, "matched"), ("a", "PY", 0.0, "matched"), ("b", "CY", 1.0, "differs"),
        ("b", "PY", 9.0, "tb only"), ("only gl", "CY", -2.0, "gl only"),
        ("only tb", "CY", 0.0, "tb only"), ("only tb", "PY", 0.0, "tb only"),
    ]
    sums = result.agg(F.sum("difference"), F.sum("tb_amount"), F.sum("gl_amount")).first()
    assert sums[0] == sums[1] - sums[2]


def test_statement_lines(spark):
    tb = trial_balance(spark, [("x1", "BS", 1, 2, 3, 4, "T", "T"), ("x2", "BS", 10, 20, 30, 40, "T", "T"),
                               ("x3", "PL", 5, 5, 5, 5, "T", "T")])
    assert records(checks.ambiguous_fs_codes(tb)) == [("x", 2)]
    lines = levels.trial_balance_at_level(tb, FS_LINE)
    assert records(lines, "account_key", "bs_pl", "closing", "t1", "risk_level") == [
        ("x_line x", "BS", 11.0, "T1", "RL"), ("x_line x", "PL", 5.0, "T1", "RL"),
    ]
    with pytest.raises(ValueError):
        levels.ledger_at_level(tb, "other")


def test_level_switch_of_the_ledger(spark):
    gl = ledger(spark, [("a", "CY", 1, "p", 1)]).withColumns(
        {"fs_code": F.lit("0010"), "fs_name": F.lit("liquid")}
    )
    assert records(levels.ledger_at_level(gl, FS_LINE), "account_key", "amount") == [("10_liquid", 1.0)]


def test_fill_and_wording(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    text = narrative.fill("{one}: [{two}] {one}", one=F.col("a"), two=F.col("b"))
    assert df.select(text.alias("t")).first().t == "x: [] x"


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(pm=1, ctt=1, level="other")
    with pytest.raises(ValueError):
        Settings(pm=1, ctt=1, top_lines=0)
    assert Settings(pm=Decimal("1.5"), ctt=0).z == 2.0
