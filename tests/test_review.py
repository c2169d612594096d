from __future__ import annotations

import random
from dataclasses import fields, replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import brute_corridor, ledger, money, records
from tallywright.plans.review import Review, review, review_levels
from tallywright.settings import FS_LINE, Settings

SETTINGS = Settings(pm=1000, ctt=10, client_label="c1")

TB_DDL = (
    "account_code string, account_name string, account_key string, closing decimal(18,2), "
    "prior_closing decimal(18,2), prior_same_period decimal(18,2), prior2_closing decimal(18,2), "
    "bs_pl string, fs_code string, fs_name string, t1 string, t2 string, t3 string, t4 string, "
    "control_reliance string, risk_level string"
)


def books(spark, seed=2):
    rng = random.Random(seed)
    rows = [
        (acct, rng.choice(["CY", "PY"]), rng.randint(1, 12), rng.choice("pqrs"),
         float(rng.choice([rng.randint(-60, 90), 25])))
        for acct in "abcd"
        for _ in range(90)
    ]
    rows += [("a", "CY", 3, "q", 3_500_000.0), ("a", "PY", 9, "p", -2_900_000.0),
             ("c", "CY", 7, "s", 5000.0)]
    gl = ledger(spark, rows).withColumns(
        {"fs_code": F.when(F.col("account_code").isin("a", "b"), "10").otherwise("20"),
         "fs_name": F.lit("line")}
    )
    sums = pd.DataFrame(rows, columns="a y m p v".split()).pivot_table(
        index="a", columns="y", values="v", aggfunc="sum"
    )
    tb = [
        (a, f"name {a}", f"{a}_name {a}", money(cy), money(0), money(py), money(0), "PL",
         "10" if a in "ab" else "20", "line", "T", a, a, a, "r", "l")
        for a, cy, py in sums[["CY", "PY"]].itertuples()
    ]
    tb.append(("quiet", "name quiet", "quiet_name quiet", *map(money, (900, 0, 0, 0)), "PL", "30",
               "other", "T", "q", "q", "q", "r", "l"))
    tb.append(("same", "name same", "same_name same", *map(money, (900, 0, 900, 0)), "PL", "30",
               "other", "T", "q", "q", "q", "r", "l"))
    return rows, gl, spark.createDataFrame(tb, TB_DDL)


def brute(rows, account):
    """Abnormal months, ranked counterparties and ranked lines of one account, by loops."""
    gl = pd.DataFrame(rows, columns="account_code year_label fiscal_month cp amount".split())
    gl["journal"] = [str(i) for i in range(len(gl))]
    frame = brute_corridor(gl, account, 10)
    odd = [r.month for r in frame.itertuples() if "O" in (r.cy_flag, r.py_flag)]
    parties, lines = [], []
    for month in odd:
        mine = gl[(gl.account_code == account) & (gl.fiscal_month == month)]
        by_party = []
        for cp in sorted(set(mine.cp)):
            cy, py = (mine[(mine.cp == cp) & (mine.year_label == y)].amount.sum() for y in ("CY", "PY"))
            by_party.append((month, cp, cy - py))
        for month_, cp, diff in by_party:
            rank = 1 + sum(abs(d) > abs(diff) for _, _, d in by_party)
            parties.append((month_, cp, diff, rank))
        for year in ("CY", "PY"):
            part = mine[mine.year_label == year]
            total = part.amount.sum()
            kept = [
                (r.journal, r.amount, r.cp)
                for r in part.itertuples()
                if (r.amount != 0 if total == 0 else abs(r.amount / total) > 0.1)
            ]
            for journal, amount, cp in kept:
                rank = 1 + sum(abs(a) > abs(amount) for _, a, _ in kept)
                if rank <= 3:
                    lines.append((month, year, journal, amount, cp, rank))
    return odd, parties, lines


def sentence(account, odd, parties, lines):
    key = f"{account}_name {account}"
    if not odd:
        return f"{key}: no month moved unusually in either year; no detail was reviewed."
    best_parties, best_lines = [], []
    for month in odd:
        cp, diff = min(((p, d) for m, p, d, _ in parties if m == month), key=lambda x: (-abs(x[1]), x[0]))
        best_parties.append(f"month {month}, {cp}, {int(diff / 1e6)}m")
        chosen = [r for r in lines if r[0] == month]
        if chosen:
            _, year, journal, amount, cp, _ = min(chosen, key=lambda r: (-abs(r[3]), r[1], r[2]))
            best_lines.append(
                f"{year} month {month}, journal {journal}, {cp}, {int(amount / 1e6)}m, 'text {journal}'"
            )
    return "\n".join([
        f"{key}: movements to explain.",
        f"(1) Months outside the usual range: {', '.join(map(str, odd))} ({len(odd)} in all).",
        f"(2) Counterparty that changed most against the prior year: {'; '.join(best_parties)}.",
        f"(3) Largest journal line: {'; '.join(best_lines)}.",
    ])


@pytest.mark.parametrize("store", [True, False])
def test_review_against_loops(spark, store):
    rows, gl, tb = books(spark)
    result = review(gl, tb, SETTINGS, store=store)
    in_scope = dict(records(result.scope, "account_code", "in_scope"))
    assert in_scope["same"] == "X" and in_scope["a"] == in_scope["quiet"] == "O"

    lead = {r.account_code: r for r in result.lead.collect()}
    assert set(lead) == set(in_scope)
    for account, flag in in_scope.items():
        odd, parties, lines = brute(rows, account) if flag == "O" else ([], [], [])
        mine = F.col("account_code") == account
        assert records(result.abnormal_months.filter(mine), "fiscal_month") == [(m,) for m in odd]
        got = records(result.counterparties.filter(mine), "fiscal_month", "counterparty", "difference", "rank")
        assert got == sorted(parties)
        got = records(
            result.lines.filter(mine),
            "fiscal_month", "year_label", "journal_no", "amount", "counterparty", "rank",
        )
        assert got == sorted(lines)
        row = lead[account]
        if flag == "O":
            assert row.explanation == sentence(account, odd, parties, lines)
            assert row.report_ref == f"review_c1_{account}_name {account}_detail"
        else:
            assert row.explanation is None and row.report_ref is None
    assert result.lead.count() == len(in_scope)
    rolled = records(result.balances.filter("account_code IN ('a', 'b', 'c', 'd')"), "roll_diff")
    assert rolled == [(0.0,)] * 4
    assert result.net_movement.count() == 4


def test_review_of_statement_lines(spark):
    rows, gl, tb = books(spark)
    result = review(gl, tb, replace(SETTINGS, level=FS_LINE), store=False)
    assert records(result.scope, "account_key", "in_scope")[0] == ("10_line", "O")
    merged = [("10" if a in "ab" else "20", y, m, p, v) for a, y, m, p, v in rows]
    odd, parties, lines = brute(merged, "10")
    mine = F.col("account_code") == "10"
    assert odd and records(result.abnormal_months.filter(mine), "fiscal_month") == [(m,) for m in odd]
    assert records(result.lines.filter(mine), "fiscal_month", "year_label", "journal_no", "amount",
                   "counterparty", "rank") == sorted(lines)
    assert result.lead.filter(mine).first().report_ref == "review_c1_10_line_fs_line"


def test_nothing_in_scope_gives_empty_tables(spark, tmp_path):
    _, gl, tb = books(spark)
    result = review(gl, tb, replace(SETTINGS, ctt=10**12), store=False)
    assert result.counterparties.count() == result.lines.count() == result.explanations.count() == 0
    assert result.lead.filter("explanation IS NOT NULL").count() == 0
    result.write(str(tmp_path / "out"))
    for field in fields(Review):
        if field.name == "work_folder":
            continue
        stored = spark.read.parquet(str(tmp_path / "out" / field.name))
        assert stored.columns == getattr(result, field.name).columns


def test_a_review_keeps_its_tables_in_a_folder_and_removes_them(spark, tmp_path):
    _, gl, tb = books(spark)
    with review(gl, tb, SETTINGS, folder=str(tmp_path)) as result:
        assert len(list(tmp_path.iterdir())) == 1 and result.lead.count()
    assert list(tmp_path.iterdir()) == []
    assert review(gl, tb, SETTINGS, store=False).work_folder is None


def test_a_review_without_a_folder_says_so(spark, monkeypatch):
    from tallywright.plans import review as plans

    _, gl, tb = books(spark)
    monkeypatch.setattr(plans, "shared_path", lambda spark: None)
    with pytest.raises(ValueError, match="shared folder"):
        plans.review(gl, tb, SETTINGS)



def _tables(result):
    """Rows of every table; doubles to 6 decimals, as sums in another order differ in the last bit."""
    same = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    return {
        field.name: [same(row) for row in records(getattr(result, field.name))]
        for field in fields(result)
        if field.name != "work_folder"
    }


@pytest.mark.parametrize("null_account", [False, True])
def test_both_levels_equal_two_reviews(spark, tmp_path, null_account):
    _, gl, tb = books(spark)
    if null_account:
        # Lines of account "d" lose their code: they stay one account, matched null-safe.
        gl = gl.withColumn("account_code", F.when(F.col("account_code") != "d", F.col("account_code")))
    detail, lines = review_levels(gl, tb, SETTINGS, folder=str(tmp_path / "both"))
    try:
        for level, result in ((SETTINGS, detail), (replace(SETTINGS, level=FS_LINE), lines)):
            with review(gl, tb, level, folder=str(tmp_path / "one")) as alone:
                assert _tables(result) == _tables(alone)
        assert records(lines.lines) and records(detail.lines)
    finally:
        detail.close()
    assert list((tmp_path / "both").iterdir()) == []


def test_both_levels_of_an_empty_ledger(spark, tmp_path):
    _, gl, tb = books(spark)
    detail, lines = review_levels(gl.limit(0), tb, SETTINGS, folder=str(tmp_path))
    with detail:
        assert detail.lines.count() == lines.lines.count() == 0
        # The trial balance has three statement lines: 10, 20 and 30.
        assert lines.lead.count() == 3 and detail.lead.count() == tb.count()
