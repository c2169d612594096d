"""The review: from ledger and trial balance to the lead schedule."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.corridor import abnormal_month_totals, abnormal_months, corridor
from tallywright.operators.drilldown import (
    contributing_lines,
    counterparty_drilldown,
    top_lines,
)
from tallywright.operators.levels import ledger_at_level, trial_balance_at_level
from tallywright.operators.monthly import balance_report, net_movement
from tallywright.operators.narrative import Wording, explanations, lead_schedule
from tallywright.operators.scoping import (
    accounts_in_scope,
    comparative_columns,
    explain_tiers,
    scope,
)
from tallywright.operators.totals import monthly_totals
from tallywright.schema import ACCOUNT
from tallywright.session import remove_folder, shared_path, together, write_through
from tallywright.settings import DETAIL, FS_LINE, Settings
from tallywright.sources.writers import write_parquet


@dataclass(frozen=True)
class Review:
    """Result tables of one review."""

    scope: DataFrame
    corridor: DataFrame
    abnormal_months: DataFrame
    counterparties: DataFrame
    lines: DataFrame
    net_movement: DataFrame
    balances: DataFrame
    explanations: DataFrame
    lead: DataFrame
    #: Where this review keeps its intermediate tables; :meth:`close` removes it.
    work_folder: str | None = None

    def write(self, folder: str, mode: str = "errorifexists") -> None:
        """Write every table as Parquet under ``folder``."""
        for field in fields(self):
            table = getattr(self, field.name)
            if isinstance(table, DataFrame):
                write_parquet(table, f"{folder}/{field.name}", mode=mode)

    def close(self) -> None:
        """Remove the intermediate tables. The result tables cannot be read afterwards."""
        if self.work_folder is not None:
            remove_folder(self.lead.sparkSession, self.work_folder)

    def __enter__(self) -> Review:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def review(
    gl: DataFrame,
    tb: DataFrame,
    settings: Settings,
    wording: Wording = Wording(),
    store: bool = True,
    folder: str | None = None,
) -> Review:
    """All results for all accounts, at the level the settings name.

    The ledger is read three times: for the monthly totals, for the counterparties and
    for the lines of abnormal months. With ``store`` the intermediate results that several
    tables start from (scope, monthly totals, corridor, contributing lines, drill-downs) are
    written once, to a new folder under ``folder`` or else under the session's
    ``spark.checkpoint.dir``. It must be one that all executors share. ``close()`` on the
    result, or leaving it as a context, removes them. Without ``store`` they are worked out
    per table, which scans the ledger many times.
    """
    spark = gl.sparkSession
    work = f"{folder.rstrip('/')}/{uuid.uuid4().hex}" if folder else shared_path(spark)
    if store and work is None:
        raise ValueError(
            "a review stores intermediate tables: name a shared folder, set spark.checkpoint.dir, "
            "or say store=False to work them out again for each result"
        )
    keep = partial(write_through, folder=work) if store else (lambda df: df)
    ledger = ledger_at_level(gl, settings.level)
    balances = comparative_columns(trial_balance_at_level(tb, settings.level))

    scoped, monthly = together(
        lambda: keep(scope(balances, settings)), lambda: keep(monthly_totals(ledger))
    )
    chosen = accounts_in_scope(scoped)
    months = keep(corridor(monthly, settings).join(chosen.select(*ACCOUNT), ACCOUNT, "left_semi"))

    def counterparties() -> DataFrame:
        return keep(counterparty_drilldown(ledger, months))

    def largest_lines() -> DataFrame:
        large = keep(contributing_lines(ledger, abnormal_month_totals(months), settings))
        return keep(top_lines(large, settings))

    parties, lines = together(counterparties, largest_lines)
    texts = explanations(chosen, months, parties, lines, wording)

    return Review(
        scope=scoped,
        corridor=months,
        abnormal_months=abnormal_months(months),
        counterparties=parties,
        lines=lines,
        net_movement=net_movement(monthly),
        balances=balance_report(monthly, scoped),
        explanations=texts,
        lead=lead_schedule(explain_tiers(scoped), texts, settings),
        work_folder=work if store else None,
    )


#: Columns of a line that the partial totals of :func:`review_levels` keep as keys.
_KEYS = [*ACCOUNT, "fs_code", "fs_name", "bs_pl", "fiscal_month", "year_label", "counterparty"]


def review_levels(
    gl: DataFrame,
    tb: DataFrame,
    settings: Settings,
    wording: Wording = Wording(),
    folder: str | None = None,
) -> tuple[Review, Review]:
    """Reviews at account level and at statement-line level, reading the ledger twice for both.

    The first read sums the lines per account, statement line, period, year and counterparty;
    monthly totals and counterparty drill-downs of both levels are sums of these partial totals,
    so they equal those of :func:`review` on the lines. The second read takes the lines of every
    month that either level finds abnormal, an account's month when its own corridor or that of
    its statement line flags it, matched null-safe; each level's line drill-down starts from
    these. :func:`review` reads the ledger three times for one level.

    Intermediate tables are stored as in :func:`review` (a shared folder is needed) and both
    results share one work folder: closing either removes the tables of both.
    """
    spark = gl.sparkSession
    work = f"{folder.rstrip('/')}/{uuid.uuid4().hex}" if folder else shared_path(spark)
    if work is None:
        raise ValueError("a review stores intermediate tables: name a shared folder or set spark.checkpoint.dir")
    keep = partial(write_through, folder=work)
    keys = [c for c in _KEYS if c in gl.columns]
    partial_totals = keep(gl.groupBy(*keys).agg(F.sum("amount").alias("amount")))

    levels = {DETAIL: replace(settings, level=DETAIL), FS_LINE: replace(settings, level=FS_LINE)}
    names = list(levels)
    totals = {level: ledger_at_level(partial_totals, level) for level in names}

    # The stored steps of the two levels are independent: their jobs run side by side.
    def scoped_of(level: str) -> DataFrame:
        balances = comparative_columns(trial_balance_at_level(tb, level))
        return keep(scope(balances, levels[level]))

    found = together(
        *(partial(scoped_of, level) for level in names),
        *(partial(lambda level: keep(monthly_totals(totals[level])), level) for level in names),
    )
    scoped, monthly = dict(zip(names, found[:2])), dict(zip(names, found[2:]))
    chosen = {level: accounts_in_scope(scoped[level]) for level in names}

    def months_of(level: str) -> DataFrame:
        flagged = corridor(monthly[level], levels[level])
        return keep(flagged.join(chosen[level].select(*ACCOUNT), ACCOUNT, "left_semi"))

    months = dict(zip(names, together(*(partial(months_of, level) for level in names))))

    # Accounts' months to read lines of: flagged at account level, or on the account's line.
    month_keys = [*ACCOUNT, "fiscal_month"]
    own = abnormal_months(months[DETAIL]).select(*month_keys)
    accounts = partial_totals.select(*[c for c in keys if c in (*ACCOUNT, "fs_code", "fs_name", "bs_pl")]).distinct()
    accounts = accounts.withColumns({"detail_code": F.col("account_code"), "detail_name": F.col("account_name")})
    on_line = (
        ledger_at_level(accounts, FS_LINE)
        .join(abnormal_months(months[FS_LINE]).select(*month_keys), ACCOUNT)
        .select(F.col("detail_code").alias("account_code"), F.col("detail_name").alias("account_name"), "fiscal_month")
    )
    wanted = own.union(on_line).distinct()
    lines = keep(gl.join(wanted, [gl[c].eqNullSafe(wanted[c]) for c in month_keys], "left_semi"))

    def parties_of(level: str) -> DataFrame:
        return keep(counterparty_drilldown(totals[level], months[level]))

    def large_of(level: str) -> DataFrame:
        chosen_lines = ledger_at_level(lines, level)
        return keep(contributing_lines(chosen_lines, abnormal_month_totals(months[level]), levels[level]))

    found = together(*(partial(parties_of, level) for level in names), *(partial(large_of, level) for level in names))
    parties, large = dict(zip(names, found[:2])), dict(zip(names, found[2:]))
    tops = together(*(partial(lambda level: keep(top_lines(large[level], levels[level])), level) for level in names))

    reviews = []
    for level, top in zip(names, tops):
        texts = explanations(chosen[level], months[level], parties[level], top, wording)
        reviews.append(
            Review(
                scope=scoped[level],
                corridor=months[level],
                abnormal_months=abnormal_months(months[level]),
                counterparties=parties[level],
                lines=top,
                net_movement=net_movement(monthly[level]),
                balances=balance_report(monthly[level], scoped[level]),
                explanations=texts,
                lead=lead_schedule(explain_tiers(scoped[level]), texts, levels[level]),
                work_folder=work,
            )
        )
    return reviews[0], reviews[1]
