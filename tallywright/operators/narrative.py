"""Explanations in words and the lead schedule that carries them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.codes import account_key, file_label
from tallywright.functions.ratios import whole_millions
from tallywright.operators.corridor import abnormal_months
from tallywright.operators.drilldown import top_counterparty, top_line
from tallywright.schema import ACCOUNT
from tallywright.settings import Settings


@dataclass(frozen=True)
class Wording:
    """Text blocks of an explanation; fields in braces are filled in."""

    nothing: str = "{account}: no month moved unusually in either year; no detail was reviewed."
    heading: str = "{account}: movements to explain."
    months: str = "(1) Months outside the usual range: {months} ({count} in all)."
    counterparties: str = "(2) Counterparty that changed most against the prior year: {items}."
    lines: str = "(3) Largest journal line: {items}."
    counterparty_item: str = "month {month}, {counterparty}, {millions}m"
    line_item: str = (
        "{year} month {month}, journal {journal}, {counterparty}, {millions}m, '{text}'"
    )
    separator: str = "; "
    month_separator: str = ", "
    paragraph: str = "\n"


def fill(template: str, **parts: Column) -> Column:
    """``template`` with its braces replaced by columns; null counts as empty text."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        pieces += [F.lit(text), F.coalesce(parts[field].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def _joined(items: DataFrame, item: Column, separator: str, name: str) -> DataFrame:
    """Items of an account in month order, as one text; at most 12 per account."""
    ordered = F.array_sort(F.collect_list(F.struct("fiscal_month", item.alias("item"))))
    return items.groupBy(*ACCOUNT).agg(
        F.array_join(F.transform(ordered, lambda x: x["item"]), separator).alias(name)
    )


def month_texts(corridor_rows: DataFrame, wording: Wording) -> DataFrame:
    """Abnormal months of an account as text, and their number."""
    months = F.array_sort(F.collect_list("fiscal_month"))
    return (
        abnormal_months(corridor_rows)
        .groupBy(*ACCOUNT)
        .agg(months.alias("_months"))
        .select(
            *ACCOUNT,
            F.array_join(F.col("_months").cast("array<string>"), wording.month_separator).alias(
                "month_list"
            ),
            F.size("_months").alias("month_count"),
        )
    )


def explanations(
    accounts: DataFrame,
    corridor_rows: DataFrame,
    ranked_counterparties: DataFrame,
    ranked_lines: DataFrame,
    wording: Wording = Wording(),
) -> DataFrame:
    """One explanation per account in ``accounts``."""
    w = wording
    parties = _joined(
        top_counterparty(ranked_counterparties),
        fill(
            w.counterparty_item,
            month=F.col("fiscal_month"),
            counterparty=F.col("counterparty"),
            millions=whole_millions(F.col("difference")),
        ),
        w.separator,
        "counterparty_items",
    )
    lines = _joined(
        top_line(ranked_lines),
        fill(
            w.line_item,
            year=F.col("year_label"),
            month=F.col("fiscal_month"),
            journal=F.col("journal_no"),
            counterparty=F.col("counterparty"),
            millions=whole_millions(F.col("amount")),
            text=F.col("line_text"),
        ),
        w.separator,
        "line_items",
    )
    key = account_key(F.col("account_code"), F.col("account_name"))
    text = F.when(F.col("month_count").isNull(), fill(w.nothing, account=key)).otherwise(
        F.concat_ws(
            w.paragraph,
            fill(w.heading, account=key),
            fill(w.months, months=F.col("month_list"), count=F.col("month_count")),
            fill(w.counterparties, items=F.col("counterparty_items")),
            fill(w.lines, items=F.col("line_items")),
        )
    )
    return (
        accounts.select(*ACCOUNT)
        .distinct()
        .join(month_texts(corridor_rows, w), ACCOUNT, "left")
        .join(parties, ACCOUNT, "left")
        .join(lines, ACCOUNT, "left")
        .select(
            *ACCOUNT,
            F.coalesce("month_count", F.lit(0)).alias("month_count"),
            text.alias("explanation"),
        )
    )


def report_ref(settings: Settings) -> Column:
    """Name under which the account's detail report is filed."""
    key = account_key(F.col("account_code"), F.col("account_name"))
    return F.concat_ws(
        "_", F.lit("review"), F.lit(settings.client_label), file_label(key), F.lit(settings.level)
    )


def lead_schedule(explained_tb: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """All trial-balance rows; accounts in scope carry explanation and report reference."""
    chosen = F.col("in_scope") == "O"
    return (
        explained_tb.join(texts.select(*ACCOUNT, "explanation"), ACCOUNT, "left")
        .withColumn("explanation", F.when(chosen, F.col("explanation")))
        .withColumn("report_ref", F.when(chosen, report_ref(settings)))
    )
