"""Ledger, trial balance and raw extracts derived from order and part tables.

Every frame reads the given Parquet tables whole, or a posting period of them; period
conditions are plain ranges on the timestamp, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.amounts import sign_by_marker
from tallywright.operators.cleansing import split_amount
from tallywright.operators.mapping import with_account_key
from tallywright.operators.totals import total_or_zero
from tallywright.schema import ACCOUNT, MONEY, TRIAL_BALANCE, conform
from tallywright.settings import Settings

SETTINGS = Settings(pm=2_000_000, ctt=100_000, client_label="demo")

SHEET_TYPES = ("STANDARD", "PROMO", "SMALL")

#: Start of the prior year, start of the current year, end of it.
REVIEW_PERIOD = ("1999-01-01", "2000-01-01", "2001-01-01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def account_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account, statement line and class of each part."""
    kind, brand = F.col("p_type"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws("|", brand, kind).alias("account_code"),
        F.concat_ws(" ", kind, brand).alias("account_name"),
        kind.alias("fs_code"),
        F.lower(kind).alias("fs_name"),
        F.when(kind.isin(*SHEET_TYPES), "BS").otherwise("PL").alias("bs_pl"),
    )


def _ledger(lines: DataFrame, accounts: DataFrame, year_label: Column) -> DataFrame:
    dated = lines.withColumn("posting_date", F.col("l_shipdate").cast("date"))
    price = F.col("l_extendedprice").cast(MONEY)
    marker = F.when(F.col("l_returnflag") == "R", "H").otherwise("S")
    posted = dated.join(accounts, "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("journal_no"),
        F.col("l_linenumber").alias("line_no"),
        "posting_date",
        year_label.alias("year_label"),
        F.month("posting_date").alias("fiscal_month"),
        F.col("l_suppkey").cast("string").alias("counterparty"),
        F.col("l_linestatus").alias("line_text"),
        sign_by_marker(price, marker).alias("amount"),
        *ACCOUNT,
        "fs_code",
        "fs_name",
        "bs_pl",
    )
    return with_account_key(posted)


def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years; those other than the two reviewed carry labels such as ``Y1998``."""
    year = F.year("posting_date")
    label = (
        F.when(year == 2000, "CY")
        .when(year == 1999, "PY")
        .otherwise(F.concat(F.lit("Y"), year.cast("string")))
    )
    return _ledger(
        table(spark, sf_dir, "lineitem"), account_dimension(spark, sf_dir), label
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the current (2000) and the prior year (1999)."""
    prior, current, end = (F.lit(day).cast("timestamp") for day in REVIEW_PERIOD)
    shipped = F.col("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").filter((shipped >= prior) & (shipped < end))
    label = F.when(shipped >= current, "CY").otherwise("PY")
    return _ledger(lines, account_dimension(spark, sf_dir), label)


def closing_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`ledger` with year-end adjustments posted to closing periods.

    Returned lines shipped in December are adjustments of the year's close; they go to the
    periods 13 to 16 by their line number (1 and 5 to 13, 2 and 6 to 14, ...). All other lines
    keep the month of their date.
    """
    gl = ledger(spark, sf_dir)
    adjusted = (F.col("fiscal_month") == 12) & (F.col("amount") < 0)
    return gl.withColumn(
        "fiscal_month",
        F.when(adjusted, (F.lit(13) + F.pmod(F.col("line_no") - 1, F.lit(4))).cast("int")).otherwise(
            F.col("fiscal_month")
        ),
    )


def split_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the two years with debit and credit columns."""
    return split_amount(ledger(spark, sf_dir))


def trial_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances that roll forward from the ledger.

    Balance-sheet accounts accumulate since the first year, P&L accounts hold one year.
    Accounts of one brand have no upper tier.
    """
    gl = full_ledger(spark, sf_dir).withColumn("year", F.year("posting_date"))
    account = [*ACCOUNT, "fs_code", "fs_name", "bs_pl"]
    # One sum per line; the four balances then come from a few rows per account.
    yearly = gl.groupBy(*account, "year").agg(F.sum("amount").alias("amount"))

    def balance(end: int) -> Column:
        year = F.col("year")
        counts = (year == end) | ((F.col("bs_pl") == "BS") & (year < end))
        return total_or_zero(F.when(counts, F.col("amount")))

    totals = yearly.groupBy(*account).agg(
        balance(2000).alias("closing"),
        balance(1999).alias("prior_closing"),
        total_or_zero(F.when(F.col("year") == 1999, F.col("amount"))).alias("prior_same_period"),
        balance(1998).alias("prior2_closing"),
    )
    brand = F.split("account_code", r"\|")[0]
    tiers = {
        "t1": F.when(brand != "Brand#5", F.col("bs_pl")),
        "t2": F.col("fs_code"),
        "t3": brand,
        "t4": F.col("account_code"),
        "control_reliance": F.when(F.col("bs_pl") == "BS", "relying").otherwise("not relying"),
        "risk_level": F.when(F.col("fs_code") == "PROMO", "higher").otherwise("lower"),
    }
    return conform(with_account_key(totals).withColumns(tiers), TRIAL_BALANCE)


def account_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account map of suppliers as accounts; every seventh has no statement line."""
    key = F.col("s_suppkey")
    line = F.col("s_nationkey").cast("string")
    known = key % 7 != 0
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lpad(key.cast("string"), 8, "0"), F.lit(".0")).alias("detail_code"),
        F.col("s_name").alias("detail_name"),
        F.when(known, line).alias("fs_code"),
        F.when(known, F.concat(F.lit("nation "), line)).alias("fs_name"),
        F.when(F.col("s_nationkey") < 12, "BS").otherwise("PL").alias("bs_pl"),
    )


def raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ERP text, with the irregularities such extracts have."""
    n = F.col("l_linenumber")
    price = F.format_number("l_extendedprice", 2)
    supplier = F.col("l_suppkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("BELNR"),
        F.col("l_linenumber").cast("string").alias("BUZEI"),
        F.when(n == 1, F.lpad(supplier, 10, "0"))
        .when(n == 2, F.concat(supplier, F.lit(".0")))
        .when(n == 3, F.concat(F.lit("V"), supplier))
        .when(n == 4, F.concat(F.lit(" "), supplier, F.lit(" ")))
        .when(n == 5, F.lit(None))
        .otherwise(supplier)
        .alias("HKONT"),
        F.when(F.col("l_returnflag") == "R", "H")
        .when(F.col("l_returnflag") == "A", "S")
        .alias("SHKZG"),
        F.when(n == 1, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(n == 2, F.concat(F.lit("("), price, F.lit(")")))
        .when(n == 3, F.concat(price, F.lit("-")))
        .when(n == 4, F.lit("-"))
        .when(n == 5, F.lit(None))
        .when(n == 6, F.concat(F.lit("x"), price))
        .otherwise(price)
        .alias("DMBTR"),
        F.when(n == 2, F.lit("00000000"))
        .when(n == 3, F.lit(None))
        .when((n == 4) & (F.col("l_linestatus") == "F"), F.lit("BUDAT"))
        .otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
        .alias("BUDAT"),
        F.when(F.col("l_linestatus") == "F", supplier).alias("LIFNR"),
        F.col("l_linestatus").alias("SGTXT"),
    )


def document_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document headers of the orders; those of one priority come twice."""
    headers = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("BELNR"),
        F.col("o_orderstatus").alias("BLART"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("HDATE"),
        F.col("o_orderpriority").alias("BKTXT"),
    )
    return headers.unionAll(headers.filter(F.col("BKTXT") == "1-URGENT"))
