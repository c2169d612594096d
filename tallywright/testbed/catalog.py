"""Queries over the test ledger, each with its SQL counterpart.

A query runs its operator over the whole tables (or a posting period of them). ``ids``
name the rows of the operator inventory it covers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import amounts, dates, ratios
from tallywright.functions.codes import account_key, canonical_code
from tallywright.operators import (
    checks,
    cleansing,
    corridor as corridors,
    drilldown,
    joins,
    levels,
    mapping,
    monthly as months,
    narrative,
    ranking,
    scoping,
    totals,
)
from tallywright.operators.mapping import KEYIN, MAP, MapRule
from tallywright.plans import prepare, publish, reconciliation
from tallywright.plans.review import review, review_levels
from tallywright.schema import BALANCES, MONEY
from tallywright.session import shared_path, write_through
from tallywright.settings import FS_LINE
from tallywright.sources import readers, tables, writers
from tallywright.streaming.intake import append_new_files, append_rejected_lines, checked_lines, intake_checked
from tallywright.testbed import commerce
from tallywright.testbed.commerce import SETTINGS
from tallywright.testbed.sql import canonical, shape, statement

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    ids: tuple[str, ...]
    run: Run
    sql: str


CATALOG: dict[str, Query] = {}

FS_SETTINGS = replace(SETTINGS, level=FS_LINE)
RATIO_SETTINGS = replace(SETTINGS, ratio_limit=0.2)

#: Columns of results, in the notation of ``sql.shape``.
KEY = "account_code account_name"
LINE = (
    f"{KEY} journal_no line_no:i posting_date year_label fiscal_month:i counterparty line_text "
    "amount:d"
)
TB = f"{KEY} account_key closing:d prior_closing:d prior_same_period:d prior2_closing:d"
SCOPE = f"{KEY} cy:d py:d py1:d change_amount:d change_ratio:d6 threshold:d in_scope"
CORRIDOR = f"{KEY} fiscal_month:i cy:d py:d upper:d2 lower:d2 cy_flag py_flag"
PARTY = f"{KEY} fiscal_month:i counterparty cy:d py:d difference:d abs_difference:d"
LARGE = f"{LINE} month_total:d explain_ratio:d6 contribution:d6 abs_amount:d"
WIDE = f"{KEY} " + " ".join(f"m{m:02d}:d" for m in range(1, 13))


def register(name: str, ids: str, spec: str, sql: str) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        CATALOG[name] = Query(
            tuple(ids.split()), lambda spark, sf: shape(run(spark, sf), spec), statement(spec, sql)
        )
        return run

    return add


# ---------------------------------------------------------------- sources


@register(
    "parquet_glob", "S3", "l_returnflag n:i quantity:d",
    """SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity
    FROM lineitem GROUP BY l_returnflag""",
)
def _(spark, sf):
    # Two files whose columns differ, behind one glob.
    folder, lines = _folder(spark), commerce.table(spark, sf, "lineitem")
    returned = F.col("l_returnflag") == "R"
    lines.filter(returned).select("l_quantity", "l_returnflag").write.parquet(f"{folder}/a.parquet")
    lines.filter(~returned).select("l_returnflag", "l_linestatus", "l_quantity").write.parquet(
        f"{folder}/b.parquet"
    )
    df = readers.read_parquet(
        spark, f"{folder}/*.parquet", ["l_returnflag", "l_quantity"], merge_schema=True
    )
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast(MONEY)).alias("quantity")
    )


@register("column_slice", "S8", "o_orderkey:i o_orderpriority",
          "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, sf):
    return mapping.keep_columns(
        commerce.table(spark, sf, "orders"), ["o_orderkey", "o_orderpriority"]
    )


@register(
    "union_by_name", "S7", "name nation:i balance:d segment",
    """SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
    FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier""",
)
def _(spark, sf):
    customers = commerce.table(spark, sf, "customer").selectExpr(
        "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = commerce.table(spark, sf, "supplier").selectExpr(
        "s_acctbal AS balance", "s_name AS name", "s_nationkey AS nation"
    )
    return readers.union_by_name([customers, suppliers])


@register("trimmed_headers", "S6", "part name brand",
          "SELECT p_partkey AS part, p_name AS name, p_brand AS brand FROM part")
def _(spark, sf):
    parts = commerce.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return mapping.trim_headers(parts.toDF(" part", "name  ", " brand "))


@register(
    "stringified", "S13", "ps_part name size marker",
    """SELECT CAST(p_partkey AS VARCHAR) AS ps_part, p_name AS name, CAST(p_size AS VARCHAR) AS size,
    CASE WHEN p_size > 25 THEN p_brand END AS marker FROM part""",
)
def _(spark, sf):
    parts = commerce.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ps_part"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("marker"),
    )
    return writers.stringify(parts, parts.columns)


@register("format_by_ending", "S14", "c_custkey:i c_name c_mktsegment",
          "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    # Half of the customers as a table, half as text.
    customers = readers.read_extract(spark, f"{sf}/customer.parquet").select(
        "c_custkey", "c_name", "c_mktsegment"
    )
    folder = f"{_folder(spark)}.csv"
    writers.write_text(customers.filter("c_custkey % 2 = 1"), folder, sep=",")
    return customers.filter("c_custkey % 2 = 0").unionByName(readers.read_extract(spark, folder))


# ---------------------------------------------------------------- files
# Round trips through the folder the cluster shares.

ORDERS = "o_orderkey:i o_orderpriority note"
ORDERS_SQL = """SELECT o_orderkey, o_orderpriority,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || chr(9) || '"x"' ELSE o_orderstatus END
    AS note FROM orders"""


def _folder(spark: SparkSession) -> str:
    path = shared_path(spark)
    if path is None:
        raise RuntimeError("this query needs spark.checkpoint.dir")
    return path


def _noted_orders(spark, sf) -> DataFrame:
    """Orders with notes that hold separators and quotes."""
    awkward = F.concat("o_orderpriority", F.lit('\t"x"'))
    return commerce.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", awkward)
        .otherwise(F.col("o_orderstatus"))
        .alias("note"),
    )


@register("text_round_trip", "S1 S5", ORDERS, ORDERS_SQL)
def _(spark, sf):
    folder = _folder(spark)
    writers.write_text(_noted_orders(spark, sf), folder)
    return readers.read_text(spark, folder)


@register("text_intake", "S11", ORDERS, ORDERS_SQL)
def _(spark, sf):
    orders, landing, target = _noted_orders(spark, sf), _folder(spark), _folder(spark)
    writers.write_text(orders.repartition(4), landing)
    append_new_files(
        spark, landing, orders.schema, target, _folder(spark), files_per_chunk=2
    ).awaitTermination()
    return readers.read_parquet(spark, target)


BAD_ORDERS = """SELECT o_orderkey % 10 < 2 AS bad, o_orderkey || '|' || o_orderpriority ||
    CASE o_orderkey % 10 WHEN 0 THEN '|' || o_orderstatus || '|more' WHEN 1 THEN ''
    ELSE '|' || o_orderstatus END AS line FROM orders"""


@register(
    "rejected_lines", "S1 S2 S7 S11", "way part line",
    f"""SELECT way, CASE WHEN bad THEN 'rejected' ELSE 'accepted' END AS part, line
    FROM ({BAD_ORDERS}) CROSS JOIN (VALUES ('batch'), ('intake')) AS w(way)""",
)
def _(spark, sf):
    # Lines with a separator too many or too few, written as they are.
    key, rest = F.col("o_orderkey"), F.concat(F.lit("|"), F.col("o_orderstatus"))
    tail = F.when(key % 10 == 0, F.concat(rest, F.lit("|more"))).when(key % 10 == 1, "").otherwise(rest)
    names = ["o_orderkey", "o_orderpriority", "note"]
    line = F.concat(key.cast("string"), F.lit("|"), F.col("o_orderpriority"), tail)
    folder, kept, bad = _folder(spark), _folder(spark), _folder(spark)
    (
        commerce.table(spark, sf, "orders")
        .select(line.alias("|".join(names)))
        .write.option("header", True).option("sep", "\u0001").option("quote", "").csv(folder)
    )
    options = readers.TextOptions(sep="|", quoting=False, bad_lines=readers.SET_ASIDE)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    for run, target in ((append_new_files, kept), (append_rejected_lines, bad)):
        run(spark, folder, schema, target, _folder(spark), options).awaitTermination()

    def part(df, way, name):
        text = F.concat_ws("|", *names) if name == "accepted" else F.col("line")
        return df.select(F.lit(way).alias("way"), F.lit(name).alias("part"), text.alias("line"))

    files = f"{folder}/*.csv"
    return readers.union_by_name(
        [
            part(readers.read_text_files(spark, files, options), "batch", "accepted"),
            part(readers.rejected_lines(spark, files, options), "batch", "rejected"),
            part(readers.read_parquet(spark, kept), "intake", "accepted"),
            part(readers.read_parquet(spark, bad), "intake", "rejected"),
        ]
    )


@register(
    "checked_intake", "S11 S1 S2", "part line",
    f"""SELECT CASE WHEN bad THEN 'rejected' ELSE 'accepted' END AS part, line FROM ({BAD_ORDERS})""",
)
def _(spark, sf):
    # One run reads each file once and writes accepted and rejected lines of a batch together.
    key, rest = F.col("o_orderkey"), F.concat(F.lit("|"), F.col("o_orderstatus"))
    tail = F.when(key % 10 == 0, F.concat(rest, F.lit("|more"))).when(key % 10 == 1, "").otherwise(rest)
    names = ["o_orderkey", "o_orderpriority", "note"]
    line = F.concat(key.cast("string"), F.lit("|"), F.col("o_orderpriority"), tail)
    folder, root = _folder(spark), _folder(spark)
    (
        commerce.table(spark, sf, "orders")
        .select(line.alias("|".join(names)))
        .repartition(4)
        .write.option("header", True).option("sep", "\u0001").option("quote", "").csv(folder)
    )
    options = readers.TextOptions(sep="|", quoting=False, bad_lines=readers.SET_ASIDE)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    intake_checked(spark, folder, schema, root, _folder(spark), options, files_per_chunk=2).awaitTermination()
    accepted = checked_lines(spark, root).select(F.lit("accepted").alias("part"), F.concat_ws("|", *names).alias("line"))
    rejected = checked_lines(spark, root, "rejected").select(F.lit("rejected").alias("part"), "line")
    return accepted.unionByName(rejected)


@register(
    "titled_text", "S10", "code:i priority",
    "SELECT o_orderkey AS code, o_orderpriority AS priority FROM orders",
)
def _(spark, sf):
    options = readers.TextOptions(sep="|", quoting=False)
    return readers.read_titled_text(spark, _titled_orders(spark, sf), ["code", "priority"], options)


@register(
    "titled_lines", "S10",
    "code:i priority",
    "SELECT o_orderkey AS code, o_orderpriority AS priority FROM orders",
)
def _(spark, sf):
    options = readers.TextOptions(sep="|", quoting=False)
    return readers.read_titled_lines(spark, _titled_orders(spark, sf), ["code", "priority"], options)


def _titled_orders(spark, sf) -> str:
    """Orders in four files: a title, a heading with blanks around its names, then lines."""
    folder, orders = _folder(spark), commerce.table(spark, sf, "orders")
    lines = orders.select(
        F.struct(F.pmod("o_orderkey", F.lit(4)).alias("file"), F.lit(1).alias("place")).alias("at"),
        F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("title"),
    )
    headings = spark.range(4).select(
        F.struct(F.col("id").alias("file"), F.lit(0).alias("place")).alias("at"),
        F.lit(" code | priority").alias("title"),
    )
    (
        lines.unionByName(headings)
        .repartition(4, "at.file")
        .sortWithinPartitions("at.file", "at.place")
        .select("at.file", F.col("title").alias("Orders of all years"))
        .write.partitionBy("file").option("header", True).option("sep", "\u0001")
        .option("quote", "").csv(folder)
    )
    return f"{folder}/file=*/*.csv"


@register(
    "unquoted_text", "S2", "c_custkey:i c_name",
    """SELECT c_custkey, '"' || c_name AS c_name FROM customer""",
)
def _(spark, sf):
    folder = _folder(spark)
    names = commerce.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit('"'), "c_name").alias("c_name")
    )
    names.write.option("sep", "|").option("header", True).option("quote", "").csv(folder)
    options = readers.TextOptions(sep="|", quoting=False)
    return readers.read_text_files(spark, f"{folder}/*.csv", options)


@register(
    "recoded_text", "S9 S1", "o_orderkey:i word",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '완료' WHEN 'O' THEN '똠방'
    ELSE '진행' END AS word FROM orders""",
)
def _(spark, sf):
    korean, folder = _folder(spark), _folder(spark)
    status = F.col("o_orderstatus")
    words = commerce.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "F", "완료").when(status == "O", "똠방").otherwise("진행").alias("word"),
    )
    writers.write_text(words, korean, encoding="cp949")
    options = readers.TextOptions(encoding="cp949")
    writers.recode_text(spark, f"{korean}/*.csv", folder, options)
    return readers.read_text(spark, folder)


@register(
    "recoded_lines", "S9 S5", "line",
    """SELECT o_orderkey || '|"' || o_orderpriority || ' |' ||
        CASE o_orderstatus WHEN 'F' THEN ' 완료' WHEN 'O' THEN '똠방 ' ELSE '"진행' END ||
        CASE WHEN o_orderkey % 7 = 0 THEN '|surplus|' ELSE '' END AS line FROM orders""",
)
def _(spark, sf):
    # Lines with stray quotes, blanks and surplus separators, UTF-8 to cp949 and back.
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    word = F.when(status == "F", " 완료").when(status == "O", "똠방 ").otherwise('"진행')
    tail = F.when(key % 7 == 0, "|surplus|").otherwise("")
    line = F.concat(key.cast("string"), F.lit('|"'), F.col("o_orderpriority"), F.lit(" |"), word, tail)
    plain, korean, back = _folder(spark), _folder(spark), _folder(spark)
    (
        commerce.table(spark, sf, "orders").select(line.alias("key|priority|word")).repartition(3)
        .write.option("header", True).option("sep", "\u0001").option("quote", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(plain)
    )
    options = readers.TextOptions(sep="|", quoting=False)
    writers.recode_lines(spark, f"{plain}/*.csv", korean, options, encoding="cp949")
    writers.recode_lines(spark, f"{korean}/*.csv", back, readers.TextOptions(sep="|", quoting=False, encoding="cp949"))
    return spark.read.text(f"{back}/*.csv").where(F.col("value") != "key|priority|word").select(
        F.col("value").alias("line")
    )


@register("compacted_parquet", "S4", "o_orderkey:i o_custkey:i o_orderstatus",
          "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    many, few = _folder(spark), _folder(spark)
    orders = commerce.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    writers.write_parquet(orders, many, files=12)
    writers.compact(spark, many, few)
    return readers.read_parquet(spark, few)


@register("compacted_in_place", "S4", "o_orderkey:i o_custkey:i o_orderstatus",
          "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    folder = _folder(spark)
    orders = commerce.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    writers.write_parquet(orders, folder, files=12)
    tables.compact_in_place(spark, folder)
    return tables.read_table(spark, folder)


@register("stored_ledger_month", "S4 S3", LINE,
          "SELECT * FROM gl WHERE year_label = 'CY' AND fiscal_month = 5")
def _(spark, sf):
    folder = _folder(spark)
    writers.write_ledger(commerce.ledger(spark, sf), folder)
    return readers.read_parquet(spark, folder).filter("year_label = 'CY' AND fiscal_month = 5")


# ---------------------------------------------------------------- projection and cleansing

RAW_MAP = [
    MapRule(MAP, "BELNR", "journal_no"),
    MapRule(MAP, "BUZEI", "line_no"),
    MapRule(MAP, "HKONT", "account_code"),
    MapRule(MAP, "DMBTR", "amount"),
    MapRule(MAP, "SHKZG", "marker"),
    MapRule(MAP, "BUDAT", "posting_date"),
    MapRule(MAP, "LIFNR", "counterparty"),
    MapRule(MAP, "SGTXT", "line_text"),
    MapRule(KEYIN, "KRW", "currency"),
]


@register(
    "column_map", "P1 P2",
    "journal_no line_no account_code amount marker posting_date counterparty line_text currency",
    """SELECT BELNR AS journal_no, BUZEI AS line_no, HKONT AS account_code, DMBTR AS amount,
    SHKZG AS marker, BUDAT AS posting_date, LIFNR AS counterparty, SGTXT AS line_text,
    'KRW' AS currency FROM raw""",
)
def _(spark, sf):
    return mapping.apply_map(commerce.raw_extract(spark, sf), RAW_MAP)


@register("renamed_columns", "P3 P6", "document item account marker",
          "SELECT BELNR AS document, BUZEI AS item, HKONT AS account, SHKZG AS marker FROM raw")
def _(spark, sf):
    renamed = mapping.rename(
        commerce.raw_extract(spark, sf),
        {"BELNR": "document", "BUZEI": "item", "HKONT": "account", "SHKZG": "marker"},
    )
    return mapping.drop_columns(renamed, "DMBTR", "SGTXT")


@register(
    "account_keys", "P4", "HKONT LIFNR account_key",
    """SELECT HKONT, LIFNR, coalesce(HKONT, '') || '_' || coalesce(LIFNR, '') AS account_key
    FROM raw""",
)
def _(spark, sf):
    return commerce.raw_extract(spark, sf).withColumn(
        "account_key", account_key(F.col("HKONT"), F.col("LIFNR"))
    )


@register(
    "flagged_steps", "P5 C6 C7 C8 C9", f"{KEY} journal_no year_label amount:d debit:d credit:d",
    """SELECT *, 'CY' AS year_label, greatest(amount, 0) AS debit, -least(amount, 0) AS credit
    FROM (SELECT * EXCLUDE (year_label) FROM full_gl)""",
)
def _(spark, sf):
    first = cleansing.apply_flags(
        commerce.full_ledger(spark, sf), {cleansing.STAMP_YEAR, cleansing.SPLIT_AMOUNT}, "CY"
    )
    # Credits made negative add up to the signed amount again; split it once more.
    again = cleansing.apply_flags(
        first.drop("amount"), {cleansing.NEGATE_CREDIT, cleansing.COMPOSE_AMOUNT}
    )
    return cleansing.split_amount(again)


@register("negated_credit", "C6", "journal_no line_no:i credit:d",
          "SELECT journal_no, line_no, least(amount, 0) AS credit FROM full_gl")
def _(spark, sf):
    return cleansing.negate_credit(cleansing.split_amount(commerce.full_ledger(spark, sf)))


@register("default_counterparty", "C1", "BELNR BUZEI counterparty",
          "SELECT BELNR, BUZEI, coalesce(LIFNR, 'NA') AS counterparty FROM raw")
def _(spark, sf):
    raw = commerce.raw_extract(spark, sf).withColumnRenamed("LIFNR", "counterparty")
    return cleansing.default_counterparty(raw)


@register(
    "coerced_amounts", "C2", "BELNR BUZEI amount:d debit:d",
    """SELECT BELNR, BUZEI, CASE WHEN t IS NULL THEN 0 ELSE TRY_CAST(t AS DECIMAL(18,2)) END
    AS amount, coalesce(TRY_CAST(t AS DECIMAL(18,2)), 0) AS debit
    FROM (SELECT *, trim(replace(DMBTR, ',', '')) AS t FROM raw)""",
)
def _(spark, sf):
    plain = F.translate("DMBTR", ",", "")
    raw = commerce.raw_extract(spark, sf).withColumns({"amount": plain, "debit": plain})
    once = cleansing.coerce_amounts(raw, ["amount"])
    return cleansing.coerce_amounts(once, ["debit"], bad_as_zero=True)


_ERP = "replace(trim(coalesce(DMBTR, '0')), ',', '')"


@register(
    "erp_amounts", "C3", "BELNR BUZEI plain:d in_parentheses:d minus_last:d",
    f"""SELECT BELNR, BUZEI,
    CASE WHEN t = '-' THEN 0 ELSE TRY_CAST(t AS DECIMAL(18,2)) END AS plain,
    CASE WHEN t = '-' THEN 0
         ELSE TRY_CAST(replace(replace(t, ')', ''), '(', '-') AS DECIMAL(18,2)) END AS in_parentheses,
    CASE WHEN t = '-' THEN 0 WHEN length(t) > 1 AND t LIKE '%-'
         THEN TRY_CAST('-' || replace(t, '-', '') AS DECIMAL(18,2))
         ELSE TRY_CAST(t AS DECIMAL(18,2)) END AS minus_last
    FROM (SELECT BELNR, BUZEI, {_ERP} AS t FROM raw)""",
)
def _(spark, sf):
    text = F.col("DMBTR")
    return commerce.raw_extract(spark, sf).withColumns(
        {
            "plain": amounts.parse_erp_amount(text),
            "in_parentheses": amounts.parse_erp_amount(text, amounts.PARENTHESES),
            "minus_last": amounts.parse_erp_amount(text, amounts.TRAILING_MINUS),
        }
    )


@register("scaled_amounts", "C4", "journal_no line_no:i amount:d",
          "SELECT journal_no, line_no, amount * 100 AS amount FROM full_gl")
def _(spark, sf):
    ledger = commerce.full_ledger(spark, sf)
    return ledger.withColumn("amount", amounts.scale_hundred(F.col("amount")))


@register(
    "fine_amounts", "C3 C4", "l_orderkey:i l_linenumber:i plain:d changed:b scaled:d",
    """SELECT l_orderkey, l_linenumber, CAST(a AS DECIMAL(18,2)) AS plain,
    CAST(a AS DECIMAL(18,2)) <> a AS changed, CAST(a * 100 AS DECIMAL(18,2)) AS scaled
    FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS a
          FROM lineitem)""",
)
def _(spark, sf):
    # Amounts of four decimals: scaled first and rounded once, they lose nothing.
    exact = F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast("decimal(4,2)")
    lines = commerce.table(spark, sf, "lineitem").withColumn("text", exact.cast("string"))
    parsed = lines.withColumn("amount", amounts.parse_erp_amount(F.col("text")))
    return parsed.withColumns(
        {
            "plain": amounts.settled(F.col("amount")),
            "changed": amounts.changed_by_settling(F.col("amount")),
            "scaled": amounts.settled(amounts.scale_hundred(F.col("amount"))),
        }
    )


@register(
    "signed_by_marker", "C5", "BELNR BUZEI signed:d signed_default:d",
    f"""SELECT BELNR, BUZEI, CASE WHEN SHKZG = 'S' THEN a ELSE -a END AS signed,
    CASE WHEN coalesce(SHKZG, 'S') = 'S' THEN a ELSE -a END AS signed_default
    FROM (SELECT *, CASE WHEN t = '-' THEN 0 ELSE TRY_CAST(t AS DECIMAL(18,2)) END AS a
          FROM (SELECT *, {_ERP} AS t FROM raw))""",
)
def _(spark, sf):
    raw = commerce.raw_extract(spark, sf)
    amount = amounts.parse_erp_amount(F.col("DMBTR"))
    return raw.withColumns(
        {
            "signed": amounts.sign_by_marker(amount, F.col("SHKZG")),
            "signed_default": amounts.sign_by_marker(amount, F.col("SHKZG"), null_is_debit=True),
        }
    )


@register(
    "posting_dates", "C10 C11", "BELNR BUZEI posting_date fiscal_month:i date_defaulted:b",
    """SELECT BELNR, BUZEI, d AS posting_date, month(d) AS fiscal_month, date_defaulted
    FROM (SELECT *, coalesce(try_strptime(BUDAT, '%Y%m%d')::DATE, DATE '2022-01-01') AS d,
                 try_strptime(BUDAT, '%Y%m%d') IS NULL AS date_defaulted FROM raw)""",
)
def _(spark, sf):
    raw = commerce.raw_extract(spark, sf).withColumnRenamed("BUDAT", "posting_date")
    return cleansing.parse_posting_date(raw, "yyyyMMdd")


@register(
    "shifted_fiscal_month", "C11", "journal_no line_no:i posting_date fiscal_month:i",
    "SELECT journal_no, line_no, posting_date, (month(posting_date) + 8) % 12 + 1 AS fiscal_month"
    " FROM full_gl",
)
def _(spark, sf):
    return commerce.full_ledger(spark, sf).withColumn(
        "fiscal_month", dates.fiscal_month(F.col("posting_date"), first_month=4)
    )


@register("canonical_codes", "C12", "BELNR BUZEI HKONT account_code",
          f"SELECT BELNR, BUZEI, HKONT, {canonical('HKONT')} AS account_code FROM raw")
def _(spark, sf):
    raw = commerce.raw_extract(spark, sf).withColumn("account_code", F.col("HKONT"))
    return cleansing.canonical_accounts(raw)


@register("without_echoed_headers", "C13", "BELNR BUZEI BUDAT",
          "SELECT BELNR, BUZEI, BUDAT FROM raw WHERE BUDAT IS DISTINCT FROM 'BUDAT'")
def _(spark, sf):
    return cleansing.drop_echoed_headers(commerce.raw_extract(spark, sf), "BUDAT", "BUDAT")


@register(
    "period_lines", "C14", "l_orderkey:i l_linenumber:i l_shipdate_text",
    """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_text
    FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1999-04-01' AND TIMESTAMP '2000-03-31'""",
)
def _(spark, sf):
    lines = commerce.table(spark, sf, "lineitem")
    return cleansing.period_filter(lines, "1999-04-01", "2000-03-31", "l_shipdate").withColumn(
        "l_shipdate_text", F.date_format("l_shipdate", "yyyy-MM-dd")
    )


@register(
    "period_row_counts", "C14", "rows_inside:i rows_outside:i",
    """SELECT count(*) FILTER (l_shipdate BETWEEN TIMESTAMP '1999-04-01'
                                              AND TIMESTAMP '2000-03-31') AS rows_inside,
    count(*) - rows_inside AS rows_outside FROM lineitem""",
)
def _(spark, sf):
    lines = commerce.table(spark, sf, "lineitem")
    return cleansing.outside_period(lines, "1999-04-01", "2000-03-31", "l_shipdate")


@register("distinct_headers", "C15", "BELNR BLART HDATE BKTXT", "SELECT DISTINCT * FROM headers")
def _(spark, sf):
    return cleansing.distinct_rows(commerce.document_headers(spark, sf))


@register(
    "filled_balances", "C16", f"{KEY} closing:d prior_closing:d",
    """SELECT account_code, account_name, CASE WHEN bs_pl = 'BS' THEN closing ELSE 0 END AS closing,
    CASE WHEN t1 IS NULL THEN 0 ELSE prior_closing END AS prior_closing FROM tb""",
)
def _(spark, sf):
    tb = commerce.trial_balance(spark, sf).withColumns(
        {
            "closing": F.when(F.col("bs_pl") == "BS", F.col("closing")),
            "prior_closing": F.when(F.col("t1").isNotNull(), F.col("prior_closing")),
        }
    )
    return cleansing.fill_balances(tb, ["closing", "prior_closing"])


@register("single_account", "C18", LINE,
          "SELECT * FROM full_gl WHERE account_code = 'Brand#7|PROMO'")
def _(spark, sf):
    return cleansing.account_rows(commerce.full_ledger(spark, sf), "Brand#7|PROMO")


@register("distinct_markers", "C18", "SHKZG", "SELECT DISTINCT SHKZG FROM raw")
def _(spark, sf):
    return cleansing.distinct_values(commerce.raw_extract(spark, sf), "SHKZG")


@register(
    "strict_amounts", "C19", "l_orderkey:i l_linenumber:i amount:d",
    "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem",
)
def _(spark, sf):
    grouped = F.format_number("l_extendedprice", 2)
    return commerce.table(spark, sf, "lineitem").withColumn(
        "amount", amounts.strict_amount(grouped)
    )


# ---------------------------------------------------------------- joins


@register(
    "lines_with_headers", "J1 C15", "BELNR BUZEI DMBTR BLART HDATE BKTXT",
    """SELECT r.BELNR, BUZEI, DMBTR, BLART, HDATE, BKTXT FROM raw r
    LEFT JOIN (SELECT DISTINCT * FROM headers) h ON r.BELNR = h.BELNR""",
)
def _(spark, sf):
    return joins.attach_headers(
        commerce.raw_extract(spark, sf),
        commerce.document_headers(spark, sf),
        ["BELNR"],
        ["BLART", "HDATE", "BKTXT"],
    )


@register(
    "published_lines", "J1 A10 A1", "BELNR BUZEI DMBTR BLART HDATE BKTXT",
    """SELECT r.BELNR, BUZEI, DMBTR, BLART, HDATE, BKTXT FROM raw r
    LEFT JOIN (SELECT DISTINCT * FROM headers) h ON r.BELNR = h.BELNR""",
)
def _(spark, sf):
    # Written, audited by rows and control total in the writing job, then published.
    target = f"{_folder(spark)}/published"
    publish.publish_with_headers(
        commerce.raw_extract(spark, sf),
        commerce.document_headers(spark, sf),
        target,
        ["BELNR"],
        ["BLART", "HDATE", "BKTXT"],
        amount=amounts.parse_erp_amount(F.col("DMBTR")),
    )
    return readers.read_parquet(spark, target)


@register(
    "repeated_headers", "J1 A11", "BELNR row_count:i",
    "SELECT BELNR, count(*) AS row_count FROM headers GROUP BY BELNR HAVING count(*) > 1",
)
def _(spark, sf):
    return checks.repeated_keys(commerce.document_headers(spark, sf), ["BELNR"])


@register(
    "mapped_accounts", "J2 C17", "BELNR BUZEI account_code account_name fs_code fs_name bs_pl",
    f"""SELECT BELNR, BUZEI, r.account_code, m.detail_name AS account_name, m.fs_code, m.fs_name,
    m.bs_pl FROM (SELECT *, {canonical('HKONT')} AS account_code FROM raw) r
    LEFT JOIN account_map m ON r.account_code = m.detail_code""",
)
def _(spark, sf):
    raw = commerce.raw_extract(spark, sf).withColumn("account_code", F.col("HKONT"))
    mapped = joins.attach_account_map(raw, commerce.account_map(spark, sf))
    return cleansing.name_from_map(mapped)


@register(
    "unmapped_accounts", "J3", "account_code",
    f"""SELECT DISTINCT account_code FROM (SELECT {canonical('HKONT')} AS account_code FROM raw)
    ANTI JOIN (SELECT detail_code AS account_code FROM account_map WHERE fs_name IS NOT NULL)
    USING (account_code)""",
)
def _(spark, sf):
    return joins.unmapped_accounts(
        commerce.raw_extract(spark, sf), commerce.account_map(spark, sf), "HKONT"
    )


@register(
    "account_names", "J4", "BELNR BUZEI HKONT account_name",
    f"""SELECT BELNR, BUZEI, r.HKONT, m.detail_name AS account_name
    FROM (SELECT * EXCLUDE (HKONT), {canonical('HKONT')} AS HKONT FROM raw) r
    LEFT JOIN account_map m ON r.HKONT = m.detail_code""",
)
def _(spark, sf):
    return joins.attach_account_names(
        commerce.raw_extract(spark, sf), commerce.account_map(spark, sf), "HKONT"
    )


REPEATED_MAP = f"""SELECT {canonical('detail_code')} AS code, fs_code FROM (
    SELECT s_suppkey::VARCHAR AS detail_code, s_nationkey AS fs_code FROM supplier
    UNION ALL SELECT lpad(s_suppkey::VARCHAR, 9, '0'), s_nationkey FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT s_suppkey::VARCHAR || '.0', -1 FROM supplier WHERE s_suppkey % 5 = 0)"""


@register(
    "repeated_map_codes", "J2 J4", "detail_code row_count:i variants:i",
    f"""SELECT code AS detail_code, count(*) AS row_count, count(DISTINCT fs_code) AS variants
    FROM ({REPEATED_MAP}) GROUP BY code HAVING count(*) > 1""",
)
def _(spark, sf):
    key, line = F.col("s_suppkey"), F.col("s_nationkey").cast("string").alias("fs_code")
    suppliers = commerce.table(spark, sf, "supplier")
    plain = suppliers.select(key.cast("string").alias("detail_code"), line)
    padded = suppliers.filter(key % 3 == 0).select(
        F.lpad(key.cast("string"), 9, "0").alias("detail_code"), line
    )
    other = suppliers.filter(key % 5 == 0).select(
        F.concat(key.cast("string"), F.lit(".0")).alias("detail_code"), F.lit("-1").alias("fs_code")
    )
    return joins.repeated_map_codes(plain.union(padded).union(other))


@register("month_spine", "J5", f"{KEY} fiscal_month:i cy:d py:d", "SELECT * FROM spine")
def _(spark, sf):
    return totals.month_spine(totals.monthly_totals(commerce.ledger(spark, sf)))


@register(
    "movement_beside_balance", "J6", f"{WIDE} closing:d bs_pl",
    "SELECT * FROM moved FULL JOIN tb USING (account_code, account_name)",
)
def _(spark, sf):
    movements = totals.monthly_totals(commerce.ledger(spark, sf))
    return months.join_trial_balance(movements, commerce.trial_balance(spark, sf))


@register(
    "ambiguous_statement_lines", "J7", "fs_code variants:i",
    """SELECT t3 AS fs_code, count(*) AS variants FROM (SELECT DISTINCT t3, fs_name, bs_pl FROM tb)
    GROUP BY t3 HAVING count(*) > 1""",
)
def _(spark, sf):
    # Brands as line codes span several line names, so that there is something to report.
    tb = commerce.trial_balance(spark, sf).withColumn("fs_code", F.col("t3"))
    return checks.ambiguous_fs_codes(tb)


@register(
    "reconciliation", "J8", f"{KEY} year_label tb_amount:d gl_amount:d difference:d status",
    """SELECT *, coalesce(tb_amount, 0) - coalesce(gl_amount, 0) AS difference,
    CASE WHEN gl_amount IS NULL THEN 'tb only' WHEN tb_amount IS NULL THEN 'gl only'
         WHEN tb_amount = gl_amount THEN 'matched' ELSE 'differs' END AS status
    FROM (SELECT replace(account_code, 'Brand#9|', 'Brand#90|') AS account_code, account_name,
                 'CY' AS year_label,
                 closing - CASE WHEN bs_pl = 'BS' THEN prior_closing ELSE 0 END AS tb_amount
          FROM tb
          UNION ALL
          SELECT replace(account_code, 'Brand#9|', 'Brand#90|'), account_name, 'PY',
                 CASE WHEN bs_pl = 'BS' THEN prior_closing - prior2_closing
                      ELSE prior_same_period END FROM tb) t
    FULL JOIN (SELECT CASE WHEN fs_code = 'PROMO' AND line_text = 'F' THEN 'SUSPENSE'
                      ELSE replace(account_code, 'Brand#7|', 'Brand#70|') END AS account_code,
                      account_name, year_label, sum(amount) AS gl_amount FROM gl
               GROUP BY ALL) g
    USING (account_code, account_name, year_label)""",
)
def _(spark, sf):
    # Breaks are planted: lines and accounts that carry another code on one side.
    suspense = (F.col("fs_code") == "PROMO") & (F.col("line_text") == "F")
    moved = F.replace("account_code", F.lit("Brand#7|"), F.lit("Brand#70|"))
    gl = commerce.ledger(spark, sf).withColumn(
        "account_code", F.when(suspense, "SUSPENSE").otherwise(moved)
    )
    tb = commerce.trial_balance(spark, sf).withColumn(
        "account_code", F.replace("account_code", F.lit("Brand#9|"), F.lit("Brand#90|"))
    )
    return reconciliation.reconciliation(tb, gl)


# ---------------------------------------------------------------- aggregations


@register("control_total", "A1", "year_label control_total:d line_count:i",
          "SELECT year_label, sum(amount) AS control_total, count(*) AS line_count FROM full_gl"
          " GROUP BY year_label")
def _(spark, sf):
    return checks.control_total(commerce.full_ledger(spark, sf), ["year_label"])


@register("account_totals", "A2", f"{KEY} amount:d",
          "SELECT account_code, account_name, sum(amount) AS amount FROM full_gl GROUP BY ALL")
def _(spark, sf):
    return totals.account_totals(commerce.full_ledger(spark, sf))


@register(
    "account_year_pivot", "A3", f"{KEY} cy:d py:d",
    """SELECT account_code, account_name, sum(amount) FILTER (year_label = 'CY') AS cy,
    sum(amount) FILTER (year_label = 'PY') AS py FROM gl GROUP BY ALL""",
)
def _(spark, sf):
    return totals.account_year_pivot(commerce.ledger(spark, sf))


@register(
    "account_month_pivot", "A4", f"{KEY} fiscal_month:i cy:d py:d",
    """SELECT account_code, account_name, fiscal_month,
    coalesce(sum(amount) FILTER (year_label = 'CY'), 0) AS cy,
    coalesce(sum(amount) FILTER (year_label = 'PY'), 0) AS py FROM gl GROUP BY ALL""",
)
def _(spark, sf):
    return totals.account_month_pivot(totals.monthly_totals(commerce.ledger(spark, sf)))


@register("counterparty_totals", "A5", PARTY, "SELECT * FROM changes")
def _(spark, sf):
    return totals.counterparty_totals(commerce.ledger(spark, sf))


@register("net_movement", "A6 V10", WIDE, "SELECT * FROM moved")
def _(spark, sf):
    return months.net_movement(totals.monthly_totals(commerce.ledger(spark, sf)))


@register(
    "left_out_lines", "A4 A6", "reason line_count:i amount:d",
    """SELECT CASE WHEN y = 1998 THEN 'no year' WHEN year_label NOT IN ('CY', 'PY') THEN 'other year'
    WHEN line_text = 'F' THEN 'no month' ELSE 'other month' END AS reason,
    count(*) AS line_count, sum(amount) AS amount FROM full_gl
    WHERE y = 1998 OR year_label NOT IN ('CY', 'PY') OR line_text = 'F' OR fiscal_month = 12
    GROUP BY 1""",
)
def _(spark, sf):
    gl = commerce.full_ledger(spark, sf)
    missing = F.when(F.col("line_text") == "F", None)
    return totals.left_out_lines(
        gl.withColumns(
            {
                "year_label": F.when(F.col("year_label") != "Y1998", F.col("year_label")),
                "fiscal_month": missing.when(F.col("fiscal_month") == 12, 13).otherwise(
                    F.col("fiscal_month")
                ),
            }
        )
    )


@register(
    "fs_unmapped", "V14 A7", f"{KEY} closing:d cy:d",
    """SELECT code AS account_code, name AS account_name, closing, cy
    FROM (SELECT CASE WHEN t3 = 'Brand#3' THEN 'UNMAPPED' ELSE fs_code END AS code,
                 CASE WHEN t3 = 'Brand#3' THEN 'not mapped to a line' ELSE fs_name END AS name,
                 sum(closing) AS closing FROM tb GROUP BY ALL)
    FULL JOIN (SELECT CASE WHEN brand = 'Brand#3' THEN 'UNMAPPED' ELSE fs_code END AS code,
                      sum(amount) AS cy FROM gl WHERE year_label = 'CY' GROUP BY ALL)
    USING (code)""",
)
def _(spark, sf):
    def without_line(df):
        return df.withColumn(
            "fs_code", F.when(~F.col("account_code").startswith("Brand#3|"), F.col("fs_code"))
        )

    tb = levels.trial_balance_at_level(without_line(commerce.trial_balance(spark, sf)), FS_LINE)
    gl = levels.ledger_at_level(without_line(commerce.ledger(spark, sf)), FS_LINE)
    cy = totals.account_year_pivot(gl).drop("py")
    return tb.select("account_code", "account_name", "closing").join(
        cy, ["account_code", "account_name"], "full_outer"
    )


@register(
    "statement_line_totals", "A7 J7", "fs_code fs_name bs_pl closing:d prior_closing:d "
    "prior_same_period:d prior2_closing:d", "SELECT * FROM tbfs",
)
def _(spark, sf):
    return levels.statement_line_totals(commerce.trial_balance(spark, sf))


@register("movement_statistics", "A8", f"{KEY} mean:d2 std:d2", "SELECT * FROM moves")
def _(spark, sf):
    return corridors.movement_statistics(totals.monthly_totals(commerce.ledger(spark, sf)))


@register("months_present", "A9 O1", "fiscal_month:i",
          "SELECT DISTINCT fiscal_month FROM gl WHERE year_label = 'CY'")
def _(spark, sf):
    return totals.months_present(commerce.ledger(spark, sf))


@register(
    "row_counts", "A10", "stage row_count:i",
    """SELECT 'lines' AS stage, count(*) AS row_count FROM raw
    UNION ALL SELECT 'headers', count(*) FROM headers
    UNION ALL SELECT 'joined', count(*) FROM raw r
      LEFT JOIN (SELECT DISTINCT * FROM headers) h ON r.BELNR = h.BELNR""",
)
def _(spark, sf):
    lines, headers = commerce.raw_extract(spark, sf), commerce.document_headers(spark, sf)
    joined = joins.attach_headers(lines, headers, ["BELNR"])
    return checks.row_counts({"lines": lines, "headers": headers, "joined": joined})


@register("repeated_accounts", "A11", "account_name row_count:i",
          "SELECT fs_name AS account_name, count(*) AS row_count FROM tb GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    tb = commerce.trial_balance(spark, sf).withColumn("account_name", F.col("fs_name"))
    return checks.repeated_keys(tb, ["account_name"])


@register("accounts_in_scope", "A12", f"{KEY} account_key",
          "SELECT DISTINCT account_code, account_name, account_key FROM scoped WHERE in_scope = 'O'")
def _(spark, sf):
    tb = scoping.comparative_columns(commerce.trial_balance(spark, sf))
    return scoping.accounts_in_scope(scoping.scope(tb, SETTINGS))


# ---------------------------------------------------------------- windows and rankings


@register("counterparty_ranks", "W1", f"{PARTY} rank:i", "SELECT * FROM ranked")
def _(spark, sf):
    parties = totals.counterparty_totals(commerce.ledger(spark, sf))
    return ranking.rank_all(parties, drilldown.MONTH, "abs_difference")


def _stored_totals(gl: DataFrame) -> DataFrame:
    """Month totals, stored: their size is then known when the join with all lines is planned."""
    return write_through(drilldown.month_totals(totals.monthly_totals(gl)))


@register("month_total_per_line", "W2", f"{LINE} month_total:d", "SELECT * FROM totalled")
def _(spark, sf):
    gl = commerce.ledger(spark, sf)
    return drilldown.with_month_total(gl, _stored_totals(gl))


def _contributing(spark, sf):
    gl = commerce.ledger(spark, sf)
    return drilldown.contributing_lines(gl, _stored_totals(gl), SETTINGS)


@register("contributing_lines", "W3", LARGE, "SELECT * FROM large")
def _(spark, sf):
    return _contributing(spark, sf)


@register("top_lines", "W4", f"{LARGE} rank:i", "SELECT * FROM top_large")
def _(spark, sf):
    return drilldown.top_lines(write_through(_contributing(spark, sf)), SETTINGS)


@register(
    "top_counterparty", "W5", f"{PARTY} rank:i",
    """SELECT * FROM ranked QUALIFY row_number() OVER (
    PARTITION BY account_code, account_name, fiscal_month
    ORDER BY abs_difference DESC, counterparty) = 1""",
)
def _(spark, sf):
    parties = totals.counterparty_totals(commerce.ledger(spark, sf))
    ranked = ranking.rank_all(parties, drilldown.MONTH, "abs_difference")
    return drilldown.top_counterparty(ranked)


@register(
    "top_line", "W6", LARGE,
    """SELECT * FROM top_large QUALIFY row_number() OVER (
    PARTITION BY account_code, account_name, fiscal_month
    ORDER BY abs_amount DESC, year_label, journal_no, line_no, posting_date, counterparty,
             line_text, amount DESC) = 1""",
)
def _(spark, sf):
    lines = write_through(_contributing(spark, sf))
    return drilldown.top_line(drilldown.top_lines(lines, SETTINGS))


@register(
    "running_balance", "W7 O1", f"{KEY} fiscal_month:i movement:d balance:d",
    """SELECT account_code, account_name, fiscal_month, amount AS movement,
    CASE WHEN bs_pl = 'BS' THEN py ELSE 0 END + sum(amount) OVER (
       PARTITION BY account_code, account_name ORDER BY fiscal_month) AS balance
    FROM monthly JOIN compared USING (account_code, account_name) WHERE year_label = 'CY'""",
)
def _(spark, sf):
    movements = totals.monthly_totals(commerce.ledger(spark, sf))
    tb = scoping.comparative_columns(commerce.trial_balance(spark, sf))
    return months.running_balance(movements, tb)


@register("tier_totals", "W8 V5",
          f"{KEY} t1 t2 t1_change:d t2_change:d t1_explain_ratio:d6 t2_explain_ratio:d6",
          "SELECT * FROM explained")
def _(spark, sf):
    # Stored, as the tier totals read it again and here it stands for a scan of all lines.
    tb = write_through(commerce.trial_balance(spark, sf))
    return scoping.explain_tiers(scoping.scope(scoping.comparative_columns(tb), SETTINGS))


# ---------------------------------------------------------------- review measures


@register("comparative_balances", "V1", f"{KEY} bs_pl cy:d py:d py1:d", "SELECT * FROM compared")
def _(spark, sf):
    return scoping.comparative_columns(commerce.trial_balance(spark, sf))


@register("change_measures", "V2", f"{KEY} change_amount:d change_ratio:d6",
          "SELECT * FROM changed")
def _(spark, sf):
    return scoping.change_columns(scoping.comparative_columns(commerce.trial_balance(spark, sf)))


@register("scope", "V3 V4", SCOPE, "SELECT * FROM scoped")
def _(spark, sf):
    return scoping.scope(
        scoping.comparative_columns(commerce.trial_balance(spark, sf)), SETTINGS
    )


@register("scope_with_ratio_limit", "V4", SCOPE, "SELECT * FROM scoped20")
def _(spark, sf):
    return scoping.scope(
        scoping.comparative_columns(commerce.trial_balance(spark, sf)), RATIO_SETTINGS
    )


def _corridor(spark, sf):
    return corridors.corridor(totals.monthly_totals(commerce.ledger(spark, sf)), SETTINGS)


@register("corridor", "V6 A8 J5", CORRIDOR, "SELECT * FROM corridor")
def _(spark, sf):
    return _corridor(spark, sf)


@register("abnormal_months", "V7", f"{KEY} fiscal_month:i", "SELECT * FROM odd")
def _(spark, sf):
    return corridors.abnormal_months(_corridor(spark, sf))


@register("counterparty_drilldown", "V8", f"{PARTY} rank:i", "SELECT * FROM odd_parties")
def _(spark, sf):
    corridor_rows = write_through(_corridor(spark, sf))
    return drilldown.counterparty_drilldown(commerce.ledger(spark, sf), corridor_rows)


def _stored_line_drilldown(gl, corridor_rows, settings):
    """As in a review: the contributing lines are stored, so the ledger is read once."""
    totals_of = corridors.abnormal_month_totals(corridor_rows)
    lines = drilldown.contributing_lines(gl, totals_of, settings)
    return drilldown.top_lines(write_through(lines), settings)


@register("line_drilldown", "V9", f"{LARGE} rank:i", "SELECT * FROM odd_lines")
def _(spark, sf):
    corridor_rows = write_through(_corridor(spark, sf))
    return _stored_line_drilldown(commerce.ledger(spark, sf), corridor_rows, SETTINGS)


_RUNNING = ", ".join(
    "CASE WHEN bs_pl = 'BS' THEN py ELSE 0 END"
    + "".join(f" + coalesce(m{k:02d}, 0)" for k in range(1, m + 1))
    + f" AS b{m:02d}"
    for m in range(1, 13)
)


@register(
    "balance_report", "V11",
    f"{WIDE} account_key t1 t2 t3 t4 control_reliance risk_level change_amount:d "
    "change_ratio:d6 threshold:d in_scope py:d cy:d roll_diff:d",
    "SELECT * EXCLUDE (py, m01, m02, m03, m04, m05, m06, m07, m08, m09, m10, m11, m12), "
    + ", ".join(f"b{m:02d} AS m{m:02d}" for m in range(1, 13))
    + f""", CASE WHEN bs_pl = 'BS' THEN py ELSE 0 END AS py, cy - b12 AS roll_diff
    FROM (SELECT *, {_RUNNING} FROM moved FULL JOIN scoped USING (account_code, account_name))""",
)
def _(spark, sf):
    movements = totals.monthly_totals(commerce.ledger(spark, sf))
    tb = scoping.comparative_columns(commerce.trial_balance(spark, sf))
    return months.balance_report(movements, scoping.scope(tb, SETTINGS))


_CLOSING = range(1, 17)
_CLOSING_PERIOD = "CASE WHEN fiscal_month = 12 AND amount < 0 THEN 13 + (line_no - 1) % 4 ELSE fiscal_month END"
_CLOSING_RUNNING = ", ".join(
    "CASE WHEN bs_pl = 'BS' THEN py ELSE 0 END"
    + "".join(f" + coalesce(m{k:02d}, 0)" for k in range(1, m + 1))
    + f" AS b{m:02d}"
    for m in _CLOSING
)


@register(
    "special_periods", "A6 V11 W7",
    f"{KEY} " + " ".join(f"m{m:02d}:d" for m in _CLOSING)
    + " account_key t1 t2 t3 t4 control_reliance risk_level change_amount:d "
    "change_ratio:d6 threshold:d in_scope py:d cy:d roll_diff:d",
    "SELECT * EXCLUDE (py, " + ", ".join(f"m{m:02d}" for m in _CLOSING) + "), "
    + ", ".join(f"b{m:02d} AS m{m:02d}" for m in _CLOSING)
    + f""", CASE WHEN bs_pl = 'BS' THEN py ELSE 0 END AS py, cy - b16 AS roll_diff
    FROM (SELECT *, {_CLOSING_RUNNING}
          FROM (SELECT account_code, account_name, """
    + ", ".join(f"sum(CASE WHEN period = {m} THEN amount ELSE 0 END) AS m{m:02d}" for m in _CLOSING)
    + f"""
                FROM (SELECT account_code, account_name, amount, {_CLOSING_PERIOD} AS period
                      FROM gl WHERE year_label = 'CY')
                GROUP BY account_code, account_name) AS periods
          FULL JOIN scoped USING (account_code, account_name))""",
)
def _(spark, sf):
    movements = totals.monthly_totals(commerce.closing_ledger(spark, sf), last_period=16)
    tb = scoping.comparative_columns(commerce.trial_balance(spark, sf))
    return months.period_balance_report(movements, scoping.scope(tb, SETTINGS))


def _review(spark, sf, settings=SETTINGS):
    return review(commerce.ledger(spark, sf), commerce.trial_balance(spark, sf), settings)


@register("explanations", "V12 W5 W6", f"{KEY} month_count:i explanation", "SELECT * FROM texts")
def _(spark, sf):
    return _review(spark, sf).explanations


LEAD = (
    f"{KEY} account_key t1 t2 t3 t4 control_reliance risk_level cy:d py:d py1:d change_amount:d "
    "change_ratio:d6 threshold:d in_scope t1_explain_ratio:d6 t2_explain_ratio:d6 explanation "
    "report_ref"
)


def _lead_sql(suffix: str, level: str) -> str:
    return f"""SELECT e.*, t.explanation, CASE WHEN in_scope = 'O' THEN
    'review_demo_' || translate(e.account_key, '/:<>', '____') || '_{level}' END AS report_ref
    FROM explained{suffix} e LEFT JOIN (SELECT account_code, account_name, explanation
    FROM texts{suffix}) t USING (account_code, account_name)"""


@register("lead_schedule", "V13 O3", LEAD, _lead_sql("", "detail"))
def _(spark, sf):
    return _review(spark, sf).lead


# ---------------------------------------------------------------- statement-line level


def _fs_ledger(spark, sf):
    return levels.ledger_at_level(commerce.ledger(spark, sf), FS_LINE)


def _fs_corridor(spark, sf):
    return corridors.corridor(totals.monthly_totals(_fs_ledger(spark, sf)), FS_SETTINGS)


def _fs_trial_balance(spark, sf):
    return levels.trial_balance_at_level(commerce.trial_balance(spark, sf), FS_LINE)


@register("fs_trial_balance", "V14 A7", f"{TB} bs_pl t1 t2 t3 t4 control_reliance risk_level",
          "SELECT * FROM tbfs")
def _(spark, sf):
    return _fs_trial_balance(spark, sf)


@register("fs_scope", "V14", SCOPE, "SELECT * FROM scopedfs")
def _(spark, sf):
    return scoping.scope(scoping.comparative_columns(_fs_trial_balance(spark, sf)), FS_SETTINGS)


@register("fs_corridor", "V14", CORRIDOR, "SELECT * FROM corridorfs")
def _(spark, sf):
    return _fs_corridor(spark, sf)


@register("fs_counterparty_drilldown", "V14", f"{PARTY} rank:i", "SELECT * FROM odd_partiesfs")
def _(spark, sf):
    corridor_rows = write_through(_fs_corridor(spark, sf))
    return drilldown.counterparty_drilldown(_fs_ledger(spark, sf), corridor_rows)


@register("fs_line_drilldown", "V14", f"{LARGE} rank:i", "SELECT * FROM odd_linesfs")
def _(spark, sf):
    corridor_rows = write_through(_fs_corridor(spark, sf))
    return _stored_line_drilldown(_fs_ledger(spark, sf), corridor_rows, FS_SETTINGS)


@register("fs_lead_schedule", "V14 V13", LEAD, _lead_sql("fs", "fs_line"))
def _(spark, sf):
    return _review(spark, sf, FS_SETTINGS).lead


@register(
    "review_levels", "V14 V13",
    f"level {LEAD}",
    f"""SELECT 'detail' AS level, * FROM ({_lead_sql("", "detail")})
    UNION ALL SELECT 'fs_line' AS level, * FROM ({_lead_sql("fs", "fs_line")})""",
)
def _(spark, sf):
    detail, lines = review_levels(commerce.ledger(spark, sf), commerce.trial_balance(spark, sf), SETTINGS)
    return detail.lead.withColumn("level", F.lit("detail")).unionByName(lines.lead.withColumn("level", F.lit("fs_line")))


# ---------------------------------------------------------------- whole preparation


@register(
    "joined_years", "O2", "year_label line_count:i amount:d",
    "SELECT year_label, count(*) AS line_count, sum(amount) AS amount FROM gl GROUP BY year_label",
)
def _(spark, sf):
    gl = commerce.ledger(spark, sf)
    current, prior = (gl.filter(F.col("year_label") == label) for label in ("CY", "PY"))
    return checks.control_total(prepare.join_years(current, prior), ["year_label"]).withColumn(
        "amount", F.col("control_total")
    )


def _erp_step(mapped: DataFrame) -> DataFrame:
    """Client step of the raw extract: ERP amounts, signed by marker."""
    amount = amounts.parse_erp_amount(F.col("amount"), amounts.TRAILING_MINUS)
    return cleansing.drop_echoed_headers(mapped, "posting_date", "BUDAT").withColumn(
        "amount", amounts.sign_by_marker(amount, F.col("marker"), null_is_debit=True)
    )


@register(
    "prepared_ledger", "U1 P1 P5 C1 C2 C10 C12 C17 J2 P4",
    "journal_no line_no:i posting_date year_label fiscal_month:i counterparty line_text amount:d "
    "debit:d credit:d account_code account_name account_key fs_code fs_name bs_pl",
    f"""SELECT *, month(posting_date) AS fiscal_month,
      CASE WHEN amount > 0 THEN amount ELSE 0 END AS debit,
      CASE WHEN amount < 0 THEN -amount ELSE 0 END AS credit,
      account_code || '_' || account_name AS account_key
    FROM (SELECT BELNR AS journal_no, BUZEI AS line_no, SGTXT AS line_text, 'CY' AS year_label,
      coalesce(try_strptime(BUDAT, '%Y%m%d')::DATE, DATE '2022-01-01') AS posting_date,
      coalesce(LIFNR, 'NA') AS counterparty, c.account_code,
      coalesce(m.detail_name, '') AS account_name, m.fs_code, m.fs_name, m.bs_pl,
      coalesce(CASE WHEN coalesce(SHKZG, 'S') = 'S' THEN a ELSE -a END, 0) AS amount
      FROM (SELECT *, {canonical('HKONT')} AS account_code, CASE WHEN t = '-' THEN 0
              WHEN length(t) > 1 AND t LIKE '%-'
              THEN TRY_CAST('-' || replace(t, '-', '') AS DECIMAL(18,2))
              ELSE TRY_CAST(t AS DECIMAL(18,2)) END AS a
            FROM (SELECT *, {_ERP} AS t FROM raw WHERE BUDAT IS DISTINCT FROM 'BUDAT')) c
      LEFT JOIN account_map m ON c.account_code = m.detail_code)""",
)
def _(spark, sf):
    return _prepared(spark, sf).rows


def _prepared(spark, sf):
    rules = prepare.LedgerRules(
        date_pattern="yyyyMMdd",
        flags={cleansing.STAMP_YEAR, cleansing.SPLIT_AMOUNT, cleansing.NAME_FROM_MAP},
        year_label="CY",
        client_step=_erp_step,
    )
    return prepare.prepare_ledger(
        commerce.raw_extract(spark, sf), RAW_MAP, commerce.account_map(spark, sf), rules
    )


@register(
    "prepared_checks", "U1 A1 A10 J3",
    "line_count:i defaulted_dates:i unreadable_amounts:i changed_amounts:i control_total:d unmapped:i",
    f"""SELECT count(*) AS line_count,
      count(*) FILTER (try_strptime(BUDAT, '%Y%m%d') IS NULL) AS defaulted_dates,
      0 AS unreadable_amounts, 0 AS changed_amounts,
      sum(coalesce(CASE WHEN coalesce(SHKZG, 'S') = 'S' THEN a ELSE -a END, 0)) AS control_total,
      (SELECT count(*) FROM (SELECT DISTINCT r.code FROM
         (SELECT {canonical('HKONT')} AS code FROM raw WHERE BUDAT IS DISTINCT FROM 'BUDAT') r
         LEFT JOIN account_map m ON r.code = m.detail_code WHERE m.fs_name IS NULL)) AS unmapped
    FROM (SELECT *, CASE WHEN t = '-' THEN 0
            WHEN length(t) > 1 AND t LIKE '%-' THEN TRY_CAST('-' || replace(t, '-', '') AS DECIMAL(18,2))
            ELSE TRY_CAST(t AS DECIMAL(18,2)) END AS a
          FROM (SELECT *, {_ERP} AS t FROM raw WHERE BUDAT IS DISTINCT FROM 'BUDAT'))""",
)
def _(spark, sf):
    # The ledger is written once; its counts come with that job, the rest from the written table.
    prepared, folder = _prepared(spark, sf), _folder(spark)
    writers.write_ledger(prepared.rows, folder)
    unmapped = prepare.unmapped_in(readers.read_parquet(spark, folder))
    seen = {name: F.lit(value).alias(name) for name, value in prepared.seen.get.items()}
    return unmapped.agg(F.count(F.lit(1)).alias("unmapped")).select(*seen.values(), "unmapped")


@register(
    "prepared_trial_balance", "U1 P1 C16 J2 V1",
    f"{TB} bs_pl fs_code fs_name t1 cy:d py:d py1:d",
    """SELECT CAST(c_nationkey AS VARCHAR) AS account_code, c_mktsegment AS account_name,
      account_code || '_' || account_name AS account_key, closing, closing AS cy,
      0 AS prior_closing, prior_same_period, prior2_closing, prior2_closing AS py1,
      CASE WHEN m.bs_pl = 'BS' THEN 0 ELSE prior_same_period END AS py, m.bs_pl, m.fs_code,
      m.fs_name, 'all' AS t1
    FROM (SELECT c_nationkey, c_mktsegment, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS closing,
                 max(CAST(c_acctbal AS DECIMAL(18,2))) AS prior_same_period,
                 min(CAST(c_acctbal AS DECIMAL(18,2))) AS prior2_closing
          FROM customer GROUP BY ALL) c
    LEFT JOIN account_map m ON CAST(c.c_nationkey AS VARCHAR) = m.detail_code""",
)
def _(spark, sf):
    balance = F.col("c_acctbal").cast(MONEY)
    raw = (
        commerce.table(spark, sf, "customer")
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(
            F.sum(balance).cast("string").alias("end"),
            F.max(balance).cast("string").alias("same period"),
            F.min(balance).cast("string").alias("two years ago"),
        )
        .withColumn("start", F.lit(None).cast("string"))
    )
    column_map = [
        MapRule(MAP, "c_nationkey", "account_code"),
        MapRule(MAP, "c_mktsegment", "account_name"),
        *(
            MapRule(MAP, name, balance_name)
            for name, balance_name in zip(("end", "start", "same period", "two years ago"), BALANCES)
        ),
        MapRule(KEYIN, "all", "t1"),
    ]
    return prepare.prepare_trial_balance(raw, column_map, commerce.account_map(spark, sf)).rows


@register(
    "millions", "V12", "journal_no line_no:i millions:i",
    "SELECT journal_no, line_no, CAST(trunc(amount * 100 / 1000000) AS BIGINT) AS millions FROM full_gl",
)
def _(spark, sf):
    return commerce.full_ledger(spark, sf).withColumn(
        "millions", ratios.whole_millions(F.col("amount") * 100)
    )


@register(
    "report_names", "V13", f"{KEY} report_ref",
    """SELECT account_code, account_name,
    'review_demo_' || account_key || '_detail' AS report_ref FROM tb""",
)
def _(spark, sf):
    return commerce.trial_balance(spark, sf).withColumn(
        "report_ref", narrative.report_ref(SETTINGS)
    )


@register("canonical_map", "C12 J2", "detail_code detail_name", "SELECT * FROM account_map")
def _(spark, sf):
    return commerce.account_map(spark, sf).withColumn(
        "detail_code", canonical_code(F.col("detail_code"))
    )
