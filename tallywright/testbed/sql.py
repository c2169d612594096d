"""SQL counterparts of the test ledger and of the shared intermediate results.

The statements work on the same tables as :mod:`tallywright.testbed.commerce` and are
plain relational SQL, written independently of the Spark operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column kinds of a result: text, whole number, number, flag (fixed values).
_KINDS = {
    "s": ("string", "VARCHAR"),
    "i": ("bigint", "BIGINT"),
    "d": ("double", "DOUBLE"),
    "b": ("boolean", "BOOLEAN"),
}

_LEDGER = """
    SELECT CAST(l_orderkey AS VARCHAR) AS journal_no, l_linenumber AS line_no,
           CAST(l_shipdate AS DATE) AS posting_date,
           CASE year(l_shipdate) WHEN 2000 THEN 'CY' WHEN 1999 THEN 'PY'
                ELSE 'Y' || CAST(year(l_shipdate) AS VARCHAR) END AS year_label,
           year(l_shipdate) AS y, month(l_shipdate) AS fiscal_month,
           CAST(l_suppkey AS VARCHAR) AS counterparty, l_linestatus AS line_text,
           CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END
                AS DECIMAL(18,2)) AS amount,
           p_brand || '|' || p_type AS account_code, p_type || ' ' || p_brand AS account_name,
           p_brand || '|' || p_type || '_' || p_type || ' ' || p_brand AS account_key,
           p_type AS fs_code, lower(p_type) AS fs_name,
           CASE WHEN p_type IN ('STANDARD', 'PROMO', 'SMALL') THEN 'BS' ELSE 'PL' END AS bs_pl,
           p_brand AS brand
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _balance(end: int) -> str:
    return (
        f"sum(CASE WHEN y = {end} OR (bs_pl = 'BS' AND y < {end}) THEN amount ELSE 0 END)"
    )


def _analysis(suffix: str) -> list[tuple[str, str]]:
    """Monthly totals to line drill-down over ``gl<suffix>``."""
    s = suffix
    account = "account_code, account_name"
    return [
        (
            f"monthly{s}",
            f"""SELECT {account}, fiscal_month, year_label, sum(amount) AS amount
            FROM gl{s} GROUP BY ALL""",
        ),
        (
            f"spine{s}",
            f"""SELECT a.account_code, a.account_name, m.fiscal_month,
                   coalesce(c.amount, 0) AS cy, coalesce(p.amount, 0) AS py
            FROM (SELECT DISTINCT {account} FROM monthly{s}) a
            CROSS JOIN (SELECT unnest(range(1, 13)) AS fiscal_month) m
            LEFT JOIN monthly{s} c ON c.account_code = a.account_code
                 AND c.account_name = a.account_name AND c.fiscal_month = m.fiscal_month
                 AND c.year_label = 'CY'
            LEFT JOIN monthly{s} p ON p.account_code = a.account_code
                 AND p.account_name = a.account_name AND p.fiscal_month = m.fiscal_month
                 AND p.year_label = 'PY'""",
        ),
        (
            f"moves{s}",
            f"""SELECT {account}, CAST(sum(amount) AS DOUBLE) / count(*) AS mean,
                   coalesce(stddev_samp(CAST(amount AS DOUBLE)), 0) AS std
            FROM monthly{s} WHERE amount <> 0 GROUP BY ALL""",
        ),
        (
            f"bounds{s}",
            f"""SELECT s.*, v.mean + 2 * v.std AS upper, v.mean - 2 * v.std AS lower
            FROM spine{s} s LEFT JOIN moves{s} v USING (account_code, account_name)""",
        ),
        (
            f"corridor{s}",
            f"""SELECT *,
                   CASE WHEN abs(cy) <= 100000 THEN 'X'
                        WHEN CAST(cy AS DOUBLE) < upper AND CAST(cy AS DOUBLE) > lower THEN 'X'
                        ELSE 'O' END AS cy_flag,
                   CASE WHEN abs(py) <= 100000 THEN 'X'
                        WHEN CAST(py AS DOUBLE) < upper AND CAST(py AS DOUBLE) > lower THEN 'X'
                        ELSE 'O' END AS py_flag
            FROM bounds{s}""",
        ),
        (
            f"odd{s}",
            f"""SELECT {account}, fiscal_month FROM corridor{s}
            WHERE cy_flag = 'O' OR py_flag = 'O'""",
        ),
        (
            f"parties{s}",
            f"""SELECT {account}, fiscal_month, counterparty,
                   sum(CASE WHEN year_label = 'CY' THEN amount ELSE 0 END) AS cy,
                   sum(CASE WHEN year_label = 'PY' THEN amount ELSE 0 END) AS py
            FROM gl{s} GROUP BY {account}, fiscal_month, counterparty""",
        ),
        (
            f"changes{s}",
            f"SELECT *, cy - py AS difference, abs(cy - py) AS abs_difference FROM parties{s}",
        ),
        (
            f"ranked{s}",
            f"""SELECT *, rank() OVER (PARTITION BY {account}, fiscal_month
                   ORDER BY abs_difference DESC) AS rank FROM changes{s}""",
        ),
        (
            f"totalled{s}",
            f"""SELECT *, sum(amount) OVER (PARTITION BY {account}, fiscal_month, year_label)
                   AS month_total, abs(amount) AS abs_amount FROM gl{s}""",
        ),
        (
            f"large{s}",
            f"""SELECT *, CASE WHEN month_total <> 0 THEN
                   CAST(amount AS DOUBLE) / CAST(month_total AS DOUBLE) END AS explain_ratio,
                   CASE WHEN month_total <> 0 THEN
                   abs(CAST(amount AS DOUBLE) / CAST(month_total AS DOUBLE)) END AS contribution
            FROM totalled{s}
            WHERE CASE WHEN month_total = 0 THEN amount <> 0
                       ELSE abs(amount) > abs(month_total) * 0.1 END""",
        ),
        (
            f"top_large{s}",
            f"""SELECT * FROM (SELECT *, rank() OVER (
                   PARTITION BY {account}, fiscal_month, year_label ORDER BY abs_amount DESC)
                   AS rank FROM large{s}) WHERE rank <= 3""",
        ),
        (
            f"odd_parties{s}",
            f"""SELECT r.* FROM ranked{s} r
            SEMI JOIN odd{s} o USING (account_code, account_name, fiscal_month)""",
        ),
        (
            f"odd_lines{s}",
            f"""SELECT r.* FROM top_large{s} r
            SEMI JOIN odd{s} o USING (account_code, account_name, fiscal_month)""",
        ),
    ]


def _scoping(tb: str, suffix: str, ratio_limit: float) -> list[tuple[str, str]]:
    s = suffix
    return [
        (
            f"compared{s}",
            f"""SELECT *, closing AS cy,
                   CASE WHEN bs_pl = 'BS' THEN prior_closing ELSE prior_same_period END AS py,
                   prior2_closing AS py1 FROM {tb}""",
        ),
        (
            f"changed{s}",
            f"""SELECT *, cy - py AS change_amount,
                   CASE WHEN cy = 0 AND py = 0 THEN 0 WHEN py = 0 THEN 1
                        ELSE CAST(cy - py AS DOUBLE) / CAST(py AS DOUBLE) END AS change_ratio,
                   least(abs(cy) * 0.2, 2000000 * 0.5) AS threshold
            FROM compared{s}""",
        ),
        (
            f"scoped{s}",
            f"""SELECT *, CASE WHEN abs(change_amount) <= 100000 THEN 'X'
                   WHEN abs(change_amount) >= threshold THEN 'O'
                   WHEN abs(change_ratio) >= {ratio_limit} THEN 'O' ELSE 'X' END AS in_scope
            FROM changed{s}""",
        ),
        (
            f"tiered{s}",
            f"""SELECT *,
                   CASE WHEN t1 IS NOT NULL THEN
                        sum(change_amount) OVER (PARTITION BY t1) END AS t1_change,
                   CASE WHEN t2 IS NOT NULL THEN
                        sum(change_amount) OVER (PARTITION BY t2) END AS t2_change
            FROM scoped{s}""",
        ),
        (
            f"explained{s}",
            f"""SELECT *,
                   CASE WHEN t1_change IS NULL OR t2_change IS NULL THEN NULL
                        WHEN t1_change = 0 AND t2_change = 0 THEN 0 WHEN t1_change = 0 THEN 1
                        ELSE CAST(t2_change AS DOUBLE) / CAST(t1_change AS DOUBLE) END
                        AS t1_explain_ratio,
                   CASE WHEN t2_change IS NULL THEN NULL
                        WHEN t2_change = 0 AND change_amount = 0 THEN 0
                        WHEN t2_change = 0 THEN 1
                        ELSE CAST(change_amount AS DOUBLE) / CAST(t2_change AS DOUBLE) END
                        AS t2_explain_ratio
            FROM tiered{s}""",
        ),
    ]


def _texts(suffix: str) -> list[tuple[str, str]]:
    """Explanations for the accounts of ``scoped<suffix>``, in the default wording."""
    s = suffix
    account = "account_code, account_name"
    millions = "CAST(CAST(trunc({0} / 1000000) AS BIGINT) AS VARCHAR)"
    return [
        (
            f"text_months{s}",
            f"""SELECT {account}, count(*) AS month_count,
                   string_agg(CAST(fiscal_month AS VARCHAR), ', ' ORDER BY fiscal_month)
                   AS months FROM odd{s} GROUP BY ALL""",
        ),
        (
            f"text_parties{s}",
            f"""SELECT {account}, string_agg('month ' || fiscal_month || ', ' || counterparty
                   || ', ' || {millions.format('difference')} || 'm', '; '
                   ORDER BY fiscal_month) AS items
            FROM (SELECT *, row_number() OVER (PARTITION BY {account}, fiscal_month
                         ORDER BY abs_difference DESC, counterparty) AS n FROM odd_parties{s})
            WHERE n = 1 GROUP BY ALL""",
        ),
        (
            f"text_lines{s}",
            f"""SELECT {account}, string_agg(year_label || ' month ' || fiscal_month
                   || ', journal ' || journal_no || ', ' || counterparty || ', '
                   || {millions.format('amount')} || 'm, ''' || line_text || '''', '; '
                   ORDER BY fiscal_month) AS items
            FROM (SELECT *, row_number() OVER (PARTITION BY {account}, fiscal_month
                         ORDER BY abs_amount DESC, year_label, journal_no, line_no, posting_date,
                                  counterparty, line_text, amount DESC) AS n FROM odd_lines{s})
            WHERE n = 1 GROUP BY ALL""",
        ),
        (
            f"texts{s}",
            f"""SELECT account_code, account_name, account_key,
                   coalesce(month_count, 0) AS month_count,
                   CASE WHEN month_count IS NULL THEN account_key ||
                     ': no month moved unusually in either year; no detail was reviewed.'
                   ELSE account_key || ': movements to explain.' || chr(10)
                     || '(1) Months outside the usual range: ' || months || ' ('
                     || month_count || ' in all).' || chr(10)
                     || '(2) Counterparty that changed most against the prior year: '
                     || coalesce(p.items, '') || '.' || chr(10)
                     || '(3) Largest journal line: ' || coalesce(l.items, '') || '.' END
                   AS explanation
            FROM scoped{s}
            LEFT JOIN text_months{s} USING (account_code, account_name)
            LEFT JOIN text_parties{s} p USING (account_code, account_name)
            LEFT JOIN text_lines{s} l USING (account_code, account_name)
            WHERE in_scope = 'O'""",
        ),
    ]


_S = "CAST(l_suppkey AS VARCHAR)"
_PRICE = "format('{:,.2f}', l_extendedprice)"
_CODE = "coalesce(CAST(CAST(trunc(TRY_CAST({0} AS DECIMAL(38,10))) AS BIGINT) AS VARCHAR), {0}, '0')"

#: Named intermediate results, each built on the ones before it.
PARTS: list[tuple[str, str]] = [
    ("full_gl", _LEDGER),
    (
        "gl",
        _LEDGER
        + """ WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2001-01-01'""",
    ),
    (
        "glfs",
        """SELECT * EXCLUDE (account_code, account_name, account_key), fs_code AS account_code,
               fs_name AS account_name, fs_code || '_' || fs_name AS account_key FROM gl""",
    ),
    (
        "tb",
        f"""SELECT account_code, account_name, account_key, fs_code, fs_name, bs_pl,
               {_balance(2000)} AS closing, {_balance(1999)} AS prior_closing,
               sum(CASE WHEN y = 1999 THEN amount ELSE 0 END) AS prior_same_period,
               {_balance(1998)} AS prior2_closing,
               CASE WHEN brand <> 'Brand#5' THEN bs_pl END AS t1, fs_code AS t2, brand AS t3,
               account_code AS t4,
               CASE WHEN bs_pl = 'BS' THEN 'relying' ELSE 'not relying' END AS control_reliance,
               CASE WHEN fs_code = 'PROMO' THEN 'higher' ELSE 'lower' END AS risk_level
        FROM full_gl GROUP BY ALL""",
    ),
    (
        "tbfs",
        """SELECT fs_code AS account_code, fs_name AS account_name,
               fs_code || '_' || fs_name AS account_key, fs_code, fs_name, bs_pl,
               sum(closing) AS closing, sum(prior_closing) AS prior_closing,
               sum(prior_same_period) AS prior_same_period, sum(prior2_closing) AS prior2_closing,
               'T1' AS t1, 'T2' AS t2, 'T3' AS t3, 'T4' AS t4, 'CR' AS control_reliance,
               'RL' AS risk_level
        FROM tb GROUP BY fs_code, fs_name, bs_pl""",
    ),
    *_analysis(""),
    *_analysis("fs"),
    *_scoping("tb", "", 0),
    *_scoping("tb", "20", 0.2),
    *_scoping("tbfs", "fs", 0),
    *_texts(""),
    *_texts("fs"),
    (
        "moved",
        """SELECT account_code, account_name,
               """
        + ", ".join(
            f"sum(CASE WHEN fiscal_month = {m} THEN amount ELSE 0 END) AS m{m:02d}"
            for m in range(1, 13)
        )
        + """
        FROM monthly WHERE year_label = 'CY' GROUP BY account_code, account_name""",
    ),
    (
        "raw",
        f"""SELECT CAST(l_orderkey AS VARCHAR) AS BELNR, CAST(l_linenumber AS VARCHAR) AS BUZEI,
               CASE l_linenumber WHEN 1 THEN lpad({_S}, 10, '0') WHEN 2 THEN {_S} || '.0'
                    WHEN 3 THEN 'V' || {_S} WHEN 4 THEN ' ' || {_S} || ' ' WHEN 5 THEN NULL
                    ELSE {_S} END AS HKONT,
               CASE l_returnflag WHEN 'R' THEN 'H' WHEN 'A' THEN 'S' END AS SHKZG,
               CASE l_linenumber WHEN 1 THEN ' ' || {_PRICE} || ' '
                    WHEN 2 THEN '(' || {_PRICE} || ')' WHEN 3 THEN {_PRICE} || '-'
                    WHEN 4 THEN '-' WHEN 5 THEN NULL WHEN 6 THEN 'x' || {_PRICE}
                    ELSE {_PRICE} END AS DMBTR,
               CASE WHEN l_linenumber = 2 THEN '00000000' WHEN l_linenumber = 3 THEN NULL
                    WHEN l_linenumber = 4 AND l_linestatus = 'F' THEN 'BUDAT'
                    ELSE strftime(l_shipdate, '%Y%m%d') END AS BUDAT,
               CASE WHEN l_linestatus = 'F' THEN {_S} END AS LIFNR, l_linestatus AS SGTXT
        FROM lineitem""",
    ),
    (
        "headers",
        """SELECT CAST(o_orderkey AS VARCHAR) AS BELNR, o_orderstatus AS BLART,
               strftime(o_orderdate, '%Y%m%d') AS HDATE, o_orderpriority AS BKTXT FROM orders
        UNION ALL
        SELECT CAST(o_orderkey AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y%m%d'),
               o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'""",
    ),
    (
        "account_map",
        """SELECT CAST(s_suppkey AS VARCHAR) AS detail_code, s_name AS detail_name,
               CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS fs_code,
               CASE WHEN s_suppkey % 7 <> 0 THEN 'nation ' || s_nationkey END AS fs_name,
               CASE WHEN s_nationkey < 12 THEN 'BS' ELSE 'PL' END AS bs_pl FROM supplier""",
    ),
]


def canonical(expression: str) -> str:
    return _CODE.format(expression)


def _columns(spec: str) -> list[tuple[str, str, int | None]]:
    columns = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        columns.append((name, kind[:1] or "s", int(kind[1:]) if kind[1:] else None))
    return columns


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Result columns of ``df`` in portable types, e.g. ``"code n:i total:d ratio:d4"``."""
    out = []
    for name, kind, digits in _columns(spec):
        value = F.col(name).cast(_KINDS[kind][0])
        out.append((F.round(value, digits) if digits is not None else value).alias(name))
    return df.select(*out)


def statement(spec: str, body: str) -> str:
    """SQL for the same columns, with the named parts that ``body`` needs."""
    needed: list[tuple[str, str]] = []
    text = body
    for name, part in reversed(PARTS):
        if re.search(rf"\b{name}\b", text):
            needed.insert(0, (name, part))
            text += "\n" + part
    select = ", ".join(
        f"round(CAST({name} AS {_KINDS[kind][1]}), {digits}) AS {name}"
        if digits is not None
        else f"CAST({name} AS {_KINDS[kind][1]}) AS {name}"
        for name, kind, digits in _columns(spec)
    )
    ctes = ",\n".join(f"{name} AS ({part})" for name, part in needed)
    prefix = f"WITH {ctes}\n" if ctes else ""
    return f"{prefix}SELECT {select} FROM ({body}) AS result"
