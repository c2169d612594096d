"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entries  # noqa: E402
from tallywright.operators import drilldown, ranking, totals  # noqa: E402
from tallywright.testbed import commerce  # noqa: E402
from tallywright.testbed.catalog import CATALOG  # noqa: E402
from verify import compare, database  # noqa: E402

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")

#: Inventory rows with a query. S12 (a database) has none.
INVENTORY = (
    [f"P{i}" for i in range(1, 7)]
    + [f"C{i}" for i in range(1, 20)]
    + [f"J{i}" for i in range(1, 9)]
    + [f"A{i}" for i in range(1, 13)]
    + [f"W{i}" for i in range(1, 9)]
    + [f"V{i}" for i in range(1, 15)]
    + ["O1", "O2", "O3", "U1"]
    + [f"S{i}" for i in range(1, 15) if i != 12]
)


@pytest.fixture(scope="module")
def con():
    return database(DATA)


#: Queries that find nothing in the smallest tables.
EMPTY_HERE: set[str] = set()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql_without_cross_joins_or_python(spark, con, name):
    df = entries.queries()[name](spark, DATA)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert unwanted not in plan(df)
    problem = compare(df, con, name)
    assert problem == ("no rows" if name in EMPTY_HERE else ""), problem


def test_every_inventory_row_has_a_query():
    covered = {i for query in CATALOG.values() for i in query.ids}
    assert covered == set(INVENTORY)
    assert set(CATALOG) <= set(entries.queries()) and set(CATALOG) <= set(entries.oracle_sql())


def test_entry(spark):
    assert entries.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_period_and_columns_reach_the_scan(spark, capsys):
    totals.monthly_totals(commerce.ledger(spark, DATA)).explain("formatted")
    scan = next(p for p in capsys.readouterr().out.split("\n\n") if "Scan parquet" in p and "lineitem" in p)
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", scan).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed
    schema = scan.split("ReadSchema:")[1]
    assert "l_extendedprice" in schema and "l_suppkey" not in schema and "l_tax" not in schema


def test_lines_are_not_shuffled_to_find_the_top(spark):
    corridor_rows = entries.queries()["corridor"](spark, DATA)
    from tallywright.session import write_through

    gl = commerce.ledger(spark, DATA)
    lines = drilldown.contributing_lines(
        gl, write_through(drilldown.month_totals(totals.monthly_totals(gl))), commerce.SETTINGS
    )
    assert "Exchange hashpartitioning" not in plan(lines)
    text = plan(drilldown.top_lines(lines, commerce.SETTINGS))
    limit = text.index("row_number(), 3, Partial")
    assert text.rindex("Exchange hashpartitioning", 0, limit) < limit
    assert corridor_rows.count() % 12 == 0


def test_ranking_reads_the_ledger_once(spark):
    parties = totals.counterparty_totals(commerce.ledger(spark, DATA))
    text = executed(ranking.rank_all(parties, drilldown.MONTH, "abs_difference"))
    assert len([x for x in text.splitlines() if "FileScan" in x and "lineitem" in x]) == 1
