"""Write, audit, publish: a joined table is published only when rows and control total hold."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallywright.plans.publish import AuditFailed, publish_with_headers


def tables(spark, tmp_path, headers):
    lines = spark.createDataFrame(
        [("1", "1", "10.00"), ("1", "2", "-4.50"), ("2", "1", "7.25"), ("3", "1", None)],
        "journal_no string, line_no string, amount string",
    )
    lines.write.parquet(str(tmp_path / "lines"))
    head = spark.createDataFrame(headers, "journal_no string, kind string")
    return spark.read.parquet(str(tmp_path / "lines")), head


def test_published_when_rows_and_total_hold(spark, tmp_path):
    lines, headers = tables(spark, tmp_path, [("1", "SA"), ("1", "SA"), ("2", "KR")])
    target = str(tmp_path / "out")
    audit = publish_with_headers(lines, headers, target, amount=F.col("amount").cast("decimal(18,2)"))
    assert (audit.rows_in, audit.rows_out, audit.total_in) == (4, 4, Decimal("12.75")) and not audit.recounted
    got = sorted(tuple(r) for r in spark.read.parquet(target).collect())
    assert got == [("1", "1", "10.00", "SA"), ("1", "2", "-4.50", "SA"), ("2", "1", "7.25", "KR"), ("3", "1", None, None)]
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []
    with pytest.raises(FileExistsError):
        publish_with_headers(lines, headers, target)
    again = publish_with_headers(lines, headers.where("kind = 'SA'"), target, replace=True)
    assert again.rows_out == 4 and spark.read.parquet(target).where("kind = 'KR'").count() == 0


def test_differing_repeated_header_publishes_nothing_and_names_the_key(spark, tmp_path):
    lines, headers = tables(spark, tmp_path, [("1", "SA"), ("1", "KR"), ("2", "KR")])
    target = str(tmp_path / "out")
    with pytest.raises(AuditFailed, match=r"4 lines went in and 6 rows came out.*\('1',\)"):
        publish_with_headers(lines, headers, target, amount="amount")
    assert not Path(target).exists()
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []


def test_lines_are_read_once(spark, tmp_path):
    lines, headers = tables(spark, tmp_path, [("1", "SA")])
    jobs = []
    listener_group = "publish-once"
    context = spark.sparkContext
    context.setJobGroup(listener_group, "publish")
    try:
        publish_with_headers(lines, headers, str(tmp_path / "out"), amount="amount")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = tracker.getJobIdsForGroup(listener_group)
    # The write and nothing else: no count, no second pass for the audit.
    names = {tracker.getStageInfo(s).name for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    assert all("parquet" in n or "Completable" in n or "withThreadLocalCaptured" in n for n in names), names
