"""One-pass intake: accepted and rejected lines of a batch are published together, once."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import types as T

from tallywright.sources.readers import SET_ASIDE, TextOptions
from tallywright.streaming.intake import checked_lines, intake_checked

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("doc", "amount")])
OPTIONS = TextOptions(sep="|", quoting=False, bad_lines=SET_ASIDE)


def landing(tmp_path: Path) -> str:
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.txt").write_text(f"doc|amount\n{i}|1\n{i}|2|extra\n{i}|3\n", encoding="utf-8")
    return str(folder)


def test_cut_off_between_the_two_writes_and_started_again(spark, tmp_path):
    folder, root, progress = landing(tmp_path), str(tmp_path / "out"), str(tmp_path / "progress")
    calls = []

    def fail_once(batch_id: int) -> None:
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("cut off")

    with pytest.raises(Exception, match="cut off"):
        intake_checked(spark, folder, SCHEMA, root, progress, OPTIONS, 2, between=fail_once).awaitTermination()
    # Batch 0 is published whole, batch 1 not at all, while the run is down.
    assert sorted(p.name for p in Path(root).glob("batch=*")) == ["batch=0"]
    assert checked_lines(spark, root).count() == 4 and checked_lines(spark, root, "rejected").count() == 2

    intake_checked(spark, folder, SCHEMA, root, progress, OPTIONS, 2, between=fail_once).awaitTermination()
    accepted, rejected = checked_lines(spark, root), checked_lines(spark, root, "rejected")
    assert accepted.count() == 12 and accepted.distinct().count() == 12
    assert rejected.count() == 6 and sorted(r.line for r in rejected.collect())[0] == "0|2|extra"
    assert accepted.columns == ["doc", "amount"] and rejected.columns == ["file", "line"]


def test_files_are_read_once_per_batch(spark, tmp_path):
    folder, root = landing(tmp_path), str(tmp_path / "out")
    intake_checked(spark, folder, SCHEMA, root, str(tmp_path / "p"), OPTIONS, 6).awaitTermination()
    assert checked_lines(spark, root).count() + checked_lines(spark, root, "rejected").count() == 18
