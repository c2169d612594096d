from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from helpers import records
from tallywright.sources import tables


def test_pack_keeps_large_files_and_fills_groups():
    assert tables.pack([50, 10, 200, 40, 60, 100], 100) == [[4, 3], [0, 1]]
    assert tables.pack([], 100) == [] and tables.pack([5], 5) == []


def _table(spark, folder, files):
    spark.range(0, 3000, 1, files).withColumn("t", F.concat(F.lit("row "), F.col("id"))).write.parquet(folder)


def test_compaction_in_place_keeps_rows_and_large_files(spark, tmp_path):
    folder = str(tmp_path / "t")
    _table(spark, folder, 12)
    big = str(tmp_path / "big.parquet.dir")
    spark.range(3000, 60000, 1, 1).withColumn("t", F.concat(F.lit("row "), F.col("id"), F.lit("x" * 40))).write.parquet(big)
    name = next(n for n in os.listdir(big) if n.endswith(".parquet"))
    os.rename(os.path.join(big, name), os.path.join(folder, "large.parquet"))
    before = records(tables.read_table(spark, folder))
    sizes = dict(tables.files_of(spark, folder))
    large = next(p for p in sizes if p.endswith("large.parquet"))
    target = max(b for p, b in sizes.items() if p != large) * 5
    assert sizes[large] > target

    during = tables.read_table(spark, folder)
    report = tables.compact_in_place(spark, folder, target)
    assert report == {"rewritten": 12, "kept": 1, "written": 3, "version": 1}
    # A reader that took version 0 before the switch still reads its files.
    assert records(during) == before == records(tables.read_table(spark, folder, 0))
    after = dict(tables.files_of(spark, folder))
    assert large in after and after[large] == sizes[large] and len(after) == 4
    assert records(tables.read_table(spark, folder)) == before
    # Nothing left to pack: the version stays.
    assert tables.compact_in_place(spark, folder, target)["version"] == 1


def test_a_version_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    _table(spark, folder, 4)
    tables._write_manifest(spark, folder, 1, tables.files_of(spark, folder))
    with pytest.raises(RuntimeError, match="version 1"):
        tables._write_manifest(spark, folder, 1, [])
    assert len(tables.files_of(spark, folder, 1)) == 4


def test_empty_folder_has_no_rows(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert tables.files_of(spark, str(tmp_path / "e")) == []
    assert tables.compact_in_place(spark, str(tmp_path / "e"))["written"] == 0
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "e"))
