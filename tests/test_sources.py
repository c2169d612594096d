from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import records
from tallywright.sources import readers, writers
from tallywright.sources.readers import TextOptions
from tallywright.streaming.intake import append_new_files


def put(folder: Path, name: str, text: str, encoding: str = "utf-8") -> str:
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def text_of(folder) -> list[str]:
    return sorted(
        line
        for part in Path(folder).glob("part-*")
        for line in part.read_text(encoding="utf-8").splitlines()
    )


def test_text_is_read_as_text_with_trimmed_headings(spark, tmp_path):
    path = put(tmp_path, "a.tsv", " code \tamount\n007\t\"1\t2\"\n\t3\n")
    df = readers.read_text(spark, path)
    assert df.dtypes == [("code", "string"), ("amount", "string")]
    assert records(df) == [("007", "1\t2"), (None, "3")]


def test_quotes_can_be_plain_characters(spark, tmp_path):
    path = put(tmp_path, "a.txt", 'code|text\n1|"half\n2|5" pipe\n')
    df = readers.read_text(spark, path, TextOptions(sep="|", quoting=False))
    assert records(df) == [("1", '"half'), ("2", '5" pipe')]


@pytest.mark.parametrize("name", ["cp949", "CP949", "ms949", "UHC"])
def test_korean_code_page(spark, tmp_path, name):
    # The second word holds syllables that exist only in the extended table.
    path = put(tmp_path, "k.txt", "계정\t금액\n현금\t1\n똠방각하 펲시\t2\n", "cp949")
    df = readers.read_text(spark, path, TextOptions(encoding=name))
    assert df.columns == ["계정", "금액"]
    assert records(df) == [("똠방각하 펲시", "2"), ("현금", "1")]


def test_byte_order_mark_is_dropped(spark, tmp_path):
    path = put(tmp_path, "b.tsv", "code\tname\n1\tx\n", "utf-8-sig")
    df = readers.read_text(spark, path, TextOptions(encoding="utf-8-sig"))
    assert df.columns == ["code", "name"] and records(df) == [("1", "x")]


def test_files_with_other_headings_are_refused_under_one_glob(spark, tmp_path):
    put(tmp_path / "g", "1.tsv", "a\tb\n1\t2\n")
    put(tmp_path / "g", "2.tsv", "b\ta\n3\t4\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_text(spark, str(tmp_path / "g" / "*.tsv")).collect()


def test_files_with_other_headings_are_united_by_name(spark, tmp_path):
    put(tmp_path / "u", "1.tsv", "a\tb\n1\t2\n")
    put(tmp_path / "u", "2.tsv", " b\ta \n3\t4\n")
    put(tmp_path / "u", "3.tsv", "a\tc\n5\t6\n")
    put(tmp_path / "u", "4.tsv", "a\tb\n7\t8\n")
    df = readers.read_text_files(spark, str(tmp_path / "u" / "*.tsv"))
    assert records(df, "a", "b", "c") == [
        ("1", "2", None), ("4", "3", None), ("5", None, "6"), ("7", "8", None),
    ]
    only = readers.read_text_files(spark, str(tmp_path / "u" / "*.tsv"), columns=["b"])
    assert only.columns == ["b"]
    with pytest.raises(Exception):
        readers.read_text_files(spark, str(tmp_path / "u" / "*.nothing"))


def test_title_line_above_the_heading(spark, tmp_path):
    for n in (1, 2):
        put(tmp_path / "t", f"{n}.csv", f"Report {n},\ncode,name\n{n},x\n")
    df = readers.read_titled_text(
        spark, str(tmp_path / "t"), ["code", "name"], TextOptions(sep=",")
    )
    assert records(df) == [("1", "x"), ("2", "x")]


def test_title_and_heading_by_place_in_one_pass(spark, tmp_path):
    put(tmp_path / "p", "1.csv", "Report 1,\n code , name\n1,x\ncode,name\n")
    put(tmp_path / "p", "2.csv", "Report 2,\ncode,name\n2,y\n")
    put(tmp_path / "p", "3.csv", "Only a title,\n")
    df = readers.read_titled_lines(spark, str(tmp_path / "p"), ["code", "name"], TextOptions(sep=","))
    # A data line that equals the heading stays; a file with nothing below its title adds nothing.
    assert records(df) == [("1", "x"), ("2", "y"), ("code", "name")]
    put(tmp_path / "q", "4.csv", "Report 4,\ncode,other\n4,z\n")
    late = readers.read_titled_lines(spark, str(tmp_path / "q"), ["code", "name"], TextOptions(sep=","))
    with pytest.raises(Exception, match="4.csv"):
        late.collect()
    wide = put(tmp_path / "r", "5.csv", "Report 5,\ncode,name\n5,x,extra\n6,y\n")
    aside = readers.read_titled_lines(spark, str(tmp_path / "r"), ["code", "name"], TextOptions(sep=",", bad_lines="set_aside"))
    assert records(aside) == [("6", "y")]
    with pytest.raises(Exception, match="too many or too few"):
        readers.read_titled_lines(spark, str(tmp_path / "r"), ["code", "name"], TextOptions(sep=",")).collect()


def test_titled_lines_of_a_file_over_many_splits(spark, tmp_path):
    body = "".join(f"{i},n{i}\n" for i in range(40000))
    put(tmp_path / "big", "1.csv", "Title,\ncode,name\n" + body + "code,name\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = readers.read_titled_lines(spark, str(tmp_path / "big"), ["code", "name"], TextOptions(sep=","))
        assert df.rdd.getNumPartitions() > 4
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 40001 and sorted(int(r.code) for r in rows if r.code != "code") == list(range(40000))


def test_parquet_globs_and_differing_columns(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "p" / "one"))
    spark.range(1).withColumn("more", F.lit("m")).write.parquet(str(tmp_path / "p" / "two"))
    df = readers.read_parquet(spark, str(tmp_path / "p" / "*"), merge_schema=True)
    assert records(df, "id", "more") == [(0, "m"), (0, None), (1, None)]
    picked = readers.read_parquet(spark, str(tmp_path / "p" / "two"), ["more"])
    assert picked.columns == ["more"]


def test_format_by_ending(spark, tmp_path):
    put(tmp_path, "x.csv", "a,b\n1,2\n")
    put(tmp_path, "x.txt", "a\tb\n1\t2\n")
    spark.range(1).write.parquet(str(tmp_path / "x.parquet"))
    assert records(readers.read_extract(spark, str(tmp_path / "x.csv"))) == [("1", "2")]
    assert records(readers.read_extract(spark, str(tmp_path / "x.txt"), columns=["b"])) == [("2",)]
    assert readers.read_extract(spark, str(tmp_path / "x.parquet")).count() == 1
    assert records(readers.read_extract(spark, str(tmp_path / "x.txt"), ".TSV")) == [("1", "2")]
    with pytest.raises(ValueError):
        readers.read_extract(spark, "book.xlsx")


def test_stringify_keeps_nulls(spark):
    df = spark.sql("SELECT 1 AS n, map('a', 1) AS m, CAST(NULL AS binary) AS b, 'x' AS s")
    out = writers.stringify(df)
    assert dict(out.dtypes) == {"n": "int", "m": "string", "b": "string", "s": "string"}
    assert out.first().b is None
    assert dict(writers.stringify(df, ["n"]).dtypes)["n"] == "string"


def test_ledger_layout_is_pruned_by_year_and_month(spark, tmp_path):
    df = spark.range(100).selectExpr(
        "id", "IF(id < 90, 'CY', 'PY') AS year_label", "CAST(1 + id % 3 AS int) AS fiscal_month"
    )
    target = str(tmp_path / "gl")
    writers.write_ledger(df, target)
    back = spark.read.parquet(target)
    assert sorted(r.id for r in back.collect()) == list(range(100))
    plan = back.filter("year_label = 'CY' AND fiscal_month = 2")._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "year_label" in filters and "fiscal_month" in filters


def test_compaction_and_fixed_file_numbers(spark, tmp_path):
    many, few, two = (str(tmp_path / n) for n in ("many", "few", "two"))
    spark.range(50).repartition(10).write.parquet(many)
    writers.compact(spark, many, few)
    writers.compact(spark, many, two, files=2)
    assert len(list(Path(few).glob("part-*"))) < 10 and len(list(Path(two).glob("part-*"))) == 2
    assert spark.read.parquet(few).count() == spark.read.parquet(two).count() == 50


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x"', None), ("2", "tab\there", "")], "a string, b string, c string")
    target = str(tmp_path / "out")
    writers.write_text(df.coalesce(1), target)
    back = readers.read_text(spark, target)
    assert records(back, "a", "b") == [("1", 'say "x"'), ("2", "tab\there")]


def test_recoding_drops_repeated_headings(spark, tmp_path):
    put(tmp_path / "in", "1.tsv", "계정\t값\n가\t1\n", "cp949")
    put(tmp_path / "in", "2.tsv", "계정\t값\n나\t2\n", "cp949")
    target = str(tmp_path / "out")
    writers.recode_text(spark, str(tmp_path / "in" / "*.tsv"), target, TextOptions(encoding="cp949"))
    lines = [line for line in text_of(target) if line != "계정\t값"]
    assert lines == ["가\t1", "나\t2"]
    sourced = str(tmp_path / "sourced")
    writers.recode_text(
        spark, str(tmp_path / "in" / "*.tsv"), sourced, TextOptions(encoding="cp949"), keep_source=True
    )
    assert any(line.endswith("1.tsv") for line in text_of(sourced))


def test_database_options_come_from_the_caller(monkeypatch):
    """No database is started here; only what Spark's writer is asked for is checked."""

    class Writer:
        def __init__(self):
            self.asked = {}

        def format(self, name):
            self.asked["format"] = name
            return self

        def mode(self, name):
            self.asked["mode"] = name
            return self

        def options(self, **given):
            self.asked.update(given)
            return self

        def option(self, name, value):
            self.asked[name] = value
            return self

        def save(self):
            self.asked["saved"] = True

    class Frame:
        write = Writer()

        def repartition(self, tasks):
            # Rows are dealt to the connections by a shuffle, so that what comes before keeps its tasks.
            assert tasks == 3
            return self

    writers.append_jdbc(Frame(), "jdbc:x", "gl", {"user": "u", "password": "p"}, 500, 3)
    assert Frame.write.asked == {
        "format": "jdbc", "mode": "append", "user": "u", "password": "p", "url": "jdbc:x",
        "dbtable": "gl", "batchsize": 500, "numPartitions": 3, "saved": True,
    }


def test_intake_takes_new_files_once(spark, tmp_path):
    folder, target, progress = (str(tmp_path / n) for n in ("land", "gl", "progress"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("doc", "amount")])

    def run():
        append_new_files(
            spark, folder, schema, target, progress, files_per_chunk=1,
            prepare=lambda df: df.withColumn("amount", F.col("amount").cast("decimal(18,2)")),
        ).awaitTermination()
        return records(spark.read.parquet(target), "doc", "amount")

    put(tmp_path / "land", "1.tsv", "doc\tamount\n1\t5\n")
    put(tmp_path / "land", "2.tsv", "doc\tamount\n2\t6\n")
    assert run() == [("1", 5.0), ("2", 6.0)]
    put(tmp_path / "land", "3.tsv", "doc\tamount\n3\t7.5\n")
    assert run() == [("1", 5.0), ("2", 6.0), ("3", 7.5)]
    assert run() == [("1", 5.0), ("2", 6.0), ("3", 7.5)]
    assert spark.read.parquet(target).first().amount.__class__ is Decimal


def jobs_of(spark, work) -> int:
    """Number of Spark jobs that ``work`` starts."""
    import uuid

    context, group = spark.sparkContext, f"count-{uuid.uuid4().hex}"
    context.setJobGroup(group, "counted")
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_headings_of_many_files_take_as_many_jobs_as_of_few(spark, tmp_path):
    def folder(name, files):
        for i in range(files):
            heading = "a|b" if i % 2 else "b|a|c"
            put(tmp_path / name, f"{i:03}.txt", f"{heading}\n{i}|x{i}\n{i}|y|z|too many\n")
        return str(tmp_path / name / "*.txt")

    options = TextOptions(sep="|", bad_lines=readers.SET_ASIDE)
    # Above 32 paths Spark lists files in a job of its own, so both counts are taken beyond that.
    few, many = folder("few", 40), folder("many", 200)
    counts = [jobs_of(spark, lambda p=p: readers.read_text_files(spark, p, options).collect()) for p in (few, many)]
    assert counts[0] == counts[1] <= 9
    rows = readers.read_text_files(spark, many, options)
    assert rows.columns == ["b", "a", "c"] and rows.count() == 100
    assert readers.rejected_lines(spark, many, options).count() == 300


def test_heading_drops_only_the_first_line(spark, tmp_path):
    put(tmp_path / "h", "1.txt", "a|b\na|b\n1|2\n")
    put(tmp_path / "h", "2.txt", "b|a\n3|4\n")
    df = readers.read_text_files(spark, str(tmp_path / "h" / "*.txt"), TextOptions(sep="|"), file_column="file")
    assert records(df, "a", "b") == [("1", "2"), ("4", "3"), ("a", "b")]
    assert sorted({Path(r.file).name for r in df.collect()}) == ["1.txt", "2.txt"]


def test_lines_are_recoded_as_they_stand(spark, tmp_path):
    lines = ['1|"half quote |x', "2| blanks kept |y ", "3|완료|surplus|", '4|say "hi" there|z']
    put(tmp_path / "a", "1.txt", "n|text|w\n" + "\n".join(lines[:2]) + "\n")
    put(tmp_path / "a", "2.txt", "n|text|w\n" + "\n".join(lines[2:]) + "\n")
    options = TextOptions(sep="|", quoting=False)
    writers.recode_lines(spark, str(tmp_path / "a" / "*.txt"), str(tmp_path / "k"), options, encoding="cp949")
    korean = b"".join(p.read_bytes() for p in sorted((tmp_path / "k").glob("part-*")))
    assert "3|완료|surplus|".encode("cp949") in korean
    back = TextOptions(sep="|", quoting=False, encoding="cp949")
    writers.recode_lines(spark, str(tmp_path / "k" / "*.csv"), str(tmp_path / "u"), back)
    got = [line for line in text_of(tmp_path / "u") if line != "n|text|w"]
    assert sorted(got) == sorted(lines)
    put(tmp_path / "b", "3.txt", "other|heading\n1|2\n")
    with pytest.raises(ValueError, match="different headings"):
        writers.recode_lines(spark, [str(tmp_path / "a" / "1.txt"), str(tmp_path / "b" / "3.txt")], str(tmp_path / "x"), options)


def test_written_text_keeps_blanks_and_plain_quotes(spark, tmp_path):
    df = spark.createDataFrame([("3", "plain "), ("1", 'say "hi" there')], "n string, t string")
    writers.write_text(df, str(tmp_path / "w"), sep="|", quoting=False)
    assert sorted(line for line in text_of(tmp_path / "w") if line != "n|t") == ['1|say "hi" there', "3|plain "]
