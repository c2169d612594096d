"""Reading ledger and trial-balance extracts.

Text is read as text: no reader infers types. Column maps and casts come later.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators.mapping import column, keep_columns

#: Names of the Korean Windows code page. Java's own ``cp949`` is another table, so all of
#: them are read as ``x-windows-949`` (fixed values).
KOREAN = {"cp949", "ms949", "uhc", "windows-949", "x-windows-949"}

#: File endings and the formats they stand for (fixed values).
FORMATS = {
    "parquet": "parquet",
    "tsv": "text",
    "txt": "text",
    "csv": "text",
}

#: Separator by file ending where the caller names none (fixed values).
SEPARATORS = {"csv": ",", "tsv": "\t", "txt": "\t"}


#: What becomes of lines that do not fit their heading.
REFUSE, SET_ASIDE = "refuse", "set_aside"

#: Column that holds a line that does not fit, while a file is read.
BAD_LINE = "_bad_line"


@dataclass(frozen=True)
class TextOptions:
    """How a delimited file is written. ``quoting=False`` takes quotes as plain characters.

    A line with more or fewer fields than the heading stops the query, or is set aside with
    ``bad_lines=SET_ASIDE``; :func:`rejected_lines` gives the lines set aside.
    """

    sep: str = "\t"
    encoding: str = "utf-8"
    quoting: bool = True
    header: bool = True
    multiline: bool = False
    bad_lines: str = REFUSE

    def __post_init__(self) -> None:
        if self.bad_lines not in (REFUSE, SET_ASIDE):
            raise ValueError(f"bad_lines must be {REFUSE!r} or {SET_ASIDE!r}")


def charset(name: str) -> str:
    """Java name of an encoding; ``utf-8-sig`` is UTF-8, whose mark Spark drops itself."""
    plain = name.lower().replace("_", "-")
    if plain in KOREAN:
        return "x-windows-949"
    if plain in {"utf8", "utf-8", "utf-8-sig", "utf8-sig"}:
        return "UTF-8"
    return name


def reader_options(options: TextOptions) -> dict[str, str | bool]:
    """Spark's names for the options, for batch and streaming readers."""
    return {
        "sep": options.sep,
        "encoding": charset(options.encoding),
        "header": options.header,
        "multiLine": options.multiline,
        "mode": "PERMISSIVE",
        # All fields are parsed whatever is selected later, or misfits would not be noticed.
        "columnNameOfCorruptRecord": BAD_LINE,
        "columnPruning": False,
        "quote": '"' if options.quoting else "",
        "escape": '"' if options.quoting else "\\",
        # Check every file's heading against the schema instead of binding by position.
        "enforceSchema": False,
    }


def with_bad_line(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])


def fitting_lines(df: DataFrame, options: TextOptions) -> DataFrame:
    """Rows of lines that fit; a line that does not stops the query unless set aside."""
    # Spark wants another column read beside the bad lines, also for a bare count.
    fits = F.col(BAD_LINE).isNull() & _read(df)
    if options.bad_lines == REFUSE:
        message = F.concat(F.lit("line with too many or too few fields: "), F.col(BAD_LINE))
        fits = fits | F.raise_error(message).cast("boolean")
    return df.filter(fits).drop(BAD_LINE)


def _read(df: DataFrame) -> Column:
    """Always true, by way of the first column."""
    return F.length(F.coalesce(column(df.columns[0]), F.lit(""))) >= 0


def _names(schema_names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in schema_names])


def unique_names(heading: Sequence[str | None]) -> list[str]:
    """Column names of a heading: a repeated one gets a number, an empty one its place."""
    seen: dict[str, int] = {}
    out = []
    for place, name in enumerate(heading):
        name = name if name is not None and name.strip() else f"_c{place}"
        times = seen.get(name, 0)
        seen[name] = times + 1
        out.append(f"{name}.{times}" if times else name)
    return out


def _heading(spark: SparkSession, file: str | Sequence[str], options: TextOptions) -> tuple[str | None, ...]:
    """Fields of the first line as they stand there."""
    plain = spark.read.options(**reader_options(replace(options, header=False))).csv(file)
    first = plain.drop(BAD_LINE).first()
    return tuple(first) if first is not None else ()


def _parsed(
    spark: SparkSession, files: str | Sequence[str], heading: Sequence[str | None], options: TextOptions
) -> DataFrame:
    """Lines of files with one heading, bad ones in their own column. Headings are trimmed."""
    names = unique_names(heading) if options.header else [f"_c{i}" for i in range(len(heading))]
    # A heading that repeats a name cannot be compared with names that are told apart.
    as_written = not options.header or list(heading) == names
    reader = spark.read.options(**reader_options(options)).option("enforceSchema", not as_written)
    df = reader.schema(with_bad_line(_names(names))).csv(files)
    return df.toDF(*(name.strip() for name in names), BAD_LINE)


def read_text(
    spark: SparkSession,
    path: str | Sequence[str],
    options: TextOptions = TextOptions(),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Delimited text with one heading, all columns as strings, headings trimmed.

    ``path`` may be a glob. All its files must share the heading; a file that does not is
    an error (``read_text_files`` takes files that differ).
    """
    df = fitting_lines(_parsed(spark, path, _heading(spark, path, options), options), options)
    return df if columns is None else keep_columns(df, columns)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files behind a path or glob, in name order. Reads names only, no content."""
    found = spark.read.format("binaryFile").load(path).select("path")
    return sorted(row.path for row in found.collect())


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_text_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    options: TextOptions = TextOptions(),
    columns: Sequence[str] | None = None,
    file_column: str | None = None,
) -> DataFrame:
    """Delimited files whose columns may differ in number and order, united by name.

    ``file_column`` names a column for the file of each line, if one is wanted.

    Headings are found inside the tasks of one job, from the first split of each file; the
    driver sees only the distinct headings, and files join their group by a table. All files
    are then read in one scan and each line is parsed by its group's heading, so the number
    of jobs does not grow with the number of files.
    """
    df = _grouped(spark, paths, options)
    lines = fitting_lines(df if file_column else df.drop(FILE), options)
    kept = lines if columns is None else keep_columns(lines, [*columns, *([FILE] if file_column else [])])
    return kept.withColumnRenamed(FILE, file_column) if file_column else kept


#: Column of the file a line comes from, while files with different headings are read.
FILE = "_file"
#: Separator of the reader of whole lines: a line that holds it is still taken whole.
WHOLE_LINE_SEP = "\u0001"


def _whole_lines(spark: SparkSession, paths: str | Sequence[str], options: TextOptions, header: bool) -> DataFrame:
    """Each line of each file as one decoded string ``_line``, with ``_file`` and ``_start``.

    With ``header`` Spark drops the first line of each file, in the task that reads it.
    """
    reader = spark.read.options(
        sep=WHOLE_LINE_SEP,
        quote="",
        encoding=charset(options.encoding),
        header=header,
        enforceSchema=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_whole",
        multiLine=False,
    ).schema("_part string, _whole string")
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    return df.select(
        F.coalesce(F.col("_whole"), F.col("_part")).alias("_line"),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order"),
    )


def heading_fields(line: str, options: TextOptions) -> tuple[str | None, ...]:
    """Fields of a heading line as they stand there; an empty one is null."""
    if options.quoting and len(options.sep) == 1:
        import csv

        fields = next(csv.reader([line], delimiter=options.sep, quotechar='"', doublequote=True), [])
    else:
        fields = line.split(options.sep)
    return tuple(field if field != "" else None for field in fields)


def _grouped(spark: SparkSession, paths: str | Sequence[str], options: TextOptions) -> DataFrame:
    """Parsed lines of all files, each by the heading of its file, bad ones in ``BAD_LINE``.

    Multi-line records and files without heading take the older way: one reading per group of
    files, after one small job per file.
    """
    if options.multiline or not options.header:
        return union_by_name(
            df.withColumn(FILE, F.input_file_name()) for df in _by_heading(spark, paths, options)
        )
    from tallywright.session import write_through

    firsts = (
        _whole_lines(spark, paths, options, header=False)
        .where(F.col("_start") == 0)
        .groupBy(FILE)
        .agg(F.min_by("_line", "_order").alias("_heading"))
    )
    firsts = write_through(firsts)
    found = firsts.groupBy("_heading").agg(F.min(FILE).alias("_first")).collect()
    if not found:
        raise FileNotFoundError(f"no files match {paths!r}")
    found = sorted(found, key=lambda r: r["_first"])
    groups = spark.createDataFrame(
        [(r["_heading"], i) for i, r in enumerate(found)], "_heading string, _group int"
    )
    lines = _whole_lines(spark, paths, options, header=True).join(
        firsts.join(groups, "_heading").select(FILE, "_group"), FILE
    )
    csv_options = {
        "sep": options.sep,
        "quote": '"' if options.quoting else "",
        "escape": '"' if options.quoting else "\\",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": BAD_LINE,
    }
    places: dict[str, list[Column]] = {}
    parsed = []
    for i, row in enumerate(found):
        names = [n.strip() for n in unique_names(heading_fields(row["_heading"], options))]
        ddl = ", ".join(f"c{p} STRING" for p in range(len(names))) + f", `{BAD_LINE}` STRING"
        parsed.append(
            F.when(F.col("_group") == i, F.from_csv(F.col("_line"), ddl, csv_options)).alias(f"_g{i}")
        )
        for p, name in enumerate(names):
            places.setdefault(name, []).append(F.col(f"_g{i}.c{p}"))
    bad = F.coalesce(*(F.col(f"_g{i}.{BAD_LINE}") for i in range(len(found))), F.lit(None).cast("string"))
    each = lines.select(FILE, *parsed)
    return each.select(
        *(F.coalesce(*cols, F.lit(None).cast("string")).alias(name) for name, cols in places.items()),
        bad.alias(BAD_LINE),
        FILE,
    )


def _by_heading(
    spark: SparkSession, paths: str | Sequence[str], options: TextOptions
) -> list[DataFrame]:
    """Parsed lines of each group of files that share their heading, one small job per file."""
    files = list_files(spark, paths) if isinstance(paths, str) else list(paths)
    if not files:
        raise FileNotFoundError(f"no files match {paths!r}")
    with ThreadPoolExecutor(max_workers=16) as pool:
        heading = inheritable_thread_target(spark)(lambda file: _heading(spark, file, options))
        headings = list(pool.map(heading, files))
    groups: dict[tuple[str | None, ...], list[str]] = {}
    for file, names in zip(files, headings):
        groups.setdefault(names, []).append(file)
    return [_parsed(spark, group, names, options) for names, group in groups.items() if names]


def rejected_lines(
    spark: SparkSession, paths: str | Sequence[str], options: TextOptions = TextOptions()
) -> DataFrame:
    """``file, line`` of all lines that do not fit the heading of their file."""
    df = _grouped(spark, paths, options)
    return df.filter(F.col(BAD_LINE).isNotNull()).select(
        F.col(FILE).alias("file"), F.col(BAD_LINE).alias("line")
    )


def read_titled_text(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    options: TextOptions = TextOptions(),
) -> DataFrame:
    """Delimited files with a title line above the heading.

    The title is dropped as if it were the heading, and the real heading by its fields, blanks
    around them aside. ``columns`` are the headings in file order; a file without such a line
    is an error, which one pass over the files finds out.
    """
    reader = spark.read.options(**reader_options(options)).option("enforceSchema", True)
    df = fitting_lines(reader.schema(with_bad_line(_names(columns))).csv(path), options)
    is_heading = reduce(
        and_, (F.trim(F.coalesce(column(c), F.lit(""))) == c.strip() for c in columns)
    )
    files = df.groupBy(F.input_file_name().alias("file")).agg(F.max(is_heading).alias("has"))
    without = [row.file for row in files.filter(~F.col("has")).select("file").take(5)]
    if without:
        raise ValueError(f"no line with the headings {list(columns)} in {without}")
    return df.filter(~is_heading)


def _without_headings(columns: Sequence[str], options: TextOptions):
    """Arrow step that drops the first line each task reads of a file's first split.

    A file's first split is read by one task, its lines in order, so the first of them that a
    task meets is the line below the title. That line must be the heading, or the task fails
    naming the file. Only these lines pass through Python one by one; the others are kept by a
    vectorised mask.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    expected = tuple(c.strip() for c in columns)

    def step(batches):
        last: tuple = (None, None)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            files, starts = batch.column(FILE), batch.column("_start")
            first_split = pc.equal(starts, 0)
            # A row begins a run when its file or split differs from the row before it.
            previous_file = pa.concat_arrays([pa.array([last[0]], files.type), files.slice(0, n - 1)])
            previous_start = pa.concat_arrays([pa.array([last[1]], starts.type), starts.slice(0, n - 1)])
            begins = pc.or_(
                pc.fill_null(pc.not_equal(files, previous_file), True),
                pc.fill_null(pc.not_equal(starts, previous_start), True),
            )
            heading = pc.and_(first_split, begins)
            for i in pc.indices_nonzero(heading).to_pylist():
                line = batch.column("_line")[i].as_py() or ""
                found = tuple((f or "").strip() for f in heading_fields(line, options))
                if found != expected:
                    raise ValueError(
                        f"no heading {list(columns)} below the title of {files[i].as_py()}: {line!r}"
                    )
            last = (files[n - 1].as_py(), starts[n - 1].as_py())
            yield batch.filter(pc.invert(heading)).select(["_line", FILE])

    return step


def read_titled_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    options: TextOptions = TextOptions(),
) -> DataFrame:
    """Delimited files with a title line above the heading, in one reading pass.

    The title is the first line of a file and the heading the second, by place: Spark drops the
    title in the task that reads the file's first split, and that task drops the line after it
    if its fields are ``columns`` (blanks around them aside), and else fails, naming the file,
    when the lines are read, not while the plan is built. A data line that equals the heading
    stays. A file with nothing below its title gives no rows. Lines that do not fit the
    heading are refused or set aside as ``options.bad_lines`` says. Records over several lines
    (``options.multiline``) are not read by place; :func:`read_titled_text` reads them.
    """
    if options.multiline:
        raise ValueError("records over several lines cannot be placed; use read_titled_text")
    lines = _whole_lines(spark, path, options, header=True).select("_line", FILE, "_start")
    kept = lines.mapInArrow(_without_headings(columns, options), f"_line string, `{FILE}` string")
    csv_options = {
        "sep": options.sep,
        "quote": '"' if options.quoting else "",
        "escape": '"' if options.quoting else "\\",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": BAD_LINE,
    }
    names = [c.strip() for c in columns]
    ddl = ", ".join(f"c{p} STRING" for p in range(len(names))) + f", `{BAD_LINE}` STRING"
    record = kept.select(F.from_csv(F.col("_line"), ddl, csv_options).alias("_r"))
    parsed = record.select(
        *(F.col(f"_r.c{p}").alias(name) for p, name in enumerate(names)), F.col(f"_r.{BAD_LINE}").alias(BAD_LINE)
    )
    return fitting_lines(parsed, options)


def read_parquet(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    """Parquet file, folder or glob; ``merge_schema`` where the files' columns differ."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", merge_schema).parquet(*paths)
    return df if columns is None else keep_columns(df, columns)


def ending(path: str) -> str:
    return path.rstrip("/*").rsplit(".", 1)[-1].lower()


def read_extract(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    options: TextOptions | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Extract in the format its ending (or ``fmt``, e.g. ``"tsv"``) stands for."""
    kind = (fmt or ending(path)).lower().lstrip(".")
    if kind not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; known: {sorted(FORMATS)}")
    if FORMATS[kind] == "parquet":
        return read_parquet(spark, path, columns)
    return read_text(spark, path, options or TextOptions(sep=SEPARATORS[kind]), columns)
