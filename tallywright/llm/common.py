"""What the operators of this folder share: shared storage, row identity, Arrow batches."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text in one Arrow batch. Texts are of any length, so batches are kept short.
BATCH_ROWS = "512"
ALL_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tallywright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._tallywright_shipped = True


def ready(spark: SparkSession) -> SparkSession:
    """Set what the operators expect of a session and return it.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only where nothing is
    named and the master is one process on one machine (``local``, ``local[n]``), as in a
    test, a new temporary folder takes its place; on any other master that is an error, as
    executors there do not see the driver's disk.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if not spark.conf.get("spark.checkpoint.dir", None):
        master = spark.sparkContext.master
        if not one_machine(master):
            raise ValueError(
                f"master {master!r} needs a folder that all executors share in spark.checkpoint.dir"
            )
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process: ``local`` or ``local[n]``, not ``local-cluster``."""
    return master == "local" or (master.startswith("local[") and master.endswith("]"))


def new_folder(spark: SparkSession, what: str) -> str:
    """A path under the cluster's shared folder that nothing has used yet."""
    base = ready(spark).conf.get("spark.checkpoint.dir").rstrip("/")
    return f"{base}/tallywright-llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, of: int) -> Column:
    """CRC-32 of the key as text, modulo ``of``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % of


def over_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(work, schema)


def with_row_numbers(documents: DataFrame, row: str = "row", rest: str = "rest") -> DataFrame:
    """``row`` and all columns in a struct ``rest``, so that no name of theirs can clash.

    Rows are numbered as tasks read them, and even a stored table may be dealt to tasks otherwise
    the next time. Whoever uses the numbers twice needs :func:`stored_with_rows`.
    """
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias(rest))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            numbers = pa.array(range(at, at + batch.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0)], names=[row, rest])
            at += batch.num_rows

    schema = T.StructType([T.StructField(row, T.LongType()), *packed.schema.fields])
    return packed.mapInArrow(work, schema)


def stored_with_rows(documents: DataFrame) -> DataFrame:
    """``row`` and ``rest`` of :func:`with_row_numbers`, numbered once and written."""
    return stored(with_row_numbers(documents), "numbered")


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers (finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] out of scrambled 64-bit ones."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def table_of(fields: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from ``name: (values, type)``."""
    arrays = [pa.array(values, type=kind) for values, kind in fields.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))
