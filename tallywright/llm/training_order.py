"""Token sequences written in training order: a keyed permutation gives each its global slot.

Documents are tokenised and joined end to end into sequences of one length. Each sequence has a
dense number: its place in its task plus the sequences of all tasks before. A balanced Feistel
network over the next even number of bits permutes the numbers; a result outside the range goes
through the network again (cycle-walking) until it falls inside, so the map is one-to-one on
exactly the sequences there are, without a table or a sort of random keys. Rows are then
range-partitioned by shard, and each shard is one file of records of fixed stride, so the slot
alone says where a record is, and a reader can start anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import mixed, new_folder, ready, stored
from tallywright.llm.tokens import stretch_ids

LENGTH = 2048
END_ID = 1
ROUNDS = 8
SENT_PARTS = 1_000_000


class Feistel:
    """A permutation of ``range(size)`` under a key."""

    def __init__(self, size: int, key: int):
        if not 0 < size < 1 << 62:
            raise ValueError("a permutation needs between 1 and 2**62 - 1 elements")
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) ^ mixed(np.array([key & (2**64 - 1)], np.uint64)))

    def once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mixed(right ^ key) & self.mask)
        return left << np.uint64(self.half) | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        slots = self.once(numbers.astype(np.uint64))
        while (outside := slots >= np.uint64(self.size)).any():
            slots[outside] = self.once(slots[outside])
        return slots.astype(np.int64)


def sequences(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``part, place, doc_ids, n_tokens, packed`` of the joined token streams of all tasks.

    ``packed`` are the compressed ids, little-endian, of 16 bits if the vocabulary allows. They
    stay compressed until a shard is written. The last sequence of a
    task may be shorter. Null texts are empty; each document ends with ``end_id``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = stretch_ids(tokenizer), TaskContext.get().partitionId()
        kind = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        stride = length * np.dtype(kind).itemsize
        end = np.array([end_id], kind).tobytes()
        held, owners, place = b"", [], 0

        def rows(pieces: list[tuple[list, bytes]]) -> pa.RecordBatch:
            nonlocal place
            first, place = place, place + len(pieces)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(pieces), pa.int64()),
                    pa.array(range(first, place), pa.int64()),
                    pa.array([list(dict.fromkeys(o)) for o, _ in pieces], pa.list_(pa.int64())),
                    pa.array([len(b) // np.dtype(kind).itemsize for _, b in pieces], pa.int64()),
                    pa.array([pa.compress(b, codec="zstd", asbytes=True) for _, b in pieces], pa.binary()),
                ],
                names=["part", "place", "doc_ids", "n_tokens", "packed"],
            )

        for batch in batches:
            done = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.ids(texts)):
                held += np.frombuffer(ids, "<u4").astype(kind).tobytes() + end
                owners.append(doc_id)
                cut = 0
                while len(held) - cut >= stride:
                    done.append((owners, held[cut : cut + stride]))
                    cut += stride
                    owners = [doc_id] if len(held) > cut else []
                held = held[cut:] if cut else held
            if done:
                yield rows(done)
        if held:
            yield rows([(owners, held)])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "part long, place long, doc_ids array<long>, n_tokens long, packed binary"
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``number``: dense over all rows, by part and place. Only counts of parts are ordered.

    A part is a task that tokenised, so there is one start per task. Up to ``SENT_PARTS`` of them
    go to every task, which spares shuffling the sequences for it.
    """
    parts = stored(rows.groupBy("part").agg(F.count("*").alias("n")), "parts")
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = parts.select("part", before.alias("before"))
    starts = F.broadcast(starts) if parts.count() <= SENT_PARTS else starts
    return rows.join(starts, "part").withColumn("number", F.col("before") + F.col("place")).drop("before")


def with_slots(rows: DataFrame, size: int, key: int) -> DataFrame:
    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(Feistel(size, key)(numbers.to_numpy()))

    return rows.withColumn("slot", slot("number"))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def store_address(folder: str) -> str:
    """The folder with the scheme of its store; a plain path is on a shared local one."""
    if folder.startswith(("/", "file:")):
        return f"file:///{folder.removeprefix('file:').lstrip('/')}"
    return folder


def write_shards(rows: DataFrame, folder: str, shard_rows: int, stride: int, width: int) -> DataFrame:
    """Write one file per shard; ``slot, shard, byte_offset, doc_ids, n_tokens, crc32`` of each row.

    ``stride`` and ``width`` are the bytes of a record and of an id. A shard is written under a name of the task attempt and then moved to its own, so a task
    that runs again, or twice at a time, leaves the same whole file.
    """
    address = store_address(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(address)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}"
        shard, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{path}/.{shard_name(shard)}.{attempt}", f"{path}/{shard_name(shard)}")

        for batch in batches:
            slots, sizes, packed = (batch.column(i).to_pylist() for i in (0, 2, 3))
            sums = []
            for slot, size, data in zip(slots, sizes, packed):
                record = pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True)
                if slot // shard_rows != shard:
                    close()
                    shard = slot // shard_rows
                    out = store.open_output_stream(f"{path}/.{shard_name(shard)}.{attempt}")
                record = record.ljust(stride, b"\0")
                out.write(record)
                sums.append(zlib.crc32(record))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s // shard_rows for s in slots], pa.int64()),
                    pa.array([s % shard_rows * stride for s in slots], pa.int64()),
                    batch.column(1),
                    batch.column(2),
                    pa.array(sums, pa.int64()),
                ],
                names=["slot", "shard", "byte_offset", "doc_ids", "n_tokens", "crc32"],
            )
        close()

    return rows.select("slot", "doc_ids", "n_tokens", "packed").mapInArrow(
        work, "slot long, shard long, byte_offset long, doc_ids array<long>, n_tokens long, crc32 long"
    )


def materialise(
    documents: DataFrame, tokenizer: str, key: int = 17, length: int = LENGTH, folder: str | None = None
) -> DataFrame:
    """Write all ``documents`` in training order and return one row per sequence.

    ``folder`` is where the shards go, in a store that all executors share; by default a new one
    in the session's checkpoint folder. Records are ``length`` ids of 16 bits (32 for large
    vocabularies), the last ones padded with 0. There are as many shards as shuffle partitions.
    No documents give no shards and no rows.
    """
    spark = ready(documents.sparkSession)
    rows = stored(sequences(documents, tokenizer, length), "sequences")
    total = rows.count()
    if not total:
        return spark.createDataFrame(
            [], "slot long, shard long, byte_offset long, doc_ids array<long>, n_tokens long, crc32 long"
        )
    from tallywright.llm.tokens import library

    width = 2 if library(tokenizer).get_vocab_size() <= 1 << 16 else 4
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard_rows = -(-total // partitions)
    placed = with_slots(numbered(rows), total, key).withColumn(
        "shard", F.floor(F.col("slot") / shard_rows).cast("long")
    )
    dealt = placed.repartitionByRange(partitions, "shard").sortWithinPartitions("slot")
    return write_shards(dealt, folder or new_folder(spark, "shards"), shard_rows, length * width, width)


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, bits: int = 16) -> DataFrame:
    """``shard, place, ids`` of the records of a folder of shards, cut at the fixed stride."""
    stride = length * bits // 8
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    places = F.sequence(F.lit(0), (F.length("content") / stride).cast("int") - 1)
    return files.select(
        F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"),
        F.explode(places).alias("place"),
        "content",
    ).select("shard", "place", F.substring("content", F.col("place") * stride + 1, stride).alias("ids"))
