"""Repeated passages across documents, found in suffix order; later copies go, the first stays.

A byte goes if a string of ``MATCH`` bytes that covers it also starts in a document with a
smaller id. For that, every window of ``MATCH`` bytes would have to be put in suffix order with
all others. Three steps keep that to the windows that can matter, without losing one:

1. Each window is keyed by the lowest hash among its ``GRAM``-byte grams. Equal windows have
   equal keys, and neighbours mostly share theirs, so a document is a row of runs, about one for
   14 windows. Keys that only one document has are dropped.
2. Runs with shared keys are read as strings. Of equal strings only the occurrence in the
   earliest document can be new; all others are covered as they are.
3. The distinct strings of a bucket of keys are put in suffix order, with the longest common
   prefixes of neighbours; those whose key one document alone has there can have no window in
   common with another and need none. Within a stretch of common prefixes of at least ``MATCH``, a suffix
   has a longest previous factor of that length if the previous or the next smaller document in
   suffix order lies in the stretch.

Tasks send each key or string once per batch, however many documents have it, packed and
compressed per bucket; what their own batch already settles they answer themselves. Keys that
many documents have (a bounded number of keys) are dealt by the window instead of the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import binary_texts, mixed, ready, stored, stored_with_rows

MATCH, GRAM = 50, 24
#: Runs or string bytes that a task holds before it sends them.
HELD_RUNS, HELD_BYTES = 800_000, 30_000_000
#: Text bytes per bucket. Buckets grow in number with the corpus, not in size.
BUCKET_BYTES = 8_000_000
#: Documents with one key from which it is hot, and the most keys that can be hot.
HOT_DOCUMENTS, HOT_KEYS = 4_000, 100_000
_KEY_BITS = np.uint64(40)
#: Keys of strings are told apart modulo this; more than one in a group only costs time.
_SENT_KEYS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse, as far as the longest text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def grams(self, raw: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all strings of ``width`` bytes."""
        self.reach(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        return mixed((sums[width:] - sums[:-width]) * self.down[: len(raw) - width + 1])


def runs_of(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Keys and first windows of the runs of one text of at least ``MATCH`` bytes."""
    low, span, reach = powers.grams(raw, GRAM), 1, MATCH - GRAM + 1
    while 2 * span <= reach:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if rest := reach - span:
        low = np.minimum(low[:-rest], low[rest:])
    starts = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
    return low[starts], starts


def squeeze(numbers: np.ndarray) -> bytes:
    """Compressed bytes of unsigned numbers, one plane per byte."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


_ROWS = pa.schema([("bucket", pa.int32()), ("numbers", pa.list_(pa.binary())), ("data", pa.binary())])
_ROWS_DDL = "bucket int, numbers array<binary>, data binary"


def rows_of(rows: list[tuple[int, list[bytes], bytes | None]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)


def split_key(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key and the 40 bits of it that are compared inside the bucket."""
    rest, bucket = np.divmod(keys, np.uint64(buckets))
    return bucket.astype(np.int64), rest & ((np.uint64(1) << _KEY_BITS) - np.uint64(1))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal values of a sorted array."""
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def texts_with_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes]]:
    """``row, doc_id, text`` of a task's documents."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_texts(batch.column(2)))


def keys_sent(documents: DataFrame, buckets: int) -> DataFrame:
    """Step 1, in the tasks: each key of a batch once, with a row that has it.

    Rows of the same key in the batch but the first are sent as candidates at once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, keys, rows, numbers, held = Powers(), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            bucket, key = split_key(np.concatenate(keys), buckets)
            row, run = np.concatenate(rows), np.concatenate(numbers)
            order = np.lexsort((key, bucket))  # runs of a row come one after the other and stay so
            bucket, key, row, run = bucket[order], key[order], row[order], run[order]
            fresh = np.r_[True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]
            other = np.r_[True, fresh[1:] | (row[1:] != row[:-1])]  # first run of a row with the key
            group = np.cumsum(fresh) - 1
            documents_of = np.bincount(group[other])
            direct = np.flatnonzero(other & ~fresh)
            out = []
            first = np.flatnonzero(fresh)
            for b, at in by_bucket(bucket[first]):
                part = first[at]
                out.append((b, list(map(squeeze, (np.diff(key[part], prepend=np.uint64(0)), row[part].astype(np.uint64), run[part].astype(np.uint64), documents_of[group[part]].astype(np.uint64)))), None))
            if len(direct):
                to = (mixed(row[direct].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                direct, to = direct[order], to[order]
                for b, at in by_bucket(to):
                    part = direct[at]
                    out.append((b, list(map(squeeze, (row[part].astype(np.uint64), run[part].astype(np.uint64)))), None))
            keys.clear(), rows.clear(), numbers.clear()
            held = 0
            yield rows_of(out)

        for row, doc_id, text in texts_with_rows(batches):
            if doc_id is None or len(text) < MATCH:
                continue
            key, _ = runs_of(np.frombuffer(text, np.uint8), powers)
            keys.append(key)
            rows.append(np.full(len(key), row))
            numbers.append(np.arange(len(key)))
            held += len(key)
            if held >= HELD_RUNS:
                yield from flush()
        yield from flush()

    return documents.mapInArrow(work, _ROWS_DDL)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[list[np.ndarray], bytes | None]]]]:
    """Rows of each bucket of a partition that is sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, numbers, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(([unsqueeze(x) for x in numbers], data))
    if held:
        yield bucket, held


def shared_runs(sent: DataFrame, buckets: int, hot_from: int) -> DataFrame:
    """Step 1, per bucket: ``row, run`` of keys in several documents; hot keys as ``key``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in grouped(batches):
            entries = [n for n, _ in held if len(n) == 4]
            rows = [n[0] for n, _ in held if len(n) == 2]
            runs = [n[1] for n, _ in held if len(n) == 2]
            hot = np.zeros(0, np.uint64)
            if entries:
                key = np.concatenate([np.cumsum(n[0]) for n in entries])
                row, run, count = (np.concatenate([n[i] for n in entries]) for i in (1, 2, 3))
                order = np.argsort(key, kind="stable")
                key, row, run, count = key[order], row[order], run[order], count[order].astype(np.int64)
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                total = np.add.reduceat(count, first)
                several = np.repeat(total > 1, np.diff(np.r_[first, len(key)]))
                rows.append(row[several])
                runs.append(run[several])
                hot = key[first][total >= hot_from]
            row, run = np.concatenate(rows).astype(np.int64), np.concatenate(runs).astype(np.int32)
            for i in range(0, len(row), 65536):
                part = slice(i, i + 65536)
                nothing = pa.nulls(len(row[part]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[part], pa.int64()), pa.array(run[part], pa.int32()), nothing, nothing],
                    names=["row", "run", "bucket", "key"],
                )
            if len(hot):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(hot), pa.int64()),
                        pa.nulls(len(hot), pa.int32()),
                        pa.array([bucket] * len(hot), pa.int64()),
                        pa.array(hot.astype(np.int64), pa.int64()),
                    ],
                    names=["row", "run", "bucket", "key"],
                )

    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "row long, run int, bucket long, key long")


def packed_texts(documents: DataFrame) -> DataFrame:
    """``row, doc_id, packed`` with compressed texts, which are what has to be shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row, doc_id, text in texts_with_rows(batches):
            packed = len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)
            held.append((row, doc_id, packed))
            if len(held) == 512:
                yield _packed(held)
                held = []
        if held:
            yield _packed(held)

    return documents.mapInArrow(work, "row long, doc_id long, packed binary")


def _packed(held: list[tuple]) -> pa.RecordBatch:
    row, doc_id, packed = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(packed, pa.binary())],
        names=["row", "doc_id", "packed"],
    )


def unpacked(packed: bytes) -> bytes:
    return pa.decompress(
        packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True
    )


def merged_ranges(rows: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Maximal ``row, first, last`` ranges out of ranges that may overlap or touch, by row."""
    if not len(rows):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((firsts, rows))
    rows, firsts, lasts = rows[order], firsts[order], lasts[order]
    other = np.r_[True, rows[1:] != rows[:-1]]
    # One axis for all rows, on which the ranges of two rows are apart.
    shift = (np.cumsum(other) - 1) * (int(lasts.max()) + 2)
    reach = np.maximum.accumulate(lasts + shift)
    begin = np.flatnonzero(np.r_[True, (firsts + shift)[1:] > reach[:-1]])
    end = np.r_[begin[1:], len(rows)] - 1
    return np.stack([rows[begin], firsts[begin], reach[end] - shift[end]], axis=1)


def strings_sent(texts: DataFrame, buckets: int, hot: set[tuple[int, int]]) -> DataFrame:
    """Step 2, in the tasks: each string of a batch once, for its earliest document.

    ``texts`` is ``row, doc_id, packed, runs``. Occurrences in later documents of the batch are
    sent as covered ranges at once. Strings of hot keys are cut into their windows. A string goes
    with bits of its key, as only strings of one key can have a window in common.
    """
    hot_keys = np.array(sorted(b * (1 << 40) + k for b, k in hot), np.uint64)
    few = np.uint64(_SENT_KEYS - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Strings are numbered as they are met; occurrences are columns, not objects.
        powers, number, size = Powers(), {}, 0
        dense = pa.Codec("zstd", compression_level=3)
        parts: list[tuple[np.ndarray, ...]] = []  # number, bucket, key, row, document, start

        def keep(strings: list[bytes], bucket, key, row: int, doc_id: int, starts: np.ndarray) -> None:
            nonlocal size
            known = len(number)
            which = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
            n = len(strings)
            parts.append((which, bucket, key, np.full(n, row), np.full(n, doc_id), starts))
            size += (len(number) - known) * (100 + sum(map(len, strings)) // n) + 24 * n

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not parts:
                return
            which, bucket, key, row, docs, start = map(np.concatenate, zip(*parts))
            strings = list(number)
            length = np.fromiter(map(len, strings), np.int64, len(strings))[which]
            earliest = np.full(len(strings), np.iinfo(np.int64).max)
            np.minimum.at(earliest, which, docs)
            later = docs > earliest[which]
            out = []
            own = np.flatnonzero(~later)
            own = own[np.lexsort((start[own], row[own], bucket[own]))]
            for b, at in by_bucket(bucket[own]):
                part = own[at]
                first = np.flatnonzero(np.r_[True, row[part][1:] != row[part][:-1]])
                raw = b"".join([strings[i] for i in which[part].tolist()])
                numbers = [
                    length[part],
                    key[part],
                    start[part],
                    np.diff(first, append=len(part)),
                    np.diff(row[part][first], prepend=0),
                    docs[part][first].view(np.uint64),
                ]
                data = len(raw).to_bytes(8, "little") + dense.compress(raw, asbytes=True)
                out.append((b, list(map(squeeze, numbers)), data))
            spans = merged_ranges(row[later], start[later], (start + length)[later])
            to = (mixed(spans[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            spans, to = spans[order], to[order]
            for b, part in by_bucket(to):
                out.append((b, [squeeze(spans[part, i].astype(np.uint64)) for i in range(3)], None))
            number.clear(), parts.clear()
            size = 0
            for i in range(0, len(out), 256):
                yield rows_of(out[i : i + 256])

        for batch in batches:
            for row, doc_id, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = unpacked(packed)
                keys, starts = runs_of(np.frombuffer(text, np.uint8), powers)
                ends = np.r_[starts[1:], len(text) - MATCH + 1] + MATCH - 1
                # A key that a text has again is wanted there, too.
                sought = np.sort(keys[np.array(wanted, np.int64)])
                place = np.minimum(np.searchsorted(sought, keys), len(sought) - 1)
                picked = np.flatnonzero(sought[place] == keys)
                bucket, rest = split_key(keys[picked], buckets)
                if len(hot_keys):
                    is_hot = np.isin(bucket.astype(np.uint64) * np.uint64(1 << 40) + rest, hot_keys)
                    for start, end in zip(starts[picked[is_hot]].tolist(), ends[picked[is_hot]].tolist()):
                        strings = [text[i : i + MATCH] for i in range(start, end - MATCH + 1)]
                        digests = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in strings)
                        b, k = split_key(np.frombuffer(digests, "<u8"), buckets)
                        keep(strings, b, k & few, row, doc_id, np.arange(start, start + len(strings)))
                    picked, bucket, rest = picked[~is_hot], bucket[~is_hot], rest[~is_hot]
                if len(picked):
                    first = starts[picked]
                    strings = [text[i:j] for i, j in zip(first.tolist(), ends[picked].tolist())]
                    keep(strings, bucket, rest & few, row, doc_id, first)
                if size > HELD_BYTES:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(work, _ROWS_DDL)


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` and common prefixes of neighbours, up to ``MATCH``.

    The first common prefix is 0. ``text`` goes on for at least ``MATCH`` bytes after each start.
    """
    columns = []
    padded = np.r_[text, np.zeros(8, np.uint8)]
    eights = np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,))  # the 8 bytes from each place
    for i in range(0, MATCH, 8):
        beyond = np.uint64(8 * max(0, i + 8 - MATCH))
        columns.append(eights[starts + i].astype(np.uint64) >> beyond << beyond)
    order = np.lexsort(columns[::-1])
    common = np.zeros(len(order), np.int64)
    open_ = np.r_[False, np.ones(max(0, len(order) - 1), bool)][: len(order)]
    for i, column in enumerate(columns):
        differs = np.r_[np.uint64(0), column[order[1:]] ^ column[order[:-1]]][: len(order)]
        width = min(8, MATCH - 8 * i)
        equal = np.full(len(order), width)
        for j in range(width - 1, -1, -1):
            equal[(differs >> np.uint64(8 * (7 - j))) > 0] = j
        common += np.where(open_, equal, 0)
        open_ &= equal == width
    return order, common


def previous_factors(documents: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether each suffix, in suffix order, has a previous factor of at least ``MATCH`` bytes.

    The previous and the next smaller document are looked for within stretches of common
    prefixes that long, by running minima from either side.
    """
    n = len(documents)
    if not n:
        return np.zeros(0, bool)
    stretch = np.cumsum(common < MATCH)
    rank = np.unique(documents, return_inverse=True)[1].astype(np.int64)
    from_left = np.minimum.accumulate(rank - stretch * n) + stretch * n
    from_right = (np.minimum.accumulate((rank + stretch * n)[::-1]) - (stretch * n)[::-1])[::-1]
    return (from_left < rank) | (from_right < rank)


def covered_ranges(sent: DataFrame, buckets: int) -> DataFrame:
    """Steps 2 and 3, per bucket: ``row, first, last`` byte ranges that an earlier document has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped(batches):
            spans = [np.stack([x.astype(np.int64) for x in n], axis=1) for n, data in held if data is None]
            given = [(n, d) for n, d in held if d is not None]
            if given:
                spans += _bucket_ranges(given)
            if not spans:
                continue
            out = merged_ranges(*np.concatenate(spans).T)
            for i in range(0, len(out), 65536):
                part = out[i : i + 65536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, j], pa.int64()) for j in range(3)], names=["row", "first", "last"]
                )
            # Later tasks of this Python process may need little; what is free goes back.
            del spans, out, given, held
            pa.default_memory_pool().release_unused()

    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "row long, first long, last long")


def _bucket_ranges(given: list[tuple[list[np.ndarray], bytes]]) -> list[np.ndarray]:
    lengths, keys, starts = (np.concatenate([n[i] for n, _ in given]).astype(np.int64) for i in range(3))
    times = [n[3].astype(np.int64) for n, _ in given]
    rows = np.concatenate([np.repeat(np.cumsum(n[4]).astype(np.int64), t) for (n, _), t in zip(given, times)])
    docs = np.concatenate([np.repeat(n[5].view(np.int64), t) for (n, _), t in zip(given, times)])
    raw = b"".join(unpacked(d) for _, d in given)
    at = np.r_[0, np.cumsum(lengths)]
    strings = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
    earliest = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(earliest, which, docs)
    later = docs > earliest[which]
    spans = [np.stack([rows[later], starts[later], (starts + lengths)[later]], axis=1)]
    # Suffix order over the distinct strings, each standing for its earliest document. Windows are
    # equal only under one key, so strings whose key is of one document only need no order.
    key_of = np.zeros(len(number), np.int64)
    key_of[which] = keys
    group = np.unique(key_of, return_inverse=True)[1]
    low, high = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
    np.minimum.at(low, group, earliest)
    np.maximum.at(high, group, earliest)
    chosen = np.flatnonzero(low[group] < high[group])
    if not len(chosen):
        return spans
    all_strings, earliest = list(number), earliest[chosen]
    distinct = [all_strings[i] for i in chosen.tolist()]
    sizes = np.array(list(map(len, distinct)), np.int64)
    offset = np.r_[0, np.cumsum(sizes)]
    windows = sizes - MATCH + 1
    owner = np.repeat(np.arange(len(distinct)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    text = np.frombuffer(b"".join(distinct), np.uint8)
    order, common = suffix_order(text, offset[owner] + inside)
    found = np.zeros(len(owner), bool)
    found[order] = previous_factors(earliest[owner][order], common)
    # Ranges of neighbouring windows, for each occurrence in the earliest document.
    begin = np.flatnonzero(found & np.r_[True, ~found[:-1] | (owner[1:] != owner[:-1])])
    stop = np.flatnonzero(found & np.r_[~found[1:] | (owner[1:] != owner[:-1]), True])
    if len(begin):
        own = np.flatnonzero(~later)
        own = own[np.argsort(which[own], kind="stable")]
        left = np.searchsorted(which[own], chosen[owner[begin]], "left")
        right = np.searchsorted(which[own], chosen[owner[begin]], "right")
        times = right - left
        k = np.repeat(np.arange(len(begin)), times)
        occurrence = own[np.repeat(left, times) + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)]
        first = starts[occurrence] + inside[begin][k]
        last = starts[occurrence] + inside[stop][k] + MATCH
        spans.append(np.stack([rows[occurrence], first, last], axis=1))
    return spans


def joined_spans(firsts: list[int], lasts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes out of ranges that may overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(firsts, lasts)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``row, firsts, lasts`` of the rows that repeat earlier documents.

    The byte ranges may overlap. ``rows`` are :func:`row_id_and_bytes` of a stored table.
    """
    spark = ready(rows.sparkSession)
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    hot_from = max(HOT_DOCUMENTS, size // 10 // HOT_KEYS)

    shared = stored(shared_runs(keys_sent(rows, buckets), buckets, hot_from), "shared-runs")
    hot_rows = shared.where(F.col("key").isNotNull()).select("bucket", "key").collect()
    hot = {(r["bucket"], r["key"]) for r in hot_rows}
    runs = shared.where(F.col("row").isNotNull()).groupBy("row").agg(F.collect_set("run").alias("runs"))
    texts = packed_texts(rows).join(runs, "row").select("row", "doc_id", "packed", "runs")
    ranges = stored(covered_ranges(strings_sent(texts, buckets, hot), buckets), "ranges")
    return ranges.groupBy("row").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")
    )


def row_id_and_bytes(numbered: DataFrame) -> DataFrame:
    """``row, doc_id, text`` of a table of :func:`stored_with_rows`."""
    return numbered.select(
        "row", F.col("rest.doc_id").cast("long").alias("doc_id"), F.col("rest.text").cast("binary").alias("text")
    )


def kept_bytes(text: bytes, firsts: list[int] | None, lasts: list[int] | None) -> tuple[bytes, int]:
    """What stays of a text, and the number of runs that go."""
    gone = joined_spans(firsts or [], lasts or [])
    cuts = [0, *(x for span in gone for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])), len(gone)


def without_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row of ``documents``.

    ``kept`` holds the bytes that stay. Texts are UTF-8 bytes; null and empty ones have none.
    Rows of one id are documents of their own and neither is earlier than the other; rows
    without an id stay as they are and remove nothing. Texts shorter than ``MATCH`` bytes stay.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                text = unpacked(packed)
                kept, n = kept_bytes(text, firsts, lasts)
                out.append((len(text), len(text) - len(kept), n, kept))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    own = row_id_and_bytes(stored_with_rows(documents.select("doc_id", "text")))
    whole = packed_texts(own).join(repeated_spans(own), "row", "left")
    return whole.select("doc_id", "packed", "firsts", "lasts").mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``documents``, all columns, with what stays of the texts; emptied documents go.

    A character of which only some bytes stay goes as a whole. ``n_chars``, if there is such a
    column, counts anew where a text changed.
    """
    numbered = stored_with_rows(documents)
    spans = repeated_spans(row_id_and_bytes(numbered))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                kept_bytes(text.encode(), firsts, lasts)[0].decode(errors="ignore") if firsts else text
                for text, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pc.is_valid(batch.column(2))],
                names=["rest", "text", "changed"],
            )

    joined = numbered.join(spans, "row", "left")
    joined = joined.select("rest", F.col("rest.text").alias("text"), "firsts", "lasts")
    schema = T.StructType(
        [joined.schema["rest"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())]
    )
    done = joined.mapInArrow(work, schema).where(~F.col("changed") | (F.col("text") != ""))
    kind = documents.schema["n_chars"].dataType if "n_chars" in documents.columns else None

    def column(name: str):
        if name == "text":
            return F.col("text")
        own = F.col("rest").getField(name)
        if name == "n_chars":
            return F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(own).alias(name)
        return own.alias(name)

    return done.select(*map(column, documents.columns))


def digest(kept: DataFrame) -> DataFrame:
    """The result with the SHA-256 of the bytes that stay in place of the bytes."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
