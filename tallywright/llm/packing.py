"""Hierarchical packing of token sequences into windows of several context sizes.

A document of ``n`` tokens is cut into whole windows of the largest size; what is left over is
routed to the smallest tier whose window holds it. Each tier is packed, longest first. Gaps of
its windows are filled with whole left-overs of shorter tiers, the longest that fits first, and
at last with the head of one that does not fit. Windows of a block are then dealt into step
groups of one tier and nearly equal attention cost.

Work is local to a task: a block of a few million tokens is packed at a time, and what fills
no window goes on to the next block. Only the tail of a task, less than one window, is cut into
windows whose sizes are powers of two. So nothing is shuffled, memory is bounded by the block,
and a lost task gives the same rows again, as long as its input split is the same.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import ready
from tallywright.llm.tokens import stretch_ids

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens packed at a time in a task, and tokens that a training step holds.
BLOCK_TOKENS = 4_000_000
STEP_TOKENS = 16 * 2048

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, window long, step_group long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    + [(n, pa.int64()) for n in "doc_tokens sequence_id offset window step_group".split()]
)


class Pool:
    """Left-over pieces ``(length, number, document, start)``, kept in order of length."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, int, int, int]] = []
        self.added = 0

    def add(self, document: int, start: int, length: int) -> None:
        self.added += 1
        insort(self.pieces, (length, self.added, document, start))

    def longest_up_to(self, length: int) -> tuple[int, int, int] | None:
        """Take the longest piece of at most ``length`` tokens."""
        at = bisect_right(self.pieces, (length, self.added + 1, 0, 0))
        if not at:
            return None
        size, _, document, start = self.pieces.pop(at - 1)
        return document, start, size

    def head(self, length: int, limit: int) -> tuple[int, int, int] | None:
        """Cut ``length`` tokens off the shortest piece that is longer than that, up to ``limit``."""
        at = bisect_right(self.pieces, (length, self.added + 1, 0, 0))
        if at == len(self.pieces) or self.pieces[at][0] > limit:
            return None
        size, _, document, start = self.pieces.pop(at)
        self.add(document, start + length, size - length)
        return document, start, length


def pack_lengths(
    lengths: list[int], tiers: tuple[int, ...] = TIERS
) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Full windows ``(size, [(document, start, length), ...])`` and the pieces left over.

    The pieces left over are in all shorter than the largest window.
    """
    most = tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    pools = {tier: Pool() for tier in tiers}
    shorter = Pool()
    for document, length in enumerate(lengths):
        whole = length - length % most
        windows += [(most, [(document, at, most)]) for at in range(0, whole, most)]
        if length > whole:
            tier = next(t for t in tiers if t >= length - whole)
            pools[tier].add(document, whole, length - whole)
    loose: list[tuple[int, int, int]] = []
    for i in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[i], tiers[i - 1] if i else 0
        own = pools[tier]
        shorter.pieces = sorted(p for t in tiers[:i] for p in pools[t].pieces)
        shorter.added = max((pools[t].added for t in tiers), default=0) + 1
        while (piece := own.longest_up_to(tier)) is not None:
            window, room = [piece], tier - piece[2]
            while room and (piece := shorter.longest_up_to(room) or own.longest_up_to(room)):
                window.append(piece)
                room -= piece[2]
            if room and (piece := shorter.head(room, below) or own.head(room, tier)):
                window.append(piece)
                room = 0
            if room:
                loose += window
            else:
                windows.append((tier, window))
        for t in tiers[:i]:
            low = tiers[tiers.index(t) - 1] if t != tiers[0] else 0
            pools[t].pieces = [p for p in shorter.pieces if low < p[0] <= t]
            pools[t].added = max(pools[t].added, shorter.added)
    # What found no partner is joined end to end into windows of the largest size.
    window, room = [], most
    for document, start, length in loose:
        while length:
            part = min(room, length)
            window.append((document, start, part))
            start, length, room = start + part, length - part, room - part
            if not room:
                windows.append((most, window))
                window, room = [], most
    return windows, window


def power_windows(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Cut the pieces into windows whose sizes are the powers of two of their sum."""
    left = sum(p[2] for p in pieces)
    windows, queue = [], [list(p) for p in reversed(pieces)]
    while left:
        size = 1 << (left.bit_length() - 1)
        window, room = [], size
        while room:
            document, start, length = queue[-1]
            part = min(room, length)
            window.append((document, start, part))
            room -= part
            queue[-1][1:] = [start + part, length - part]
            if not queue[-1][2]:
                queue.pop()
        windows.append((size, window))
        left -= size
    return windows


def balanced_steps(windows: list[tuple[int, list[tuple[int, int, int]]]], first: int) -> tuple[list[int], int]:
    """A step group for each window, of one tier each, with nearly equal sums of squared lengths."""
    groups = [0] * len(windows)
    for size in sorted({w[0] for w in windows}):
        mine = [k for k, w in enumerate(windows) if w[0] == size]
        mine.sort(key=lambda k: (-sum(p[2] ** 2 for p in windows[k][1]), k))
        steps = -(-len(mine) // max(1, STEP_TOKENS // size))
        for rank, k in enumerate(mine):
            lap, at = divmod(rank, steps)
            groups[k] = first + (at if lap % 2 == 0 else steps - 1 - at)
        first += steps
    return groups, first


class TaskPacker:
    """Packs the documents of one task block by block."""

    def __init__(self, task: int):
        self.sequence = self.step = task << 36
        self.documents: list[tuple[int | None, int, int, bytes]] = []  # id, first token, all tokens, ids
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id, 0, len(ids) // 4, ids))
        self.tokens += len(ids) // 4

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        windows, rest = pack_lengths([len(d[3]) // 4 for d in self.documents])
        if last:
            windows, rest = windows + power_windows(rest), []
        groups, self.step = balanced_steps(windows, self.step)
        rows = []
        for (size, window), group in zip(windows, groups):
            offset = 0
            for document, start, length in window:
                doc_id, first, total, ids = self.documents[document]
                cut = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, first + start, length, cut, total, self.sequence, offset, size, group))
                offset += length
            self.sequence += 1
        carried = []
        for document, start, length in rest:
            doc_id, first, total, ids = self.documents[document]
            carried.append((doc_id, first + start, total, ids[4 * start : 4 * (start + length)]))
        self.documents, self.tokens = carried, sum(len(d[3]) // 4 for d in carried)
        for at in range(0, len(rows), 4096):
            columns = list(zip(*rows[at : at + 4096]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
            )


def pack(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Pieces of all ``documents`` (``doc_id``, ``text``) in windows of at most 2048 tokens.

    ``tokenizer`` is the path of a tokenizer file that drops white space. Each document's ids
    end with ``end_id``. One row per piece: ``ids`` (little-endian, 32 bits each), its place in
    the document (``start``, ``length`` of ``doc_tokens``) and in its sequence
    (``sequence_id``, ``offset``), the size of the window and the step group.

    Null and empty texts are the end token alone. Repeated rows and rows of one or of no id are
    documents of their own. Further columns are ignored. No rows give no rows.
    """
    ready(documents.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = stretch_ids(tokenizer), TaskPacker(TaskContext.get().partitionId())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.ids(texts)):
                packer.add(doc_id, ids + end)
                if packer.tokens >= BLOCK_TOKENS:
                    yield from packer.flush(last=False)
        yield from packer.flush(last=True)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "window",
        "step_group",
    )
