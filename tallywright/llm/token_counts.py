"""Token counts of whole texts without token ids.

Texts are split into the tokenizer's pre-tokens. The library sees each distinct pre-token of a
block of documents once; its number of pieces is joined to the pre-token's frequency in each
document, and the products are summed. Counts of earlier blocks are kept in a bounded table.
A block is an Arrow batch, so the join stays inside the task and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import ready
from tallywright.llm.tokens import CACHE_CHARS, CACHE_ENTRIES, library

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class PieceCounts:
    """Number of tokens of texts by a byte-level BPE file; its special strings count as one.

    Characters that Unicode has not assigned may be split otherwise by another release of the
    library's character tables, so texts that hold one go through the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len)
        marks = "|".join(regex.escape(s) for s in reversed(special))
        self.special = regex.compile(f"({marks})") if marks else None
        self.split = regex.compile(PRE_TOKENS).findall
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.special is None or "<" not in text:
            return self.split(text)
        parts = self.special.split(text)
        return [x for i, p in enumerate(parts) for x in ([p] if i % 2 else self.split(p))]

    def counts(self, texts: list[str]) -> np.ndarray:
        known = self.known
        per_document = [self.pre_tokens(t) for t in texts]
        distinct: set[str] = set()
        for found in per_document:
            distinct.update(found)
        unknown = sorted(distinct.difference(known))
        if not unknown:
            return self.sums(per_document, known)
        encoded = self.tokenizer.encode_batch_fast(unknown, add_special_tokens=False)
        new = dict(zip(unknown, map(len, encoded)))
        doubtful = {p for p in unknown if not p.isascii() and any(category(c) == "Cn" for c in p)}
        keep = [p for p in unknown if len(p) <= CACHE_CHARS and p not in doubtful]
        known.update((p, new[p]) for p in keep[: max(0, CACHE_ENTRIES - len(known))])
        if not known.keys() >= new.keys():
            known = {p: known[p] for p in distinct if p in known} | new
        sums = self.sums(per_document, known)
        if doubtful:
            for i, found in enumerate(per_document):
                if not doubtful.isdisjoint(found):
                    sums[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False))
        return sums

    @staticmethod
    def sums(per_document: list[list[str]], pieces: dict[str, int]) -> np.ndarray:
        return np.array([sum(map(pieces.__getitem__, found)) for found in per_document], np.int64)


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    """One per Python process, so that the tasks of a worker share their table."""
    return PieceCounts(path)


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``tokenizer`` is the path of a byte-level BPE file. Begin, end and added special tokens do
    not count; special strings inside a text count as the library's default has them. A null
    text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each; other
    columns are ignored.
    """
    ready(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counts(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counter.counts(texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return (
        documents.select(
            F.col("doc_id").cast("long"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            "text",
        )
        .mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
