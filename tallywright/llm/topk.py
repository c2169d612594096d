"""Exact top-k by inner product: refine global histograms of scores until each kth value is known.

Every pass scores all vectors against a block of queries. The first pass counts scores per
query in wide bins over the range that norms allow; the bin that holds the kth highest score
becomes the range of the next pass, until a bin is one score wide. A last pass keeps what lies
above the kth score, and of the rows that tie with it the lowest ids that are still needed.
A task hands on only the bins at or above its own kth score, which lie at or above the global
one's bin or are irrelevant to it, and at most k rows per query. So what is shuffled does not
grow with the number of equal scores, however many copies of a vector there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import ready, stored

BINS = 1024
#: Queries that are sent to all tasks at a time, and cells of one score matrix in a task.
QUERY_BLOCK = 4096
CELLS = 4_000_000
#: Whole numbers up to here are exact in float64, which the fast matrix product uses.
EXACT = 1 << 53


def integer_vectors(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """``vec_id, v`` with ``v`` the floor of ``factor`` times each component.

    Rows with a null vector, an empty one, or a null, NaN or infinite component are left out,
    and so are components whose product does not fit a 64-bit integer.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * factor).cast("long"))
    bad = F.exists(
        "embedding",
        lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * factor >= 2.0**62),
    )
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return vectors.where(usable).where(~bad).select(F.col("vec_id").cast("long"), x.alias("v"))


class Scorer:
    """Exact scores of batches of vectors against one block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray):
        self.ids, self.queries = ids, queries
        self.most = int(np.abs(queries).max(initial=0))

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(vec_ids, scores, own)`` with a row per vector and a column per query."""
        width = self.queries.shape[1]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lists = batch.column(1)
            fits = [k for k in range(len(ids)) if len(lists[k]) == width]
            step = max(1, CELLS // max(1, len(self.ids)))
            for at in range(0, len(fits), step):
                part = fits[at : at + step]
                rows = np.array([lists[k].as_py() for k in part], np.int64)
                own_ids = np.array([-1 if ids[k] is None else ids[k] for k in part], np.int64)
                null = np.array([ids[k] is None for k in part])
                if self.most * int(np.abs(rows).max(initial=0)) * width < EXACT:
                    scores = (rows.astype(np.float64) @ self.queries.T.astype(np.float64)).astype(np.int64)
                else:
                    exact = rows.astype(object) @ self.queries.T.astype(object)
                    scores = np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
                yield own_ids, scores, (own_ids[:, None] == self.ids[None, :]) | null[:, None]


def _bin(scores: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bin of each score; -1 below the query's range and ``BINS`` above it."""
    # Differences of 64-bit numbers fit unsigned ones.
    offset = scores.astype(np.uint64) - low.astype(np.uint64)
    bins = np.minimum(offset // width.astype(np.uint64), np.uint64(BINS)).astype(np.int64)
    return np.where(scores < low, -1, bins)


def histogram(vectors: DataFrame, scorer: Scorer, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """``query, bin, n``: scores per query and bin, as far down as the kth of each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(scorer.ids)
        counts = np.zeros((n, BINS + 1), np.int64)
        for _, scores, own in scorer.batches(batches):
            bins = _bin(scores, low, width)
            bins[own] = -1
            query, at = np.nonzero(bins.T >= 0)
            flat = query * (BINS + 1) + bins.T[query, at]
            counts += np.bincount(flat, minlength=n * (BINS + 1)).reshape(n, BINS + 1)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, at = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[query, at], pa.int64())],
            names=["query", "bin", "n"],
        )

    per_task = vectors.mapInArrow(work, "query int, bin int, n long")
    return per_task.groupBy("query", "bin").agg(F.sum("n").alias("n"))


def kth_bins(counts: DataFrame, k: int) -> DataFrame:
    """``query, bin, above``: the bin of each query's kth highest score (or of its lowest)."""
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    above = F.sum("n").over(down) - F.col("n")
    reached = counts.withColumn("above", above).where(F.col("above") < k)
    return reached.groupBy("query").agg(F.min_by("bin", "bin").alias("bin"), F.max("above").alias("above"))


def winners(vectors: DataFrame, scorer: Scorer, kth: np.ndarray, k: int) -> DataFrame:
    """Per task and query: scores above the kth, and the lowest ids that tie with it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(scorer.ids)
        kept = [np.empty(0, np.int64)] * 3  # query, score, id
        for ids, scores, own in scorer.batches(batches):
            at, query = np.nonzero((scores >= kth) & ~own)
            kept = [np.concatenate(x) for x in zip(kept, (query, scores[at, query], ids[at]))]
            if len(kept[0]) > 8 * k * n:
                kept = best(kept, k)
        query, score, ids = best(kept, k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query, pa.int32()),
                pa.array(scorer.ids[query], pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array(score, pa.int64()),
            ],
            names=["query", "query_id", "vec_id", "score"],
        )

    return vectors.mapInArrow(work, "query int, query_id long, vec_id long, score long")


def best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k first rows of each query by falling score and rising id."""
    query, score, ids = rows
    order = np.lexsort((ids, ~score, query))
    query = query[order]
    first = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.empty(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    order = order[rank < k]
    return [x[order] for x in rows]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` nearest to each query.

    Both frames are ``vec_id, v`` as :func:`integer_vectors` gives them. Ties go to the smaller
    ``vec_id``. Rows of the query's own id are not its candidates, rows without an id are
    nobody's, and vectors meet only queries of their own length. Repeated query rows are one
    query; rows of one id but other vectors are queries of their own. Scores beyond 64 bits count as the nearest 64-bit number. No rows give no rows.

    Queries are taken in blocks of about :data:`QUERY_BLOCK`, each sent to the tasks that score;
    rows are dealt to blocks by id and vector, so that many rows of one id spread over blocks.
    """
    spark = ready(vectors.sparkSession)
    queries = stored(
        queries.where(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "v"]), "queries"
    )
    sizes = queries.groupBy(F.size("v").alias("width")).count().collect()
    found: DataFrame | None = None
    for width, count in sorted((r["width"], r["count"]) for r in sizes):
        blocks = -(-count // QUERY_BLOCK)
        mine = queries.where(F.size("v") == width)
        for block in range(blocks):
            own = mine.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block) if blocks > 1 else mine
            part = _block(vectors, own, k)
            if part is not None:
                part = stored(part, "top-k")
                found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def _block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    rows = queries.orderBy("vec_id").collect()
    if not rows:
        return None
    scorer = Scorer(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64))
    # Cauchy-Schwarz bounds every score by the product of norms.
    norm = vectors.select(
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))
    ).first()[0]
    if norm is None:
        return None
    reach = np.sqrt((scorer.queries.astype(np.float64) ** 2).sum(axis=1)) * norm
    most = np.array([min(2**63 - 1, int(r * (1 + 1e-9)) + 1) for r in reach], np.int64)
    low, width = -most, most // (BINS // 2) + 1
    kth = np.full(len(rows), -(2**63), np.int64)
    while True:
        state = kth_bins(histogram(vectors, scorer, low, width, k), k).collect()
        at = np.array([r["query"] for r in state], np.int64)
        bins = np.array([r["bin"] for r in state], np.int64)
        if not len(at):
            break
        inside = bins < BINS
        low[at[inside]] += bins[inside] * width[at[inside]]
        if (width == 1).all():
            kth[at] = low[at]
            break
        width = np.maximum(1, -(-width // BINS))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = winners(vectors, scorer, kth, k).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
