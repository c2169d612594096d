"""Benchmark items inside long documents: size-partitioned MinHash containment search.

Everything is DataFrame operations. Texts are shingles of ``width`` words, hashed. An item is in
a document if at least ``share`` of the item's distinct shingles are.

Items are partitioned by size, in powers of two of their shingle counts. The sketch of an item
is its ``k`` smallest min-hash values, and ``k`` follows from its size partition: of ``n``
shingles at most ``n - ceil(share n)`` can be missing from a document that contains the item,
so one value more than the partition's largest allowance cannot all be missing. Hence a
document that meets no value of the sketch is ruled out for certain and no link is lost, which
banded signatures of whole documents could not promise: an item of 10 shingles in a document of
20,000 has a Jaccard similarity of 0.0004. Documents that do meet one are candidates, and their
shingles are compared with the item's as texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import ready, stored

WIDTH, SHARE = 5, 0.8
#: Fixed value: what separates lower-cased words.
SEPARATORS = "[\\x00-/:-`{-\\x7f]+"
#: Sketch values that may be sent to every task; beyond that Spark shuffles both sides.
SENT_VALUES = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words. ASCII signs and blanks separate them; other characters belong to them."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` has a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(words: Column, width: int) -> tuple[Column, Column]:
    """Places of the first words of all shingles, and the last of them; -1 for an empty text."""
    last = F.when(F.size(words) == 0, -1).otherwise(F.greatest(F.size(words) - width, F.lit(0)))
    return F.sequence(F.lit(0), F.greatest(last, F.lit(0))), last


def hashed_shingles(words: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` words, in order; a shorter text is one shingle."""

    def of(own: Column) -> Column:
        starts, last = _starts(own, width)
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(width))))
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(hashes)

    return _once(words, of)


def shingles(words: Column, width: int = WIDTH) -> Column:
    """The distinct shingles themselves."""

    def of(own: Column) -> Column:
        starts, last = _starts(own, width)
        texts = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(own, i + 1, width)))
        return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.array_distinct(texts))

    return _once(words, of)


def sketches(items: DataFrame, share: float = SHARE) -> DataFrame:
    """``item, value`` of ``item, hashes`` (distinct): the smallest values of each item."""
    size = F.size("hashes")
    upper = F.pow(F.lit(2), F.floor(F.log2(size)) + 1) - 1
    missing = F.floor((1 - F.lit(share)) * upper + 1e-9)
    k = F.least(missing + 1, size).cast("int")
    return items.where(size > 0).select(
        "item", F.explode(F.slice(F.sort_array("hashes"), F.lit(1), k)).alias("value")
    )


def contained(
    documents: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE
) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of all items inside documents.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``. One row
    per document id and item id; of several rows of one id the best pair counts. Null and empty
    texts contain nothing and are in nothing; a text of fewer than ``width`` words is one
    shingle. Rows without an id are not reported. Other columns are ignored.
    """
    ready(documents.sparkSession)
    own = items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item_words")
    )
    own = own.select(
        "item_id",
        shingles(F.col("item_words"), width).alias("item_shingles"),
        F.array_distinct(hashed_shingles(F.col("item_words"), width)).alias("hashes"),
    ).where(F.size("item_shingles") > 0)
    # Equal items are one item in the search.
    key = F.sha2(F.array_join(F.array_sort("item_shingles"), "\n"), 256)
    own = stored(own.withColumn("item", key), "items")
    values = stored(sketches(own.dropDuplicates(["item"]), share).distinct(), "sketches")
    few = values.count() <= SENT_VALUES
    values = F.broadcast(values) if few else values

    texts = documents.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    hashes = hashed_shingles(F.col("doc_words"), width)
    met = (
        texts.select("doc_id", words(F.col("text")).alias("doc_words"))
        .select("doc_id", F.explode(hashes).alias("value"))
        .join(values, "value")
        .select("doc_id", "item")
        .distinct()
    )
    candidates = stored(met, "candidates")
    return _verified(texts, own, candidates, width, share)


def _verified(texts: DataFrame, own: DataFrame, candidates: DataFrame, width: int, share: float) -> DataFrame:
    """Candidates whose shingles, compared as texts, reach the share."""
    sets = own.dropDuplicates(["item"]).select("item", "item_shingles")
    mine = candidates.join(sets, "item").groupBy("doc_id").agg(
        F.collect_list(F.struct("item", "item_shingles")).alias("tried")
    )
    shared = F.size(F.array_intersect("doc_shingles", F.col("tried.item_shingles")))
    pairs = (
        texts.join(mine, "doc_id")
        .select("doc_id", shingles(words(F.col("text")), width).alias("doc_shingles"), "tried")
        .select("doc_id", "doc_shingles", F.explode("tried").alias("tried"))
        .select(
            "doc_id",
            F.col("tried.item").alias("item"),
            F.size("tried.item_shingles").cast("long").alias("n_item"),
            shared.cast("long").alias("n_shared"),
        )
        .where(F.col("n_shared") >= F.lit(share) * F.col("n_item") - 1e-9)
    )
    return (
        pairs.join(own.select("item", "item_id"), "item")
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_item", "n_shared"), F.struct(F.col("n_shared") / F.col("n_item"), "n_item")).alias("best"))
        .select(
            "doc_id",
            "item_id",
            "best.n_item",
            "best.n_shared",
            (F.col("best.n_shared") / F.col("best.n_item")).alias("containment"),
        )
    )


def clean(documents: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """``documents`` without those that contain an item. Rows without an id stay.

    A document is its ``doc_id``: where several rows share an id, all of them go when the text
    of one of them contains an item, also rows whose own text holds none.
    """
    found = contained(documents, items, width, share).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti").select(documents.columns)
