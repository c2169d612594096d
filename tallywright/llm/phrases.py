"""Phrases of two to four words that occur together far more often than their parts, per language.

The growth reads the texts once for each of three steps, each an aggregation, with bounds that
no frequent phrase exceeds (``f >= LEAST``):

1. words and their counts;
2. phrases of 2, 3 and 4 words all of whose words may be frequent, as 40-bit hashes with counts.
   The count of a hash is an admissible bound on the count of each phrase that has it, as the
   count of a part is on the count of a phrase that holds it;
3. phrases whose hash may reach ``LEAST``, counted as strings. These are the exact counts.

What may be frequent is told by Bloom filters of fixed size, built by the tasks and ORed by
Spark. Hashes that meet by chance and false positives are counted too and fall out at ``LEAST``
in the counts of strings; nothing frequent is left out. A task takes texts by blocks and sends
each word, hash or phrase of a block once with its count, so a very frequent one costs a row per
block. The lookups of ``l`` and ``r`` need only the frequent tables, never all phrases.

The score of a candidate is that of its weakest cut: cutting after the first ``k`` words gives
``l`` and ``r``, the counts of both parts, and ``floor(2000000 * a / (l + r))``, worked out in
38-digit decimals so that no product overflows. The lowest score counts, ties to the smallest
``k``. A candidate is dropped when a longer candidate (dropped or not) holds it as contiguous
words and is at least ``NESTED`` as frequent. Each language keeps its first ``TOP`` by score
descending, ``a`` descending, phrase ascending (UTF-8 byte order, as Spark compares strings);
the ranking window is limited per group, so each task sends at most ``TOP`` rows per language.

Why not the best-first branch and bound of the dealt method: a candidate's survival depends on all
longer candidates, of any score, so every phrase with ``a >= LEAST`` has to be counted whatever
the bound says; the count bound above is the part of it that saves work here.

Defined results for odd input:

* null text: empty, no words; null ``lang``: ``und``; empty table: empty result;
* repeated rows count as often as they occur; whole texts are read, however long;
* a word is a run of anything but space and tab, pieces end at ``.,;:!?`` and line breaks;
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import binary_texts, mixed, ready, stored
from tallywright.llm.repeats import Powers, by_bucket, squeeze, unsqueeze

# Fixed values of the contract.
GAPS, ENDS = b"\x20\x09", b".,;:!?\x0A\x0B\x0C\x0D"
#: Least count of a candidate; longest phrase; longer phrases that are at least
#: ``NESTED`` (as a fraction 4/5: 100 f >= 80 a) as frequent drop a shorter one.
LEAST, LONGEST, TOP = 30, 4, 2000
UNKNOWN_LANG = "und"
#: Bits and hash functions of a Bloom filter of what may be frequent. Its size is fixed, so what
#: goes to the tasks is bounded; a fuller filter only lets more phrases be counted.
FILTER_BITS, FILTER_HASHES = 1 << 25, 2
#: Text bytes of a block, and hashes of a bucket that are counted at once.
BLOCK_BYTES, BUCKET_HASHES = 2_000_000, 8_000_000
#: Hashes of phrases and strings that a task holds before it sends them.
HELD_HASHES, HELD_PHRASES = 3_000_000, 400_000
_KEY_BITS = np.uint64(40)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(ENDS)] = 1, 2
_end = re.compile(b"[" + re.escape(ENDS) + b"]")


class Block:
    """The words of a block of texts of one language.

    ``first`` and ``last`` are where each word lies in ``raw``, lower-cased; ``piece`` numbers the
    pieces; ``hash`` is a hash of the language and the word.
    """

    def __init__(self, lang: str, texts: list[bytes], powers: Powers) -> None:
        self.lang = lang
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.raw, kind = _LOWER[raw], _KIND[raw]
        edges = np.flatnonzero(np.diff(np.r_[False, kind == 0, False]))
        self.first, self.last = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.first)
        powers.reach(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)], out=sums[1:])
        of = int.from_bytes(lang.encode("utf-8", "surrogatepass")[:64], "little") % (1 << 64)
        self.hash = mixed((sums[self.last] - sums[self.first]) * powers.down[self.first] ^ mixed(np.array([of], np.uint64)))

    def starts(self, n: int) -> np.ndarray:
        """First words of all phrases of ``n`` words."""
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def phrase_hashes(self, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(starts), n, np.uint64)
        for i in range(n):
            out = mixed(out * np.uint64(0xD1342543DE82EF95) + self.hash[starts + i])
        return out

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for the same word only."""
        _, at, number = np.unique(self.hash, return_index=True, return_inverse=True)
        length = self.last - self.first
        like = at[number]
        same = bool((length == length[like]).all())
        if same:
            shift = np.repeat(self.first[like] - self.first, length)
            place = np.arange(len(shift)) + np.repeat(self.first - np.cumsum(length) + length, length)
            same = bool((self.raw[place] == self.raw[place + shift]).all())
        if not same:  # hashes that meet by chance
            known: dict[bytes, int] = {}
            number = np.array([known.setdefault(self.word(i), len(known)) for i in range(len(length))], np.int64)
        return number

    def word(self, i: int) -> bytes:
        return self.raw[self.first[i] : self.last[i]].tobytes()

    def counted(self, number: np.ndarray, starts: np.ndarray, n: int) -> tuple[list[str], list[int]]:
        """The phrases of ``n`` words at ``starts`` and how often each occurs there."""
        ids = number[starts].astype(np.int64)
        for i in range(1, n):
            ids = np.unique(ids, return_inverse=True)[1] * (int(number.max(initial=0)) + 1) + number[starts + i]
        _, at, counts = np.unique(ids, return_index=True, return_counts=True)
        whole, at = self.raw.tobytes(), starts[at]
        words = [
            [whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip(self.first[at + i].tolist(), self.last[at + i].tolist())]
            for i in range(n)
        ]
        return list(map(" ".join, zip(*words))), counts.tolist()


def parts_of(text: bytes) -> Iterator[bytes]:
    """A long text by parts that end where a piece ends, which no phrase crosses."""
    at = 0
    while len(text) - at > BLOCK_BYTES and (end := _end.search(text, at + BLOCK_BYTES)):
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of a task's ``lang, text``, each of one language."""
    powers, held, size = Powers(), {}, {}
    for batch in batches:
        texts = zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)))
        for lang, text in ((lang, part) for lang, whole in texts for part in parts_of(whole)):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= BLOCK_BYTES:
                size.pop(lang)
                yield Block(lang, held.pop(lang), powers)
            elif sum(size.values()) >= 8 * BLOCK_BYTES:
                largest = max(size, key=size.get)
                size.pop(largest)
                yield Block(largest, held.pop(largest), powers)
    for lang, texts in held.items():
        yield Block(lang, texts, powers)


def _slices(hashes: np.ndarray) -> list[np.ndarray]:
    """``FILTER_HASHES`` positions of each hash in a filter."""
    width = np.uint64(FILTER_BITS.bit_length() - 1)
    again = mixed(hashes)
    return [(again >> (width * np.uint64(i))) & np.uint64(FILTER_BITS - 1) for i in range(FILTER_HASHES)]


def filter_words(hashes: np.ndarray) -> pa.RecordBatch:
    """``i, b`` of the 64-bit words of a filter that hold ``hashes``."""
    spots = np.unique(np.concatenate(_slices(hashes)))
    at = spots >> np.uint64(6)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    bits = np.uint64(1) << (spots & np.uint64(63))
    bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
    return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(bits.view(np.int64))], names=["i", "b"])


def bloom_filter(words: DataFrame) -> Broadcast:
    """A filter of its parts ``i, b``: tasks set the bits, Spark ORs them per 64-bit word.

    At most ``FILTER_BITS / 64`` rows reach the driver, whatever the number of phrases.
    """
    whole = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[whole["i"].to_numpy()] = whole["b"].to_numpy().view(np.uint64)
    return words.sparkSession.sparkContext.broadcast(bits)


def might_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    held = np.ones(len(hashes), bool)
    for p in _slices(hashes):
        held &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return held


_COUNTS_DDL = "lang string, n int, g string, f long"


def string_counts(texts: DataFrame, counted: Callable[[Block], Iterator[tuple[int, list[str], list[int]]]]) -> DataFrame:
    """(``lang``, ``n``, ``g``, ``f``) of the phrases that ``counted`` gives of each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict[str, int]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, n), counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(counts), pa.string()),
                        pa.array([n] * len(counts), pa.int32()),
                        pa.array(list(counts), pa.string()),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    names=["lang", "n", "g", "f"],
                )
            held.clear()

        for block in blocks(batches):
            for n, grams, counts in counted(block):
                known = held.setdefault((block.lang, n), {})
                for g, f in zip(grams, counts):
                    known[g] = known.get(g, 0) + f
            if sum(map(len, held.values())) >= HELD_PHRASES:
                yield from sent()
        yield from sent()

    return texts.mapInArrow(work, _COUNTS_DDL).groupBy("lang", "n", "g").agg(F.sum("f").alias("f"))


def words_counted(texts: DataFrame) -> DataFrame:
    """Step 1: each word and its count."""

    def counted(block: Block) -> Iterator[tuple[int, list[str], list[int]]]:
        yield 1, *block.counted(block.numbers(), np.arange(len(block.first)), 1)

    return string_counts(texts, counted)


def word_filter(frequent: DataFrame) -> Broadcast:
    """The filter of frequent words (``lang``, ``g``), by the hashes that blocks give them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            of: dict[str, list[bytes]] = {}
            for lang, g in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
                of.setdefault(lang, []).append(g)
            for lang, words in of.items():
                yield filter_words(Block(lang, words, powers).hash)

    return bloom_filter(frequent.select("lang", "g").mapInArrow(work, "i int, b long"))


def frequent_starts(block: Block, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths and first words of phrases all of whose words may be frequent."""
    known = might_hold(bits, block.hash)
    for n in range(2, LONGEST + 1):
        starts = block.starts(n)
        yield n, starts[np.logical_and.reduce([known[starts + i] for i in range(n)])]


def hashes_sent(texts: DataFrame, words: Broadcast, buckets: int) -> DataFrame:
    """Step 2, in the tasks: ``bucket, hashes, counts``, compressed, of what a task holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = (keys * np.uint64(buckets) >> _KEY_BITS).astype(np.int64)
            rows = [
                (b, squeeze(np.diff(keys[at], prepend=np.uint64(0))), squeeze(counts[at].astype(np.uint64)))
                for b, at in by_bucket(bucket)
            ]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["bucket", "hashes", "counts"],
            )

        for block in blocks(batches):
            for n, starts in frequent_starts(block, words.value):
                held.append(block.phrase_hashes(starts, n) >> (np.uint64(64) - _KEY_BITS))
            if sum(map(len, held)) >= HELD_HASHES:
                yield from sent()
        if sum(map(len, held)):
            yield from sent()

    return texts.mapInArrow(work, "bucket int, hashes binary, counts binary")


def phrase_filter(sent: DataFrame, buckets: int) -> Broadcast:
    """Step 2, per bucket: the filter of hashes that occur ``LEAST`` times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            keys = np.concatenate([np.cumsum(unsqueeze(h)) for h, _ in held])
            counts = np.concatenate([unsqueeze(c) for _, c in held]).astype(np.int64)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return filter_words(keys[first][np.add.reduceat(counts, first) >= LEAST])

        bucket, held = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if b != bucket and held:
                    yield frequent(held)
                    held = []
                bucket = b
                held.append(row)
        if held:
            yield frequent(held)

    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return bloom_filter(dealt.mapInArrow(work, "i int, b long"))


def phrases_counted(texts: DataFrame, words: Broadcast, phrases: Broadcast) -> DataFrame:
    """Step 3: each phrase that may be frequent and its count."""

    def counted(block: Block) -> Iterator[tuple[int, list[str], list[int]]]:
        number = block.numbers()
        for n, starts in frequent_starts(block, words.value):
            keys = block.phrase_hashes(starts, n) >> (np.uint64(64) - _KEY_BITS)
            yield n, *block.counted(number, starts[might_hold(phrases.value, keys)], n)

    return string_counts(texts, counted)


def frequent_counts(documents: DataFrame) -> DataFrame:
    """(``lang``, ``n``, ``g``, ``f``) of phrases with ``f >= LEAST``, and per language one row
    ``n = 0`` whose ``f`` counts all words."""
    spark = ready(documents.sparkSession)
    texts = documents.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col("text").cast("binary"))
    single = stored(words_counted(texts), "phrase-words-counted")
    totals = single.groupBy("lang").agg(F.sum("f").alias("f"))
    found = [stored(single.where(F.col("f") >= LEAST), "phrase-counts-1")]
    words = word_filter(found[0])
    size = single.agg(F.sum("f")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * (LONGEST - 1) // BUCKET_HASHES))
    phrases = phrase_filter(hashes_sent(texts, words, buckets), buckets)
    found.append(stored(phrases_counted(texts, words, phrases).where(F.col("f") >= LEAST), "phrase-counts"))
    per_lang = totals.select("lang", F.lit(0).alias("n"), F.lit(None).cast("string").alias("g"), "f")
    return reduce(DataFrame.unionByName, found, per_lang)


def _part(words: Column, start: int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counted: DataFrame) -> DataFrame:
    """Candidates with their weakest cut: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``k``, ``score``."""
    frequent = counted.where(F.col("f") >= LEAST)
    candidates = frequent.where(F.col("n") >= 2).select("lang", F.col("g").alias("phrase"), "n", F.col("f").alias("a"))
    words = F.split(F.col("phrase"), " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")).select(
        "*", _part(words, 1, F.col("k")).alias("left"), _part(words, F.col("k") + 1, F.col("n") - F.col("k")).alias("right")
    )
    lookup = frequent.select("lang", "g", "f")
    with_l = cuts.join(lookup.withColumnRenamed("g", "left").withColumnRenamed("f", "l"), ["lang", "left"])
    with_r = with_l.join(lookup.withColumnRenamed("g", "right").withColumnRenamed("f", "r"), ["lang", "right"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div cast(l + r as decimal(20,0)) as bigint)")
    weakest = F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("cut")
    return with_r.groupBy("lang", "phrase", "n", "a").agg(weakest).select(
        "lang", "phrase", "n", "a", "cut.l", "cut.r", "cut.k", "cut.score"
    )


def nested(counted: DataFrame) -> DataFrame:
    """(``lang``, ``phrase``, ``outer``): the largest count of a longer candidate holding it."""
    longer = counted.where((F.col("f") >= LEAST) & (F.col("n") >= 3))
    words = F.split(F.col("g"), " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("n") - 1),
            lambda s: F.transform(F.sequence(F.lit(1), F.col("n") - s + 1), lambda i: _part(words, i, s)),
        )
    )
    inner = longer.select("lang", "f", F.explode(spans).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("outer"))


def collocations(documents: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``k``."""
    counted = frequent_counts(documents)
    totals = counted.where(F.col("n") == 0).select("lang", F.col("f").alias("n_words"))
    counted = counted.where(F.col("n") > 0)
    kept = scored(counted).join(nested(counted), ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (F.col("outer") * 5 < F.col("a") * 4)
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("a").cast("long").alias("a"),
        F.col("l").cast("long").alias("l"),
        F.col("r").cast("long").alias("r"),
        F.col("n_words").cast("long").alias("n"),
        F.col("score").cast("long").alias("score"),
        F.col("k").cast("long").alias("cut"),
    )
