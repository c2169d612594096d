"""Near-duplicates by BagMinHash: signatures whose agreement is the weighted Jaccard similarity.

A document is a multiset of ``WIDTH``-word shingles. Each shingle of weight ``w`` is a Poisson
process of points in time on the levels ``[0, w)``; each point falls on a random register, and a
register keeps its earliest point. Two documents share exactly the points on the levels that
both have, so a register agrees with the probability of their weighted Jaccard similarity.
Levels are discretised into blocks ``[0, 1), [1, 2), [2, 4), [4, 8), ...``: a block of width v is
one process of v-fold rate whose points are split onto its levels, so a weight w costs log w
processes, not w. Points are made in order of time, and a process stops as soon as its next
point is later than all registers of its document.

Registers are banded. Bands are chosen so that a pair at the threshold is missed with a
probability under 1e-9. Documents of equal words are one text. In a bucket every text meets the
most central one, and in small buckets all meet all. Texts of larger buckets that this leaves in
several components meet by the rarest shingles of each, as many as a linked text cannot all lack
(prefix filtering), and only where the shingles that follow suffice for a link; texts of one
component do not meet. Pairs whose registers agree too rarely for the threshold are left out, and
all others are verified by the exact overlap of their multisets.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import mixed, ready, stored, stored_with_rows, unit
from tallywright.llm.components import components

WIDTH, SHARE = 5, 0.8
ROWS, BANDS = 3, 32
REGISTERS = ROWS * BANDS
#: Buckets up to this size are compared all with all.
SMALL = 8
#: Texts in a part of a component, when parts of two components meet.
BLOCK = 1024
#: Size classes of texts in a factor of e.
CLASSES = 16
#: Pairs of texts up to which all are verified at once, and the shares of more in each wave.
ONE_WAVE, WAVES = 100_000, (64, 8, 1)
#: Register agreement below which a pair is not verified: four deviations under the threshold.
AGREEMENT = 0.62

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _words(text.lower()) if text else []


def digest(words: list[str]) -> bytes | None:
    """What texts of equal words share; null for no words."""
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    return hashlib.blake2b(joined, digest_size=16).digest() if words else None


def shingle_counts(words: list[str], width: int = WIDTH) -> Counter:
    """The multiset of runs of ``width`` words; a shorter text is one shingle."""
    if not words:
        return Counter()
    starts = range(max(1, len(words) - width + 1))
    return Counter(tuple(words[i : i + width]) for i in starts)


class ShingleHashes:
    """Hashes of all shingles of a text from prefix sums of a polynomial over its bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def of(self, words: list[str], width: int = WIDTH) -> np.ndarray:
        raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        self.powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        spaces = np.flatnonzero(raw == 32)
        starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(raw)]
        width = min(width, len(words))
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (times of first points) of ``n`` documents from their weighted shingles."""
    registers = np.full(n * m, np.inf)
    if not len(owner):
        return registers.reshape(n, m)
    parts, low, block = [], 0, 0
    while (on := np.flatnonzero(weights > low)).size:
        width = max(1, low)
        parts.append((on, np.full(len(on), low), np.full(len(on), width), np.full(len(on), block)))
        low, block = low + width, block + 1
    at, low, width, block = (np.concatenate(x) for x in zip(*parts))
    own, weight = owner[at], weights[at]
    with np.errstate(over="ignore"):
        key = mixed(hashes[at] ^ mixed(block.astype(np.uint64) + np.uint64(1)))
        time, rate = np.zeros(len(at)), m * width.astype(np.float64)
        while len(own):
            key = key + _STEP
            first = mixed(key)
            time = time - np.log(unit(first)) / rate
            second = mixed(first ^ _STEP)
            register = (second % np.uint64(m)).astype(np.int64)
            level = low + unit(mixed(second + _STEP)) * width
            counts = level <= weight
            np.minimum.at(registers, own[counts] * m + register[counts], time[counts])
            latest = registers.reshape(n, m).max(axis=1)
            live = time < latest[own]
            own, key, time, rate = own[live], key[live], time[live], rate[live]
            low, width, weight = low[live], width[live], weight[live]
    return registers.reshape(n, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and document."""
    bits = mixed(np.ascontiguousarray(registers).view(np.uint64))
    bits = bits.reshape(len(registers), BANDS, ROWS)
    keys = np.zeros((len(registers), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys ^ bits[:, :, r])
    return keys.view(np.int64)


def signed(documents: DataFrame) -> DataFrame:
    """``row, doc_id, copy, signature, bands`` of ``row, doc_id, text``.

    ``copy`` is a digest of the words and null for a text without words, which is nobody's copy.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHashes()
        for batch in batches:
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            n = len(texts)
            owner, hashes, weights, copies = [], [], [], []
            for i, words in enumerate(texts):
                if words:
                    distinct, counts = np.unique(hasher.of(words), return_counts=True)
                    owner.append(np.full(len(distinct), i))
                    hashes.append(distinct)
                    weights.append(counts)
                copies.append(digest(words))
            if owner:
                registers = signatures(*map(np.concatenate, (owner, hashes, weights)), n)
            else:
                registers = np.full((n, REGISTERS), np.inf)
            short = (mixed(np.ascontiguousarray(registers).view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
            keys = band_keys(registers)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(copies, pa.binary()),
                    pa.array([s.tobytes() for s in short], pa.binary()),
                    pa.array([k if c else [] for k, c in zip(keys, copies)], pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "copy", "signature", "bands"],
            )

    return documents.mapInArrow(
        work, "row long, doc_id long, copy binary, signature binary, bands array<long>"
    )


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of rows whose registers agree often enough to be verified."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (2, 3)
            )
            near = (left == right).mean(axis=1) >= AGREEMENT
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"]
            )

    of = lambda c: texts.select(F.col("row").alias(c), F.col("signature").alias(f"of_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, share: float = SHARE) -> DataFrame:
    """Pairs of rows whose shingle multisets overlap by ``share`` or more, compared as texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, left, right in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if last[0] != a:
                    last = (a, shingle_counts(words_of(left)))
                one, two = last[1], shingle_counts(words_of(right))
                small, large = (one, two) if len(one) <= len(two) else (two, one)
                both = sum(min(n, large[s]) for s, n in small.items() if s in large)
                keep.append(both >= share * (one.total() + two.total() - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"]
            )

    of = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"of_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long")


def with_pivots(members: DataFrame) -> DataFrame:
    """Add how central each text is, and the most central text of each bucket as its pivot.

    A text is as central as its buckets are large: the original of a group of near copies
    shares more of its bands with them than they share with each other.
    """
    weight = members.groupBy("row").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "row")
    best = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("row")).alias("row"))).alias("best"))
    pivots = best.select("key", (-F.col("best.row")).alias("pivot"))
    return weighed.join(pivots, "key")


def first_pairs(members: DataFrame) -> DataFrame:
    """Pairs of every text with the pivot of its buckets, and all pairs of small buckets."""
    star = members.where(F.col("row") != F.col("pivot")).select(
        F.least("pivot", "row").alias("a"), F.greatest("pivot", "row").alias("b")
    )
    small = (
        members.where((F.col("n") > 2) & (F.col("n") <= SMALL))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
    )
    pairs = (
        small.select("rows", F.posexplode("rows").alias("i", "a"))
        .select("a", F.explode(F.slice("rows", F.col("i") + 2, F.size("rows"))).alias("b"))
    )
    return star.union(pairs).distinct()


def mixed_texts(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, label, part`` of the texts of larger buckets that hold texts of two components.

    ``part`` deals a large component into parts of about ``BLOCK`` texts. A text's label is
    looked up once, not once for each of its buckets.
    """
    held = members.where(F.col("n") > SMALL).groupBy("row").agg(F.collect_list("key").alias("keys"))
    named = stored(
        held.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row")),
        "large-buckets",
    )
    dealt = named.select("row", "label", F.explode("keys").alias("key"))
    several = dealt.groupBy("key").agg((F.min("label") < F.max("label")).alias("several")).where("several")
    texts = stored(dealt.join(several, "key", "left_semi").select("row", "label").distinct(), "mixed-texts")
    parts = texts.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return texts.join(parts, "label").select(
        "row", "label", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")
    )


def shingle_tokens(texts: DataFrame) -> DataFrame:
    """``row, label, part, n, tokens``: the ``n`` shingles of a text as a set.

    A token stands for a shingle and its how-manieth occurrence, so that shared tokens are the
    overlap of the multisets. Equal hashes of different shingles only raise that.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHashes()
        for batch in batches:
            tokens = []
            for text in batch.column(3).to_pylist():
                distinct, counts = np.unique(hasher.of(words_of(text)), return_counts=True)
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                tokens.append(mixed(np.repeat(distinct, counts) + nth.astype(np.uint64) * _STEP).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([len(x) for x in tokens], pa.int64()),
                    pa.array(tokens, pa.list_(pa.int64())),
                ],
                names=["row", "label", "part", "n", "tokens"],
            )

    return texts.select("row", "label", "part", "text").mapInArrow(
        work, "row long, label long, part long, n long, tokens array<long>"
    )


def prefixes(tokens: DataFrame, share: float) -> DataFrame:
    """``token, row, label, part, n, reach``: the rarest tokens of each text.

    Two texts of ``m`` and ``n`` tokens are linked if they share ``share / (1 + share) * (m + n)``.
    All texts hold their tokens in one order: those that one component alone has, which no pair
    to be found shares, then rarest first. Tokens shared by a pair do not come before its first
    shared one, so if that is the text's i-th, at most ``n - i`` are shared (i from 0), and the
    other text has at most ``reach`` tokens. A text is given with all tokens that
    leave a reach of ``share * n``, the smallest size of a partner.
    """
    held = tokens.select("row", "label", F.explode("tokens").alias("token"))
    common = (
        held.groupBy("token")
        .agg(F.count("*").alias("texts"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("token", "texts")
    )
    kept = held.select("row", "token").join(common, "token").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("texts", "token"))).alias("kept")
    )
    placed = tokens.drop("tokens").join(kept, "row").select(
        "row", "label", "part", "n", (F.col("n") - F.size("kept")).alias("alone"), F.posexplode("kept").alias("i", "of")
    )
    reach = (1 + share) / share * (F.col("n") - F.col("alone") - F.col("i")) - F.col("n") + 0.001
    return placed.select("of.token", "row", "label", "part", "n", reach.alias("reach")).where(
        F.col("reach") >= share * F.col("n")
    )


def size_class(n: Column) -> Column:
    """Sizes in classes of a constant ratio."""
    return F.floor(F.log(n) * CLASSES).cast("long")


def sides(held: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`prefixes` as the larger and as the smaller text of a pair.

    They meet by token and ``size``, the class of the smaller one's size.
    """
    most = F.least(F.col("n").cast("double"), F.col("reach"))
    classes = F.sequence(size_class(F.greatest(share * F.col("n") - 0.001, F.lit(0.5))), size_class(most))
    large = held.withColumn("size", F.explode(classes))
    small = held.where(F.col("reach") >= F.col("n")).withColumn("size", size_class(F.col("n")))
    return large, small


def meeting(large: DataFrame, small: DataFrame) -> DataFrame:
    """Parts of two components that can hold a pair: ``token, size``, both labels and parts.

    Every part is met as one row with its smallest size and longest reach, so texts of one
    component are not compared with each other. ``most`` is the number of pairs of texts.
    """

    def parts(side: DataFrame, of: str) -> DataFrame:
        return side.groupBy("token", "size", "label", "part").agg(
            F.min("n").alias(f"{of}_n"), F.max("reach").alias(f"{of}_reach"), F.count("*").alias(f"{of}_texts")
        ).withColumnsRenamed({"label": f"{of}_label", "part": f"{of}_part"})

    both = parts(large, "large").join(parts(small, "small"), ["token", "size"])
    apart = F.col("large_label") != F.col("small_label")
    within = (F.col("small_n") <= F.col("large_reach")) & (F.col("large_n") <= F.col("small_reach"))
    return both.where(apart & within).select(
        "token", "size", "large_label", "large_part", "small_label", "small_part",
        (F.col("large_texts") * F.col("small_texts")).alias("most"),
    )


def unconnected_pairs(large: DataFrame, small: DataFrame, met: DataFrame, one_of: int) -> DataFrame:
    """All pairs ``a, b`` of two components that can be linked, or one of ``one_of`` of them."""

    def texts(side: DataFrame, of: str) -> DataFrame:
        return side.withColumnsRenamed({c: f"{of}_{c}" for c in ("label", "part", "row", "n", "reach")})

    of = lambda side: [f"{side}_label", f"{side}_part"]
    both = met.drop("most").join(texts(large, "large"), ["token", "size", *of("large")]).join(
        texts(small, "small"), ["token", "size", *of("small")]
    )
    a, b = F.least("large_row", "small_row"), F.greatest("large_row", "small_row")
    within = (F.col("small_n") <= F.col("large_reach")) & (F.col("large_n") <= F.col("small_reach"))
    turn = F.pmod(F.xxhash64(a, b), F.lit(one_of)) == 0
    return both.where(within & turn).select(a.alias("a"), b.alias("b")).distinct()


def relabelled(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of :func:`prefixes` under the components that ``labels`` say."""
    named = held.drop("label").join(labels.withColumnRenamed("node", "row"), "row", "left")
    return named.withColumn("label", F.coalesce("label", "row"))


def classes(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """``row, doc_id, copy, class_id, leader`` of every row of ``documents``.

    ``class_id`` is the lowest ``doc_id`` of the documents connected to this one by
    similarities of at least ``share``; ``leader`` marks the first row of each class. A text
    without words is a class of its own, as is a text in no pair; null texts have no words.
    Rows of equal ids are documents of their own, and rows without an id take part too.
    """
    return classes_of(stored_with_rows(documents.select("doc_id", "text")), share)


def classes_of(numbered: DataFrame, share: float) -> DataFrame:
    """:func:`classes` of a table of :func:`stored_with_rows`."""
    ready(numbered.sparkSession)
    own = numbered.select("row", F.col("rest.doc_id").cast("long").alias("doc_id"), F.col("rest.text").alias("text"))
    rows = stored(signed(own), "signed")
    copies = rows.where(F.col("copy").isNotNull()).groupBy("copy").agg(F.min("row").alias("text"))
    copies = stored(copies, "copies")
    firsts = stored(
        rows.join(copies.select(F.col("text").alias("row")), "row").select("row", "signature", "bands"), "firsts"
    )
    keys = firsts.select("row", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = with_pivots(stored(keys.join(buckets, "key"), "shared-keys"))
    members = stored(members, "members")
    pairs = stored(first_pairs(members), "pairs")
    near = stored(agreeing(pairs, firsts), "near")

    wanted = members.select("row").distinct()
    texts = stored(own.select("row", "text").join(wanted, "row"), "texts")
    edges = stored(verified(near, texts, share), "edges")
    labels = stored(components(edges), "labels")

    # What the pivots have left apart meets by shared rare tokens. Of many pairs a few are verified
    # first, as those that these connect need not be.
    left = mixed_texts(members, labels)
    tokens = stored(shingle_tokens(texts.join(left, "row")), "tokens")
    held = stored(prefixes(tokens, share), "prefixes")
    met = stored(meeting(*sides(held, share)), "meeting")
    count = met.agg(F.coalesce(F.sum("most"), F.lit(0)).alias("n")).first()["n"]
    for one_of in () if not count else WAVES if count > ONE_WAVE else (1,):
        large, small = sides(held, share)
        apart = stored(unconnected_pairs(large, small, met, one_of), "apart")
        found = stored(verified(agreeing(apart, firsts), texts, share), "edges")
        if one_of > 1 and not found.isEmpty():
            edges = edges.union(found)
            labels = stored(components(edges), "labels")
            held = stored(relabelled(held, labels), "prefixes")
            met = stored(meeting(*sides(held, share)), "meeting")
    if count and not found.isEmpty():
        labels = stored(components(edges.union(found)), "labels")

    text_label = copies.join(labels, copies["text"] == labels["node"], "left").select(
        "copy", F.coalesce("label", "text").alias("label")
    )
    labelled = stored(
        rows.select("row", "doc_id", "copy")
        .join(text_label, "copy", "left")
        .withColumn("label", F.coalesce("label", "row")),
        "labelled",
    )
    heads = labelled.groupBy("label").agg(
        F.min("doc_id").alias("class_id"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"),
    )
    return labelled.join(heads, "label").select(
        "row", "doc_id", "copy", "class_id", (F.col("row") == F.col("head.row")).alias("leader")
    )


def keep_first(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """``documents``, all columns, with one row of each class: its lowest id, then its first row."""
    numbered = stored_with_rows(documents)
    dropped = stored(classes_of(numbered, share).where(~F.col("leader")).select("row"), "dropped")
    return numbered.join(dropped, "row", "left_anti").select("rest.*")
