"""Document likelihood by a subword lattice: all segmentations count, not the best one alone.

An existing vocabulary of pieces gives the lattice: every way to cut a word into pieces is a
path, and the forward recursion in log space sums the paths. Its pieces are ordered by merge
rank, which gives the first scores; expectation maximisation over the distinct words of all
training rows, with expected piece counts from the forward and backward recursions, gives the
final ones. One more arc spans a word of the training rows as a whole. Its weight is the word's
share of all tokens after an absolute discount, and the discounts together are the weight of
the paths of pieces: ``p(word) = (c - d) / N + d V / N * lattice(word)``. Words and the end of
a text have probabilities that sum to 1, so the model is a distribution over texts.

No piece crosses a space, so a document's lattice falls apart into its words: each is scored
once per process, and the marginal of a document is the sum over its words and the end.

Word counts cover all training rows. Words are joined to documents in two ways: those above a
``1 / HOT_WORDS`` share of all tokens are at most ``HOT_WORDS`` in number and go to every task;
all others are joined by Spark, so no key of that join is hot.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import bucket_of, ready, stored

#: At most so many words are frequent enough to be sent to every task.
HOT_WORDS = 400_000
EM_ROUNDS = 3
#: Expected count that every piece has beforehand.
PRIOR = 0.05
#: Words of a task that are counted or scored at a time, which bounds its memory.
HELD_WORDS = 300_000
CACHE_WORDS = 400_000
#: Words whose lattices are worked out together; many words of one length share the steps.
WORDS_AT_ONCE = 60_000

#: What separates words, and the letters that are made small.
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOG10 = math.log(10.0)


def words_of(text: bytes) -> list[bytes]:
    return _WORDS(text.translate(_LOWER))


class Lattice:
    """A vocabulary as a trie over bytes; piece 0 is the end of a text.

    Pieces are those of the vocabulary that a lower-cased word can hold, and all single bytes,
    so every word has a segmentation. A word starts with a space, as its first pieces do.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, int] = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            text = model.id_to_piece(i)
            raw = text.replace("▁", " ").encode()
            if b" " not in raw[1:] and raw == raw.translate(_LOWER):
                pieces.setdefault(raw, i)
        for b in range(256):
            if b not in (9, 10, 11, 12, 13) and not 65 <= b <= 90:
                pieces.setdefault(bytes([b]), model.get_piece_size() + b)
        self.pieces = [b"", *sorted(pieces, key=pieces.__getitem__)]
        children: list[dict[int, int]] = [{}, {}]
        final = [-1, -1]
        for number, piece in enumerate(self.pieces[1:], 1):
            node = 1
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    final.append(-1)
                node = children[node][b]
            final[node] = number
        self.child = np.zeros((len(children), 256), np.int32)
        for node, to in enumerate(children):
            for b, n in to.items():
                self.child[node, b] = n
        self.final = np.array(final)
        self.depth = max(map(len, self.pieces))

    def first_scores(self) -> np.ndarray:
        """Log probabilities that fall with the merge rank."""
        weight = 1.0 / (np.arange(len(self.pieces)) + 10.0)
        return np.log(weight / weight.sum())

    def node_scores(self, scores: np.ndarray) -> np.ndarray:
        return np.where(self.final >= 0, scores[np.maximum(self.final, 0)], -np.inf)

    def spans(self, words: np.ndarray, node_scores: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``start, end, nodes, scores`` of all spans that are a piece in one of the words."""
        n, length = words.shape
        for start in range(length):
            node = np.ones(n, np.int32)
            for end in range(start + 1, min(length, start + self.depth) + 1):
                node = self.child[node, words[:, end - 1]]
                if not node.any():
                    break
                score = node_scores[node]
                yield start, end, node, score

    def forward(self, words: np.ndarray, node_scores: np.ndarray) -> np.ndarray:
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        for start, end, _, score in self.spans(words, node_scores):
            np.logaddexp(alpha[end], alpha[start] + score, out=alpha[end])
        return alpha

    def marginals(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, over all segmentations."""
        node_scores, out = self.node_scores(scores), np.empty(len(words))
        for at, block in by_length(words):
            out[at] = self.forward(block, node_scores)[-1]
        return out

    def expected(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over the words."""
        node_scores, uses = self.node_scores(scores), np.zeros(len(self.child))
        for _, block in by_length(words):
            spans = list(self.spans(block, node_scores))
            alpha = np.full((block.shape[1] + 1, len(block)), -np.inf)
            beta = alpha.copy()
            alpha[0] = beta[-1] = 0.0
            for start, end, _, score in spans:
                np.logaddexp(alpha[end], alpha[start] + score, out=alpha[end])
            for start, end, _, score in reversed(spans):
                np.logaddexp(beta[start], beta[end] + score, out=beta[start])
            rest = -alpha[-1]
            for start, end, node, score in spans:
                use = np.exp(alpha[start] + score + beta[end] + rest)
                uses += np.bincount(node, weights=use, minlength=len(uses))
        out = np.zeros(len(self.pieces))
        ends = self.final > 0
        out[self.final[ends]] = uses[ends]
        return out


def by_length(words: list[bytes], cells: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and byte matrices of words of one length, each word after a space."""
    if not words:
        return
    lengths = np.array([len(w) + 1 for w in words])
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            length = lengths[group[0]]
            step = max(1, cells // length)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                raw = b"".join(b" " + words[k] for k in part)
                yield part, np.frombuffer(raw, np.uint8).reshape(len(part), length)


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def is_training(doc_id: Column, folds: int = 10) -> Column:
    """Rows to learn from: all but one fold. Rows without an id are not learnt from."""
    return F.coalesce(bucket_of(doc_id, folds) != 0, F.lit(False))


def word_counts(documents: DataFrame) -> DataFrame:
    """``word, c`` over all rows of ``text``; the empty word counts ends of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            keys, values = list(held), list(held.values())
            for i in range(0, len(keys), 8192):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i : i + 8192], pa.binary()), pa.array(values[i : i + 8192], pa.int64())],
                    names=["word", "c"],
                )
            held.clear()

        for batch in batches:
            texts = batch.column(0).to_pylist()
            held[b""] += len(texts)
            for text in texts:
                if text:
                    held.update(words_of(text))
            if len(held) > HELD_WORDS:
                yield from rows()
        yield from rows()

    parts = documents.select(F.col("text").cast("binary")).mapInArrow(work, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces after ``rounds`` of expectation maximisation."""
    scores = lattice(path).first_scores()

    def round_of(scores: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, held = lattice(path), []
            uses = np.zeros(len(model.pieces))
            for batch in batches:
                words = [w for w in batch.column(0).to_pylist() if w]
                uses[0] += batch.num_rows - len(words)
                held += words
                if len(held) > WORDS_AT_ONCE:
                    uses += model.expected(held, scores)
                    held = []
            uses += model.expected(held, scores)
            if uses.any():
                used = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array(uses[used], pa.float64())], names=["piece", "uses"]
                )

        return work

    for _ in range(rounds):
        parts = counts.mapInArrow(round_of(scores), "piece int, uses double")
        rows = parts.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(scores), PRIOR)
        for row in rows:
            uses[row["piece"]] += row["uses"]
        scores = np.log(uses / uses.sum())
    return scores


class WordScores:
    """Log10 lattice marginals of words, each worked out once as long as there is room."""

    def __init__(self, path: str, scores: np.ndarray):
        self.model, self.scores, self.known = lattice(path), scores, {}

    def of(self, words: set[bytes]) -> dict[bytes, float]:
        unknown = sorted(words.difference(self.known))
        new = dict(zip(unknown, (self.model.marginals(unknown, self.scores) / LOG10).tolist()))
        if len(self.known) + len(new) <= CACHE_WORDS:
            self.known.update(new)
            return self.known
        return {w: self.known[w] for w in words if w in self.known} | new

    def end(self) -> float:
        """That a text ends where a word could start: log10 share of the end in both."""
        inside = sum(
            math.exp(s) for p, s in zip(self.model.pieces[1:], self.scores[1:]) if p[:1] != b" "
        )
        return (self.scores[0] - math.log(max(1.0 - inside, 1e-12))) / LOG10


class Smoothing:
    """Totals of the training tokens and what follows from them.

    The discount comes from the numbers of words that occur once and twice, as usual for
    absolute discounting. Without training tokens only the lattice counts.
    """

    def __init__(self, tokens: int, distinct: int, once: int, twice: int):
        self.tokens, self.distinct = tokens, distinct
        self.discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.paths = self.discount * distinct / tokens if tokens else 1.0
        self.denominator = tokens + 0.1 * (distinct + 1)

    def base(self, c: int) -> float:
        return math.log10((c + 0.1) / self.denominator)

    def word(self, c: int, marginal: float) -> float:
        if not c:
            return math.log10(self.paths) + marginal
        return math.log10((c - self.discount) / self.tokens + self.paths * 10.0**marginal)


def score(documents: DataFrame, vocabulary: str, learn: Column | None = None) -> DataFrame:
    """Log10 probability of every whole text, beside a smoothed word-frequency baseline.

    ``vocabulary`` is the path of a piece vocabulary. ``learn`` marks the rows to learn from (by
    default all folds of ``doc_id`` but one). Returns ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``; tokens are lower-cased words and one end per text.

    Null texts are empty: one token, the end. Each row is scored by itself, so repeated rows
    and ids stay. Without training rows all counts are 0 and pieces keep their first scores.
    """
    spark: SparkSession = ready(documents.sparkSession)
    learn = is_training(F.col("doc_id")) if learn is None else learn
    text = F.col("text").cast("binary").alias("text")
    rows = documents.select(F.col("doc_id").cast("long"), text, learn.alias("learn"))
    counts = stored(word_counts(rows.where("learn")), "word-counts")
    number = lambda k: F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), number(1), number(2)).first()
    smoothing = Smoothing(*map(int, total))
    tokens = smoothing.tokens
    scores = fit(counts, vocabulary, EM_ROUNDS if tokens else 0)
    floor = max(1, -(-tokens // HOT_WORDS))
    is_hot = (F.col("c") >= floor) | (F.octet_length("word") == 0)
    hot = {bytes(r["word"]): r["c"] for r in counts.where(is_hot).collect()} if tokens else {}
    send = spark.sparkContext.broadcast((hot, scores))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, scores = send.value
        words = WordScores(vocabulary, scores)
        base = {w: smoothing.base(c) for w, c in hot.items()}
        full = dict(zip(hot, map(smoothing.word, hot.values(), map(words.of(set(hot)).__getitem__, hot))))
        end_known = b"" in hot
        end_base = smoothing.base(hot.get(b"", 0))
        end = smoothing.word(hot.get(b"", 0), words.end())
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            found = [words_of(t) if t else [] for t in batch.column(1).to_pylist()]
            distinct_words: set[bytes] = set()
            for w in found:
                distinct_words.update(w)
            value = words.of(distinct_words)
            out: list[tuple] = []
            for doc_id, learnt, mine in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), found):
                row += 1
                known, part, whole = int(end_known), end_base, end
                rare: Counter[bytes] = Counter()
                for w in mine:
                    b = base.get(w)
                    if b is None:
                        rare[w] += 1
                    else:
                        part += b
                        whole += full[w]
                        known += 1
                # The row of the document itself has a key that no word can have.
                out.append((row, b" %d" % row, 0, doc_id, not learnt, len(mine) + 1, known, part, whole))
                out += [(row, w, n, None, None, None, None, None, value[w]) for w, n in rare.items()]
            for i in range(0, len(out), 16384):
                columns = list(zip(*out[i : i + 16384]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS
                )

    parts = rows.mapInArrow(
        work,
        "row long, word binary, n int, doc_id long, held_out boolean, n_tokens long, "
        "n_known long, base double, score double",
    )
    joined = parts.join(counts.where(~is_hot), "word", "left")
    n, c, lattice_score = F.col("n").cast("double"), F.col("c"), F.col("score")
    counted = F.coalesce(c, F.lit(0))
    own = F.col("n_tokens").isNotNull()
    base = F.when(own, F.col("base")).otherwise(n * F.log10((counted + 0.1) / smoothing.denominator))
    known = F.when(own, F.col("n_known")).when(c.isNotNull(), F.col("n")).otherwise(0)
    seen = F.log10((c - smoothing.discount) / (tokens or 1) + smoothing.paths * F.pow(F.lit(10.0), lattice_score))
    unseen = F.lit(math.log10(smoothing.paths)) + lattice_score
    whole = F.when(own, lattice_score).otherwise(n * F.when(c.isNotNull(), seen).otherwise(unseen))
    return (
        joined.select(
            "row", "doc_id", "held_out", "n_tokens", known.alias("k"), base.alias("b"), whole.alias("s")
        )
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("k").cast("long").alias("n_known"),
            F.sum("b").alias("base_score"),
            F.sum("s").alias("score"),
        )
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(tokens).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )


_PARTS = pa.schema(
    [("row", pa.int64()), ("word", pa.binary()), ("n", pa.int32()), ("doc_id", pa.int64())]
    + [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    + [("base", pa.float64()), ("score", pa.float64())]
)
