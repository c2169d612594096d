"""Document quality by attention over passages, learnt from labels of whole documents.

A document is a bag of passages. Each passage is encoded by hashed counts of its byte pairs and
triples and some measures of its shape. A small network maps a passage to a hidden vector, gated
attention (the product of a tanh and a sigmoid branch) gives each passage a weight, the weights
of a document sum to 1, and the weighted vector is scored by logistic regression. Only labels
of documents are known, so training finds by itself which passages matter.

Training uses at most ``SAMPLE`` labelled documents, those with the lowest hashes of their ids,
and of these the first whose passages together stay within ``SAMPLE_PASSAGES`` (the first one
always). Every passage of a chosen document is learnt from, and scoring reads every passage of
every document. Both bounds are on whole labelled rows, so that the driver's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import binary_texts, bucket_of, ready

#: Bytes of a passage, and of the hashed encoding.
PASSAGE = 600
BUCKETS = 256
#: Bounds of training: labelled documents, and the passages of all of them together.
SAMPLE = 6000
SAMPLE_PASSAGES = 100_000
HIDDEN, ATTENTION = 32, 16
EPOCHS, RATE, DECAY, GROUP = 30, 4e-3, 1e-4, 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, np.int64)  # 0 signs, 1 small, 2 capitals, 3 digits, 4 spaces, 5 line ends, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[_SPACE], _KIND[10] = 4, 5
SHAPES = 7 + 5
FEATURES = BUCKETS + SHAPES


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of ``texts``, and the text of each. Empty texts have one."""
    features, owner = [], []
    for i, text in enumerate(texts):
        raw = np.frombuffer(text or b" ", np.uint8)
        n = max(1, -(-len(raw) // PASSAGE))
        at = np.minimum(np.arange(len(raw)) // PASSAGE, n - 1)
        sizes = np.bincount(at, minlength=n).astype(np.float32)
        small = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int64)
        counts = np.zeros(n * BUCKETS)
        if len(raw) > 2:
            pair = small[:-1] * 31 + small[1:]
            triple = (pair[:-1] * 7919 + small[2:] * 104729) % 65521 % BUCKETS
            counts += np.bincount(at[2:] * BUCKETS + triple, minlength=n * BUCKETS)
            counts += np.bincount(at[1:] * BUCKETS + pair % 8191 % BUCKETS, minlength=n * BUCKETS)
        hashed = np.sqrt(counts.reshape(n, BUCKETS).astype(np.float32))
        hashed /= np.linalg.norm(hashed, axis=1, keepdims=True) + 1e-6
        kinds = np.bincount(at * 7 + _KIND[raw], minlength=n * 7).reshape(n, 7) / sizes[:, None]
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        whole = np.array(
            [
                len(set(words)) / max(1, len(words)),
                sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words)),
                len(set(lines)) / max(1, len(lines)),
                len(text) / max(1, len(words)) / 10.0,
                np.log1p(len(text)) / 10.0,
            ]
        )
        features.append(np.hstack([4 * hashed, 3 * kinds, np.tile(whole, (n, 1))]).astype(np.float32))
        owner.append(np.full(n, i))
    if not features:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    return np.vstack(features), np.concatenate(owner)


@dataclass
class Attention:
    """Weights of the network; :meth:`forward` works on the passages of many documents."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 11) -> Attention:
        random = np.random.default_rng(seed)
        shapes = {
            "encode": (FEATURES, HIDDEN),
            "tanh": (HIDDEN, ATTENTION),
            "gate": (HIDDEN, ATTENTION),
            "weigh": (ATTENTION, 1),
            "score": (HIDDEN, 1),
        }
        weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in shapes.items()}
        weights |= {"encode_0": np.zeros(HIDDEN, np.float32), "score_0": np.zeros(1, np.float32)}
        return cls(weights)

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
        e = ((t * g) @ w["weigh"])[:, 0]
        top = np.full(n, -np.inf, np.float32)
        np.maximum.at(top, owner, e)
        a = np.exp(e - top[owner])
        a /= np.bincount(owner, weights=a, minlength=n)[owner]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, owner, a[:, None] * h)
        p = sigmoid(z @ w["score"] + w["score_0"])[:, 0]
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p}

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        w, n = self.weights, len(y)
        wrong = (f["p"] - y)[:, None] / n
        dz = wrong @ w["score"].T
        da = (dz[owner] * f["h"]).sum(axis=1)
        mean = np.bincount(owner, weights=f["a"] * da, minlength=n)
        de = (f["a"] * (da - mean[owner]))[:, None]
        dtg = de @ w["weigh"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz[owner] + dt @ w["tanh"].T + dg @ w["gate"].T
        dh *= 1 - f["h"] ** 2
        return {
            "encode": x.T @ dh,
            "encode_0": dh.sum(axis=0),
            "tanh": f["h"].T @ dt,
            "gate": f["h"].T @ dg,
            "weigh": (f["t"] * f["g"]).T @ de,
            "score": f["z"].T @ wrong,
            "score_0": wrong.sum(axis=0),
        }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def bag(text: bytes) -> np.ndarray:
    """Encodings of all passages of the text."""
    return encode([text])[0]


def passages_of(text: Column) -> Column:
    """Number of passages that :func:`encode` makes of a text: one at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / PASSAGE)).cast("long")


def within(counts: list[int], budget: int) -> int:
    """How many of the first rows fit ``budget`` passages together; the first one always."""
    total = 0
    for taken, n in enumerate(counts):
        total += n
        if total > budget and taken > 0:
            return taken
    return len(counts)


def train(bags: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Attention:
    """Fit the network by Adam. Both labels weigh as often as they occur."""
    model, random = Attention.new(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        # Nothing to tell apart: the share of the label is the score of every text.
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        model.weights["score"][:] = 0
        model.weights["score_0"][:] = np.log(share / (1 - share))
        return model
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second, step = {k: np.zeros_like(v) for k, v in model.weights.items()}, 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = random.permutation(len(bags))
        for at in range(0, len(order), GROUP):
            part, step = order[at : at + GROUP], step + 1
            x = np.vstack([bags[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            f = model.forward(x, owner, len(part))
            for k, g in model.gradients(x, owner, y[part], f).items():
                w = model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.weights[k] = (w - rate * (move + DECAY * w)).astype(np.float32)
    return model


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows never learnt from. Rows without an id have no label either."""
    return F.coalesce(bucket_of(doc_id, folds) == fold, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, bound: int) -> list[tuple[np.ndarray, int]]:
    """At most ``bound`` bags and labels of rows to learn from, lowest hashes of ids first, and of
    these as many as fit ``SAMPLE_PASSAGES`` passages together (:func:`within`); a bag holds
    every passage of its text.

    An id with several labels counts for each of them once, so that of contradicting ones none
    wins; ids and labels that are null, and labels but 0 and 1, do not count.
    """
    mark = F.col("quality").cast("int")
    known = (
        labels.where(F.col("doc_id").isNotNull() & mark.isin(0, 1))
        .select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("quality"))
        .where(~held_out(F.col("doc_id")))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(bound)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t).astype(np.float16).tobytes() for t in binary_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bags, pa.binary())],
                names=["doc_id", "quality", "bag"],
            )

    # At most ``bound`` rows of two numbers are sent to the tasks, and as many numbers of
    # passages come back; the rows that fit the passage budget are then encoded.
    candidates = texts.join(F.broadcast(known), "doc_id").select(
        "doc_id", "quality", "text", passages_of(F.col("text")).alias("n")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality"), F.col("n"), F.sha2(F.col("text"), 256)]
    counts = [r["n"] for r in candidates.orderBy(*order).limit(bound).select("n").collect()]
    taken = within(counts, SAMPLE_PASSAGES)
    if not taken:
        return []
    rows = (
        candidates.orderBy(*order)
        .limit(taken)
        .select("doc_id", "quality", "text")
        .mapInArrow(work, "doc_id long, quality int, bag binary")
        .collect()
    )
    shape = (-1, FEATURES)
    return [
        (np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(shape), r["quality"]) for r in rows
    ]


def scores(network: Attention, texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts, a megabyte or so of them at a time."""
    out, group, size = [np.zeros(0)], [], 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size > 1_000_000 or i == len(texts) - 1:
            x, owner = encode(group)
            out.append(network.forward(x, owner, len(group))["p"])
            group, size = [], 0
    return np.concatenate(out)


def with_scores(documents: DataFrame, model: Attention) -> DataFrame:
    """``row, score`` beside the given ``row`` and ``text`` of every document."""
    spark = documents.sparkSession
    send = spark.sparkContext.broadcast(model.weights)
    kind = documents.schema["row"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Attention(send.value)
        for batch in batches:
            values = scores(network, binary_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64())], names=["row", "score"]
            )

    return documents.select("row", "text").mapInArrow(work, f"row {kind.simpleString()}, score double")


def keep_good(documents: DataFrame, labels: DataFrame, least: float, sample: int = SAMPLE) -> DataFrame:
    """``documents``, all columns, without those that score below ``least``."""
    spark = ready(documents.sparkSession)
    bags = labelled(documents, labels, sample)
    model = train([x for x, _ in bags], [y for _, y in bags])
    send, at = spark.sparkContext.broadcast(model.weights), documents.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Attention(send.value)
        for batch in batches:
            good = scores(network, binary_texts(batch.column(at))) >= least
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(work, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text of ``documents``.

    ``labels`` has ``doc_id`` and ``quality``. Empty and null texts are scored as an empty text.
    Repeated rows and null ids give a row each. Without labels every score is 0.5.
    """
    ready(documents.sparkSession)
    bags = labelled(documents, labels, sample)
    model = train([x for x, _ in bags], [y for _, y in bags])
    rows = documents.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text")
    scored = with_scores(rows, model)
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
