"""Whitening of integer embeddings by the eigenvectors of their exact covariance.

One distributed pass sums, per task and in exact integers, the count, the sums ``S`` and the
cross products of the vectors (entries shifted by a constant, which no covariance sees); Spark
adds the partial sums up as 38-digit decimals. Only these ``1 + d + d*d`` numbers reach the
driver: their size is bounded by the dimension, never by the rows.

The eigenvectors: a float32 decomposition first, then the iterative refinement of Ogita and
Aishima, whose matrix products run in extended precision (``numpy.longdouble``): with
``R = I - X'X`` and ``S = X'AX`` the eigenvalues are ``s_ii / (1 - r_ii)`` and the correction is
``E_ij = (s_ij + l_j r_ij) / (l_j - l_i)``, or ``r_ij / 2`` where two eigenvalues lie closer than
the method's bound. Such a cluster is settled afterwards by a sub-solve: the eigenvectors of the
small matrix ``X_c' A X_c`` rotate the cluster's columns. A second pass over the rows then gives
each row's projections, worked out in tasks with numpy.

Defined results for odd input:

* rows whose vector is null, empty, holds a null or a non-finite entry, or whose length is not
  the most common one (ties: the longer) take no part and give no row; an empty table or one
  without any such vector gives an empty result;
* repeated rows are rows of the fit list like any other; ties of eigenvalues are settled by
  the cluster sub-solve, so that components stay orthonormal;
* each component's sign is fixed so that its entry of largest magnitude is positive;
* a component whose eigenvalue is not above zero has no finite whitened value and is not returned;
* a null ``vec_id`` is a row like any other and keeps its null; other columns are ignored,
  whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: scale and offset of the integer entries, number of components.
#: ``OFFSET`` is added by the contract and taken away again here: no covariance, deviation or
#: centred value depends on it, and the shifted entries keep the exact sums small.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Refinement steps at most; they stop early once the correction is at the rounding level.
STEPS = 8


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(``vec_id``, ``x``) of rows that take part, ``x`` the shifted integers ``floor(64 c)``; and ``d``."""
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    clean = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)
    lengths = clean.groupBy(F.size("embedding").alias("d")).count().collect()
    if not lengths:
        return clean.select("vec_id", F.array().cast("array<bigint>").alias("x")), 0
    d = max(lengths, key=lambda r: (r["count"], r["d"]))["d"]
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return clean.where(F.size("embedding") == d).select("vec_id", x.alias("x")), d


def _exact_sums(d: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, d)
            n += x.shape[0]
            sums += x.sum(axis=0, dtype=object)
            if np.abs(x).max(initial=0) < (1 << 26) and x.shape[0] <= 512:
                cross += (x.T @ x).astype(object)
            else:
                big = x.astype(object)
                cross += big.T @ big
        if n == 0:
            return
        i, j = np.indices((d, d))
        values = [int(v) for v in cross.ravel()] + [int(v) for v in sums] + [n]
        rows = np.concatenate([i.ravel(), np.arange(d), [-1]])
        cols = np.concatenate([j.ravel(), np.full(d, -1), [-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(values, pa.decimal128(38, 0))],
            names=["i", "j", "v"],
        )

    return work


def moments(x: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, ``S`` and the cross products ``G`` of the shifted vectors, exact."""
    partial = x.select("x").mapInArrow(_exact_sums(d), "i int, j int, v decimal(38,0)")
    summed = partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n, sums, cross = 0, [0] * d, [[0] * d for _ in range(d)]
    for row in summed:
        value = int(row["v"])
        if row["i"] < 0:
            n = value
        elif row["j"] < 0:
            sums[row["i"]] = value
        else:
            cross[row["i"]][row["j"]] = value
    return n, sums, cross


def refined_eigen(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the symmetric ``a``, refined from float32."""
    hi = np.longdouble
    A = a.astype(hi)
    _, x32 = np.linalg.eigh(a.astype(np.float32))
    X = x32.astype(hi)
    d = a.shape[0]
    norm_a = np.abs(a).sum(axis=1).max() if d else 0.0
    for _ in range(steps):
        R = np.eye(d, dtype=hi) - X.T @ X
        S = X.T @ A @ X
        lam = np.diag(S) / (1 - np.diag(R))
        gap = 2 * (np.abs(S - np.diag(lam)).sum(axis=1).max() + norm_a * np.abs(R).sum(axis=1).max())
        diff = lam[None, :] - lam[:, None]
        apart = np.abs(diff) > gap
        E = np.where(apart, (S + lam[None, :] * R) / np.where(apart, diff, 1), R / 2)
        X = X + X @ E
        X = _settle_clusters(A, X, lam, ~apart)
        if np.abs(E).max(initial=0) < 1e-18:
            break
    S = X.T @ A @ X
    lam = np.diag(S) / np.diag(X.T @ X)
    X = X / np.sqrt((X * X).sum(axis=0))
    order = np.argsort(-lam.astype(np.float64), kind="stable")
    lam, X = lam[order], X[:, order]
    signs = np.sign(X[np.abs(X).argmax(axis=0), np.arange(d)])
    return lam.astype(np.float64), (X * np.where(signs == 0, 1, signs)).astype(np.float64)


def _settle_clusters(A: np.ndarray, X: np.ndarray, lam: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Rotate the columns of each cluster of close eigenvalues by the eigenvectors of its sub-problem."""
    d = len(lam)
    seen = np.zeros(d, dtype=bool)
    for start in range(d):
        if seen[start]:
            continue
        members, todo = {start}, [start]
        while todo:
            i = todo.pop()
            for j in np.nonzero(close[i])[0]:
                if j not in members:
                    members.add(int(j))
                    todo.append(int(j))
        seen[list(members)] = True
        if len(members) > 1:
            cols = sorted(members)
            block = X[:, cols]
            Q, _ = np.linalg.qr(block.astype(np.float64))
            Q = Q.astype(np.longdouble)
            T = (Q.T @ A @ Q).astype(np.float64)
            _, W = np.linalg.eigh((T + T.T) / 2)
            X[:, cols] = Q @ W.astype(np.longdouble)
    return X


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error`` (see the contract in the module text)."""
    spark = embeddings.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    x, d = usable(embeddings)
    if d == 0:
        return spark.createDataFrame([], schema)
    n, sums, cross = moments(x, d)
    if n == 0:
        return spark.createDataFrame([], schema)
    S = np.array(sums, dtype=object)
    scaled = n * np.array(cross, dtype=object) - np.outer(S, S)  # n^2 V, exact
    V = np.array([[float(v) for v in row] for row in scaled], dtype=np.float64) / float(n) / float(n)
    lam, vectors = refined_eigen(V)
    trace = float(sum(int(scaled[i, i]) for i in range(d))) / n / n
    keep = [k for k in range(min(components, d)) if lam[k] > 0]
    lam, vectors = lam[keep], vectors[:, keep]
    hi = np.longdouble
    exact = np.array([[hi(int(v)) for v in row] for row in scaled]) / hi(n) / hi(n)
    white = vectors.astype(hi) / np.sqrt(lam.astype(hi))
    identity_error = float(np.abs(white.T @ exact @ white - np.eye(len(keep), dtype=hi)).max(initial=0))
    explained = (lam / trace) if trace > 0 else np.zeros_like(lam)
    return x.mapInArrow(
        _projections(n, [int(s) for s in sums], vectors, lam, explained, identity_error, [k + 1 for k in keep]), schema
    )


def _projections(n, sums, vectors, lam, explained, identity_error, numbers):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S = np.array(sums, dtype=object)
        small = max(abs(s) for s in sums) < (1 << 40) and n < (1 << 20)
        m = len(numbers)
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            d = len(sums)
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(rows, d)
            if small and np.abs(x).max(initial=0) < (1 << 20):
                centred = n * x - np.array(sums, dtype=np.int64)
            else:
                centred = n * x.astype(object) - S
            largest = int(np.abs(centred).max(initial=0))
            if centred.dtype != object and largest * largest * d < (1 << 63):
                deviation = (centred * centred).sum(axis=1)
            else:
                deviation = (centred.astype(object) ** 2).sum(axis=1)
            projected = (np.asarray(centred, dtype=np.float64) / n) @ vectors / np.sqrt(lam)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), m))).cast(pa.int64()),
                    pa.array(np.tile(np.array(numbers, dtype=np.int32), rows), pa.int32()),
                    pa.array(np.full(rows * m, n, dtype=np.int64), pa.int64()),
                    pa.array(np.repeat(np.array([int(v) for v in deviation], dtype=np.int64), m), pa.int64()),
                    pa.array(projected.ravel(), pa.float64()),
                    pa.array(np.tile(explained, rows), pa.float64()),
                    pa.array(np.full(rows * m, identity_error), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return work
