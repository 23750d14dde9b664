"""Whitening of embeddings by their principal components, found without a covariance matrix.

The leading eigenvectors come from block subspace iteration: a pass of Spark over the centred vectors computes X'(XQ) for
a block Q of orthonormal columns, from which a Rayleigh-Ritz step takes the best vectors of their span and their
residuals; the next block is orthonormalised again. It ends when the residuals of all wanted components are at the level
of rounding. A pass sends back as many numbers as a block has, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import id_in, id_out, written

SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more have no whole number that all sums could hold; their vectors count as not finite.
LARGEST = float(1 << 30)
#: Passes that a block may still need before it is widened instead.
PATIENCE = 6


def quantised(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """id and x (array of long) of the rows whose vector is whole: x = floor(64 c) + 1000000 of every entry c.

    Rows go if the vector is null, empty, holds null or non-finite entries or one of LARGEST or more, or has another length
    than most vectors (the longer one if two are equally common).
    """
    whole = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "d"))["d"].alias("_d"))
    return rows.join(F.broadcast(usual), F.size(vector) == F.col("_d")).select(F.col(id).alias(id), x.alias("x"))  # one row


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()) if len(x) else np.empty((0, 0), np.int64)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly, as long where it fits and as whole numbers of any size elsewhere."""
    fits = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62
    return n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(x, n, sums).astype(float) / n


def _added(rows: DataFrame, per_batch, shape: tuple[int, ...], kind: str = "double") -> np.ndarray:
    """The sum of per_batch(x) (an array of `shape`) over all batches of rows: within tasks, then by Spark cell by cell."""

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = per_batch(_matrix(batch["x"])).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(len(total)), "value": total})

    # one partial array a task: a few tasks for each core, however many files there are
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    cells = rows.select("x").coalesce(tasks).mapInPandas(within, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(int(np.prod(shape)), np.int64 if kind == "long" else float)
    for cell, value in cells.collect():  # as many rows as the array has cells
        out[cell] = value
    return out.reshape(shape)


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, vectors and images of the vectors that are best in the span of q, by falling value."""
    t = q.T @ vq
    values, turn = np.linalg.eigh((t + t.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def components(fit: DataFrame, n: int, sums: list[int], wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(values, vectors, trace, passes) of the covariance of fit (x): up to `wanted` unit eigenvectors, by falling value.

    The block has twice as many columns as are wanted. If its residuals fall so slowly that more than PATIENCE passes are
    left, it is doubled, up to one column for each dimension, where a single pass is exact; so the passes are few for any
    spectrum, ties included. Components without variance are left out. The sign makes the largest entry positive.
    """
    d = len(sums)
    trace = float(_added(fit, lambda x: np.array([(_centred(x, n, sums) ** 2).sum()]), (1,))[0]) / n
    if trace == 0:
        return np.empty(0), np.empty((d, 0)), 0.0, 0
    draw = np.random.default_rng(seed)
    wanted = min(wanted, d)
    block = min(d, 2 * wanted)
    q, passes, before = np.linalg.qr(draw.standard_normal((d, block)))[0], 0, None
    while True:
        image = lambda x, q=q: (lambda c: c.T @ (c @ q) / n)(_centred(x, n, sums))
        values, vectors, images = _ritz(q, _added(fit, image, q.shape))
        passes += 1
        residual = float(np.linalg.norm(images[:, :wanted] - vectors[:, :wanted] * values[:wanted], axis=0).max())
        target = 4 * d * np.finfo(float).eps * max(values[0], 0.0)
        if residual <= target or q.shape[1] == d:
            break
        slow = before is not None and (residual >= before or np.log(residual / target) / np.log(before / residual) > PATIENCE)
        before, wide = (None, images) if slow else (residual, images)
        if slow:
            wide = np.hstack([images, draw.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1])) * values[0]])
        q = np.linalg.qr(wide)[0]
        q = np.linalg.qr(q)[0]  # once more, as images of near-equal directions lose digits
    real = values[:wanted] > d * np.finfo(float).eps * values[0]
    values, vectors = values[:wanted][real], vectors[:, :wanted][:, real]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]), trace, passes


def whiten(vectors: DataFrame, wanted: int = 16, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """Every whole vector on the leading components of all distinct ones: a row for each vector and component.

    id, component (int, from 1 by falling variance e), n (distinct x vectors), deviation (sum over dimensions of
    (n x - S)^2, exact; null where no long can hold it), whitened ((x - S/n) on the component, over sqrt(e)), explained
    (e over the covariance's trace) and identity_error (largest entry of whitened's covariance over the distinct vectors,
    less the identity; measured by a pass of its own).

    See quantised() for the rows that go. The fit list has each distinct x once; equal vectors meet in partial aggregation.
    There are min(wanted, dimensions, rank) components; with one distinct vector, or none, there is no row. Null ids stay
    null, repeated rows come out each, other columns are ignored. The driver holds a block of at most d x d numbers.
    """
    spark = vectors.sparkSession
    schema = f"{id} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(quantised(vectors, vector, id), "quantised")
    fit = written(rows.select("x").distinct(), "fit")
    first = fit.head()
    if first is None:
        return spark.createDataFrame([], schema)
    d = len(first["x"])
    counted = _added(fit, lambda x: np.append(x.sum(axis=0), len(x)), (d + 1,), "long")
    n, sums = int(counted[d]), [int(s) for s in counted[:d]]
    values, axes, trace, _ = components(fit, n, sums, wanted)
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], schema)
    project = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ project
        return np.vstack([w.T @ w, w.sum(axis=0)]) / n

    got = _added(fit, moments, (k + 1, k))
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    explained = values / trace

    def project_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            exact = _deviations(_matrix(batch["x"]), n, sums)
            whitened = (exact.astype(float) / n) @ project
            if (exact.astype(float) ** 2).sum(axis=1).max() < 2.0**62:
                deviation = pd.array((exact.astype(np.int64) ** 2).sum(axis=1), "Int64")
            else:
                totals = (exact.astype(object) ** 2).sum(axis=1)
                deviation = pd.array([t if t < 1 << 63 else None for t in totals], "Int64")
            m = len(batch)
            yield pd.DataFrame({
                id: np.repeat(batch[id].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": n,
                "deviation": deviation.repeat(k), "whitened": whitened.ravel(), "explained": np.tile(explained, m), "identity_error": error,
            })

    out = rows.select(id_in(id), "x").mapInPandas(project_all, schema)
    return out.select(id_out(id), "component", "n", "deviation", "whitened", "explained", "identity_error")
