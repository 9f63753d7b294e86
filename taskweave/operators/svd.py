"""Truncated singular values of sparse rows by random projections with power steps.

Tasks multiply their packed blocks (``linear.packed``) by a narrow matrix and give back sums by ranges of features; the driver
orthogonalises matrices of features by dimensions. Columns travel in groups of at most ``linear.CELLS`` numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from taskweave.operators import linear


def _gram(sent):
    def run(batches):
        matrix = sent.value
        total = np.zeros_like(matrix)
        for block in linear.blocks_of(batches):
            if len(block.features):
                block.lay(matrix.shape[1])
                total[block.features] += block.turned(block.products(matrix))
        yield from linear.ranges_out(total)

    return run


def gram_times(blocks: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """A' A times a matrix, for the rows A."""
    out, step, tasks = np.empty_like(matrix), max(1, linear.CELLS // (len(matrix) + 1)), linear.tasks_of(blocks)
    for i in range(0, matrix.shape[1], step):
        part = np.vstack([matrix[:, i : i + step], np.zeros((1, matrix[:, i : i + step].shape[1]))])  # without intercepts
        sent = blocks.sparkSession.sparkContext.broadcast(part)
        out[:, i : i + step] = linear.summed(blocks.mapInArrow(_gram(sent), "part int, body binary"), part.shape, tasks)[:-1]
        sent.unpersist()
    return out


def truncated(blocks: DataFrame, width: int, k: int = 180, more: int = 20, power: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), largest first; at most ``width`` of them."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + more))))
    for _ in range(power):
        q, _ = np.linalg.qr(gram_times(blocks, q))
    values, turn = np.linalg.eigh(q.T @ gram_times(blocks, q))
    order = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[order], 0)), q @ turn[:, order]


def projected(rows: DataFrame, vectors: np.ndarray, name: str = "svd") -> DataFrame:
    """``rows`` with their places along the singular vectors, as an array."""
    return linear.scored(rows, np.vstack([vectors, np.zeros((1, vectors.shape[1]))]), name)
