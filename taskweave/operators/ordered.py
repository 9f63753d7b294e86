"""The proportional-odds model by Fisher scoring: tasks sum slopes and expected information, the driver solves for the step.

Rows have a dense array of features and a rank from 0. With weights w and rising cuts c, P(rank <= k) is 1 / (1 + exp(w x - c_k)). A step that
does not raise the penalised likelihood, or breaks the order of the cuts, is halved; the fit ends when a step is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(x: np.ndarray, y: np.ndarray, p: np.ndarray, classes: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, its slope, expected information) of rows at weights and cuts ``p``."""
    d = x.shape[1]
    z, cuts = x @ p[:d], p[d:]
    below = 1 / (1 + np.exp(np.clip(z[:, None] - cuts[None, :], -40, 40)))  # P(rank <= k)
    edge = np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1)
    slope = edge * (1 - edge)
    share = np.maximum(np.diff(edge, axis=1), 1e-12)
    # Of each class's share the slopes along z and along the cuts.
    along = np.zeros((len(x), classes, classes))
    along[:, :, 0] = -np.diff(slope, axis=1)
    for k in range(classes - 1):
        along[:, k, k + 1] += slope[:, k + 1]
        along[:, k + 1, k + 1] -= slope[:, k + 1]
    own = along[np.arange(len(x)), y] / share[np.arange(len(x)), y][:, None]
    gradient = np.concatenate([x.T @ own[:, 0], own[:, 1:].sum(axis=0)])
    inner = np.einsum("nka,nkb,nk->nab", along, along, 1 / share)
    information = np.zeros((len(p), len(p)))
    information[:d, :d] = (x * inner[:, :1, 0]).T @ x
    information[:d, d:] = x.T @ inner[:, 0, 1:]
    information[d:, :d] = information[:d, d:].T
    information[d:, d:] = inner[:, 1:, 1:].sum(axis=0)
    return float(np.log(share[np.arange(len(x)), y]).sum()), gradient, information


def fit(rows: DataFrame, features: str, rank: str, classes: int = 3, penalty: float = 1.0, steps: int = 60, tolerance: float = 1e-8) -> np.ndarray:
    """Weights, then cuts. ``penalty`` is that of half the weights' squares. The features' number squared travels once for each task and step."""
    context = rows.sparkSession.sparkContext
    known = rows.select(F.col(features).alias("x"), F.col(rank).cast("int").alias("y")).persist()
    d = known.select(F.max(F.size("x"))).first()[0]
    counts = dict(known.groupBy("y").count().collect())  # a row for each class
    share = np.clip(np.cumsum([counts.get(k, 0) for k in range(classes)])[:-1] / max(1, sum(counts.values())), 1e-3, 1 - 1e-3)
    p = np.concatenate([np.zeros(d), np.log(share / (1 - share)) + np.arange(classes - 1) * 1e-6])

    def evaluate(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sent = context.broadcast(p)

        def part(batches):
            total = np.zeros(1 + len(sent.value) + len(sent.value) ** 2)
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    some = b.slice(i, 4096)
                    x = some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                    value, slope, information = pieces(x, some.column(1).to_numpy(), sent.value, classes)
                    total += np.concatenate([[value], slope, information.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

        sums = known.mapInArrow(part, "total array<double>").select(F.posexplode("total").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # of fixed size
        total = np.zeros(1 + len(p) + len(p) ** 2)
        for r in sums:
            total[r.k] = r.v
        slope, information = total[1 : 1 + len(p)], total[1 + len(p) :].reshape(len(p), len(p))
        charge = np.concatenate([np.full(d, penalty), np.zeros(classes - 1)])
        return total[0] - (charge * p * p).sum() / 2, slope - charge * p, information + np.diag(charge)

    now, slope, information = evaluate(p)
    for _ in range(steps):
        ahead, length = np.linalg.lstsq(information, slope, rcond=None)[0], 1.0
        while length > 1e-6:
            trial = p + length * ahead
            if np.all(np.diff(trial[d:]) > 0):
                found = evaluate(trial)
                if found[0] >= now:
                    break
            length /= 2
        else:
            break
        p, (now, slope, information) = trial, found
        if np.abs(length * ahead).max() < tolerance:
            break
    known.unpersist()
    return p


def passed(features: Column, p: np.ndarray, classes: int = 3) -> list[Column]:
    """P(rank > k) for each cut."""
    d = len(p) - classes + 1
    w = F.array(*[F.lit(float(v)) for v in p[:d]])
    z = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return [1 / (1 + F.exp(F.lit(float(c)) - z)) for c in p[d:]]
