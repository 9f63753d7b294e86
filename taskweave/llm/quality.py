"""Document quality: ridge regression on random Fourier features of document statistics, then isotonic calibration.

One pass over the texts gives each document a few statistics. They are standardised over all documents and mapped by random Fourier
features, which approximate a Gaussian kernel. Partitions of the labelled rows sum their part of the normal equations for each fold;
the sums are of fixed size however many rows there are, and the driver solves them. Scores of rows by the solution without their own
fold, counted in ``BINS`` bins, are calibrated by pooling adjacent violators.

Null and empty texts get the statistics of an empty document and a score like any other. Rows with a null label are not learned from;
of several labels of one document the largest counts. Without any label scores are 0.5; with labels of one value they are that value.
Rows that repeat a doc_id each get a row. Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.llm.words import SPACED, runs, scan, slices
from taskweave.shared import written

FEATURES, BLOCK, FOLDS, BINS, SALTS = 256, 64, 5, 1024, 32
WIDTH, RIDGE, SEED, THRESHOLD = 4.0, 1e-3, 7, 0.7
SLICE_BYTES = 2 << 20

STATISTICS = (
    "words", "word_bytes", "letters", "capitals", "digits", "spaces", "lines", "stops", "shouts", "symbols", "beyond_ascii", "distinct_words", "distinct_pairs", "commonest_word", "distinct_lines", "short_words",
)
_CLASSES = np.stack(
    [
        np.array([test(b) for b in range(256)], dtype=np.float64)
        for test in (
            lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A,
            lambda b: 0x41 <= b <= 0x5A,
            lambda b: 0x30 <= b <= 0x39,
            lambda b: b == 0x20,
            lambda b: b == 0x0A,
            lambda b: b in b".,;:",
            lambda b: b in b"!?",
            lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum() and b not in b".,;:!?'\"()-",
            lambda b: b >= 0x80,
        )
    ],
    axis=1,
)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    w = scan(column, SPACED, lower=True)
    pairs = runs(w.hash, 2)
    length = w.end - w.start
    out = np.zeros((len(column), len(STATISTICS)))
    for i in range(len(column)):
        a, b = int(w.texts[i]), int(w.texts[i + 1])
        if a == b:
            continue
        body = w.data[a:b]
        share = np.bincount(body, minlength=256) @ _CLASSES / (b - a)
        s, e = int(w.first[i]), int(w.first[i + 1])
        n = e - s
        many = np.unique(w.hash[s:e], return_counts=True)[1] if n else np.zeros(1)
        lines = body.tobytes().split(b"\n")
        out[i] = [
            np.log1p(n), length[s:e].mean() if n else 0, share[0], share[1], share[2], share[3], share[4] * 20, share[5], share[6] * 5, share[7] * 5, share[8],
            len(many) / max(n, 1), len(np.unique(pairs[s : e - 1])) / max(n - 1, 1) if n > 1 else 1, many.max() / max(n, 1), len(set(lines)) / len(lines), (length[s:e] <= 3).mean() if n else 0,
        ]
    return out


def _measure(batches):
    for batch in slices(batches, "text", SLICE_BYTES):
        found = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(found.shape[1])]], names=["doc_id", *STATISTICS])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics...) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


class Features:
    """Standardised statistics through random cosines."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 0, spread, 1.0)
        self.turn, self.shift = random.normal(size=(len(mean), FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES)

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], axis=1)
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ self.turn + self.shift), np.ones((len(x), 1))], axis=1)


def _sums(features_of):
    def run(batches):
        features: Features = features_of.value
        size = FEATURES + 1
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y, fold = features.of(batch), batch.column("label").to_numpy().astype(float), batch.column("fold").to_numpy()
                for f in np.unique(fold):
                    at = fold == f
                    total[f] += z[at].T @ np.concatenate([z[at], y[at, None]], axis=1)
        rows = [(f, a, total[f, a : a + BLOCK].tobytes()) for f in range(FOLDS) if total[f].any() for a in range(0, size, BLOCK)]
        if rows:
            part = zlib.crc32(rows[0][2]) % SALTS
            fold, at, body = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(at, pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array(body, pa.binary())], names=["fold", "at", "salt", "sums"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group["sums"].iloc[0]) // 8)
    for x in group["sums"]:
        total += np.frombuffer(x)
    return group.head(1).assign(sums=total.tobytes())


def _solved(total: np.ndarray) -> np.ndarray:
    size = total.shape[0]
    n = max(total[-1, size - 1], 1.0)
    penalty = np.eye(size) * RIDGE * n / FEATURES
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(total[:, :size] + penalty, total[:, size])


def _binned(features_of, weights_of):
    def run(batches):
        features, weights = features_of.value, weights_of.value
        for batch in batches:
            if batch.num_rows:
                raw = (features.of(batch) * weights[batch.column("fold").to_numpy()]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(_bin(raw), pa.int32()), batch.column("label").cast(pa.float64())], names=["bin", "label"])

    return run


def _bin(raw: np.ndarray) -> np.ndarray:
    """Raw scores from -0.25 to 1.25, in equal bins."""
    return np.clip((raw + 0.25) / 1.5 * BINS, 0, BINS - 1).astype(np.int32)


def pooled(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Rising means by pooling adjacent violators; bins without rows are filled in between."""
    at = np.flatnonzero(counts)
    if not len(at):
        return np.full(len(counts), 0.5)
    blocks: list[list[float]] = []  # sum, count, bins
    for i in at:
        blocks.append([sums[i], counts[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + n]
    means = np.repeat([s / c for s, c, _ in blocks], [int(n) for _, _, n in blocks])
    return np.interp(np.arange(len(counts)), at, means)


def _scored(features_of, model_of):
    def run(batches):
        features, (weights, levels) = features_of.value, model_of.value
        for batch in batches:
            if batch.num_rows:
                raw = features.of(batch) @ weights
                place = np.clip((raw + 0.25) / 1.5 * BINS - 0.5, 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.interp(place, np.arange(BINS), levels), 0, 1))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) of every document. ``learn``: which rows of (doc_id, label) to learn from."""
    context = docs.sparkSession.sparkContext
    table = written(measured(docs, id_col, text_col), "statistics")
    moments = table.select([F.mean(c).alias(f"mean_{c}") for c in STATISTICS] + [F.stddev_pop(c).alias(f"spread_{c}") for c in STATISTICS]).first()
    of = lambda kind: np.array([moments[f"{kind}_{c}"] or 0.0 for c in STATISTICS])
    features = context.broadcast(Features(of("mean"), of("spread")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(learn)
    learned = written(table.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    sums = learned.mapInArrow(_sums(features), "fold int, at int, salt int, sums binary")
    for keys in (["fold", "at", "salt"], ["fold", "at"]):
        sums = sums.groupBy(*keys).applyInPandas(_added, "fold int, at int, salt int, sums binary")
    total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for r in sums.collect():  # FOLDS * (FEATURES / BLOCK + 1) rows
        total[r.fold, r.at : r.at + BLOCK] = np.frombuffer(r.sums).reshape(-1, FEATURES + 2)
    every = total.sum(axis=0)
    without = context.broadcast(np.stack([_solved(every - total[f]) for f in range(FOLDS)]))
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for r in learned.mapInArrow(_binned(features, without), "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect():  # BINS rows at most
        counts[r.bin], ones[r.bin] = r.n, r.s
    return table.mapInArrow(_scored(features, context.broadcast((_solved(every), pooled(counts, ones)))), "doc_id long, score double").withColumnRenamed("doc_id", id_col)


def op10(spark, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
