"""Toxicity by a classifier chain.

Categories are predicted one after another: the linear model of each sees the document's hashed words and word beginnings, and the
probabilities of the categories before it. For training those probabilities are out-of-fold: each fold's rows get them from models of
the other folds. The models are fitted on a bounded sample of labelled rows (``SAMPLE`` of each class, by a hash of the id); every
whole text is scored.

Null and empty texts have no features and get the chain's base rates; texts of any length are scored whole. Rows of ``labels`` with a
null id or a null toxic value are not learned from; a null quality counts as good. Of several labels of a document the largest toxic one
counts, of those the one with the largest quality. Without labelled toxic rows nothing is toxic. Rows that repeat a doc_id or have a
null one each get a row; of several texts of a labelled id the smallest is learned from. Equal probabilities are on the same side of the
threshold. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.llm.linear import Rows, fit, sigmoid
from taskweave.llm.words import LETTERED, Words, hash_words, mix, scan, slices

#: Categories in the chain's order, as SQL over the labels table: toxic documents of bad and of good quality, and all toxic ones.
CATEGORIES = (("toxic_junk", "toxic = 1 and coalesce(quality, 1) = 0"), ("toxic_prose", "toxic = 1 and coalesce(quality, 1) = 1"), ("toxic", "toxic = 1"))
SAMPLE = 4000
HELD = 4096
LEAST_DOCS = 3
FOLDS = 4
BITS = 22
BEGINNINGS = (4, 5, 6)
PENALTY = 0.1
SLICE_BYTES = 2 << 20


def features(w: Words) -> np.ndarray:
    """A row for each way to see a word: the feature numbers of the word and of its beginnings."""
    shift = np.uint64(64 - BITS)
    out = [mix(w.hash) >> shift]
    for n in BEGINNINGS:
        out.append(mix(hash_words(w.data, w.start, np.minimum(w.start + n, w.end), True) ^ np.uint64(n)) >> shift)
    return np.stack(out).astype(np.int32)


def _document_features(batches):
    for batch in slices(batches, "text", SLICE_BYTES):
        w = scan(batch.column(1), LETTERED, lower=True)
        found = features(w)
        rows = [np.unique(found[:, w.first[i] : w.first[i + 1]]).astype(np.int32).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(rows, pa.binary())], names=[*batch.schema.names[2:], "features"])


@dataclass
class Chain:
    """Known features, ascending, a weight vector for each category (features, earlier categories, intercept), and what counts as toxic.

    ``threshold``: of the last category's out-of-fold probabilities, midway in the gap that gives the best F1 on the sample.
    """

    known: np.ndarray
    weights: list[np.ndarray]
    threshold: float = 0.5

    def probabilities(self, sums: list[np.ndarray]) -> np.ndarray:
        """``sums``: of each category the summed weights of each row's features."""
        out = np.zeros((len(sums[0]), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = sigmoid(sums[k] + out[:, :k] @ w[len(self.known) : -1] + w[-1])
        return out


def chosen(rows: list[np.ndarray], y: np.ndarray, most: int = HELD) -> np.ndarray:
    """Features whose rows differ most from the rest in how often they are toxic, by a chi-square score; few enough to fit fast.

    A row has a feature once at most, so rows are counted into two tables of all features, one row after another.
    """
    n, ones = np.zeros(1 << BITS, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
    for r, positive in zip(rows, y, strict=True):
        n[r] += 1
        if positive:
            ones[r] += 1
    found = np.flatnonzero(n >= LEAST_DOCS)
    if not len(found):
        return found.astype(np.int32)
    n, ones, rate = n[found], ones[found], y.mean()
    score = (ones - n * rate) ** 2 / np.maximum(n * rate * (1 - rate), 1e-9)
    keep = np.argsort(-score, kind="stable")[:most]
    return np.sort(found[keep[score[keep] > 4]]).astype(np.int32)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Midway between the lowest probability that should count and the next lower one; 0.5 without ones."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum((weight * y)[order])
    if not len(p) or not hit[-1]:
        return 0.5
    f1 = 2 * hit / (np.cumsum(weight[order]) + hit[-1])
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    k = int(f1.argmax())
    return float((p[order[k]] + p[order[k + 1]]) / 2 if k + 1 < len(p) else p[order[k]] / 2)


def train(rows: list[np.ndarray], truth: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> Chain:
    """``truth``: a column for each category."""
    known = chosen(rows, truth.max(axis=1))
    member = np.zeros(1 << BITS, dtype=bool)
    member[known] = True
    cut = [np.searchsorted(known, r[member[r]]) for r in rows]
    every = Rows(cut)
    earlier = np.zeros((len(rows), 0))
    weights = []
    for k in range(truth.shape[1]):
        y = truth[:, k]
        out_of_fold = np.zeros(len(rows))
        for f in range(FOLDS):
            on, off = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(on) and len(off):
                w = fit(Rows([cut[i] for i in on]), len(known), earlier[on], y[on], weight[on], PENALTY)
                out_of_fold[off] = sigmoid(Rows([cut[i] for i in off]).dot(w[: len(known)]) + earlier[off] @ w[len(known) : -1] + w[-1])
        weights.append(fit(every, len(known), earlier, y, weight, PENALTY))
        earlier = np.concatenate([earlier, out_of_fold[:, None]], axis=1)
    return Chain(known, weights, best_threshold(earlier[:, -1], truth[:, -1], weight))


def _train(names: list[str]):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id")
        rows = [np.frombuffer(x, dtype=np.int32) for x in sample["features"]]
        chain = train(rows, sample[names].to_numpy(dtype=np.float64), sample["fold"].to_numpy(), sample["weight"].to_numpy())
        return pd.DataFrame({"chain": [pickle.dumps(chain)]})

    return run


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Learns the chain from the labelled documents, at most ``sample`` toxic and ``sample`` others."""
    names = [name for name, _ in categories]
    worst = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.struct("toxic", "quality")).alias("label")).select("doc_id", "label.*")
    order = F.xxhash64(F.lit("sample"), "doc_id")
    parts, counts = [], {r.toxic: r.n for r in worst.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r.toxic in (0, 1)}
    for value in (0, 1):
        held = min(counts.get(value, 0), sample)
        parts.append(worst.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(sample).withColumn("weight", F.lit(counts.get(value, 0) / max(held, 1))))
    flags = [F.coalesce(F.expr(rule), F.lit(False)).cast("int").alias(name) for name, rule in categories]
    picked = parts[0].unionByName(parts[1]).select("doc_id", "weight", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), *flags)
    keys = ["doc_id", "weight", "fold", *names]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy(*keys).agg(F.min("text").alias("text"))  # 2 * sample rows at most
    seen = rows.select("doc_id", "text", F.col("doc_id").alias("id"), "weight", "fold", *names).mapInArrow(_document_features, "id long, weight double, fold int, " + ", ".join(f"{n} int" for n in names) + ", features binary").withColumnRenamed("id", "doc_id")
    found = seen.groupBy().applyInPandas(_train(names), "chain binary").collect()
    return pickle.loads(found[0].chain) if found else Chain(np.zeros(0, dtype=np.int32), [np.append(np.zeros(k), -40.0) for k in range(len(names))])


def _score(chain_of, names: list[str]):
    def run(batches):
        chain: Chain = chain_of.value
        weights = [w[: len(chain.known)] for w in chain.weights]
        member = np.zeros(1 << BITS, dtype=bool)  # which features are known; their weights are looked up by rank
        member[chain.known] = True
        for batch in slices(batches, "text", SLICE_BYTES):
            w = scan(batch.column(1), LETTERED, lower=True)
            found = features(w)
            hit, at = np.nonzero(member[found])
            pairs = np.unique((w.text[at].astype(np.int64) << BITS) | found[hit, at])
            text, rank = pairs >> BITS, np.searchsorted(chain.known, pairs & ((1 << BITS) - 1))
            sums = [np.bincount(text, weights=v[rank], minlength=batch.num_rows) for v in weights]
            p = chain.probabilities(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(len(names))]], names=["doc_id", *[f"p_{n}" for n in names]])

    return run


def score(docs: DataFrame, chain: Chain, categories=CATEGORIES) -> DataFrame:
    """(doc_id, a probability for each category, toxic) of every document."""
    names = [name for name, _ in categories]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(chain), names), "doc_id long, " + ", ".join(f"p_{n} double" for n in names))
    return found.withColumn("toxic", F.col(f"p_{names[-1]}") >= chain.threshold)


def _clean(chain_of, names: list[str]):
    score_batches = _score(chain_of, names)

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            at = batch.schema.get_field_index("text")
            p = next(score_batches(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])])))
            yield batch.filter(pa.array(p.column(p.num_columns - 1).to_numpy() < chain_of.value.threshold))

    return run


def clean(docs: DataFrame, chain: Chain, categories=CATEGORIES) -> DataFrame:
    """The documents that the chain's last category does not reject, with all their columns."""
    names = [name for name, _ in categories]
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(chain), names), docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit_chain(docs, labels))
