"""Hard negatives of anchors among integer vectors, by exact inner products of residues.

Components become ``floor(scale * x)``. Inner products are taken modulo several small primes, each a matrix product of balanced residues in
float32 whose sums stay below 2**24 and so are exact; Chinese remainders by balanced mixed radix give the signed integer score. The number
of primes follows from the longest vector: no score is larger than its square.

Anchors are read in blocks of bounded size, which are broadcast one after another; rows stay where they are. A first pass over all rows
keeps each task's best rows of the anchor's label, and a window picks the positives. A second one keeps, for each anchor and positive, each
task's best rows of other labels within the band of the positive's score, and a window picks the negatives. So no vector is shuffled, and
only a few rows for each anchor and task are.

Rows with a null id or label, a null or empty vector, null or non-finite components, or another length than most rows' (ties: the
shorter) take no part, nor do vectors whose scaled square is above 2**62, as their scores would not fit a long. Each row that repeats an
id is a row by itself, as an anchor too. An anchor without positives, or whose positives have no row in their band, gives no rows, nor
does an empty table. A negative positive score has an empty band. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskweave.shared import new_path, written

#: Anchors of a block, and components of all its vectors.
ANCHORS, COMPONENTS = 8192, 1 << 22
#: Scores that a task holds at once, and candidates before it sorts them.
CELLS, WAITING = 1 << 21, 1 << 18
LARGEST_SQUARE = float(1 << 62)
_NONE = np.iinfo(np.int64).min


def primes_for(largest: int) -> list[int]:
    """The fewest primes below 256, from the largest down, whose product holds all numbers from -largest to largest."""
    found, product = [], 1
    for p in range(255, 2, -1):
        if product > 2 * largest + 1:
            break
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues of integers as float32."""
    r = np.mod(x, p)
    return (r - p * (r > p // 2)).astype(np.float32)


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of two sets of integer vectors, given as their residues by prime."""
    shape = (len(left[0]), len(right[0]))
    total, digits, weights, weight = np.zeros(shape, dtype=np.int64), [], [], 1
    for a, b, p in zip(left, right, primes, strict=True):
        step = ((1 << 24) - 1) // (p // 2) ** 2  # components whose sum float32 holds exactly
        r = np.zeros(shape, dtype=np.int32)
        for i in range(0, a.shape[1], step):
            r += (a[:, i : i + step] @ b[:, i : i + step].T).astype(np.int32) % p
        for d, w in zip(digits, weights, strict=True):
            r -= d * (w % p) % p
        r = r % p * pow(weight, -1, p) % p
        r -= p * (r > p // 2)
        # The digits are balanced, so the sum is the signed score whatever wraps around on the way.
        total += r.astype(np.int64) * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
        digits.append(r)
        weights.append(weight)
        weight *= p
    return total


class Best:
    """The first ``k`` rows of each group: by score, highest first, then by id, then by row."""

    def __init__(self, groups: int, k: int):
        self.k, self.groups = k, groups
        self.least = np.full(groups, _NONE)  # what a row must reach to be among them
        self.held, self.waiting = [(np.zeros(0, dtype=np.int64),) * 4], 0

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if len(group):
            self.held.append((group, score, vec_id, row))
            self.waiting += len(group)
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        group, score, vec_id, row = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((row, vec_id, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        order, group, place = order[place < self.k], group[place < self.k], place[place < self.k]
        self.held, self.waiting = [(group, score[order], vec_id[order], row[order])], 0
        last = place == self.k - 1
        self.least[group[last]] = score[order][last]
        return self.held[0]


def _blocks(batches, width: int, at_once: int):
    """(row, vec_id, label, vectors) of at most ``at_once`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            part = batch.slice(i, at_once)
            yield (*(part.column(k).to_numpy() for k in range(3)), part.column(3).flatten().to_numpy().reshape(part.num_rows, width))


def _scored(batches, anchors: dict, primes: list[int]):
    """Blocks of rows with the scores of all anchors: (row, vec_id, label, scores)."""
    x = anchors["vectors"]
    left = [residues(x, p) for p in primes]
    for row, vec_id, label, v in _blocks(batches, x.shape[1], max(1, CELLS // len(x))):
        yield row, vec_id, label, products(left, [residues(v, p) for p in primes], primes)


def _rows(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["group", "score", "vec_id", "row"])


FOUND = "group long, score long, vec_id long, row long"


def _positives(anchors_of, primes: list[int], k: int):
    def run(batches):
        anchors = anchors_of.value
        best = Best(len(anchors["row"]), k)
        for row, vec_id, label, s in _scored(batches, anchors, primes):
            good = (anchors["label"][:, None] == label[None, :]) & (s >= best.least[:, None])
            _, own, here = np.intersect1d(anchors["row"], row, assume_unique=True, return_indices=True)
            good[own, here] = False
            a, b = np.nonzero(good)
            best.add(a, s[a, b], vec_id[b], row[b])
        yield _rows(best.settle())

    return run


def _negatives(anchors_of, primes: list[int], k: int, low: int, high: int):
    def run(batches):
        anchors = anchors_of.value
        top = anchors["positives"]  # (anchors, places), the least number where there is none
        places = top.shape[1]
        best = Best(top.size, k)
        whole, rest = np.divmod(top, 100)
        floor, roof = whole * low - (-rest * low // 100), whole * high + rest * high // 100  # of integers, so the same rows
        for row, vec_id, label, s in _scored(batches, anchors, primes):
            other = anchors["label"][:, None] != label[None, :]
            for j in range(places):
                group = np.arange(len(top)) * places + j
                good = other & (s <= roof[:, j, None]) & (s >= np.maximum(floor[:, j], best.least[group])[:, None]) & (top[:, j, None] > _NONE)
                a, b = np.nonzero(good)
                best.add(group[a], s[a, b], vec_id[b], row[b])
        yield _rows(best.settle())

    return run


def integer_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, label, v, square) of the rows that take part, but for their lengths."""
    x = F.col("x")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + (F.abs(v) * scale + 1) * (F.abs(v) * scale + 1))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & ~F.exists(x, odd)).where(square <= LARGEST_SQUARE)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform(x, lambda v: F.floor(v * scale)).alias("v"))
    return rows.withColumn("square", F.aggregate("v", F.lit(0).cast("long"), lambda a, v: a + v * v))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``. An anchor's positives are its first other rows of the same label. Of each, the first rows of
    other labels count whose score is between the two percentages of ``band`` (0 to 100) of the positive's score, ends included.
    """
    spark = vectors.sparkSession
    low, high = band
    rows = written(integer_rows(vectors, id_col, label_col, vector_col, scale), "integer-rows")
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max("square").alias("square"))
    most = widths.orderBy(F.desc("n"), "width").limit(1).collect()
    out = new_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not most:
        return spark.createDataFrame([], schema)
    width, primes = most[0].width, primes_for(int(most[0].square))
    rows = rows.where(F.size("v") == width).select("row", "vec_id", "label", "v")
    asked = rows.where(is_anchor)
    n_blocks = -(-asked.count() // max(1, min(ANCHORS, COMPONENTS // width)))
    if not n_blocks:
        return spark.createDataFrame([], schema)
    folder = new_path(spark, "anchors")
    asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(folder)
    held = spark.read.parquet(folder)
    first = Window.partitionBy("group").orderBy(F.desc("score"), "vec_id", "row")
    for block in [r.block for r in held.select("block").distinct().orderBy("block").collect()]:  # a row for each block
        part = held.where(F.col("block") == block).select("row", "vec_id", "label", "v").orderBy("row").collect()  # a block's anchors
        anchors = {"row": np.array([r.row for r in part]), "label": np.array([r.label for r in part]), "vectors": np.array([r.v for r in part], dtype=np.int64).reshape(len(part), width)}
        sent = spark.sparkContext.broadcast(anchors)
        near = rows.mapInArrow(_positives(sent, primes, positives), FOUND).withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
        chosen = near.collect()  # ``positives`` rows an anchor of the block
        top = np.full((len(part), positives), _NONE)
        for r in chosen:
            top[r.group, r.place - 1] = r.score
        again = spark.sparkContext.broadcast(anchors | {"positives": top})
        far = rows.mapInArrow(_negatives(again, primes, negatives, low, high), FOUND).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
        names = spark.createDataFrame([(r.group * positives + r.place - 1, part[r.group].vec_id, r.vec_id, r.score) for r in chosen], "group long, anchor_id long, positive_id long, positive_score long")
        found = far.join(F.broadcast(names), "group").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""
