"""Many linear models over sparse rows, fitted together: a pass over the rows gives the gradients of all of them.

Rows are (index, value) arrays as ``fields`` makes them. They are packed once, values in single precision, into blocks that tasks read without rebuilding lists. A
``Problem`` says which rows it is fitted on, by fold columns and classes, which features it sees, its loss and its penalty; so all folds,
settings and classes of a comparison are columns of one weight matrix. In each pass tasks sum losses and gradients of their blocks, the
sums are added up by ranges of features, and the driver moves each problem by its own limited-memory quasi-Newton step, halving the step of
those that did not improve. Problems are fitted in groups so that a matrix has at most ``CELLS`` numbers, whatever the vocabulary.

Each problem minimises ``c * sum(row weight * loss) + |w|^2 / 2``; the intercept is penalised like a weight unless ``free_intercept``.
Rows without features see the intercept only. A problem without rows, or whose rows are of one kind, ends at what its loss gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.operators.fields import Stored
from taskweave.operators.labels import CLASSES, rank
from taskweave.shared import partitions, written

CELLS = 1 << 22
#: Entries of a packed block, and numbers that a task multiplies at once.
BLOCK_ENTRIES, AT_ONCE = 1 << 17, 1 << 21
#: Numbers of one range of a gradient on its way to the driver.
RANGE = 1 << 18
#: The most cells of a block that is multiplied as a dense matrix. It is where that takes less: laying a cell costs ``LAY`` and a product ``DENSE_STEP``,
#: where a filled cell's product costs 1 if only filled ones are multiplied.
DENSE, LAY, DENSE_STEP = 1 << 23, 0.25, 0.025
#: Matrices of so few columns are multiplied column by column, without a row for each entry.
FEW = 4
#: Matrices of so many tasks go straight to the driver.
DIRECT = 4
MEMORY = 6
EVERYTHING = ((0, 1 << 31),)


@dataclass(frozen=True)
class Problem:
    """A linear model of the rows outside ``without`` and inside ``only``, pairs of (fold column, fold), and, where given, of the classes ``among``.

    ``positive`` holds the class ranks that count as 1, the others as -1; losses on ``target`` take the row's number instead.
    """

    positive: tuple[int, ...] = ()
    c: float = 1.0
    loss: str = "squared_hinge"
    weight: float = 1.0  # of positive rows
    balanced: bool = False  # rows weighed by the column weight
    without: tuple[tuple[int, int], ...] = ()
    only: tuple[tuple[int, int], ...] = ()
    among: tuple[int, ...] | None = None
    features: tuple[tuple[int, int], ...] = EVERYTHING
    free_intercept: bool = False


def losses(kind: str, z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A loss and its slope at margins or predictions ``z`` for signs or targets ``t``."""
    if kind == "squared_hinge":
        short = np.maximum(1 - t * z, 0)
        return short**2, -2 * t * short
    if kind == "logistic":
        return np.logaddexp(0, -t * z), -t / (1 + np.exp(np.clip(t * z, -50, 50)))
    miss = z - t
    if kind == "square":
        return miss**2 / 2, miss
    if kind == "huber":
        near = np.abs(miss) <= HUBER
        return np.where(near, miss**2 / 2, HUBER * (np.abs(miss) - HUBER / 2)), np.clip(miss, -HUBER, HUBER)
    if kind == "insensitive":  # squared beyond the tube, so that it has a slope everywhere
        over = np.sign(miss) * np.maximum(np.abs(miss) - TUBE, 0)
        return over**2, 2 * over
    raise ValueError(f"unknown loss {kind}")


HUBER, TUBE = 0.135, 0.05
SIGNED = ("squared_hinge", "logistic")
PACKED = "n int, starts binary, features binary, local binary, value binary, y binary, target binary, weight binary, folds binary"


def _pack(n_folds: int):
    def block(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        index, value = table.column(0).combine_chunks(), table.column(1).combine_chunks()
        starts = np.concatenate([[0], np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        features, local = np.unique(index.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        own = [np.asarray(table.column(2 + k).to_numpy(), dtype=d) for k, d in enumerate((np.int32, np.float64, np.float64))]
        folds = np.stack([np.asarray(table.column(5 + k).to_numpy(), dtype=np.int32) for k in range(n_folds)], axis=1) if n_folds else np.zeros((len(table), 0), dtype=np.int32)
        arrays = [starts, features.astype(np.int32), local.astype(np.uint16 if len(features) <= 1 << 16 else np.int32), value.flatten().to_numpy(zero_copy_only=False).astype(np.float32), *own, folds]
        return pa.RecordBatch.from_arrays([pa.array([len(table)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=[x.split()[0] for x in PACKED.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                ends = np.cumsum(batch.column(0).slice(i).value_lengths().to_numpy(zero_copy_only=False) + 1)
                n = max(1, int(np.searchsorted(ends, BLOCK_ENTRIES - size, side="right")))
                held.append(batch.slice(i, n))
                size, i = size + int(ends[min(n, len(ends)) - 1]), i + n
                if size >= BLOCK_ENTRIES or i < batch.num_rows:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return run


def packed(rows: DataFrame, y: Column, target: Column | None = None, weight: Column | None = None, folds: list[str] = ()) -> DataFrame:
    """Rows as blocks for ``fit``. ``y``: class ranks; ``target``: numbers for losses that take them; ``folds``: columns that problems name by number."""
    one = F.lit(1.0)
    columns = ["index", "value", y.cast("int").alias("_y"), F.coalesce(target if target is not None else one, one).cast("double").alias("_t"), (weight if weight is not None else one).cast("double").alias("_w")]
    laid = rows.select(*columns, *[F.col(f).cast("int").alias(f"_f{i}") for i, f in enumerate(folds)])
    entries = laid.agg(F.coalesce(F.sum(F.size("index") + 1), F.lit(0))).first()[0]
    n, cores = max(1, -(-entries // BLOCK_ENTRIES)), rows.sparkSession.sparkContext.defaultParallelism  # a task for each block at least, so that few rows give few matrices to add up
    dealt = laid.coalesce(1) if n == 1 else laid.repartition(min(n, max(cores, partitions(rows.sparkSession))))  # however few files the rows were in
    return written(dealt.mapInArrow(_pack(len(folds)), PACKED), "packed").coalesce(cores)  # a matrix for each core, not for each file


class _Block:
    def __init__(self, row: dict):
        self.n = row["n"]
        take = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.starts, self.features, self.value = take("starts", np.int64), take("features", np.int32), take("value", np.float32)
        self.packed = take("local", np.uint16 if len(self.features) <= 1 << 16 else np.int32)
        self.local = self.packed.astype(np.intp)
        self.y, self.target, self.weight = take("y", np.int32), take("target", np.float64), take("weight", np.float64)
        self.folds = take("folds", np.int32).reshape(self.n, -1)
        self.dense = None

    def lay(self, columns: int) -> None:
        """Lays a dense matrix if products with so many columns are cheaper then."""
        cells = self.n * len(self.features)
        if 0 < cells <= DENSE and cells * (LAY + DENSE_STEP * columns) < len(self.value) * columns:
            self.dense = np.zeros((self.n, len(self.features)))
            self.dense[np.repeat(np.arange(self.n), np.diff(self.starts)), self.local] = self.value

    def weights_for(self, p: Problem) -> np.ndarray:
        """Of each row how much it counts in a problem."""
        used = np.ones(self.n, dtype=bool)
        for column, fold in p.without:
            used &= self.folds[:, column] != fold
        for column, fold in p.only:
            used &= self.folds[:, column] == fold
        if p.among is not None:
            used &= np.isin(self.y, p.among)
        own = self.weight if p.balanced else np.ones(self.n)
        return p.c * used * own * np.where(np.isin(self.y, p.positive), p.weight, 1.0)

    def signs(self, p: Problem) -> np.ndarray:
        return np.where(np.isin(self.y, p.positive), 1.0, -1.0) if p.loss in SIGNED else self.target

    def products(self, weights: np.ndarray) -> np.ndarray:
        """Rows times a weight matrix, whose last row has the intercepts."""
        if self.dense is not None:
            return self.dense @ weights[self.features] + weights[-1]
        own, out = weights[self.features], np.repeat(weights[-1:], self.n, axis=0)
        step = max(1, AT_ONCE // max(1, weights.shape[1]))
        sizes = np.diff(self.starts)
        full = np.flatnonzero(sizes)
        bounds = self.starts[full]
        if weights.shape[1] <= FEW:
            for j, column in enumerate(np.ascontiguousarray(own.T)) if len(full) else ():
                out[full, j] += np.add.reduceat(column[self.local] * self.value, bounds)
            return out
        i = 0
        while i < len(full):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, side="right")) - 1) if i + 1 < len(full) else len(full)
            a, b = bounds[i], self.starts[full[j - 1] + 1]
            out[full[i:j]] += np.add.reduceat(own[self.local[a:b]] * self.value[a:b, None], bounds[i:j] - a, axis=0)
            i = j
        return out

    def turned(self, slopes: np.ndarray) -> np.ndarray:
        """Of each of the block's features the sum of its rows' slopes."""
        if self.dense is not None:
            return self.dense.T @ slopes
        if slopes.shape[1] <= FEW:
            sizes = np.diff(self.starts)
            return np.stack([np.bincount(self.local, weights=np.repeat(slope, sizes) * self.value, minlength=len(self.features)) for slope in slopes.T], axis=1)
        order = np.argsort(self.packed, kind="stable")
        cuts = np.searchsorted(self.packed[order], np.arange(len(self.features)))
        row = np.repeat(np.arange(self.n), np.diff(self.starts))[order]
        value, out = self.value[order], np.empty((len(self.features), slopes.shape[1]))
        step, i = max(1, AT_ONCE // max(1, slopes.shape[1])), 0
        ends = np.append(cuts[1:], len(row))
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(ends, cuts[i] + step, side="right")))
            a, b = cuts[i], ends[j - 1]
            out[i:j] = np.add.reduceat(slopes[row[a:b]] * value[a:b, None], cuts[i:j] - a, axis=0)
            i = j
        return out


def blocks_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):  # arrays stay where the batch has them
            yield _Block({name: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for name, v in ((name, batch.column(k)[i]) for k, name in enumerate(batch.schema.names))})


def ranges_out(total: np.ndarray):
    """A matrix as (part, body) rows of whole matrix rows."""
    step = max(1, RANGE // max(1, total.shape[1]))
    for i in range(0, len(total), step):
        yield pa.RecordBatch.from_arrays([pa.array([i // step], pa.int32()), pa.array([np.ascontiguousarray(total[i : i + step]).tobytes()], pa.binary())], names=["part", "body"])


def summed(parts: DataFrame, shape: tuple[int, int], tasks: int) -> np.ndarray:
    """The sum of matrices that ``tasks`` tasks gave as ``ranges_out``; those of more than a few are added up by range before they reach the driver."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column(1).to_pylist():
                x = np.frombuffer(body)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "body"])

    out, step = np.zeros(shape), max(1, RANGE // max(1, shape[1]))
    added = parts if tasks <= DIRECT else parts.groupBy("part").applyInArrow(add, "part int, body binary")
    for r in added.collect():  # ``DIRECT`` matrices of at most ``shape``, or one
        x = np.frombuffer(r.body).reshape(-1, shape[1])
        out[r.part * step : r.part * step + len(x)] += x
    return out


def tasks_of(blocks: DataFrame) -> int:
    return blocks.rdd.getNumPartitions()


def _pass(sent, problems: list[Problem]):
    def run(batches):
        weights = sent.value
        total = np.zeros((len(weights) + 1, weights.shape[1]))  # gradients, the intercepts' and the losses
        for block in blocks_of(batches):
            block.lay(weights.shape[1])
            z = block.products(weights)
            slopes = np.empty_like(z)
            for m, p in enumerate(problems):
                counts = block.weights_for(p)
                loss, slope = losses(p.loss, z[:, m], block.signs(p))
                slopes[:, m] = counts * slope
                total[-1, m] += counts @ loss
            if len(block.features):
                total[block.features] += block.turned(slopes)
            total[-2] += slopes.sum(axis=0)
        yield from ranges_out(total)

    return run


def _descent(start: np.ndarray, tolerance: float):
    """The way to the least of one function: gives the next point to try and the best so far, takes the former's value and slope, and returns the point that it has arrived at."""
    w = start
    f, g = yield w, w
    far, ahead, length, scale = max(1.0, np.abs(g).max()), -g, 1 / max(1.0, np.sqrt(g @ g)), 1.0
    past: list[tuple[np.ndarray, np.ndarray, float]] = []  # moves, changes of slope, and one by their product
    while np.abs(g).max() > tolerance * far and length > 1e-12:
        trial = w + length * ahead
        fn, gn = yield trial, w
        if not fn <= f + 1e-4 * length * (g @ ahead):
            length /= 4
            continue
        s, y = trial - w, gn - g
        curve = s @ y
        if curve > 1e-12:
            past, scale = [*past, (s, y, 1 / curve)][-MEMORY:], curve / (y @ y)
        w, f, g, q, along = trial, fn, gn, gn.copy(), []
        for s, y, r in reversed(past):
            along.append(r * (s @ q))
            q -= along[-1] * y
        q *= scale
        for (s, y, r), a in zip(past, reversed(along), strict=True):
            q += (a - r * (y @ q)) * s
        ahead, length = -q if q @ g > 0 else -g, 1.0
    return w


def minimised(evaluate, start: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Columns of a matrix moved to the least of as many functions. ``evaluate(matrix, columns)`` gives values and slopes.

    All columns step together, each by its own way, whose few arrays stay near the processor while it is moved; one that did not improve tries a
    shorter step while others go on. Columns that have arrived are dropped.
    """
    out = start.copy()
    ways = [_descent(start[:, k].copy(), tolerance) for k in range(start.shape[1])]
    points = {k: next(way) for k, way in enumerate(ways)}
    for _ in range(steps + 1):
        if not points:
            break
        columns = np.array(list(points))
        f, g = evaluate(np.ascontiguousarray(np.stack([points[k][0] for k in columns]).T), columns)
        for k, value, slope in zip(columns.tolist(), f, np.ascontiguousarray(g.T), strict=True):
            try:
                points[k] = ways[k].send((value, slope))
            except StopIteration as end:
                out[:, k] = end.value
                del points[k]
    for k, (_, best) in points.items():
        out[:, k] = best
    return out


def fit(blocks: DataFrame, problems: list[Problem], width: int, steps: int = 50, tolerance: float = 1e-3) -> np.ndarray:
    """The weights of all problems, a column each; the last row has the intercepts. ``blocks``: rows that ``packed`` has laid."""
    context = blocks.sparkSession.sparkContext
    at_once, tasks = max(1, CELLS // (width + 1)), tasks_of(blocks)
    out = np.zeros((width + 1, len(problems)))
    for a in range(0, len(problems), at_once):
        group = problems[a : a + at_once]
        seen = np.zeros((width + 1, len(group)), dtype=bool)
        for m, p in enumerate(group):
            for first, last in p.features:
                seen[min(first, width) : min(last, width), m] = True
        seen[-1] = True
        charged = np.ones((width + 1, len(group)))
        charged[-1] = [0.0 if p.free_intercept else 1.0 for p in group]

        def evaluate(w: np.ndarray, columns: np.ndarray, group=group, seen=seen, charged=charged) -> tuple[np.ndarray, np.ndarray]:
            sent = context.broadcast(w)
            own = [group[m] for m in columns]
            total = summed(blocks.mapInArrow(_pass(sent, own), "part int, body binary"), (width + 2, len(own)), tasks)
            sent.unpersist()
            kept = charged[:, columns]
            return total[-1] + (kept * w * w).sum(axis=0) / 2, (total[:-1] + kept * w) * seen[:, columns]

        out[:, a : a + len(group)] = minimised(evaluate, out[:, a : a + len(group)], steps, tolerance)
    return out


def scored(rows: DataFrame, weights: np.ndarray, name: str = "scores") -> DataFrame:
    """``rows`` with an array of what each column of a weight matrix gives them."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def score(index: pa.Array, value: pa.Array) -> pa.Array:
        w = sent.value
        sizes = index.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        i, v = index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
        out, full, a = np.repeat(w[-1:], len(sizes), axis=0), np.flatnonzero(sizes), 0
        step = max(1, AT_ONCE // max(1, w.shape[1]))
        bounds = starts[full]
        while a < len(full):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1) if a + 1 < len(full) else len(full)
            x, z = bounds[a], starts[full[b - 1] + 1]
            out[full[a:b]] += np.add.reduceat(w[i[x:z]] * v[x:z, None], bounds[a:b] - x, axis=0)
            a = b
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))

    return rows.withColumn(name, score("index", "value"))


def valued(rows: DataFrame, numbers: np.ndarray) -> DataFrame:
    """``rows`` whose features have, in place of their values, a number of their own each."""
    sent = rows.sparkSession.sparkContext.broadcast(numbers)

    @F.arrow_udf("array<double>")
    def own(index: pa.Array) -> pa.Array:
        sizes = index.value_lengths().to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(sent.value[index.flatten().to_numpy(zero_copy_only=False)], pa.float64()))

    return rows.withColumn("value", own("index"))


class _Settings(Params):
    labelCol = Param(Params._dummy(), "labelCol", "column of the class's name", TypeConverters.toString)
    c = Param(Params._dummy(), "c", "weight of the losses against the penalty", TypeConverters.toFloat)
    classes = Param(Params._dummy(), "classes", "the classes, in their order", TypeConverters.toListString)


class LinearClasses(Estimator, _Settings):
    """A squared-hinge machine for each class against the rest, over the arrays ``index`` and ``value``."""

    @keyword_only
    def __init__(self, *, labelCol="y", c=0.2, classes=CLASSES):
        super().__init__()
        self._set(labelCol=labelCol, c=c, classes=list(classes))

    def _fit(self, dataset: DataFrame) -> LinearClassesModel:
        classes, label = self.getOrDefault(self.classes), self.getOrDefault(self.labelCol)
        rows = written(dataset.select(label, "index", "value"), "featured")  # features are made once
        blocks = packed(rows, rank(F.col(label), tuple(classes)))
        width = rows.agg(F.coalesce(F.max(F.array_max("index")) + 1, F.lit(0))).first()[0]
        return LinearClassesModel(classes=classes)._with(fit(blocks, [Problem(positive=(k,), c=self.getOrDefault(self.c)) for k in range(len(classes))], width))


class LinearClassesModel(Model, _Settings, Stored):
    """Adds ``scores``, an array by class, and ``label``, the class of the highest; ties go to the first class."""

    SCHEMA = "index int, weights array<double>"

    @keyword_only
    def __init__(self, *, classes=CLASSES):
        super().__init__()
        self._set(classes=list(classes))
        self.weights = np.zeros((1, len(classes)))

    def _with(self, weights: np.ndarray) -> LinearClassesModel:
        self.weights = weights
        return self

    def table(self) -> DataFrame:
        from pyspark.sql import SparkSession

        held = pa.table({"index": pa.array(range(len(self.weights)), pa.int32()), "weights": pa.array(list(self.weights), pa.list_(pa.float64()))})
        return SparkSession.active().createDataFrame(held)  # a row a feature, as many as the vocabularies' caps allow

    def extra(self) -> dict:
        return {"width": len(self.weights)}

    def restored(self, table: DataFrame, held: dict) -> LinearClassesModel:
        return self._with(np.array([r.weights for r in table.orderBy("index").collect()]).reshape(held["width"], -1))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.getOrDefault(self.classes)
        known = scored(dataset.withColumn("index", F.filter("index", lambda i: i < len(self.weights) - 1)).withColumn("value", F.slice("value", 1, F.size("index"))), self.weights)
        top = F.array_position("scores", F.array_max("scores")).cast("int")
        return known.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in classes]), top))
