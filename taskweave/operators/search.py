"""Decision search: grids of thresholds, offsets and gates evaluated as data.

Thresholds, cuts and gates are judged from histograms: rows are counted once by how many candidates they reach, and running sums of those
counts give every candidate. Offsets are counted as one confusion matrix a candidate in each task. So what is shuffled has a fixed size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskweave.operators.splits import draw


def f1(hit: Column, called: Column, support: Column) -> Column:
    return F.when(called + support > 0, 2 * hit / (called + support)).otherwise(0.0)


def best(candidates: DataFrame, metric: str, *order: str) -> DataFrame:
    """The candidate with the highest metric; ties go to the first by ``order``. Candidates are few."""
    return candidates.orderBy(F.desc(F.round(metric, 9)), *order).limit(1)


def bucket(score: Column, points: Column) -> Column:
    """How many of the points a score reaches."""
    return F.size(F.filter(points, lambda p: p <= score))


def threshold_grid(df: DataFrame, positive: Column, score: str, points: list[float]) -> DataFrame:
    """(t, tp, called, support, f1) for each threshold, from a histogram of the rows by how many thresholds they reach."""
    order = sorted(set(map(float, points)))
    grid = F.array(*[F.lit(p) for p in order])
    rows = df.select(positive.cast("int").alias("_y"), bucket(F.col(score), grid).alias("_b")).groupBy("_y", "_b").agg(F.count("*").alias("_n"))
    each = rows.select("*", F.posexplode(grid).alias("_i", "t")).withColumn("_called", F.when(F.col("_b") > F.col("_i"), F.col("_n")).otherwise(0))  # points by points
    sums = each.groupBy("t").agg(F.sum(F.col("_called") * F.col("_y")).alias("tp"), F.sum("_called").alias("called"), F.sum(F.col("_n") * F.col("_y")).alias("support"))
    return sums.withColumn("f1", f1(F.col("tp"), F.col("called"), F.col("support")))


def argmax(scores: list[Column], classes) -> Column:
    """The class of the highest score; ties go to the first class."""
    out, top = F.lit(classes[-1]), F.greatest(*scores)
    for c, s in reversed(list(zip(classes, scores, strict=True))):
        out = F.when(s == top, c).otherwise(out)
    return out


def macro_f1(rows: DataFrame, by: list[str], truth: str, predicted: str, n: str, classes) -> DataFrame:
    """(by..., macro_f1) over candidates in ``by``."""
    sums = []
    for c in classes:
        t, p = F.col(truth) == c, F.col(predicted) == c
        sums += [F.sum(F.when(t & p, F.col(n)).otherwise(0)).alias(f"_h_{c}"), F.sum(F.when(t, F.col(n)).otherwise(0)).alias(f"_s_{c}"), F.sum(F.when(p, F.col(n)).otherwise(0)).alias(f"_c_{c}")]
    each = [f1(F.col(f"_h_{c}"), F.col(f"_c_{c}"), F.col(f"_s_{c}")) for c in classes]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return rows.groupBy(*by).agg(*sums).select(*by, (total / len(classes)).alias("macro_f1"))


def collapsed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("_n"))


def _macro_of_calls(df: DataFrame, truth: str, scores: list[str], classes, candidates: np.ndarray, call) -> DataFrame:
    """(_i, macro_f1) of each candidate; ``call(x, candidate)`` gives the class scores of a batch, whose ties, to six decimals, go to the first class.

    Each task counts its rows into one confusion matrix a candidate; only those travel, so the work is rows times candidates and the
    shuffle is of fixed size.
    """
    names = list(classes)

    def count(batches):
        total = np.zeros((len(candidates), len(names) + 1, len(names)), dtype=np.int64)  # the last row is for other labels
        for batch in batches:
            if batch.num_rows:
                place = {c: i for i, c in enumerate(names)}
                y = np.array([place.get(c, len(names)) for c in batch.column(0).to_pylist()])
                x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(scores))], axis=1)
                for i, candidate in enumerate(candidates):
                    called = np.rint(call(x, candidate) * 1e6).argmax(axis=1)
                    total[i] += np.bincount(y * len(names) + called, minlength=total[i].size).reshape(total[i].shape)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*[pa.array(a.astype(np.int32)) for a in at], pa.array(total[at])], names=["_i", "_y", "_c", "_n"])

    rows = df.select(truth, *[F.col(s).cast("double") for s in scores]).na.drop(subset=scores)
    counts = rows.mapInArrow(count, "_i int, _y int, _c int, _n long").groupBy("_i", "_y", "_c").agg(F.sum("_n").alias("_n"))
    return macro_f1(counts, ["_i"], "_y", "_c", "_n", range(len(names)))


def _grid(df: DataFrame, truth: str, scores: list[str], classes, grid: list[list[float]], call) -> DataFrame:
    table = np.array(list(itertools.product(*grid)), dtype=np.float64)
    sums = _macro_of_calls(df, truth, scores, classes, table, call)
    columns = [f"b{k}" for k in range(len(scores))]
    candidates = df.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(table)], "_i int, " + ", ".join(f"{c} double" for c in columns))  # the grid
    return sums.join(F.broadcast(candidates), "_i").select(*columns, "macro_f1")


def offset_grid(df: DataFrame, truth: str, scores: list[str], classes, grid: list[list[float]]) -> DataFrame:
    """(b0, b1, ..., macro_f1) for each combination of class offsets."""
    return _grid(df, truth, scores, classes, grid, lambda x, offsets: x + offsets)


def passed_grid(df: DataFrame, truth: str, scores: list[str], classes, grid: list[list[float]]) -> DataFrame:
    """(b0, b1, ..., macro_f1) for each combination of thresholds of boundary scores; the rank of a class is how many are passed."""
    ranks = np.arange(len(classes))
    return _grid(df, truth, scores, classes, grid, lambda x, cuts: (x >= cuts).sum(axis=1)[:, None] == ranks)


def blend_trials(df: DataFrame, truth: str, matrices: list[list[str]], classes, trials: int, seed: str = "blend") -> DataFrame:
    """(trial, w, macro_f1) of score matrices, each a list of columns by class, blended by random weights."""
    drawn = simplex_weights(df.sparkSession, trials, len(matrices), seed).orderBy("trial").collect()  # ``trials`` rows
    table = np.array([r.w for r in drawn])

    def mixed(x, w):
        return np.tensordot(w, x.reshape(len(x), len(w), -1), axes=(0, 1))

    flat = [c for m in matrices for c in m]
    unique = df.select(truth, *[F.col(c).alias(f"_m{i}") for i, c in enumerate(flat)])
    sums = _macro_of_calls(unique, truth, [f"_m{i}" for i in range(len(flat))], classes, table, mixed)
    candidates = df.sparkSession.createDataFrame([(r.trial, r.w) for r in drawn], "trial long, w array<double>")
    return sums.join(F.broadcast(candidates), F.col("_i") == F.col("trial")).select("trial", "w", "macro_f1")


def coordinate_search(df: DataFrame, truth: str, scores: list[str], classes, points: list[float], passes: int = 3, evaluate=offset_grid) -> list[float]:
    """Offsets, or thresholds with ``passed_grid``, by coordinate passes that keep strict improvements; one job for each coordinate, of which a row comes back."""
    held, top = [0.0] * len(scores), -1.0
    for _ in range(passes):
        before = list(held)
        for k in range(len(scores)):
            grid = [[h] if i != k else [held[k], *points] for i, h in enumerate(held)]
            found = best(evaluate(df, truth, scores, classes, grid), "macro_f1", f"b{k}").first()
            if found.macro_f1 > top + 1e-12:
                held[k], top = found[f"b{k}"], found.macro_f1
        if held == before:
            break
    return held


def grouped_offsets(df: DataFrame, group: str, truth: str, scores: list[str], classes, points: list[float], passes: int = 3) -> dict[int, tuple[float, list[float]]]:
    """For each group (a number) the best (macro F1, offsets) by ``coordinate_search``; all groups move together, a job for each coordinate of a pass.

    Tasks count one confusion matrix for each group and candidate; groups are models or folds, so few.
    """
    names = list(classes)
    groups = sorted(r[0] for r in df.select(group).distinct().collect())  # a row for each group
    held, top = {g: [0.0] * len(scores) for g in groups}, dict.fromkeys(groups, -1.0)
    rows = df.select(F.col(group).cast("int"), truth, *[F.col(s).cast("double") for s in scores]).na.drop(subset=scores)

    def tried(candidates: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        n = max(map(len, candidates.values()))

        def count(batches):
            place = {c: i for i, c in enumerate(names)}
            total = {g: np.zeros((n, len(names) + 1, len(names)), dtype=np.int64) for g in candidates}
            for batch in batches:
                own = batch.column(0).to_numpy()
                y = np.array([place.get(c, len(names)) for c in batch.column(1).to_pylist()])
                x = np.stack([batch.column(k + 2).to_numpy(zero_copy_only=False) for k in range(len(scores))], axis=1)
                for g in np.unique(own).tolist():
                    for i, offsets in enumerate(candidates[g]):
                        called = np.rint((x[own == g] + offsets) * 1e6).argmax(axis=1)
                        total[g][i] += np.bincount(y[own == g] * len(names) + called, minlength=total[g][i].size).reshape(total[g][i].shape)
            for g, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["g", "t"])

        sums = {g: np.zeros((n, len(names) + 1, len(names))) for g in candidates}
        for r in rows.mapInArrow(count, "g int, t binary").collect():  # of fixed size for each task
            sums[r.g] += np.frombuffer(r.t, dtype=np.int64).reshape(sums[r.g].shape)
        out = {}
        for g, t in sums.items():
            hit = np.stack([t[:, k, k] for k in range(len(names))], axis=1)
            both = t[:, : len(names)].sum(axis=2) + t.sum(axis=1)
            out[g] = np.where(both > 0, 2 * hit / np.maximum(both, 1), 0).mean(axis=1)[: len(candidates[g])]
        return out

    for _ in range(passes):
        before = {g: list(h) for g, h in held.items()}
        for k in range(len(scores)):
            grid = {g: sorted({h[k], *points}) for g, h in held.items()}
            found = tried({g: np.array([[*h[:k], v, *h[k + 1 :]] for v in grid[g]]) for g, h in held.items()})
            for g, values in found.items():
                i = int(np.round(values, 9).argmax())
                if values[i] > top[g] + 1e-12:
                    held[g][k], top[g] = grid[g][i], float(values[i])
        if held == before:
            break
    return {g: (top[g], held[g]) for g in groups}


def cut_points(df: DataFrame, truth: str, score: str, classes, quantiles: list[float]) -> DataFrame:
    """(a, b, macro_f1) for each pair of cuts among the score's quantiles; classes are in the order of the score.

    Rows are counted once, by class and by how many cuts they reach; all pairs follow from running sums of those counts.
    """
    cuts = df.agg(F.percentile(score, F.array(*[F.lit(q) for q in quantiles])).alias("_q")).select(F.array_sort(F.array_distinct(F.transform("_q", lambda x: F.round(x, 6)))).alias("_q"))
    rows = df.crossJoin(F.broadcast(cuts)).select(F.col(truth).alias("_y"), "_q", bucket(F.col(score), F.col("_q")).alias("_b"))
    counts = rows.groupBy("_q", "_b").agg(*[F.count_if(F.col("_y") == c).alias(f"n{k}") for k, c in enumerate(classes)], F.count("*").alias("n"))
    each = counts.select("*", F.posexplode("_q").alias("i", "cut"))  # cuts by cuts
    below = F.col("_b") <= F.col("i")
    names = ["n", *[f"n{k}" for k in range(len(classes))]]
    sums = each.groupBy("i", "cut").agg(*[F.sum(F.when(below, F.col(x)).otherwise(0)).alias(x) for x in names], *[F.sum(x).alias(f"all_{x}") for x in names])
    left, right = sums.select(*[F.col(x).alias(f"a_{x}") for x in ("i", "cut", *names)]), sums.select(*[F.col(x).alias(f"b_{x}") for x in ("i", "cut", *names)], *[f"all_{x}" for x in names])
    pairs = F.broadcast(left).join(right, F.col("a_i") < F.col("b_i"))  # of the quantiles asked for
    c = F.col
    parts = [(c("a_n0"), c("a_n"), c("all_n0")), (c("b_n1") - c("a_n1"), c("b_n") - c("a_n"), c("all_n1")), (c("all_n2") - c("b_n2"), c("all_n") - c("b_n"), c("all_n2"))]
    total = sum((f1(*p) for p in parts[1:]), f1(*parts[0]))
    return pairs.select(c("a_cut").alias("a"), c("b_cut").alias("b"), (total / 3).alias("macro_f1"))


def gate_grid(df: DataFrame, truth: str, predicted: str, gate_class: str, confidence: str, support: str, thresholds: list[float], supports: list[int], classes) -> DataFrame:
    """(t, m, macro_f1) of overriding with ``gate_class`` where confidence and support reach a candidate's.

    Rows are counted once, by label, prediction and how many thresholds and supports they reach.
    """
    t, m = F.array(*[F.lit(float(x)) for x in sorted(thresholds)]), F.array(*[F.lit(x) for x in sorted(supports)])
    rows = collapsed(df.select(truth, predicted, F.coalesce(bucket(F.col(confidence), t), F.lit(0)).alias("_i"), F.coalesce(bucket(F.col(support), m), F.lit(0)).alias("_j")), [truth, predicted, "_i", "_j"])
    rows = rows.select("*", F.posexplode(t).alias("_a", "t")).select("*", F.posexplode(m).alias("_b", "m"))
    rows = rows.withColumn("_p", F.when((F.col("_i") > F.col("_a")) & (F.col("_j") > F.col("_b")), gate_class).otherwise(F.col(predicted)))
    return macro_f1(rows, ["t", "m"], truth, "_p", "_n", classes)


def class_gates(df: DataFrame, truth: str, predicted: str, scores: dict[str, str], thresholds: list[float], classes) -> list[tuple[str, float | None, float, float]]:
    """(class, threshold, macro F1 before, after) of each class in turn, in the order of ``scores`` (class -> its column).

    A class overrides where its score reaches a threshold, the lowest of the best; the gate is kept only if macro F1 rises, else its
    threshold is None, and later classes see the calls of those that were kept. A null score reaches nothing. A job for each class,
    which shuffles counts by label, call and bucket; one row of it comes back. An empty table keeps none.
    """
    rows, out = df.withColumn("_call", F.col(predicted)).withColumn("_any", F.lit(1)), []
    start = macro_f1(collapsed(rows, [truth, "_call"]).withColumn("_all", F.lit(1)), ["_all"], truth, "_call", "_n", classes).first()
    held = start.macro_f1 if start else 0.0
    for name, column in scores.items():
        found = best(gate_grid(rows, truth, "_call", name, column, "_any", thresholds, [1], classes), "macro_f1", "t").first()
        kept = found is not None and found.macro_f1 > held + 1e-9
        out.append((name, found.t if kept else None, held, found.macro_f1 if kept else held))
        if kept:
            held = found.macro_f1
            rows = rows.withColumn("_call", F.when(F.col(column) >= found.t, name).otherwise(F.col("_call")))
    return out


def gated_call(predicted: Column, scores: dict[str, str], gates: list[tuple[str, float | None, float, float]]) -> Column:
    """The call after the gates that ``class_gates`` kept."""
    for name, t, *_ in gates:
        if t is not None:
            predicted = F.when(F.col(scores[name]) >= t, name).otherwise(predicted)
    return predicted


def simplex_weights(spark, trials: int, parts: int, seed: str = "blend") -> DataFrame:
    """(trial, w array): exponential draws from MD5, normalised."""
    u = lambda k: (F.conv(F.substring(draw(seed, F.concat_ws("|", F.col("trial").cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    raw = spark.range(trials).withColumnRenamed("id", "trial").withColumn("_e", F.array(*[-F.ln(u(k)) for k in range(parts)]))
    return raw.select("trial", F.transform("_e", lambda x: F.round(x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b), 6)).alias("w"))


def softmax(scores: list[Column], temperature: float = 1.0) -> Column:
    """Probabilities of a row's scores, as an array."""
    top = F.greatest(*scores)
    e = F.array(*[F.exp((s - top) / temperature) for s in scores])
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def leaderboard(df: DataFrame, by: str, metric: str, split: str) -> DataFrame:
    """Models by their metric within each split; ``best`` marks the first on validation only."""
    w = Window.partitionBy(split).orderBy(F.desc(metric), by)
    return df.withColumn("place", F.row_number().over(w)).withColumn("best", (F.col("place") == 1) & (F.col(split) == "validation"))
