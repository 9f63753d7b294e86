"""Analysis of matched panels: one label for each unit and condition."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.shared import partitions, written

BLOCK = 4096
RAW = ("E0", "E1", "E2", "E3")


def complete_cells(rows: DataFrame, unit: list[str], condition: str, label: str, order: str, conditions: list[str], labels: tuple[str, ...] = RAW) -> DataFrame:
    """A column for each condition with the unit's first label by ``order``; units that lack one are dropped. ``labels``: all that there are.

    A label is its place in ``labels`` until the end, and a number as ``order`` makes the state of a unit one of fixed size, which is hashed and not sorted.
    """
    place = F.when(F.col(label).isNotNull(), F.coalesce(*[F.when(F.col(label) == l, i) for i, l in enumerate(labels)], F.raise_error(F.concat(F.lit("unknown label "), F.col(label))).cast("int")))
    first = [F.min_by(F.when(F.col(condition) == c, place), F.when(F.col(condition) == c, F.col(order))).alias(c) for c in conditions]
    found = rows.groupBy(*unit).agg(*first).na.drop(subset=conditions)
    name = lambda c: F.element_at(F.array(*[F.lit(l) for l in labels]), F.col(f"`{c}`") + 1).alias(c)
    return found.select(*unit, *[name(c) for c in conditions])


def outcomes(label: Column) -> dict[str, Column]:
    """0 or 1 for each outcome of a raw label."""
    return {"E0": label == "E0", "E1": label == "E1", "E2": label == "E2", "E3": label == "E3", "E23": label.isin("E2", "E3"), "impacted": label != "E0"}


def long_outcomes(wide: DataFrame, unit: list[str], conditions: list[str]) -> DataFrame:
    """(unit..., condition, outcome, value) of a complete table."""
    cells = wide.select(*unit, F.explode(F.create_map(*[x for c in conditions for x in (F.lit(c), F.col(f"`{c}`"))])).alias("condition", "label"))
    return cells.select(*unit, "condition", "label", F.explode(F.create_map(*[x for k, v in outcomes(F.col("label")).items() for x in (F.lit(k), v.cast("int"))])).alias("outcome", "value"))


def patterns(wide: DataFrame, by: list[str], conditions: list[str]) -> DataFrame:
    """(by..., conditions..., weight): how many units have the same labels in all conditions; as many rows as there are combinations, however many units."""
    return wide.groupBy(*by, *conditions).agg(F.count("*").alias("weight"))


def against_children(wide: DataFrame, parent: str, own: Column, conditions: list[str], labels: tuple[str, ...] = RAW) -> DataFrame:
    """(condition, outcome, own, child_rate, n, weight): a parent's value against the mean of its ``n`` children, and how many parents have the same.

    ``own``: whether a row is the parent's. Labels are counted once for each parent and condition, and parents with equal counts become one row before outcomes are made.
    """
    count = lambda c, l: F.count_if(~own & (F.col(f"`{c}`") == l))
    mine = lambda c: F.max(F.when(own, F.coalesce(*[F.when(F.col(f"`{c}`") == l, i) for i, l in enumerate(labels)])))
    each = wide.groupBy(parent).agg(*[mine(c).alias(f"own_{i}") for i, c in enumerate(conditions)], *[count(c, l).alias(f"k_{i}_{j}") for i, c in enumerate(conditions) for j, l in enumerate(labels)])
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"own_{i}").alias("own"), *[F.col(f"k_{i}_{j}").alias(f"k{j}") for j in range(len(labels))]) for i, c in enumerate(conditions)])
    names = [f"k{j}" for j in range(len(labels))]
    n = sum((F.col(k) for k in names[1:]), F.col(names[0]))
    same = each.select(F.explode(cells).alias("x")).select("x.*").where(F.col("own").isNotNull() & (n > 0)).groupBy("condition", "own", *names).agg(F.count("*").alias("weight"))
    hits = [(outcomes(F.lit(l))) for l in labels]
    value = lambda o: sum((F.when(F.col("own") == j, h[o].cast("int")).otherwise(0) for j, h in enumerate(hits)), F.lit(0))
    rate = lambda o: sum((F.col(names[j]) * h[o].cast("int") for j, h in enumerate(hits)), F.lit(0)) / n
    long = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), value(o).alias("value"), rate(o).alias("child_rate")) for o in hits[0]]))
    return same.select("condition", n.alias("n"), "weight", long.alias("x")).select("condition", "x.outcome", F.col("x.value").alias("own"), "x.child_rate", "n", "weight")


def _replicates(by: list[str], reps: int, seed: str):
    """Of rows (by..., group, block, n, values, totals), the sums of each replicate's draws from the block."""

    def run(batches):
        start = zlib.crc32(seed.encode())
        for batch in batches:
            rows, sums = [], []
            for i, (group, block, n, values, totals) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_group", "_block", "n", "_values", "_totals")], strict=True)):
                v, c = np.array([(x["_v"], x["_c"]) for x in values]).T
                shares = np.array([t["_c"] for t in totals], dtype=np.float64) / n
                place = [t["_block"] for t in totals].index(block)
                for rep in range(reps):
                    key = [start, group & (1 << 64) - 1, rep]
                    own = n if len(shares) == 1 else int(np.random.default_rng(key).multinomial(n, shares)[place])
                    sums.append(float(np.random.default_rng([*key, block + 1]).multinomial(own, c / c.sum()) @ v))
                rows += [i] * reps
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in by], pa.array(list(range(reps)) * (len(rows) // reps), pa.int32()), pa.array(sums, pa.float64())], names=[*by, "_rep", "_s"])

    return run


def bootstrap(values: DataFrame, by: list[str], value: str, reps: int = 2000, seed: str = "boot", weight: str | None = None) -> DataFrame:
    """(by..., mean, low, high, n): the mean of each group and its 95 % percentile interval.

    A replicate of n draws with replacement is a multinomial count of the group's distinct values, so the work is replicates by distinct
    values, however many rows there are. Distinct values are held in blocks of about ``BLOCK``: a replicate's draws are first shared
    among blocks. Draws depend on seed, group, replicate and block alone. ``weight``: how many times a row counts.
    """
    keys = by or ["_all"]
    values = values if by else values.withColumn("_all", F.lit(0))
    counts = values.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_c")).where("_v is not null")
    counts = written(counts.withColumn("_group", F.xxhash64(*keys)), "values")
    held = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_n_blocks"))
    blocks = counts.join(held.select(*keys, "n", "_n_blocks"), keys).groupBy(*keys, "_group", "n", F.pmod(F.xxhash64("_v"), F.col("_n_blocks")).cast("int").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_values"), F.sum("_c").alias("_c"))
    totals = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_c"))).alias("_totals"))
    rows = blocks.join(totals, keys).select(*keys, "_group", "_block", "n", "_values", "_totals").repartition(partitions(values.sparkSession), *keys, "_block")
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("_rep", T.IntegerType()), T.StructField("_s", T.DoubleType())])
    means = rows.mapInArrow(_replicates(keys, reps, seed), schema).groupBy(*keys, "_rep").agg(F.sum("_s").alias("_s")).join(held, keys).select(*keys, (F.col("_s") / F.col("n")).alias("_m"))
    spread = means.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    return held.join(spread, keys).select(*by, "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), "n")


def agreement(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("int"))


def modal(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """The commonest label (ties: the lowest) and the mean of ``impacted``."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("modal"), F.sum("_n").alias("n"))
