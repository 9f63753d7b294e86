"""Evaluation of labels, ranks and scores. Every metric comes from a confusion table of a few rows, so rows are counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.operators.labels import CLASSES, rank


def confusion(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", classes=CLASSES, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, predicted, n), with zeros."""
    by = by or []
    counts = df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c) for c in classes])
    keys = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = keys.withColumn("truth", F.explode(names)).withColumn("predicted", F.explode(names))
    return grid.join(counts, [*by, "truth", "predicted"], "left").na.fill(0, ["n"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_report(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, precision, recall, f1, support) of a confusion table; 0 where there is nothing to divide by."""
    by = by or []
    cells = table.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("c")).select(*by, "c.*")
    each = cells.groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    return each.select(*by, "class", _ratio(F.col("hit"), F.col("called")).alias("precision"), _ratio(F.col("hit"), F.col("support")).alias("recall"), _ratio(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"), "support", "hit", "called")


def metrics(table: DataFrame, by: list[str] | None = None, present_only: bool = False) -> DataFrame:
    """(by..., accuracy, macro_f1, weighted_f1, n). ``present_only``: the macro mean leaves out classes that neither side has."""
    by = by or []
    each = class_report(table, by)
    counted = F.col("f1") if not present_only else F.when(F.col("support") + F.col("called") > 0, F.col("f1"))
    return each.groupBy(*by).agg(_ratio(F.sum("hit"), F.sum("support")).alias("accuracy"), F.avg(counted).alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


def quadratic_kappa(table: DataFrame, classes=CLASSES) -> DataFrame:
    """(qwk): 1 minus the ratio of observed to expected squared rank differences."""
    c = table.withColumn("w", F.pow(rank(F.col("truth"), classes) - rank(F.col("predicted"), classes), 2))
    rows, columns = c.groupBy("truth").agg(F.sum("n").alias("a")), c.groupBy("predicted").agg(F.sum("n").alias("b"))
    total = c.agg(F.sum("n").alias("t"))
    joined = c.join(rows, "truth").join(columns, "predicted").crossJoin(F.broadcast(total))
    return joined.agg((1 - F.sum(F.col("w") * F.col("n")) / F.sum(F.col("w") * F.col("a") * F.col("b") / F.col("t"))).alias("qwk"))


def regression(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    d = F.col(predicted) - F.col(truth)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def nearest_score(score: Column, scores: dict[str, float]) -> Column:
    """The label whose score is nearest (ties: the lower score)."""
    options = F.array(*[F.struct(F.round(F.abs(score - F.lit(v)), 9).alias("d"), F.lit(v).alias("v"), F.lit(k).alias("k")) for k, v in scores.items()])
    return F.array_min(options)["k"]


def projected_rank(score: Column, k: int) -> Column:
    return F.least(F.greatest(F.rint(score), F.lit(0.0)), F.lit(float(k - 1))).cast("int")


def audit_tag(truth: Column, predicted: Column, positive: str) -> Column:
    """missed, false or correct for one class; null where neither side has it."""
    return F.when((truth == positive) & (predicted != positive), "missed").when((truth != positive) & (predicted == positive), "false").when(truth == positive, "correct")
