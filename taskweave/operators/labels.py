"""Label columns: merging, ranks, scores, names and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes in rank order, and the score of each label.
CLASSES = ("E0", "E1", "E23")
SCORES = {"E0": 0.1, "E3": 0.3, "E23": 0.4, "E2": 0.5, "E1": 0.7}


def mapped(column: Column, table: dict) -> Column:
    """A lookup in a small table as one expression; other values give null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column]


def merged(label: Column, groups: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The label with groups of labels under one name."""
    out = label
    for name, members in (groups or {"E23": ("E2", "E3")}).items():
        out = F.when(label.isin(*members), name).otherwise(out)
    return out


def rank(label: Column, classes=CLASSES) -> Column:
    return mapped(label, {c: i for i, c in enumerate(classes)})


def from_rank(number: Column, classes=CLASSES) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (number + 1).cast("int"))


def score(label: Column) -> Column:
    return mapped(label, SCORES)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, balanced, inverse_share, root_balanced, inverse) of each class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    share = F.col("total") / F.col("n")
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (share / F.col("k")).alias("balanced"), share.alias("inverse_share"), F.sqrt(share / F.col("k")).alias("root_balanced"), (1 / F.col("n")).alias("inverse"))


def missing_classes(df: DataFrame, label: str, classes=CLASSES) -> DataFrame:
    """Classes without a row."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    return wanted.join(df.select(F.col(label).alias("label")).distinct(), "label", "left_anti")
