"""Scoring: margins, lexical coverage, review scores and levels, percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskweave.operators.features import Grams, known_shares


def margin(scores: list[Column]) -> Column:
    """The best score less the second best."""
    ordered = F.sort_array(F.array(*scores), asc=False)
    return ordered[0] - ordered[1]


def coverage(df: DataFrame, row: str, text: str, of: Column, least_df: int = 2) -> DataFrame:
    """(row, n_tokens, coverage): the share of a text's tokens, with repeats, that enough rows ``of`` the reference have; 0 without tokens."""
    found = known_shares(df, row, [(Grams("letters"), F.col(text))], of, least_df)
    return found.select(row, F.col("n_0").alias("n_tokens"), F.when(F.col("n_0") > 0, F.col("known_0") / F.col("n_0")).otherwise(0.0).alias("coverage"))


def review_score(margin: Column, coverage: Column, n_tokens: Column) -> Column:
    """How much a prediction should be looked at: small margins, unknown words and very short texts raise it."""
    raw = F.greatest(1 / (1 + F.exp(margin)), 1 - coverage, F.when(n_tokens < 4, 0.25).otherwise(0.0))
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4)


def percentile_rank(values: DataFrame, row: str, value: str, reference: DataFrame, ref_value: str, buckets: int = 64) -> DataFrame:
    """(row, rank): the share of the reference that is at most the value.

    Both sides are dealt to value buckets by approximate quantiles of the reference; a rank is the count of lower buckets and a running
    count inside the own one, so no window spans the table.
    """
    cuts = reference.agg(F.percentile_approx(ref_value, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 10000).alias("_cuts"))
    place = lambda c: F.size(F.filter("_cuts", lambda x: x < c))
    ref = reference.select(F.col(ref_value).alias("_v")).crossJoin(F.broadcast(cuts)).select("_v", place(F.col("_v")).alias("_b"), F.lit(0).alias("_ask"))
    ask = values.select(row, F.col(value).alias("_v")).crossJoin(F.broadcast(cuts)).select(row, "_v", place(F.col("_v")).alias("_b"), F.lit(1).alias("_ask"))
    counts = ref.groupBy("_b").agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_all"))
    every = reference.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b"))
    upto = every.join(counts.select(F.col("_b").alias("_lb"), F.col("_c").alias("_lc")), F.col("_lb") < F.col("_b"), "left").groupBy("_b").agg(F.coalesce(F.sum("_lc"), F.lit(0)).alias("_low"))  # buckets by buckets
    both = ask.unionByName(ref, allowMissingColumns=True)
    w = Window.partitionBy("_b").orderBy("_v", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.sum(F.when(F.col("_ask") == 0, 1).otherwise(0)).over(w)).where("_ask = 1")
    lower = inside.join(F.broadcast(upto), "_b", "left").crossJoin(F.broadcast(total))
    return lower.select(row, ((F.col("_low") + F.col("_in")) / F.col("_all")).alias("rank"))


#: Signals of a prediction, the reason that each gives when it is low, and the quantile of the reference below which it is;
#: review scores from which a prediction's level is medium and high.
REVIEW = {"margin": ("low_decision_margin", 0.10), "word_coverage": ("low_word_coverage", 0.03), "char_coverage": ("low_char_coverage", 0.03), "total_coverage": ("low_total_feature_coverage", 0.03)}
MEDIUM, HIGH = 0.80, 0.99


def review_thresholds(reference: DataFrame) -> DataFrame:
    """One row with the least value of each signal that is not low, ``least_`` and its name."""
    return reference.agg(*[F.round(F.percentile(name, q), 9).alias(f"least_{name}") for name, (_, q) in REVIEW.items()])


def review_levels(rows: DataFrame, row: str, reference: DataFrame, medium: float = MEDIUM, high: float = HIGH, buckets: int = 64) -> DataFrame:
    """(row, review_reasons, review_score, review_level, needs_review) of rows with the signals of ``REVIEW``, against a reference with the same.

    The score is the largest share of the reference that is above a signal. Any reason, or a high score, makes the level high, and only
    that level needs review.
    """
    out = rows.select(row, *REVIEW).crossJoin(F.broadcast(review_thresholds(reference)))  # one row
    for name in REVIEW:
        out = out.join(percentile_rank(rows.select(row, name), row, name, reference.select(name), name, buckets).withColumnRenamed("rank", f"rank_{name}"), row)
    return out.select(row, *_levels(lambda name: F.col(f"rank_{name}"), medium, high))


#: Quantiles of a stored summary: a rank read from it is off by less than one in so many.
SUMMARY = 1000
SUMMARY_SCHEMA = ", ".join(f"least_{n} double, at_{n} array<double>" for n in REVIEW)


def review_summary(reference: DataFrame, points: int = SUMMARY) -> DataFrame:
    """One row to be stored with a model: the thresholds of ``review_thresholds``, and ``points`` + 1 quantiles of each signal as ``at_`` and its name."""
    cuts = F.array(*[F.lit(i / points) for i in range(points + 1)])
    at = [F.transform(F.percentile(name, cuts), lambda x: F.round(x, 9)).alias(f"at_{name}") for name in REVIEW]
    return reference.agg(*[F.round(F.percentile(name, q), 9).alias(f"least_{name}") for name, (_, q) in REVIEW.items()], *at)


def review_stored(rows: DataFrame, row: str, summary: DataFrame, medium: float = MEDIUM, high: float = HIGH) -> DataFrame:
    """What ``review_levels`` gives, from a stored summary in place of the reference rows; rows are only mapped."""
    out = rows.select(row, *REVIEW).crossJoin(F.broadcast(summary))  # one row
    ranked = out.select("*", *[(_at_most(F.col(f"at_{name}"), F.col(name)) / F.size(f"at_{name}")).alias(f"rank_{name}") for name in REVIEW])
    return ranked.select(row, *_levels(lambda name: F.col(f"rank_{name}"), medium, high))


def _at_most(points: Column, value: Column) -> Column:
    """How many of ascending points, fewer than 2**20, are at most the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(points, n + step - 1) <= value, n + step).otherwise(n))


def _levels(rank, medium: float, high: float) -> list[Column]:
    score = F.greatest(*[1 - rank(name) for name in REVIEW])
    reasons = F.array_compact(F.array(*[F.when(F.col(name) < F.col(f"least_{name}"), F.lit(reason)) for name, (reason, _) in REVIEW.items()]))
    level = F.when((F.size(reasons) > 0) | (score >= high), "high").when(score >= medium, "medium").otherwise("low")
    return [reasons.alias("review_reasons"), score.alias("review_score"), level.alias("review_level"), (level == "high").alias("needs_review")]


def calibrate(rows: DataFrame, row: str, wrong: Column, buckets: int = 64) -> DataFrame:
    """One row: thresholds from out-of-fold signals, the share of rows that would be reviewed, and the error rates inside and outside."""
    seen = review_levels(rows, row, rows, buckets=buckets).select(row, "needs_review").join(rows.select(row, wrong.cast("int").alias("_wrong")), row)
    rates = seen.agg(F.avg(F.col("needs_review").cast("int")).alias("review_rate"), F.avg(F.when(F.col("needs_review"), F.col("_wrong"))).alias("error_in_review"), F.avg(F.when(~F.col("needs_review"), F.col("_wrong"))).alias("error_outside"))
    return review_thresholds(rows).crossJoin(F.broadcast(rates))
