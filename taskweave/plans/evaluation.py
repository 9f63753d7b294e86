"""Queries: evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators import evaluate as E
from taskweave.operators import labels as L
from taskweave.operators import splits as S
from taskweave.plans import fixtures as V
from taskweave.plans.registry import query
from taskweave.plans.splits import FOLDS

P = "WITH " + V.CTE_PRED
CLASSES = "(VALUES ('E0'), ('E1'), ('E23'))"
REPORT = """, cls AS (SELECT c AS class, (SELECT count(*) FROM {t} WHERE y_true = c)::DOUBLE AS s, (SELECT count(*) FROM {t} WHERE y_pred = c)::DOUBLE AS p, (SELECT count(*) FROM {t} WHERE y_true = c AND y_pred = c)::DOUBLE AS h FROM (VALUES ('E0'), ('E1'), ('E23')) v(c)),
rep AS (SELECT class, CASE WHEN p > 0 THEN h / p ELSE 0 END AS prec, CASE WHEN s > 0 THEN h / s ELSE 0 END AS rec, CASE WHEN p + s > 0 THEN 2 * h / (p + s) ELSE 0 END AS f1, s, h FROM cls)"""
R = P + REPORT.format(t="predictions")
six = lambda *names: [F.round(n, 6).alias(n) for n in names]


@query("ev_confusion", P + f" SELECT t AS truth, p AS predicted, count(y_true)::BIGINT AS n FROM {CLASSES} a(t) CROSS JOIN {CLASSES} b(p) LEFT JOIN predictions ON y_true = t AND y_pred = p GROUP BY ALL")
def ev_confusion(spark, sf):
    return E.confusion(V.predictions(spark, sf))


@query("ev_class_report", R + " SELECT class, round(prec, 6) AS \"precision\", round(rec, 6) AS recall, round(f1, 6) AS f1, s::BIGINT AS support FROM rep")
def ev_class_report(spark, sf):
    return E.class_report(E.confusion(V.predictions(spark, sf))).select("class", *six("precision", "recall", "f1"), "support")


@query("ev_metrics", R + " SELECT round(sum(h) / sum(s), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * s) / sum(s), 6) AS weighted_f1, sum(s)::BIGINT AS n FROM rep")
def ev_metrics(spark, sf):
    return E.metrics(E.confusion(V.predictions(spark, sf))).select(*six("accuracy", "macro_f1", "weighted_f1"), "n")


RANK = "CASE {0} WHEN 'E0' THEN 0 WHEN 'E1' THEN 1 ELSE 2 END"


@query("ev_qwk", P + f", r AS (SELECT {RANK.format('y_true')} AS a, {RANK.format('y_pred')} AS b FROM predictions) SELECT round(1 - (SELECT sum((a - b) ** 2) FROM r) / (SELECT sum((x.a - y.b) ** 2) / (SELECT count(*) FROM r) FROM r x, r y), 6) AS qwk")
def ev_qwk(spark, sf):
    return E.quadratic_kappa(E.confusion(V.predictions(spark, sf))).select(*six("qwk"))


def _scored(spark, sf):
    noise = (V.bucket(F.concat(F.lit("n|"), "task_id")) % 401 - 200) / 1000.0
    return V.labelled(spark, sf).select("task_id", "y", L.score(F.col("y")).alias("score"), F.round(L.score(F.col("y")) + noise, 3).alias("guess"))


SCORED = "WITH " + V.CTE_TASKS + f", sc AS (SELECT task_id, y, score, round(score + ({V.h(chr(39) + 'n|' + chr(39) + ' || task_id')} % 401 - 200) / 1000.0, 3)::DOUBLE AS guess FROM (SELECT *, CASE y WHEN 'E0' THEN 0.1 WHEN 'E23' THEN 0.4 ELSE 0.7 END::DOUBLE AS score FROM labelled))"
NEAR = "CASE WHEN round(abs(guess - 0.1), 9) <= least(round(abs(guess - 0.4), 9), round(abs(guess - 0.7), 9)) THEN 'E0' WHEN round(abs(guess - 0.4), 9) <= round(abs(guess - 0.7), 9) THEN 'E23' ELSE 'E1' END"


@query("ev_regression", SCORED + f", n AS (SELECT *, {NEAR} AS near FROM sc) SELECT round(avg(abs(guess - score)), 6) AS mae, round(sqrt(avg((guess - score) ** 2)), 6) AS rmse, round(avg(abs({RANK.format('y')} - {RANK.format('near')})), 6) AS ordinal_mae FROM n")
def ev_regression(spark, sf):
    rows = _scored(spark, sf)
    near = E.nearest_score(F.col("guess"), {"E0": 0.1, "E23": 0.4, "E1": 0.7})
    ordinal = rows.agg(F.round(F.avg(F.abs(L.rank(F.col("y")) - L.rank(near))), 6).alias("ordinal_mae"))
    return E.regression(rows, "score", "guess").select(*six("mae", "rmse")).crossJoin(ordinal)


@query("ev_rank_projection", SCORED + " SELECT task_id, least(greatest(round_even(guess * 3 - 0.2, 0), 0), 2)::INT AS rank FROM sc")
def ev_rank_projection(spark, sf):
    return _scored(spark, sf).select("task_id", E.projected_rank(F.col("guess") * 3 - 0.2, 3).alias("rank"))


def _folded(spark, sf):
    rows = V.labelled(spark, sf)
    return V.predictions(spark, sf).join(S.group_folds(rows, "jobrole_id", "y").select("jobrole_id", "fold"), "jobrole_id")


FOLDED = FOLDS + ", predictions AS" + V.CTE_PRED.split("predictions AS", 1)[1] + """, p AS (SELECT *, fold::VARCHAR AS part FROM predictions JOIN folds USING (jobrole_id) UNION ALL SELECT *, 'pooled' FROM predictions JOIN folds USING (jobrole_id)),
k AS (SELECT DISTINCT part FROM p), cls AS (SELECT part, c, (SELECT count(*) FROM p WHERE p.part = k.part AND y_true = c)::DOUBLE AS s, (SELECT count(*) FROM p WHERE p.part = k.part AND y_pred = c)::DOUBLE AS q, (SELECT count(*) FROM p WHERE p.part = k.part AND y_true = c AND y_pred = c)::DOUBLE AS h FROM k, (VALUES ('E0'), ('E1'), ('E23')) v(c))
SELECT part, round(sum(h) / sum(s), 6) AS accuracy, round(avg(CASE WHEN q + s > 0 THEN 2 * h / (q + s) ELSE 0 END), 6) AS macro_f1, round(sum(CASE WHEN q + s > 0 THEN 2 * h / (q + s) ELSE 0 END * s) / sum(s), 6) AS weighted_f1, sum(s)::BIGINT AS n FROM cls GROUP BY part"""


@query("ev_fold_metrics", FOLDED)
def ev_fold_metrics(spark, sf):
    rows = _folded(spark, sf).withColumn("part", F.explode(F.array(F.col("fold").cast("string"), F.lit("pooled"))))
    return E.metrics(E.confusion(rows, by=["part"]), ["part"]).select("part", *six("accuracy", "macro_f1", "weighted_f1"), "n")


@query("ev_error_audit", P + " SELECT task_id, task, CASE WHEN y_true = 'E1' AND y_pred <> 'E1' THEN 'missed' WHEN y_true <> 'E1' AND y_pred = 'E1' THEN 'false' ELSE 'correct' END AS tag FROM predictions WHERE y_true = 'E1' OR y_pred = 'E1'")
def ev_error_audit(spark, sf):
    return V.predictions(spark, sf).select("task_id", "task", E.audit_tag(F.col("y_true"), F.col("y_pred"), "E1").alias("tag")).where("tag is not null")


@query("ev_override_effect", P + f""", o AS (SELECT 'before' AS stage, y_true, y_pred, 0 AS moved FROM predictions UNION ALL SELECT 'after', y_true, CASE WHEN {V.h("'o|' || task_id")} % 10 = 0 THEN 'E1' ELSE y_pred END, (({V.h("'o|' || task_id")} % 10 = 0) AND y_pred <> 'E1')::INT FROM predictions),
cls AS (SELECT stage, c, count(*) FILTER (y_true = c)::DOUBLE AS s, count(*) FILTER (y_pred = c)::DOUBLE AS q, count(*) FILTER (y_true = c AND y_pred = c)::DOUBLE AS h FROM o, (VALUES ('E0'), ('E1'), ('E23')) v(c) GROUP BY ALL)
SELECT stage, round(sum(h) / sum(s), 6) AS accuracy, round(avg(CASE WHEN q + s > 0 THEN 2 * h / (q + s) ELSE 0 END), 6) AS macro_f1, (SELECT sum(moved) FROM o WHERE o.stage = cls.stage)::BIGINT AS overrides FROM cls GROUP BY stage""")
def ev_override_effect(spark, sf):
    p = V.predictions(spark, sf)
    gate = V.bucket(F.concat(F.lit("o|"), "task_id")) % 10 == 0
    rows = p.select("y_true", F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.col("y_pred"), F.lit(0).alias("moved")), F.struct(F.lit("after").alias("stage"), F.when(gate, "E1").otherwise(F.col("y_pred")).alias("y_pred"), (gate & (F.col("y_pred") != "E1")).cast("int").alias("moved")))).alias("s")).select("y_true", "s.*")
    return E.metrics(E.confusion(rows, by=["stage"]), ["stage"]).select("stage", *six("accuracy", "macro_f1")).join(rows.groupBy("stage").agg(F.sum("moved").alias("overrides")), "stage")
