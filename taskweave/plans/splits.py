"""Queries: splits, leak checks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators import labels as L
from taskweave.operators import splits as S
from taskweave.operators import text as X
from taskweave.operators.graph import connected_components
from taskweave.plans import fixtures as V
from taskweave.plans.prepare import COMPONENTS, KEY, role_task_edges
from taskweave.plans.registry import query
from taskweave.shared import written

SIZES = "WITH " + V.CTE_TASKS + """, counts AS (SELECT jobrole_id, y, count(*) AS n FROM labelled GROUP BY ALL), sizes AS (SELECT jobrole_id, sum(n)::BIGINT AS size, arg_min(y, (-n, y)) AS dominant FROM counts GROUP BY jobrole_id)"""
SNAKE = "CASE WHEN (i // {k}) % 2 = 0 THEN i % {k} ELSE {k} - 1 - i % {k} END"
FOLDS = SIZES + f", folds AS (SELECT jobrole_id, size, dominant, ({SNAKE.format(k=5)})::INT AS fold FROM (SELECT *, row_number() OVER (PARTITION BY dominant ORDER BY size DESC, md5('42|' || jobrole_id)) - 1 AS i FROM sizes))"
HELD = SIZES + f", slots AS (SELECT jobrole_id, {SNAKE.format(k=20)} AS s FROM (SELECT *, row_number() OVER (PARTITION BY dominant ORDER BY size DESC, md5('42|' || jobrole_id)) - 1 AS i FROM sizes)), splits AS (SELECT jobrole_id, CASE WHEN s < 14 THEN 'train' WHEN s < 17 THEN 'validation' ELSE 'test' END AS split FROM slots)"


@query("split_group_kfold", FOLDS + " SELECT jobrole_id, size, dominant, fold FROM folds")
def split_group_kfold(spark, sf):
    return S.group_folds(V.labelled(spark, sf), "jobrole_id", "y")


@query("grp_split_summary", FOLDS + ' SELECT fold, count(*)::BIGINT AS n_rows, count(*) FILTER (y = \'E0\')::BIGINT AS "E0", count(*) FILTER (y = \'E1\')::BIGINT AS "E1", count(*) FILTER (y = \'E23\')::BIGINT AS "E23" FROM labelled JOIN folds USING (jobrole_id) GROUP BY fold')
def grp_split_summary(spark, sf):
    rows = V.labelled(spark, sf)
    return rows.join(S.group_folds(rows, "jobrole_id", "y").select("jobrole_id", "fold"), "jobrole_id").groupBy("fold").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("y") == c).alias(c) for c in L.CLASSES])


@query("split_group_holdout", HELD + " SELECT jobrole_id, split, (SELECT round(sum(c) + sum(((n - goal) / greatest(goal, 1)) ** 2), 6) FROM (SELECT split, sum(n) AS n, sum(goal) AS goal, sum(((n - goal) / greatest(goal, 1)) ** 2) AS c FROM (SELECT split, y, want * t AS goal, coalesce(n, 0)::DOUBLE AS n FROM (SELECT y, count(*) AS t FROM labelled GROUP BY y) CROSS JOIN (VALUES ('train', 0.7::DOUBLE), ('validation', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) v(split, want) LEFT JOIN (SELECT split, y, count(*) AS n FROM labelled JOIN splits USING (jobrole_id) GROUP BY ALL) USING (split, y)) GROUP BY split)) AS cost FROM splits")
def split_group_holdout(spark, sf):
    rows = V.labelled(spark, sf)
    splits = S.group_holdout(rows, "jobrole_id", "y")
    return splits.crossJoin(F.broadcast(S.split_cost(rows, "jobrole_id", "y", splits, {"train": 0.7, "validation": 0.15, "test": 0.15}).select(F.round("cost", 6).alias("cost"))))


TARGET = {"train": 0.7, "validation": 0.15, "test": 0.15}


@query("split_group_holdout_search")
def split_group_holdout_search(spark, sf):
    """The restarted search, with the cost of the serpentine deal beside its own; what costs less is returned."""
    rows = V.labelled(spark, sf)
    dealt = S.group_holdout(rows, "jobrole_id", "y")
    found = written(S.searched(rows, "jobrole_id", "y", TARGET, dealt), "searched")
    splits, costs = S.best_of(rows, "jobrole_id", "y", [found, dealt], TARGET)
    return splits.select("jobrole_id", "split", F.lit(min(costs)).alias("cost"), F.lit(costs[1]).alias("serpentine_cost"))


@query("split_kfold", "WITH " + V.CTE_TASKS + " SELECT task_id, y, ((row_number() OVER (PARTITION BY y ORDER BY md5('7|' || task_id)) - 1) % 5)::INT AS fold FROM labelled")
def split_kfold(spark, sf):
    return S.row_folds(V.labelled(spark, sf), "task_id", "y").select("task_id", "y", "fold")


@query("split_nested", FOLDS + f", apart AS (SELECT o.k AS outer_, f.* FROM folds f, (SELECT unnest(generate_series(0, 4)) AS k) o WHERE f.fold <> o.k) SELECT outer_::INT AS \"outer\", jobrole_id, ({SNAKE.format(k=4)})::INT AS \"inner\" FROM (SELECT *, row_number() OVER (PARTITION BY outer_, dominant ORDER BY size DESC, md5('43|' || jobrole_id)) - 1 AS i FROM apart)")
def split_nested(spark, sf):
    return S.nested_folds(V.labelled(spark, sf), "jobrole_id", "y")


@query("split_component_holdout", COMPONENTS + """, rows AS (SELECT component, y FROM labelled JOIN components ON node = 'r:' || jobrole_id), counts AS (SELECT component, y, count(*) AS n FROM rows GROUP BY ALL), sizes AS (SELECT component, sum(n)::BIGINT AS size, arg_min(y, (-n, y)) AS dominant FROM counts GROUP BY component),
t AS (SELECT *, sum(size) OVER (PARTITION BY dominant) AS total FROM sizes), r AS (SELECT *, sum(CASE WHEN size <= 0.2 * total THEN size ELSE 0 END) OVER (PARTITION BY dominant ORDER BY size DESC, component ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT component, CASE WHEN size <= 0.2 * total AND run <= 0.2 * total THEN 'test' ELSE 'train' END AS split FROM r""")
def split_component_holdout(spark, sf):
    found = connected_components(role_task_edges(spark, sf))
    rows = V.labelled(spark, sf).withColumn("node", F.concat(F.lit("r:"), "jobrole_id")).join(found, "node")
    return S.component_holdout(rows, "component", "y")


@query("split_component_holdout_search")
def split_component_holdout_search(spark, sf):
    """Whole components whose rows and classes come near a fifth: 500 restarts, components above a fifth stay in train, test at most a tenth above its share."""
    found = written(connected_components(role_task_edges(spark, sf)), "components")
    rows = V.labelled(spark, sf).withColumn("node", F.concat(F.lit("r:"), "jobrole_id")).join(found, "node")
    dealt = S.component_holdout(rows, "component", "y")
    splits = written(S.searched(rows, "component", "y", {"test": 0.2, "train": None}, dealt, restarts=500, most=1.1, kick=0.015, largest=0.2), "searched")
    best, costs = S.best_of(rows, "component", "y", [splits, dealt], {"test": 0.2})
    return best.select("component", "split", F.lit(min(costs)).alias("cost"), F.lit(costs[1]).alias("running_sum_cost"))


def _leaks(table: str, split: str, checks: dict[str, tuple[str, str]]) -> str:
    values = " UNION ".join(f"SELECT {split} AS s, '{c}' AS c, ({e})::VARCHAR AS v FROM {table}" for c, (e, _) in checks.items())
    severity = " ".join(f"WHEN '{c}' THEN '{s}'" for c, (_, s) in checks.items())
    names = ", ".join(f"('{c}')" for c in checks)
    return f""", vals AS ({values}), found AS (SELECT a.c, a.s AS l, b.s AS r, count(*) AS n FROM vals a JOIN vals b ON a.c = b.c AND a.v = b.v AND a.s < b.s GROUP BY ALL), names AS (SELECT DISTINCT s FROM vals)
SELECT k.c AS "check", CASE k.c {severity} END AS severity, a.s AS left_split, b.s AS right_split, coalesce(n, 0)::BIGINT AS overlap FROM names a JOIN names b ON a.s < b.s CROSS JOIN (VALUES {names}) k(c) LEFT JOIN found f ON f.c = k.c AND f.l = a.s AND f.r = b.s"""


def _split_rows(spark, sf):
    rows = V.labelled(spark, sf)
    return rows.join(S.group_holdout(rows, "jobrole_id", "y"), "jobrole_id").withColumn("k", X.casefold_key(F.col("task"))).withColumn("full", F.concat_ws("|", F.lower("jobrole_title"), "k"))


ROWS = HELD + f", sr AS (SELECT *, {KEY} AS k, lower(jobrole_title) || '|' || {KEY} AS full_ FROM labelled JOIN splits USING (jobrole_id))"


@query("leak_split_pairs", ROWS + _leaks("sr", "split", {"jobrole_id": ("jobrole_id", "fail"), "task_id": ("task_id", "fail"), "sector_title": ("sector_title", "warn"), "k": ("k", "warn")}))
def leak_split_pairs(spark, sf):
    return S.overlaps(_split_rows(spark, sf), "split", {"jobrole_id": "fail", "task_id": "fail", "sector_title": "warn", "k": "warn"})


@query("leak_role_task", ROWS + _leaks("sr", "split", {"jobrole_id": ("jobrole_id", "fail"), "k": ("k", "fail")}))
def leak_role_task(spark, sf):
    return S.overlaps(_split_rows(spark, sf), "split", {"jobrole_id": "fail", "k": "fail"})


@query("leak_release", ROWS + _leaks("sr", "split", {"jobrole_id": ("jobrole_id", "fail"), "full": ("full_", "fail")}))
def leak_release(spark, sf):
    return S.overlaps(_split_rows(spark, sf), "split", {"jobrole_id": "fail", "full": "fail"})


@query("smp_simple_random", "SELECT o_orderkey FROM orders ORDER BY md5('sample|' || o_orderkey), o_orderkey LIMIT 50")
def smp_simple_random(spark, sf):
    return S.simple_random(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 50)


QUOTA = "SELECT *, floor(e)::INT + CASE WHEN row_number() OVER ({p} ORDER BY round(e - floor(e), 9) DESC, sector) <= want - sum(floor(e)) OVER ({p}) THEN 1 ELSE 0 END AS quota FROM (SELECT *, round(want * n_rows / sum(n_rows) OVER ({p}), 9) AS e FROM {t})"


@query("smp_quota", "WITH " + V.CTE_PANEL + ", c AS (SELECT sector, count(*)::BIGINT AS n_rows, 100 AS want FROM history GROUP BY sector) SELECT sector, n_rows, quota FROM (" + QUOTA.format(p="PARTITION BY 1", t="c") + ")")
def smp_quota(spark, sf):
    return S.quotas(V.history(spark, sf).groupBy("sector").agg(F.count("*").alias("n_rows")), "sector", 100)


@query("smp_stratified_capped", "WITH " + V.CTE_PANEL + """, able AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY md5('panel|' || parent), parent) AS c FROM history) WHERE c <= 3),
c AS (SELECT history, sector, count(*) AS n_rows, CASE history WHEN 'E0' THEN 40 WHEN 'E1' THEN 25 WHEN 'E2' THEN 25 ELSE 10 END AS want FROM able GROUP BY ALL), q AS (""" + QUOTA.format(p="PARTITION BY history", t="c") + """),
i AS (SELECT a.*, want, row_number() OVER (PARTITION BY history, sector ORDER BY md5('panel|' || parent), parent) <= quota AS inside FROM able a JOIN q USING (history, sector))
SELECT parent, history, sector, role FROM (SELECT *, row_number() OVER (PARTITION BY history ORDER BY inside DESC, md5('panel|' || parent), parent) AS r FROM i) WHERE r <= want""")
def smp_stratified_capped(spark, sf):
    return S.stratified(V.history(spark, sf).select("parent", "history", "sector", "role"), "parent", "history", "sector", "role", {"E0": 40, "E1": 25, "E2": 25, "E3": 10})


@query("smp_minority_oversample", "WITH " + V.CTE_TASKS + f", ranked AS (SELECT task_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('draw|' || task_id)) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM labelled), draws AS (SELECT d AS draw, CASE d % 3 WHEN 0 THEN 'E0' WHEN 1 THEN 'E1' ELSE 'E23' END AS y FROM (SELECT unnest(generate_series(0, 299)) AS d)) SELECT draw, task_id, y FROM draws JOIN ranked USING (y) WHERE i = {V.h("'draw|' || draw")} % n")
def smp_minority_oversample(spark, sf):
    return S.oversampled(V.labelled(spark, sf).select("task_id", "y"), "task_id", "y", 300, L.CLASSES)
