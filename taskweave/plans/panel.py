"""Queries: matched-panel analysis, with the bootstrap's 2,000 replicates; its draws have no SQL, so their means are held against SQL and their
intervals against theory."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators import evaluate as E
from taskweave.operators import labels as L
from taskweave.operators import panel as A
from taskweave.plans import fixtures as V
from taskweave.plans.registry import query

P = "WITH " + V.CTE_PANEL
CONDITIONS = [f"{p}__{m}" for p in V.PROMPTS for m in V.MODELS]
WIDE = P + ", ok AS (SELECT parent, child, grain, prompt || '__' || model AS condition, label FROM responses WHERE status = 'success'), wide AS (SELECT parent, child, grain, " + ", ".join(f"max(label) FILTER (condition = '{c}') AS {c}" for c in CONDITIONS) + " FROM ok GROUP BY ALL), complete AS (SELECT * FROM wide WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CONDITIONS) + ")"
LONG = WIDE + ", long AS (" + " UNION ALL ".join(f"SELECT parent, child, grain, '{c}' AS condition, {c} AS label FROM complete" for c in CONDITIONS) + "), vals AS (" + " UNION ALL ".join(f"SELECT parent, child, grain, condition, '{o}' AS outcome, ({e})::INT AS value FROM long" for o, e in {"E0": "label = 'E0'", "E1": "label = 'E1'", "E2": "label = 'E2'", "E3": "label = 'E3'", "E23": "label IN ('E2', 'E3')", "impacted": "label <> 'E0'"}.items()) + ")"


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


def successes(spark, sf):
    return V.responses(spark, sf).where("status = 'success'").withColumn("condition", F.concat("prompt", F.lit("__"), "model"))


def complete(spark, sf):
    return A.complete_cells(successes(spark, sf), ["parent", "child", "grain"], "condition", "label", "attempt_count", CONDITIONS)


def combined(spark, sf):
    """(grain, conditions..., weight)."""
    return A.patterns(complete(spark, sf), ["grain"], CONDITIONS)


def outcome_rows(spark, sf):
    """(grain, weight, condition, label, outcome, value)."""
    return A.long_outcomes(combined(spark, sf), ["grain", "weight"], CONDITIONS)


def mean(value):
    return F.sum(value * F.col("weight")) / F.sum("weight")


@query("pa_complete_cells", WIDE + " SELECT * FROM complete")
def pa_complete_cells(spark, sf):
    return complete(spark, sf)


@query("pa_distribution", LONG + " SELECT grain, condition, outcome, sum(value)::BIGINT AS n, round(avg(value), 6) AS share FROM vals GROUP BY ALL")
def pa_distribution(spark, sf):
    return outcome_rows(spark, sf).groupBy("grain", "condition", "outcome").agg(F.sum(F.col("value") * F.col("weight")).alias("n"), F.round(mean(F.col("value")), 6).alias("share"))


@query("pa_bootstrap_ci")
def pa_bootstrap_ci(spark, sf):
    """Every outcome's share in every cell, with its interval."""
    by = ["grain", "condition", "outcome"]
    return A.bootstrap(outcome_rows(spark, sf), by, "value", weight="weight").select(*by, *six("mean", "low", "high"), "n")


#: Contrasts (name, left, right): prompts within each model, and models within each prompt.
CONTRASTS = [(f"{a} minus {b} by {m}", f"{a}__{m}", f"{b}__{m}") for m in V.MODELS for a, b in (("production", "legacy"), ("production_legacy_anchors", "production"), ("production_legacy_anchors", "legacy"))]
CONTRASTS += [(f"{V.MODELS[1]} minus {V.MODELS[0]} by {p}", f"{p}__{V.MODELS[1]}", f"{p}__{V.MODELS[0]}") for p in V.PROMPTS]


@query("pa_paired_delta")
def pa_paired_delta(spark, sf):
    """Left less right in percentage points for every contrast, grain and outcome, with paired intervals and exact agreement."""
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(a).alias("l"), F.col(b).alias("r")) for n, a, b in CONTRASTS])).alias("x")
    cells = combined(spark, sf).select("grain", "weight", sides).select("grain", "weight", "x.*")
    left, right = A.outcomes(F.col("l")), A.outcomes(F.col("r"))
    pairs = cells.select("grain", "contrast", "weight", F.explode(F.create_map(*[x for k in left for x in (F.lit(k), (left[k].cast("int") - right[k].cast("int")) * 100)])).alias("outcome", "v"))
    by = ["grain", "contrast"]
    agree = cells.groupBy(*by).agg(F.round(mean((F.col("l") == F.col("r")).cast("int")), 6).alias("agreement"))
    return A.bootstrap(pairs, [*by, "outcome"], "v", weight="weight").select(*by, "outcome", *six("mean", "low", "high"), "n").join(F.broadcast(agree), by)  # a row for each contrast and grain


KIDS = LONG + ", kids AS (SELECT parent, condition, outcome, avg(value) AS child_rate, count(*) AS n FROM vals WHERE grain = 'atomic_child' GROUP BY ALL), own AS (SELECT parent, condition, outcome, value FROM vals WHERE grain = 'raw_parent')"


def parent_and_children(spark, sf):
    """(condition, outcome, own, child_rate, n, weight) of parents with children."""
    return A.against_children(complete(spark, sf), "parent", F.col("grain") == "raw_parent", CONDITIONS)


@query("pa_representation", KIDS + " SELECT condition, outcome, count(*)::BIGINT AS parents, sum(n)::BIGINT AS children, round(avg(value), 6) AS parent_rate, round(avg(child_rate), 6) AS child_rate, round(avg(child_rate - value) * 100, 6) AS delta FROM own JOIN kids USING (parent, condition, outcome) GROUP BY ALL")
def pa_representation(spark, sf):
    """A parent's label against its children's mean, parents weighing the same, for every condition and outcome."""
    both = parent_and_children(spark, sf).groupBy("condition", "outcome")
    return both.agg(F.sum("weight").alias("parents"), F.sum(F.col("n") * F.col("weight")).alias("children"), F.round(mean(F.col("own")), 6).alias("parent_rate"), F.round(mean(F.col("child_rate")), 6).alias("child_rate"), F.round(mean(F.col("child_rate") - F.col("own")) * 100, 6).alias("delta"))


@query("pa_representation_ci")
def pa_representation_ci(spark, sf):
    """The same difference with paired intervals."""
    by = ["condition", "outcome"]
    return A.bootstrap(parent_and_children(spark, sf).withColumn("v", F.round((F.col("child_rate") - F.col("own")) * 100, 6)), by, "v", weight="weight").select(*by, *six("mean", "low", "high"), "n")


@query("pa_parent_modal", LONG + ", c AS (SELECT parent, condition, label AS l, count(*) AS k FROM long WHERE grain = 'atomic_child' GROUP BY ALL) SELECT parent, condition, arg_min(l, (-k, l)) AS modal, sum(k)::BIGINT AS n FROM c GROUP BY parent, condition")
def pa_parent_modal(spark, sf):
    """The commonest label of each parent's children in every condition."""
    wide = complete(spark, sf).where("grain = 'atomic_child'")
    cells = wide.select("parent", F.explode(F.create_map(*[x for c in CONDITIONS for x in (F.lit(c), F.col(c))])).alias("condition", "l"))
    return A.modal(cells, ["parent", "condition"], "l")


@query("pa_transitions", LONG + " SELECT l.condition, round(avg((l.label = c.legacy__gpt_4o)::INT), 6) AS agreement, round(100 * (avg((l.label IN ('E2', 'E3'))::INT) - avg((c.legacy__gpt_4o IN ('E2', 'E3'))::INT)), 6) AS change_pp FROM long l JOIN complete c USING (parent, child, grain) WHERE grain = 'raw_parent' GROUP BY l.condition")
def pa_transitions(spark, sf):
    wide = complete(spark, sf).where("grain = 'raw_parent'")
    base = F.col("legacy__gpt_4o")
    cells = wide.select(base, F.explode(F.create_map(*[x for c in CONDITIONS for x in (F.lit(c), F.col(c))])).alias("condition", "label"))
    return cells.groupBy("condition").agg(F.round(A.agreement(F.col("label"), base), 6).alias("agreement"), F.round(100 * (F.avg(F.col("label").isin("E2", "E3").cast("int")) - F.avg(base.isin("E2", "E3").cast("int"))), 6).alias("change_pp"))


@query("pa_factorial_effects", LONG + """, m AS (SELECT outcome, avg(value) FILTER (condition = 'legacy__gpt_4o') AS a, avg(value) FILTER (condition = 'production__gpt_4o') AS b, avg(value) FILTER (condition = 'legacy__gpt_5_2') AS c, avg(value) FILTER (condition = 'production__gpt_5_2') AS d FROM vals WHERE grain = 'raw_parent' GROUP BY outcome)
SELECT outcome, round(100 * (b - a), 6) AS prompt_effect_gpt_4o, round(100 * (d - c), 6) AS prompt_effect_gpt_5_2, round(100 * (c - a), 6) AS model_effect_legacy, round(100 * (d - b), 6) AS model_effect_production, round(100 * ((d - c) - (b - a)), 6) AS interaction FROM m""")
def pa_factorial_effects(spark, sf):
    share = lambda c: F.sum(F.when(F.col("condition") == c, F.col("value") * F.col("weight"))) / F.sum(F.when(F.col("condition") == c, F.col("weight")))
    m = outcome_rows(spark, sf).where("grain = 'raw_parent'").groupBy("outcome").agg(share("legacy__gpt_4o").alias("a"), share("production__gpt_4o").alias("b"), share("legacy__gpt_5_2").alias("c"), share("production__gpt_5_2").alias("d"))
    pp = lambda e, name: F.round(100 * F.expr(e), 6).alias(name)
    return m.select("outcome", pp("(b - a)", "prompt_effect_gpt_4o"), pp("(d - c)", "prompt_effect_gpt_5_2"), pp("(c - a)", "model_effect_legacy"), pp("(d - b)", "model_effect_production"), pp("((d - c) - (b - a))", "interaction"))


M = "CASE WHEN {0} IN ('E2', 'E3') THEN 'E23' ELSE {0} END"


@query("pa_history", LONG + f""", j AS (SELECT condition, label, history, {M.format('label')} AS ml, {M.format('history')} AS mh FROM long JOIN history USING (parent) WHERE grain = 'raw_parent'),
f AS (SELECT condition, c, CASE WHEN count(*) FILTER (ml = c) + count(*) FILTER (mh = c) > 0 THEN 2.0 * count(*) FILTER (ml = c AND mh = c) / (count(*) FILTER (ml = c) + count(*) FILTER (mh = c)) ELSE 0 END AS f1 FROM j, (VALUES ('E0'), ('E1'), ('E23')) v(c) GROUP BY ALL)
SELECT condition, round(avg((label = history)::INT), 6) AS exact, round(avg((ml = mh)::INT), 6) AS merged, round(avg(((label = 'E0') = (history = 'E0'))::INT), 6) AS "binary", round(avg((label = 'E0')::INT), 6) AS e0_share, round(avg((history = 'E0')::INT), 6) AS history_e0_share, (SELECT round(avg(f1), 6) FROM f WHERE f.condition = j.condition) AS macro_f1 FROM j GROUP BY condition""")
def pa_history(spark, sf):
    wide = complete(spark, sf).where("grain = 'raw_parent'").join(V.history(spark, sf), "parent")
    rows = wide.select("history", F.explode(F.create_map(*[x for c in CONDITIONS for x in (F.lit(c), F.col(c))])).alias("condition", "label"))
    rows = rows.select("*", L.merged(F.col("label")).alias("y_pred"), L.merged(F.col("history")).alias("y_true"))
    share = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    l, h = F.col("label"), F.col("history")
    out = rows.groupBy("condition").agg(share(l == h, "exact"), share(F.col("y_pred") == F.col("y_true"), "merged"), share((l == "E0") == (h == "E0"), "binary"), share(l == "E0", "e0_share"), share(h == "E0", "history_e0_share"))
    return out.join(E.metrics(E.confusion(rows, by=["condition"]), ["condition"]).select("condition", *six("macro_f1")), "condition")


@query("pa_run_summary", WIDE + " SELECT (SELECT count(*) FROM manifest)::BIGINT AS expected, (SELECT count(*) FROM responses WHERE status = 'success')::BIGINT AS success, (SELECT count(*) - count(DISTINCT call_id) FROM responses)::BIGINT AS duplicates, (SELECT count(*) FROM complete)::BIGINT AS complete_units")
def pa_run_summary(spark, sf):
    r = V.responses(spark, sf)
    counts = r.agg(F.count_if(F.col("status") == "success").alias("success"), (F.count("*") - F.count_distinct("call_id")).alias("duplicates"))
    return V.manifest(spark, sf).agg(F.count("*").alias("expected")).crossJoin(counts).crossJoin(complete(spark, sf).agg(F.count("*").alias("complete_units")))
