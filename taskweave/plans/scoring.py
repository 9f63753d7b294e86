"""Queries: batch scores, review, and decision search over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators import evaluate as E
from taskweave.operators import features as T
from taskweave.operators import labels as L
from taskweave.operators import scoring as C
from taskweave.operators import search as Q
from taskweave.plans import fixtures as V
from taskweave.plans.features import COUNTS, WB
from taskweave.plans.registry import query
from taskweave.shared import new_path, written

S = "WITH " + V.CTE_SCORES
CLASSES = L.CLASSES
COLUMNS = ["s0", "s1", "s2"]
ARG = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 'E0' WHEN {1} >= {2} THEN 'E1' ELSE 'E23' END"
MARGIN = "round(list_sort([s0, s1, s2])[3] - list_sort([s0, s1, s2])[2], 6)"


def macro(p: str, n: str = "n") -> str:
    one = "(CASE WHEN sum(CASE WHEN y = '{c}' THEN {n} ELSE 0 END) + sum(CASE WHEN {p} = '{c}' THEN {n} ELSE 0 END) > 0 THEN 2.0 * sum(CASE WHEN y = '{c}' AND {p} = '{c}' THEN {n} ELSE 0 END) / (sum(CASE WHEN y = '{c}' THEN {n} ELSE 0 END) + sum(CASE WHEN {p} = '{c}' THEN {n} ELSE 0 END)) ELSE 0 END)"
    return "(" + " + ".join(one.format(c=c, p=p, n=n) for c in CLASSES) + ") / 3"


def cols(*names):
    return [F.col(n) for n in names]


def tokens_sql(table: str) -> str:
    return f"tok AS (SELECT task_id, unnest(regexp_extract_all(lower(task), '[a-z]{{2,}}')) AS term FROM {table}), vocab AS (SELECT term FROM tok WHERE task_id % 2 = 0 GROUP BY term HAVING count(DISTINCT task_id) >= 2), cov AS (SELECT t.task_id, count(k.term)::BIGINT AS n_tokens, CASE WHEN count(k.term) > 0 THEN count(v.term) / count(k.term) ELSE 0 END AS coverage FROM {table} t LEFT JOIN tok k USING (task_id) LEFT JOIN vocab v ON v.term = k.term GROUP BY t.task_id)"


def covered(spark, sf):
    return C.coverage(V.labelled(spark, sf), "task_id", "task", F.expr("task_id % 2 = 0"))


COVERED = S + ", " + tokens_sql("labelled")


def signals(spark, sf):
    """(task_id, y, label, margin, n_tokens, coverage)."""
    s = V.scores(spark, sf)
    return s.select("task_id", "y", Q.argmax(cols(*COLUMNS), CLASSES).alias("label"), F.round(C.margin(cols(*COLUMNS)), 6).alias("margin")).join(covered(spark, sf), "task_id")


SIGNALS = COVERED + f", sig AS (SELECT task_id, y, {ARG.format('s0', 's1', 's2')} AS label, {MARGIN} AS margin, n_tokens, coverage FROM scores JOIN cov USING (task_id))"
REVIEW = "round(least(greatest(1 / (1 + exp(margin)), 1 - coverage, CASE WHEN n_tokens < 4 THEN 0.25 ELSE 0 END), 1), 4)"


@query("top_margin", S + f" SELECT task_id, {MARGIN} AS margin FROM scores")
def top_margin(spark, sf):
    return V.scores(spark, sf).select("task_id", F.round(C.margin(cols(*COLUMNS)), 6).alias("margin"))


@query("sc_lexical_coverage", COVERED + " SELECT task_id, n_tokens, round(coverage, 6) AS coverage FROM cov")
def sc_lexical_coverage(spark, sf):
    return covered(spark, sf).select("task_id", "n_tokens", F.round("coverage", 6).alias("coverage"))


@query("sc_review_score", SIGNALS + f" SELECT task_id, {REVIEW} AS review_score FROM sig")
def sc_review_score(spark, sf):
    return signals(spark, sf).select("task_id", C.review_score(F.col("margin"), F.col("coverage"), F.col("n_tokens")).alias("review_score"))


@query("sc_batch_predict", SIGNALS + f" SELECT task_id, label, margin, round(coverage, 6) AS coverage, {REVIEW} AS review_score FROM sig")
def sc_batch_predict(spark, sf):
    return signals(spark, sf).select("task_id", "label", "margin", F.round("coverage", 6).alias("coverage"), C.review_score(F.col("margin"), F.col("coverage"), F.col("n_tokens")).alias("review_score"))


RANKS = SIGNALS + ", ranks AS (SELECT task_id, (SELECT count(*) FROM sig r WHERE r.task_id % 2 = 0 AND r.margin <= sig.margin)::DOUBLE / (SELECT count(*) FROM sig r WHERE r.task_id % 2 = 0) AS rank FROM sig)"


def ranks(spark, sf):
    s = V.scores(spark, sf).select("task_id", F.round(C.margin(cols(*COLUMNS)), 6).alias("margin"))
    return C.percentile_rank(s, "task_id", "margin", s.where("task_id % 2 = 0"), "margin", 16)


@query("sc_percentile_rank", RANKS + " SELECT task_id, round(rank, 6) AS rank FROM ranks")
def sc_percentile_rank(spark, sf):
    return ranks(spark, sf).select("task_id", F.round("rank", 6).alias("rank"))


known = lambda terms, vocabulary, out: f"(SELECT task_id, coalesce(sum(tf) FILTER (v.term IS NOT NULL), 0) / sum(tf) AS {out} FROM {terms} k LEFT JOIN (SELECT term FROM {terms} WHERE task_id % 2 = 0 GROUP BY term HAVING count(*) >= 2) v USING (term) GROUP BY task_id)"
FOUR = S + COUNTS + WB + f""", chars AS (SELECT task_id, term, count(*)::BIGINT AS tf FROM wb GROUP BY ALL), four AS (SELECT s.task_id, y, {ARG.format('s0', 's1', 's2')} AS label, {MARGIN} AS margin, round(coalesce(w, 0), 9) AS word_coverage, round(coalesce(c, 0), 9) AS char_coverage, round((coalesce(w, 0) + coalesce(c, 0)) / 2, 9) AS total_coverage
FROM scores s LEFT JOIN {known('counts', 'words', 'w')} USING (task_id) LEFT JOIN {known('chars', 'chars', 'c')} USING (task_id)), ref AS (SELECT * FROM four WHERE task_id % 2 = 0)"""
LEAST = lambda table: "least AS (SELECT " + ", ".join(f"round(quantile_cont({n}, {q}), 9) AS least_{n}" for n, (_, q) in C.REVIEW.items()) + f" FROM {table})"
LEVELS = lambda table: (
    LEAST(table) + ", scored AS (SELECT task_id, y, label, list_filter([" + ", ".join(f"CASE WHEN {n} < least_{n} THEN '{r}' END" for n, (r, _) in C.REVIEW.items()) + "], lambda x: x IS NOT NULL) AS reasons, greatest(" + ", ".join(f"1 - (SELECT count(*) FROM {table} r WHERE r.{n} <= four.{n}) / (SELECT count(*) FROM {table})" for n in C.REVIEW) + ") AS score FROM four, least)"
)


def four_signals(spark, sf):
    """(task_id, y, label and the signals of a prediction): terms are known if two even tasks have them."""
    tasks = V.labelled(spark, sf)
    s = V.scores(spark, sf).select("task_id", "y", Q.argmax(cols(*COLUMNS), CLASSES).alias("label"), F.round(C.margin(cols(*COLUMNS)), 6).alias("margin"))
    texts = [(T.Grams("word", 1, 2), F.col("task")), (T.Grams("char_wb", 3, 4), F.col("task"))]
    known = T.known_shares(tasks, "task_id", texts, F.expr("task_id % 2 = 0"))
    share = lambda k: F.when(F.col(f"n_{k}") > 0, F.col(f"known_{k}") / F.col(f"n_{k}"))
    s = s.join(known.select("task_id", share(0).alias("word_coverage"), share(1).alias("char_coverage")), "task_id", "left")
    w, c = F.coalesce("word_coverage", F.lit(0.0)), F.coalesce("char_coverage", F.lit(0.0))
    return written(s.withColumn("total_coverage", F.round((w + c) / 2, 9)).withColumn("word_coverage", F.round(w, 9)).withColumn("char_coverage", F.round(c, 9)), "signals")


@query("sc_review_levels", FOUR + ", " + LEVELS("ref") + f" SELECT task_id, array_to_string(reasons, ',') AS reasons, round(score, 6) AS review_score, CASE WHEN len(reasons) > 0 OR score >= {C.HIGH} THEN 'high' WHEN score >= {C.MEDIUM} THEN 'medium' ELSE 'low' END AS level, len(reasons) > 0 OR score >= {C.HIGH} AS needs_review FROM scored")
def sc_review_levels(spark, sf):
    rows = four_signals(spark, sf)
    found = C.review_levels(rows, "task_id", rows.where("task_id % 2 = 0"), buckets=16)
    return found.select("task_id", F.array_join("review_reasons", ",").alias("reasons"), F.round("review_score", 6).alias("review_score"), F.col("review_level").alias("level"), "needs_review")


AT = ", ".join(f"list_transform(quantile_cont({n}, [{', '.join(str(i / C.SUMMARY) for i in range(C.SUMMARY + 1))}]), lambda x: round(x, 9)) AS at_{n}" for n in C.REVIEW)
STORED = (
    LEAST("ref") + f", summary AS MATERIALIZED (SELECT {AT} FROM ref), scored AS (SELECT task_id, list_filter([" + ", ".join(f"CASE WHEN {n} < least_{n} THEN '{r}' END" for n, (r, _) in C.REVIEW.items())
    + "], lambda x: x IS NOT NULL) AS reasons, greatest(" + ", ".join(f"1 - len(list_filter(at_{n}, lambda q: q <= {n})) / len(at_{n})" for n in C.REVIEW) + ") AS score FROM four, least, summary)"
)


@query("sc_review_stored", FOUR + ", " + STORED + f" SELECT task_id, array_to_string(reasons, ',') AS reasons, round(score, 6) AS review_score, CASE WHEN len(reasons) > 0 OR score >= {C.HIGH} THEN 'high' WHEN score >= {C.MEDIUM} THEN 'medium' ELSE 'low' END AS level FROM scored")
def sc_review_stored(spark, sf):
    """Levels of rows from a summary that was stored and read back; the reference rows are not there any more."""
    rows = four_signals(spark, sf)
    path = new_path(spark, "calibration")
    C.review_summary(rows.where("task_id % 2 = 0")).write.parquet(path)
    found = C.review_stored(rows, "task_id", spark.read.schema(C.SUMMARY_SCHEMA).parquet(path))
    return found.select("task_id", F.array_join("review_reasons", ",").alias("reasons"), F.round("review_score", 6).alias("review_score"), F.col("review_level").alias("level"))


@query("sc_review_calibrate", FOUR + ", " + LEVELS("four") + f", s2 AS (SELECT (label <> y)::INT AS wrong, len(reasons) > 0 OR score >= {C.HIGH} AS high FROM scored) SELECT least.*, (SELECT round(avg(high::INT), 6) FROM s2) AS review_rate, (SELECT round(avg(wrong) FILTER (high), 6) FROM s2) AS error_in_review, (SELECT round(avg(wrong) FILTER (NOT high), 6) FROM s2) AS error_outside FROM least")
def sc_review_calibrate(spark, sf):
    out = C.calibrate(four_signals(spark, sf), "task_id", F.col("label") != F.col("y"), 16)
    return out.select(*[c if c.startswith("least") else F.round(c, 6).alias(c) for c in out.columns])


# --- decision search ------------------------------------------------------------------------------------------------

POINTS = [round(-2 + 0.05 * k, 2) for k in range(101)]
T_SQL = "(SELECT round(-2 + 0.05 * k, 2) AS t FROM (SELECT unnest(generate_series(0, 100)) AS k))"
THRESHOLDS = S + f", g AS (SELECT t, sum((s1 >= t AND y = 'E1')::INT) AS tp, sum((s1 >= t)::INT) AS called, sum((y = 'E1')::INT) AS support FROM scores, {T_SQL} GROUP BY t), f AS (SELECT t::DOUBLE AS t, tp::BIGINT AS tp, called::BIGINT AS called, support::BIGINT AS support, 2.0 * tp / (called + support) AS f1 FROM g)"


@query("op_threshold_grid", THRESHOLDS + " SELECT t, tp, called, support, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 9) DESC, t LIMIT 1")
def op_threshold_grid(spark, sf):
    grid = Q.threshold_grid(V.scores(spark, sf), F.col("y") == "E1", "s1", POINTS)
    return Q.best(grid, "f1", "t").withColumn("f1", F.round("f1", 6))


OFFSETS = [round(-0.6 + 0.1 * k, 1) for k in range(13)]
B_SQL = "(SELECT round(-0.6 + 0.1 * k, 1)::DOUBLE AS {0} FROM (SELECT unnest(generate_series(0, 12)) AS k))"
OFFSET = S + f", c AS (SELECT b0, b1, b2, y, {ARG.format('round(s0 + b0, 6)', 'round(s1 + b1, 6)', 'round(s2 + b2, 6)')} AS p FROM scores, {{grid}}), m AS (SELECT b0, b1, b2, {macro('p', '1')} AS macro_f1 FROM c GROUP BY ALL)"
FULL = ", ".join(B_SQL.format(f"b{k}") for k in range(3))


@query("op_bias_grid", OFFSET.format(grid=FULL) + " SELECT b0, b1, b2, round(macro_f1, 6) AS macro_f1 FROM m ORDER BY round(macro_f1, 9) DESC, b0, b1, b2 LIMIT 1")
def op_bias_grid(spark, sf):
    grid = Q.offset_grid(V.scores(spark, sf), "y", COLUMNS, CLASSES, [OFFSETS] * 3)
    return Q.best(grid, "macro_f1", "b0", "b1", "b2").withColumn("macro_f1", F.round("macro_f1", 6))


def _coordinate_sql(passes: int = 3) -> str:
    """Each step tries one coordinate's points and the offset that is held, and keeps the best if it is strictly better."""
    steps, names = ["h0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, -1.0::DOUBLE AS top)"], ["b0", "b1", "b2"]
    for i in range(3 * passes):
        b = f"b{i % 3}"
        tried = ", ".join("v.v AS " + n if n == b else "h." + n for n in names)
        steps.append(f"g{i} AS (SELECT {tried} FROM h{i} h, (SELECT {b} AS v FROM h{i} UNION SELECT v FROM {B_SQL.format('v')}) v)")
        called = ARG.format("round(s0 + b0, 6)", "round(s1 + b1, 6)", "round(s2 + b2, 6)")
        steps.append(f"m{i} AS (SELECT b0, b1, b2, {macro('p', '1')} AS macro_f1 FROM (SELECT b0, b1, b2, y, {called} AS p FROM scores, g{i}) GROUP BY ALL)")
        steps.append(f"t{i} AS (SELECT * FROM m{i} ORDER BY round(macro_f1, 9) DESC, {b} LIMIT 1)")
        kept = ", ".join(f"CASE WHEN t.macro_f1 > h.top + 1e-12 THEN t.{n} ELSE h.{n} END AS {n}" for n in names)
        steps.append(f"h{i + 1} AS (SELECT {kept}, CASE WHEN t.macro_f1 > h.top + 1e-12 THEN t.macro_f1 ELSE h.top END AS top FROM h{i} h, t{i} t)")
    return S + ", " + ", ".join(steps) + f" SELECT b0, b1, b2, round(top, 6) AS macro_f1 FROM h{3 * passes}"


@query("op_bias_coordinate", _coordinate_sql())
def op_bias_coordinate(spark, sf):
    """Three passes over all coordinates."""
    rows = written(V.scores(spark, sf).select("y", *COLUMNS), "scores")
    held = Q.coordinate_search(rows, "y", COLUMNS, CLASSES, OFFSETS)
    return Q.offset_grid(rows, "y", COLUMNS, CLASSES, [[h] for h in held]).withColumn("macro_f1", F.round("macro_f1", 6))


GUESS = "round(CASE y WHEN 'E0' THEN 0.1 WHEN 'E23' THEN 0.4 ELSE 0.7 END + s0 / 8, 3)::DOUBLE"


QUANTILES = ", ".join(str(round(0.01 * k, 2)) for k in range(1, 100))


@query("op_cutpoints", S + f", r AS (SELECT y, {GUESS} AS g FROM scores), q AS (SELECT DISTINCT round(unnest(quantile_cont(g, [{QUANTILES}])), 6) AS c FROM r), p AS (SELECT a.c AS a, b.c AS b FROM q a, q b WHERE a.c < b.c), m AS (SELECT a, b, {macro('z', '1')} AS macro_f1 FROM (SELECT a, b, y, CASE WHEN g < a THEN 'E0' WHEN g < b THEN 'E23' ELSE 'E1' END AS z FROM r, p) GROUP BY ALL) SELECT a, b, round(macro_f1, 6) AS macro_f1 FROM m ORDER BY round(macro_f1, 9) DESC, a, b LIMIT 1")
def op_cutpoints(spark, sf):
    s = V.scores(spark, sf)
    rows = s.select("y", F.round(L.score(F.col("y")) + F.col("s0") / 8, 3).alias("g"))
    grid = Q.cut_points(rows, "y", "g", ["E0", "E23", "E1"], [round(0.01 * k, 2) for k in range(1, 100)])
    return Q.best(grid, "macro_f1", "a", "b").withColumn("macro_f1", F.round("macro_f1", 6))


GATE = S + f", r AS (SELECT task_id, y, {ARG.format('s0', 's1', 's2')} AS p, ({V.h(chr(39) + 'g|' + chr(39) + ' || task_id')} % 100) / 100.0 AS conf, ({V.h(chr(39) + 'u|' + chr(39) + ' || task_id')} % 10)::INT AS sup FROM scores)"


def gated(spark, sf):
    s = V.scores(spark, sf)
    return s.select("task_id", "y", Q.argmax(cols(*COLUMNS), CLASSES).alias("p"), ((V.bucket(F.concat(F.lit("g|"), "task_id")) % 100) / 100.0).alias("conf"), (V.bucket(F.concat(F.lit("u|"), "task_id")) % 10).cast("int").alias("sup"))


@query("op_gates", GATE + f", z AS (SELECT 'before' AS stage, y, p FROM r UNION ALL SELECT 'after', y, CASE WHEN conf >= 0.9 THEN 'E1' ELSE p END FROM r), m AS (SELECT stage, {macro('p', '1')} AS f FROM z GROUP BY stage) SELECT round(max(f) FILTER (stage = 'before'), 6) AS before, round(max(f) FILTER (stage = 'after'), 6) AS after, max(f) FILTER (stage = 'after') > max(f) FILTER (stage = 'before') + 1e-12 AS accepted FROM m")
def op_gates(spark, sf):
    """One class's gate: accepted only if the macro F1 rises."""
    rows = gated(spark, sf)
    stages = rows.select("y", F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.col("p").alias("z")), F.struct(F.lit("after").alias("stage"), F.when(F.col("conf") >= 0.9, "E1").otherwise(F.col("p")).alias("z")))).alias("x")).select("y", "x.*")
    m = Q.macro_f1(Q.collapsed(stages, ["stage", "y", "z"]), ["stage"], "y", "z", "_n", CLASSES)
    value = lambda s: F.max(F.when(F.col("stage") == s, F.col("macro_f1")))
    return m.agg(value("before").alias("b"), value("after").alias("a")).select(F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), (F.col("a") > F.col("b") + 1e-12).alias("accepted"))


GATED = {"E1": "s1", "E23": "s2", "E0": "s0"}
STEPS = [round(-0.5 + 0.025 * k, 3) for k in range(81)]


def _gates_sql() -> str:
    sql, held = S + f", c0 AS (SELECT task_id, y, s0, s1, s2, {ARG.format('s0', 's1', 's2')} AS p FROM scores), h0 AS (SELECT {macro('p', '1')} AS f FROM c0)", []
    for i, (name, s) in enumerate(GATED.items()):
        m = f"SELECT t, {macro('z', '1')} AS f FROM (SELECT t, y, CASE WHEN {s} >= t THEN '{name}' ELSE p END AS z FROM c{i}, (SELECT unnest({STEPS})::DOUBLE AS t)) GROUP BY t"
        sql += f", b{i} AS (SELECT t, f FROM ({m}) ORDER BY round(f, 9) DESC, t LIMIT 1), g{i} AS (SELECT CASE WHEN b{i}.f > h{i}.f + 1e-9 THEN t END AS t, h{i}.f AS before, greatest(h{i}.f, CASE WHEN b{i}.f > h{i}.f + 1e-9 THEN b{i}.f ELSE 0 END) AS after FROM b{i}, h{i})"
        sql += f", h{i + 1} AS (SELECT after AS f FROM g{i}), c{i + 1} AS (SELECT task_id, y, s0, s1, s2, CASE WHEN {s} >= t THEN '{name}' ELSE p END AS p FROM c{i}, g{i})"
        held.append(f"SELECT {i} AS step, '{name}' AS gate, t, round(before, 6) AS before, round(after, 6) AS after FROM g{i}")
    return sql + " " + " UNION ALL ".join(held)


@query("op_gates_by_class", _gates_sql())
def op_gates_by_class(spark, sf):
    """Overrides of one class after another, each kept only if macro F1 rises."""
    found = Q.class_gates(V.scores(spark, sf).withColumn("p", Q.argmax(cols(*COLUMNS), CLASSES)), "y", "p", GATED, STEPS, CLASSES)
    rows = [(i, c, t, before, after) for i, (c, t, before, after) in enumerate(found)]  # a row for each class
    return spark.createDataFrame(rows, "step int, gate string, t double, before double, after double").withColumn("before", F.round("before", 6)).withColumn("after", F.round("after", 6))


@query("op_gate_grid", GATE + f", m AS (SELECT t, m, {macro('z', '1')} AS macro_f1 FROM (SELECT t, m, y, CASE WHEN conf >= t AND sup >= m THEN 'E1' ELSE p END AS z FROM r, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) a(t), (VALUES (1), (3), (5)) b(m)) GROUP BY ALL) SELECT t, m, round(macro_f1, 6) AS macro_f1 FROM m ORDER BY round(macro_f1, 9) DESC, t, m LIMIT 1")
def op_gate_grid(spark, sf):
    grid = Q.gate_grid(gated(spark, sf), "y", "p", "E1", "conf", "sup", [0.5, 0.7, 0.9], [1, 3, 5], CLASSES)
    return Q.best(grid, "macro_f1", "t", "m").withColumn("macro_f1", F.round("macro_f1", 6))


TRIALS = 2000
U = lambda k: f"(({V.h(chr(39) + 'blend|' + chr(39) + f' || trial || ' + chr(39) + f'|{k}' + chr(39))} + 1) / 4294967297.0)"
BLEND = S + f", e AS (SELECT trial, -ln({U(0)}) AS e0, -ln({U(1)}) AS e1 FROM (SELECT unnest(generate_series(0, {TRIALS - 1})) AS trial)), w AS (SELECT trial, round(e0 / (e0 + e1), 6) AS w0, round(e1 / (e0 + e1), 6) AS w1 FROM e), c AS (SELECT trial, w0, w1, y, round(w0 * s0 + w1 * s1, 6) AS a, round(w0 * s1 + w1 * s2, 6) AS b, round(w0 * s2 + w1 * s0, 6) AS d FROM scores, w), m AS (SELECT trial, w0, w1, {macro('p', '1')} AS macro_f1 FROM (SELECT *, {ARG.format('a', 'b', 'd')} AS p FROM c) GROUP BY ALL)"


@query("op_blend", BLEND + " SELECT trial, round(w0, 5) AS w0, round(w1, 5) AS w1, round(macro_f1, 6) AS macro_f1 FROM m ORDER BY round(macro_f1, 9) DESC, trial LIMIT 1")
def op_blend(spark, sf):
    """Two score matrices (one a turn of the other) blended by random weights."""
    m = Q.blend_trials(V.scores(spark, sf), "y", [["s0", "s1", "s2"], ["s1", "s2", "s0"]], CLASSES, TRIALS)
    return Q.best(m, "macro_f1", "trial").select("trial", F.round(F.col("w")[0], 5).alias("w0"), F.round(F.col("w")[1], 5).alias("w1"), F.round("macro_f1", 6).alias("macro_f1"))


@query("op_softmax", S + " SELECT task_id, round(exp(s0 / 0.5) / (exp(s0 / 0.5) + exp(s1 / 0.5) + exp(s2 / 0.5)), 6) AS p0, round(exp(s2 / 0.5) / (exp(s0 / 0.5) + exp(s1 / 0.5) + exp(s2 / 0.5)), 6) AS p2 FROM scores")
def op_softmax(spark, sf):
    p = Q.softmax(cols(*COLUMNS), 0.5)
    return V.scores(spark, sf).select("task_id", F.round(p[0], 6).alias("p0"), F.round(p[2], 6).alias("p2"))


BOARD = S + f", r AS (SELECT CASE WHEN task_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split, y, {ARG.format('s0', 's1', 's2')} AS a, {ARG.format('s0', 's1 + 0.3', 's2')} AS b FROM scores), m AS (SELECT 'plain' AS model, split, y, a AS p FROM r UNION ALL SELECT 'shifted', split, y, b FROM r), f AS (SELECT model, split, round({macro('p', '1')}, 6) AS macro_f1 FROM m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY macro_f1 DESC, model)::INT AS place FROM f)"


@query("op_leaderboard", BOARD + " SELECT model, split, macro_f1, place, place = 1 AND split = 'validation' AS best FROM k")
def op_leaderboard(spark, sf):
    s = V.scores(spark, sf).withColumn("split", F.when(F.col("task_id") % 4 == 0, "validation").otherwise("train"))
    models = {"plain": Q.argmax(cols(*COLUMNS), CLASSES), "shifted": Q.argmax([F.col("s0"), F.col("s1") + 0.3, F.col("s2")], CLASSES)}
    rows = s.select("split", F.col("y").alias("y_true"), F.explode(F.create_map(*[x for k, v in models.items() for x in (F.lit(k), v)])).alias("model", "y_pred"))
    m = E.metrics(E.confusion(rows, by=["model", "split"]), ["model", "split"]).select("model", "split", F.round("macro_f1", 6).alias("macro_f1"))
    return Q.leaderboard(m, "model", "macro_f1", "split")
