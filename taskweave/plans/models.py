"""Queries: fitted models. They learn from tasks outside every fourth and score the rest; results of optimisers are held against held-out labels,
runs on shuffled labels and direct computation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from taskweave.operators import evaluate as E
from taskweave.operators import features as X
from taskweave.operators import fields as P
from taskweave.operators import labels as L
from taskweave.operators import linear as N
from taskweave.operators import models as M
from taskweave.operators import ordered as O
from taskweave.operators import retrieval as R
from taskweave.operators import search as Q
from taskweave.operators import splits as S
from taskweave.operators import svd as D
from taskweave.plans import fixtures as V
from taskweave.plans.features import COUNTS, counts
from taskweave.plans.registry import query
from taskweave.plans.scoring import COLUMNS, OFFSETS
from taskweave.shared import new_path, written
from taskweave.sources import tables as S_

c = F.col
HELD = "task_id % 4 = 0"
VALIDATION = "task_id % 4 = 1"
#: The most terms of a block in the queries that compare many models: the weights of all models are one matrix of terms by models.
CAP = 1 << 13
WORD3, WORD4 = P.Block("word", "task", "word", 1, 3, 2, CAP, 1.0), P.Block("word_long", "task", "word", 1, 4, 2, CAP, 1.0)
CHAR5, CHAR6 = P.Block("char", "task", "char_wb", 3, 5, 3, CAP, 0.65), P.Block("char_long", "task", "char_wb", 2, 6, 3, CAP, 0.65)
TITLED = P.Block("title", "jobrole_title", "word", 1, 2, 1, CAP, 0.5)
CLASSES = L.CLASSES
EACH = range(len(CLASSES))


def rank():
    return L.rank(c("y"))


def target_score():
    return L.score(c("y"))


def featured(spark, sf, blocks, folds=None):
    """(fitted features, rows with them): vocabularies and frequencies are those of training rows. ``folds``: further columns (task_id, ...)."""
    rows = V.labelled(spark, sf)
    fields, marks = P.FieldFeatures(idCol="task_id", blocks=blocks), [F.expr(f"int({HELD})").alias("held"), F.expr(f"int({VALIDATION})").alias("validation")]
    stored = P.texts(rows, "task_id", blocks, ["jobrole_id", "y"])  # texts are made once
    model = fields.fit_texts(stored.where(f"not ({HELD})"))
    rows = model.vectors(stored).select("task_id", "jobrole_id", "y", "index", "value", *marks)
    return model, written(rows if folds is None else rows.join(folds, "task_id"), "featured")


def balanced(rows):
    """Class weights that are balanced over training rows."""
    sizes = {r.y: r["count"] for r in rows.where("held = 0").groupBy("y").count().collect()}  # a row for each class
    known = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, sum(sizes.values()) / (len(sizes) * n))]) if sizes else None
    return F.lit(1.0) if known is None else F.coalesce(F.try_element_at(known, c("y")), F.lit(1.0))


def laid(rows, folds=("held", "validation"), target=None):
    """Rows as blocks for ``linear.fit``, with balanced class weights."""
    return N.packed(rows, rank(), target, balanced(rows), list(folds))


NO_HELD, FITTING = ((0, 1),), ((0, 1), (1, 1))


def asked(rows, weights):
    """Held-out rows with ``scores``."""
    return N.scored(rows.where("held = 1"), weights)


def each_score(names):
    return [c("scores")[k].alias(n) for k, n in enumerate(names)]


def best_of(scores):
    return Q.argmax(scores, CLASSES)


def vectors(rows, width: int):
    """Spark ML's vectors of (index, value) arrays, which has no built-in constructor of sparse rows."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    vector = F.udf(lambda i, v: SparseVector(width, i, v), VectorUDT())
    return rows.withColumn("features", vector("index", "value")).withColumn("weight", F.lit(1.0)).withColumn("index", rank().cast("double"))


def released(rows):
    """The released recipe: the smaller profile and a machine for each class against the rest."""
    return Pipeline(stages=[P.FieldFeatures(idCol="task_id", blocks=P.PROFILES["basic"]), N.LinearClasses(c=0.2)]).fit(rows)


def split_rows(spark, sf):
    rows = V.labelled(spark, sf)
    return rows.where(f"not ({HELD})"), rows.where(HELD)


@query("ml_svc_ovr")
def ml_svc_ovr(spark, sf):
    train, held = split_rows(spark, sf)
    return released(train).transform(held).select("task_id", "y", "label")


@query("ml_refit_full")
def ml_refit_full(spark, sf):
    """Held-out rows by the sealed model, which did not see them, and by the one that is refitted on all rows for release."""
    train, held = split_rows(spark, sf)
    sealed, full = released(train), released(train.unionByName(held))
    out = sealed.transform(held).select("task_id", "y", "label")
    return out.join(full.transform(held).select("task_id", c("label").alias("refit_label")), "task_id").select("*", F.lit("full").alias("fit_scope"), F.lit(full.stages[0].rows).alias("fitted_rows"))


@query("snk_model", "WITH " + V.CTE_TASKS + " SELECT 'E0|E1|E23' AS classes, 1 AS version, count(*)::BIGINT AS labelled_rows FROM labelled")
def snk_model(spark, sf):
    """Features and weights saved with a manifest, which is read back."""
    path = new_path(spark, "model")
    S_.save_model(released(split_rows(spark, sf)[0]), path, CLASSES, 1, V.labelled(spark, sf).count())
    return spark.read.schema(S_.MANIFEST).json(f"{path}/manifest")


@query("src_model")
def src_model(spark, sf):
    """Loaded, refused if its classes or version differ, and used to score rows that were not there when it was fitted."""
    train, held = split_rows(spark, sf)
    path = new_path(spark, "model")
    S_.save_model(released(train), path, CLASSES, 1, 0)
    return S_.load_model(spark, PipelineModel, path, CLASSES, 1).transform(held).select("task_id", "y", "label")


#: View, C and weight of the positive rows of the specialists' candidates.
SPECIALISTS = [
    ("word", 0.25, 2), ("word", 0.5, 4), ("word", 1.0, 8), ("word", 1.0, 16), ("char_word", 0.25, 2), ("char_word", 0.5, 4), ("char_word", 0.75, 8), ("char_word", 1.0, 16),
    ("word_long", 0.25, 2), ("word_long", 0.5, 4), ("word_long", 1.0, 8), ("char_word_long", 0.25, 2), ("char_word_long", 0.5, 4), ("char_word_long", 0.75, 8), ("char_word_long", 1.0, 16),
]
VIEWS = {"word": ("word",), "char_word": ("word", "char"), "word_long": ("word_long",), "char_word_long": ("word_long", "char_long")}
POINTS = [round(-2.5 + 0.05 * k, 2) for k in range(101)]


def best_threshold(rows, positive, score, points=POINTS):
    """(f1, threshold) with the best F1."""
    found = Q.best(Q.threshold_grid(rows, positive, score, points), "f1", "t").first()
    return found.f1, found.t


@query("ml_svc_specialists")
def ml_svc_specialists(spark, sf):
    """One binary machine a class: view, C, weight and threshold are those with the best F1 on validation rows; the highest score above its threshold, with offsets found there, wins.

    All candidates of all classes are fitted in one go, and so are the three that are chosen, on all training rows.
    """
    model, rows = featured(spark, sf, [WORD3, CHAR5, WORD4, CHAR6])
    blocks = laid(rows)
    problem = lambda k, s, without: N.Problem(positive=(k,), c=s[1], weight=float(s[2]), without=without, features=model.ranges(*VIEWS[s[0]]))
    every = [(k, s) for k in EACH for s in SPECIALISTS]
    tried = N.fit(blocks, [problem(k, s, FITTING) for k, s in every], model.width)
    known = written(N.scored(rows.where("validation = 1"), tried).select("task_id", "y", "scores"), "tried")
    flat = known.select("y", *each_score([f"s{i}" for i in range(len(every))]))
    chosen = []
    for k in EACH:
        own = [i for i, (of, _) in enumerate(every) if of == k]
        (f1, t), i = max(((best_threshold(flat, c("y") == CLASSES[k], f"s{i}"), i) for i in own), key=lambda x: (x[0][0], -x[1]))
        chosen.append((i, t))
    columns = [f"score_{k}" for k in EACH]
    centred = written(flat.select("y", *[(c(f"s{i}") - t).alias(n) for (i, t), n in zip(chosen, columns, strict=True)]), "specialists")
    offsets = Q.coordinate_search(centred, "y", columns, CLASSES, OFFSETS)
    final = N.fit(blocks, [problem(*every[i], NO_HELD) for i, _ in chosen], model.width)
    out = asked(rows, final).select("task_id", "y", *[(c("scores")[k] - chosen[k][1]).alias(f"score_{n}") for k, n in enumerate(CLASSES)])
    label = best_of([c(f"score_{n}") + F.lit(b) for n, b in zip(CLASSES, offsets, strict=True)])
    return out.select("*", *[(c(f"score_{n}") >= 0).alias(f"is_{n}") for n in CLASSES], label.alias("label"))


@query("ml_char_word_svc")
def ml_char_word_svc(spark, sf):
    model, rows = featured(spark, sf, [WORD3, CHAR5])
    weights = N.fit(laid(rows), [N.Problem(positive=(k,), c=0.5, balanced=True, without=NO_HELD) for k in EACH], model.width)
    return asked(rows, weights).select("task_id", "y", best_of([c("scores")[k] for k in EACH]).alias("label"))


@query("ml_logreg")
def ml_logreg(spark, sf):
    model, rows = featured(spark, sf, [WORD3, TITLED])
    data = written(vectors(rows, model.width).select("task_id", "y", "held", "index", "weight", "features"), "dataset")
    return M.predicted(M.logistic(data.where("held = 0"), 10.0), data.where("held = 1")).select("task_id", "y", "label")


@query("ml_teacher_aided")
def ml_teacher_aided(spark, sf):
    """Diagnostic: the source score is a feature beside the text's dimensions, so the result is leaky by design."""
    rows = dense(spark, sf)
    rows = rows.withColumn("features", array_to_vector(F.concat("svd", F.array(target_score()))))
    model = M.logistic(rows.where("held = 0"), 100.0)
    return M.predicted(model, rows.where("held = 1")).select("task_id", "y", "label", F.lit(True).alias("leaky"))


NB = "WITH " + V.CTE_TASKS + COUNTS + ", seen AS (SELECT y AS label, term, sum(tf) AS c FROM counts JOIN labelled USING (task_id) WHERE task_id % 4 <> 0 GROUP BY ALL), terms AS (SELECT term, sum(c) AS a FROM seen GROUP BY term), cls AS (SELECT label, sum(c) AS t FROM seen GROUP BY label), ask AS (SELECT * FROM counts WHERE task_id % 4 = 0)"


@query("ml_nb_multinomial", NB + """, pr AS (SELECT y AS label, ln(count(*) / (SELECT count(*) FROM labelled WHERE task_id % 4 <> 0)) AS p FROM labelled WHERE task_id % 4 <> 0 GROUP BY y),
s AS (SELECT task_id, cls.label, sum(tf * ln((coalesce(c, 0) + 0.1) / (t + 0.1 * (SELECT count(*) FROM terms)))) AS s FROM ask JOIN terms USING (term) CROSS JOIN cls LEFT JOIN seen ON seen.label = cls.label AND seen.term = ask.term GROUP BY ALL)
SELECT task_id, arg_min(label, (-round(coalesce(s, 0) + p, 6), label)) AS label FROM (SELECT DISTINCT task_id FROM ask) CROSS JOIN pr LEFT JOIN s USING (task_id, label) GROUP BY task_id""")
def ml_nb_multinomial(spark, sf):
    labels = V.labelled(spark, sf).where(f"not ({HELD})").select("task_id", c("y").alias("label"))
    k = counts(spark, sf)
    return M.naive_bayes(k, "task_id", labels, k.where(HELD), 0.1)


@query("ml_nb_complement", NB + """, o AS (SELECT cls.label, terms.term, a - coalesce(c, 0) + 0.25 AS o FROM terms CROSS JOIN cls LEFT JOIN seen ON seen.label = cls.label AND seen.term = terms.term), w AS (SELECT label, term, ln(o / sum(o) OVER (PARTITION BY label)) AS w FROM o), nw AS (SELECT label, term, w / sum(abs(w)) OVER (PARTITION BY label) AS w FROM w),
s AS (SELECT task_id, label, round(sum(tf * w), 9) AS s FROM ask JOIN nw USING (term) GROUP BY ALL) SELECT task_id, arg_min(label, (s, label)) AS label FROM s GROUP BY task_id""")
def ml_nb_complement(spark, sf):
    labels = V.labelled(spark, sf).where(f"not ({HELD})").select("task_id", c("y").alias("label"))
    k = counts(spark, sf)
    return M.complement_bayes(k, "task_id", labels, k.where(HELD), 0.25)


@query("ml_nbsvm")
def ml_nbsvm(spark, sf):
    """Binary term features scaled by naive Bayes log ratios of the training rows, then a binary machine: E0 or not."""
    model, rows = featured(spark, sf, [WORD3, CHAR5])
    seen = rows.where("held = 0").select("y", F.explode("index").alias("term"))  # a vocabulary's terms are all terms of training rows
    each = seen.groupBy("term").agg((F.count_if(c("y") == "E0") + 1).alias("p"), (F.count_if(c("y") != "E0") + 1).alias("q")).toArrow()  # as many as the blocks' caps allow
    term, p, q = (each.column(k).to_numpy() for k in range(3))
    ratio = np.zeros(model.width)
    ratio[term] = np.log(p / p.sum()) - np.log(q / q.sum())
    data = N.valued(rows, ratio)
    weights = N.fit(laid(data), [N.Problem(positive=(0,), c=0.05, without=NO_HELD)], model.width)
    e0 = lambda x: F.when(x, "E0").otherwise("impacted")
    return asked(data, weights).select("task_id", e0(c("y") == "E0").alias("y"), c("scores")[0].alias("score"), e0(c("scores")[0] >= 0).alias("label"))


@query("ml_hierarchical")
def ml_hierarchical(spark, sf):
    """Stage 1: E0 or not; stage 2, trained on the others: E1 or E23."""
    model, rows = featured(spark, sf, [WORD3, TITLED])
    stages = [N.Problem(positive=(1, 2), c=1.0, balanced=True, without=NO_HELD), N.Problem(positive=(2,), c=1.0, balanced=True, without=NO_HELD, among=(1, 2))]
    out = asked(rows, N.fit(laid(rows), stages, model.width))
    return out.select("task_id", "y", F.when(c("scores")[0] < 0, "E0").when(c("scores")[1] < 0, "E1").otherwise("E23").alias("label"))


P_SQL = "1 / (1 + exp(-({0})))"


@query("ml_ordinal_threshold", "WITH " + V.CTE_SCORES + f", p AS (SELECT task_id, {P_SQL.format('s0')} AS a, least({P_SQL.format('s0')}, {P_SQL.format('s1')}) AS b FROM scores) SELECT task_id, round(greatest(1 - a, 0) / (greatest(1 - a, 0) + greatest(a - b, 0) + b), 6) AS \"E0\", round(greatest(a - b, 0) / (greatest(1 - a, 0) + greatest(a - b, 0) + b), 6) AS \"E1\", round(b / (greatest(1 - a, 0) + greatest(a - b, 0) + b), 6) AS \"E23\" FROM p")
def ml_ordinal_threshold(spark, sf):
    """Decoding of boundary probabilities."""
    p = [1 / (1 + F.exp(-c(k))) for k in ("s0", "s1")]
    return V.scores(spark, sf).select("task_id", *[F.round(v, 6).alias(k) for k, v in M.monotone_classes(p).items()])


@query("ml_ordinal_svm", "WITH " + V.CTE_SCORES + " SELECT task_id, ((s0 >= 0.0)::INT + (s1 >= 0.25)::INT)::INT AS rank FROM scores")
def ml_ordinal_svm(spark, sf):
    """Decoding of boundary margins."""
    return V.scores(spark, sf).select("task_id", M.passed_rank([c("s0"), c("s1")], [0.0, 0.25]).alias("rank"))


@query("ml_ordinal_threshold_fit")
def ml_ordinal_threshold_fit(spark, sf):
    """A logistic model for each step of the order, decoded into class probabilities; the likeliest class wins."""
    model, rows = featured(spark, sf, [WORD3, TITLED])
    steps = [N.Problem(positive=tuple(range(t + 1, len(CLASSES))), c=10.0, loss="logistic", balanced=True, without=NO_HELD, free_intercept=True) for t in EACH[:-1]]
    out = asked(rows, N.fit(laid(rows), steps, model.width))
    p = M.monotone_classes([1 / (1 + F.exp(-c("scores")[t])) for t in EACH[:-1]])
    out = out.select("task_id", "y", *[v.alias(k) for k, v in p.items()])
    return out.withColumn("label", best_of([c(k) for k in CLASSES]))


#: C and weight of the positive rows of the boundaries' candidates.
BOUNDARIES = [(0.25, 1), (0.5, 1), (0.5, 2), (0.75, 2), (1.0, 4)]


@query("ml_ordinal_svm_fit")
def ml_ordinal_svm_fit(spark, sf):
    """A boundary machine for each step of the order, its setting by F1 on validation rows, all thresholds by macro F1 there; models of all training rows score the rest."""
    model, rows = featured(spark, sf, [WORD3, CHAR5])
    blocks = laid(rows)
    above = lambda t: tuple(range(t + 1, len(CLASSES)))
    every = [(t, s) for t in EACH[:-1] for s in BOUNDARIES]
    problem = lambda t, s, without: N.Problem(positive=above(t), c=s[0], weight=float(s[1]), without=without)
    known = written(N.scored(rows.where("validation = 1"), N.fit(blocks, [problem(t, s, FITTING) for t, s in every], model.width)).select("y", *each_score([f"s{i}" for i in range(len(every))])), "tried")
    chosen = []
    for t in EACH[:-1]:
        own = [i for i, (of, _) in enumerate(every) if of == t]
        chosen.append(max(own, key=lambda i: (best_threshold(known, rank() > t, f"s{i}", [0.0])[0], -i)))  # noqa: B023
    columns = [f"over_{t}" for t in EACH[:-1]]
    seen = written(known.select("y", *[c(f"s{i}").alias(n) for i, n in zip(chosen, columns, strict=True)]), "boundaries")
    cuts = Q.coordinate_search(seen, "y", columns, CLASSES, [k / 20 - 2 for k in range(81)], 4, Q.passed_grid)
    out = asked(rows, N.fit(blocks, [problem(*every[i], NO_HELD) for i in chosen], model.width)).select("task_id", "y", *each_score(columns))
    return out.withColumn("label", L.from_rank(M.passed_rank([c(n) for n in columns], cuts)))


#: Dimensions of the text's singular vectors.
DIMENSIONS = 180


def dense(spark, sf, k: int = DIMENSIONS):
    """Rows with ``svd``, their places along the leading singular vectors of the training rows' terms, and what Spark ML's estimators take."""
    model, rows = featured(spark, sf, [WORD3, TITLED])
    _, v = D.truncated(N.packed(rows.where("held = 0"), rank()), model.width, k)
    rows = D.projected(rows, v).select("task_id", "y", "held", "validation", "svd", rank().cast("double").alias("index"), balanced(rows).alias("weight"), target_score().alias("target"))
    return written(rows, "dense")


@query("ml_ordered_logit")
def ml_ordered_logit(spark, sf):
    """Proportional odds on the text's dimensions, by Fisher scoring."""
    rows = dense(spark, sf)
    p = O.fit(rows.where("held = 0"), "svd", "index", penalty=0.05)
    shares = M.monotone_classes(O.passed(c("svd"), p))
    out = rows.where("held = 1").select("task_id", "y", *[v.alias(f"p_{k}") for k, v in shares.items()])
    return out.withColumn("label", best_of([c(f"p_{k}") for k in CLASSES]))


def score_model(spark, sf, problem):
    """Held-out rows with a predicted score, from -0.1 to 0.9, and the class whose score is nearest. Targets are centred on the training rows' mean."""
    model, rows = featured(spark, sf, [WORD3, TITLED])
    mean = rows.where("held = 0").agg(F.coalesce(F.avg(target_score()), F.lit(0.0))).first()[0]
    weights = N.fit(laid(rows, target=target_score() - mean), [problem], model.width)
    score = F.least(F.greatest(c("scores")[0] + mean, F.lit(-0.1)), F.lit(0.9))
    out = asked(rows, weights).select("task_id", "y", score.alias("score"))
    return out.withColumn("label", best_of([-F.abs(c("score") - L.score(F.lit(k))) for k in CLASSES]))


@query("ml_ridge_score")
def ml_ridge_score(spark, sf):
    return score_model(spark, sf, N.Problem(c=10.0, loss="square", balanced=True, without=NO_HELD))


@query("ml_huber_score")
def ml_huber_score(spark, sf):
    return score_model(spark, sf, N.Problem(c=10.0, loss="huber", balanced=True, without=NO_HELD))


@query("ml_svr_score")
def ml_svr_score(spark, sf):
    return score_model(spark, sf, N.Problem(c=10.0, loss="insensitive", balanced=True, without=NO_HELD))


def embedded(spark, sf):
    """Rows with their stored dense vectors."""
    vectors = V.table(spark, sf, "embeddings").select(c("vec_id").alias("task_id"), array_to_vector(X.unit(c("embedding"))).alias("features"))
    return V.labelled(spark, sf).select("task_id", "y").join(vectors, "task_id").withColumn("weight", F.lit(1.0)).withColumn("index", L.rank(c("y")).cast("double"))


def ridge_labels(train, rows):
    """Ridge to +1 and -1 for each class; the highest wins."""
    for k, name in enumerate(L.CLASSES):
        model = M.ridge(train.withColumn("t", F.when(c("y") == name, 1.0).otherwise(-1.0)), "t")
        rows = model.transform(rows).withColumnRenamed("prediction", f"r{k}")
    return rows.withColumn("label", Q.argmax([c(f"r{k}") for k in range(3)], L.CLASSES))


@query("ml_ridge_classifier")
def ml_ridge_classifier(spark, sf):
    """On dense vectors."""
    rows = written(embedded(spark, sf), "dense")
    return ridge_labels(rows.where(f"not ({HELD})"), rows.where(HELD)).select("task_id", "y", "label")


@query("ml_dense_probe")
def ml_dense_probe(spark, sf):
    """Three estimators on dense vectors with their metrics on validation and test rows; ``best`` marks the highest macro F1 on validation rows."""
    rows = embedded(spark, sf).withColumn("split", F.when(F.expr(HELD), "test").when(F.expr(VALIDATION), "validation").otherwise("train"))
    rows = written(rows, "dense")
    train, asked = rows.where("split = 'train'"), rows.where("split <> 'train'")
    calls = {"ridge": ridge_labels(train, asked), "logistic": M.predicted(M.logistic(train), asked), "svc": M.predicted(M.one_vs_rest(train), asked)}
    out = None
    for name, found in calls.items():
        part = found.select(F.lit(name).alias("model"), "split", c("y").alias("y_true"), c("label").alias("y_pred"))
        out = part if out is None else out.unionByName(part)
    by = ["model", "split"]
    return Q.leaderboard(E.metrics(E.confusion(out, by=by), by).select(*by, "accuracy", "macro_f1"), "model", "macro_f1", "split")


@query("ml_trees")
def ml_trees(spark, sf):
    """On the text's dimensions."""
    rows = dense(spark, sf).withColumn("features", array_to_vector("svd"))
    train, held = rows.where("held = 0"), rows.where("held = 1")
    kinds = {
        "decision_tree": DecisionTreeClassifier(labelCol="index", maxDepth=10, weightCol="weight", seed=7),
        "random_forest": RandomForestClassifier(labelCol="index", numTrees=100, maxDepth=10, weightCol="weight", seed=7),
        "extra_trees": RandomForestClassifier(labelCol="index", numTrees=100, maxDepth=10, featureSubsetStrategy="sqrt", bootstrap=False, weightCol="weight", seed=7),
        "boosted": OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, seed=7), labelCol="index", weightCol="weight"),
    }
    out = None
    for name, kind in kinds.items():
        part = kind.fit(train).transform(held).select(F.lit(name).alias("model"), "task_id", "y", L.from_rank(c("prediction")).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ml_platt")
def ml_platt(spark, sf):
    """A machine for each class, fitted without the validation rows, on which a sigmoid of each score is fitted."""
    model, rows = featured(spark, sf, [WORD3, TITLED])
    weights = N.fit(laid(rows), [N.Problem(positive=(k,), c=1.0, without=FITTING) for k in EACH], model.width)
    names = [f"s{k}" for k in EACH]
    known = written(N.scored(rows.where("validation = 1"), weights).select("y", *each_score(names)), "validation")
    raw = []
    for k, name in enumerate(CLASSES):
        a, b = M.platt(known, f"s{k}", c("y") == name)
        raw.append(1 / (1 + F.exp(-(F.lit(a) * c(f"s{k}") + F.lit(b)))))
    total = raw[0] + raw[1] + raw[2]
    out = asked(rows, weights).select("task_id", "y", *each_score(names)).select("task_id", "y", *[(r / total).alias(f"p_{n}") for r, n in zip(raw, CLASSES, strict=True)])
    return out.withColumn("label", best_of([c(f"p_{n}") for n in CLASSES]))


#: View and C of the stack's base models, and the meta model's choices of C.
BASES = [("task", 0.2), ("task", 0.5), ("titled", 0.2), ("titled", 0.5)]
META_C = [0.1, 1.0, 10.0]
OUTER, INNER = 3, 3


def stack_folds(rows):
    """(task_id, outer, inner): group-disjoint folds, and for each outer fold the inner folds of the rows outside it, as an array by outer fold."""
    nested = S.nested_folds(rows, "jobrole_id", "y", OUTER, INNER).groupBy("jobrole_id").agg(F.map_from_entries(F.collect_list(F.struct("outer", "inner"))).alias("m"))
    outer = S.group_folds(rows, "jobrole_id", "y", OUTER).select("jobrole_id", c("fold").alias("outer"))
    inner = F.transform(F.sequence(F.lit(0), F.lit(OUTER - 1)), lambda o: F.coalesce(F.try_element_at("m", o), F.lit(-1)))
    return rows.select("task_id", "jobrole_id").join(outer, "jobrole_id").join(nested, "jobrole_id", "left").select("task_id", "outer", *[inner[o].alias(f"inner_{o}") for o in range(OUTER)])


def base_scores(spark, sf):
    """(rows with fold columns and ``scores``, places): base scores of all fold combinations that the nested stack asks for.

    ``places[(outer, left out inner folds)]`` are the columns of the base models that saw neither. All are fitted in one go.
    """
    every = V.labelled(spark, sf)
    model, rows = featured(spark, sf, [WORD3, CHAR5, TITLED], stack_folds(every))
    views = {"task": model.ranges("word", "char"), "titled": model.ranges("word", "char", "title")}
    folds = ["outer", *[f"inner_{o}" for o in range(OUTER)]]
    wanted = [(o, gone) for o in range(OUTER) for gone in [(), *[(i,) for i in range(INNER)], *[(0, i) for i in range(1, INNER)]]]
    problems, places = [], {}
    for o, gone in wanted:
        places[o, gone] = list(range(len(problems), len(problems) + len(BASES) * len(CLASSES)))
        without = ((0, o), *[(o + 1, i) for i in gone])
        problems += [N.Problem(positive=(k,), c=v, balanced=True, without=without, features=views[view]) for view, v in BASES for k in EACH]
    weights = N.fit(laid(rows, folds), problems, model.width, 40, 2e-3)
    return written(N.scored(rows, weights).select("task_id", "y", *folds, "scores"), "base-scores"), places


def nested_stack(rows, places, signals=None):
    """(task_id, outer, y, label, meta_c): each outer fold by a meta model of the others.

    In each outer fold, C of the meta model and class offsets are chosen on inner fold 0, which neither the base scores nor the meta model of
    the other inner folds have seen; then a meta model of out-of-fold base scores of all rows outside the outer fold scores the fold.
    ``signals``: (task_id, without, ...), more inputs for each outer fold. Inputs are scaled by the rows that a meta model is fitted on. All
    meta models are fitted in one go: group g < OUTER chooses for outer fold g, and group OUTER + g scores it.
    """
    base = len(BASES) * len(CLASSES)
    more = [n for n in signals.columns if n not in ("task_id", "without")] if signals is not None else []
    size = base + len(more)
    take = lambda columns: F.transform(F.array(*[F.lit(j) for j in columns]), lambda j: F.get("scores", j))
    cells = []
    for o in range(OUTER):
        inner, out = c(f"inner_{o}"), c("outer") == o
        by_fold = lambda pairs: F.coalesce(*[F.when(inner == i, take(places[o, gone])) for i, gone in pairs])  # noqa: B023, E731
        deep, oof = by_fold([(0, (0,)), *[(i, (0, i)) for i in range(1, INNER)]]), by_fold([(i, (i,)) for i in range(INNER)])
        cells += [
            F.when(~out, F.struct(F.lit(o).alias("g"), F.lit(o).alias("without"), (inner != 0).cast("int").alias("fit"), deep.alias("x"))),
            F.struct(F.lit(OUTER + o).alias("g"), F.lit(o).alias("without"), (~out).cast("int").alias("fit"), F.when(out, take(places[o, ()])).otherwise(oof).alias("x")),
        ]
    long = rows.select("task_id", "y", F.explode(F.array_compact(F.array(*cells))).alias("s")).select("task_id", "y", "s.*")
    if more:
        long = long.join(signals, ["task_id", "without"]).withColumn("x", F.concat("x", F.array(*[c(n).cast("double") for n in more])))
    long = written(long.select("task_id", "y", "g", "without", "fit", "x"), "stack")
    each = long.where("fit = 1").select("g", F.posexplode("x").alias("j", "v")).groupBy("g", "j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("j", "m", F.when(c("s") > 0, c("s")).otherwise(1.0).alias("s")))).alias("scale"))  # a row for each group
    place = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (c("g") * size + j).cast("int"))
    ready = long.join(F.broadcast(scale), "g").select("task_id", "y", "g", "without", "fit", place.alias("index"), F.zip_with("x", "scale", lambda v, z: (v - z["m"]) / z["s"]).alias("value"))
    ready = written(ready, "meta")
    problems = [N.Problem(positive=(k,), c=v, loss="logistic", only=((0, g), (1, 1)), free_intercept=True) for g in range(2 * OUTER) for v in META_C for k in EACH]
    weights = N.fit(N.packed(ready, rank(), folds=["g", "fit"]), problems, 2 * OUTER * size)
    share = lambda v: [1 / (1 + F.exp(-F.get("scores", (c("g") * len(META_C) + v) * len(CLASSES) + k))) for k in EACH]
    chances = F.array(*[F.array(*share(v)) for v in range(len(META_C))])
    known = N.scored(ready.where("g >= {0} or fit = 0".format(OUTER)), weights).select("task_id", "y", "g", "without", "fit", chances.alias("p"))
    known = written(known.where("fit = 0"), "chances")
    normal = lambda p: [p[k] / F.aggregate(p, F.lit(0.0), lambda a, b: a + b) for k in EACH]
    tried = known.where(c("g") < OUTER).select("y", "without", F.posexplode("p").alias("v", "q")).select("y", (c("without") * len(META_C) + c("v")).alias("group"), *[x.alias(f"m{k}") for k, x in enumerate(normal(c("q")))])
    found = Q.grouped_offsets(tried, "group", "y", ["m0", "m1", "m2"], CLASSES, OFFSETS)
    out = known.where(c("g") >= OUTER)
    label, chosen = F.lit(None).cast("string"), F.lit(None).cast("double")
    for o in range(OUTER):
        own = [v for v in range(len(META_C)) if o * len(META_C) + v in found]
        v = max(own, key=lambda v: (found[o * len(META_C) + v][0], -v)) if own else 0  # noqa: B023
        offsets = found[o * len(META_C) + v][1] if own else [0.0] * len(CLASSES)
        p = normal(c("p")[v])
        label = F.when(c("without") == o, best_of([x + F.lit(b) for x, b in zip(p, offsets, strict=True)])).otherwise(label)
        chosen = F.when(c("without") == o, F.lit(META_C[v])).otherwise(chosen)
    return out.select("task_id", c("without").alias("outer"), "y", label.alias("label"), chosen.alias("meta_c"))


@query("ml_oof_stack")
def ml_oof_stack(spark, sf):
    """Nested: every row is scored once, by a stack that saw nothing of its group."""
    return nested_stack(*base_scores(spark, sf))


SIGNALS = [f"{n}_{k}" for n in ("nb", "rule", "near") for k in EACH]


def weights_of(spark, sf):
    return X.tfidf_of(V.labelled(spark, sf), "task_id", (X.Grams("word", 1, 2), c("task"))).withColumnRenamed("task_id", "row")


@query("ml_oof_enriched")
def ml_oof_enriched(spark, sf):
    """The nested stack with rule, naive Bayes and centroid signals, and with centroids of stored dense vectors, from rows that are neither of the row's own outer fold nor of the one to be scored."""
    rows, places = base_scores(spark, sf)
    folds = rows.select(c("task_id").alias("row"), c("outer").alias("fold"), c("y").alias("label"))
    signals = R.fold_signals(weights_of(spark, sf), folds, CLASSES, OUTER, nested=True)
    vectors = V.table(spark, sf, "embeddings").select(c("vec_id").alias("row"), F.posexplode(X.unit(c("embedding"))).alias("term", "weight")).join(folds.select("row"), "row", "left_semi")
    near = R.fold_signals(vectors.withColumn("term", c("term").cast("string")), folds, CLASSES, OUTER, nested=True).select("row", "without", *[c(f"near_{k}").alias(f"dense_{k}") for k in EACH])
    more = signals.join(near, ["row", "without"]).select(c("row").alias("task_id"), "without", *SIGNALS, *[f"dense_{k}" for k in EACH])
    return nested_stack(rows, places, written(more, "signals"))


def _fold_sql() -> str:
    """Each fold's signals counted afresh from the rows of the other folds."""
    tfidf = "raw AS (SELECT task_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1) AS w FROM counts JOIN (SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2) USING (term)), weights AS (SELECT task_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY task_id)) AS weight FROM raw)"
    one = lambda k: f"count(*) FILTER (y = '{CLASSES[k]}') AS n{k}, coalesce(sum(weight) FILTER (y = '{CLASSES[k]}'), 0) AS w{k}"
    n = "(n0 + n1 + n2)"
    seen = f"facts AS (SELECT f AS fold, term, {', '.join(one(k) for k in EACH)} FROM rows JOIN weights USING (task_id), (SELECT unnest([0, 1, 2, 3]) AS f) WHERE fold <> f GROUP BY ALL)"
    sums = "sums AS (SELECT fold, " + ", ".join(f"sqrt(sum(w{k} * w{k})) AS len{k}, sum(n{k} + 1) AS p{k}, sum({n} - n{k} + 1) AS q{k}" for k in EACH) + " FROM facts GROUP BY fold)"
    # Terms that only the row's own fold has count as terms that no row has.
    every = f"asked AS (SELECT task_id, term, weight, rows.fold, {', '.join(f'coalesce(n{k}, 0) AS n{k}, coalesce(w{k}, 0) AS w{k}' for k in EACH)} FROM rows JOIN weights USING (task_id) LEFT JOIN facts USING (term, fold))"
    own = "extra AS (SELECT fold, count(*) AS e FROM (SELECT f AS fold, term FROM (SELECT DISTINCT term FROM weights), (SELECT unnest([0, 1, 2, 3]) AS f) EXCEPT SELECT fold, term FROM facts) GROUP BY fold)"
    cols = ", ".join(f"round(avg(ln((n{k} + 1) / (p{k} + coalesce(e, 0))) - ln(({n} - n{k} + 1) / (q{k} + coalesce(e, 0)))), 6) AS nb_{k}, round(coalesce(max(n{k} / {n}) FILTER ({n} >= 2), 0), 6) AS rule_{k}, round(coalesce(sum(weight * w{k} / len{k}), 0), 6) AS near_{k}" for k in EACH)
    return f"{COUNTS}, {tfidf}, rows AS (SELECT task_id, y, (task_id % 4)::INT AS fold FROM labelled), {seen}, {sums}, {every}, {own} SELECT task_id, {cols} FROM asked JOIN sums USING (fold) LEFT JOIN extra USING (fold) GROUP BY task_id"


@query("ml_fold_signals", "WITH " + V.CTE_TASKS + _fold_sql())
def ml_fold_signals(spark, sf):
    """What other folds' rows say of each row, for folds by id."""
    folds = V.labelled(spark, sf).select(c("task_id").alias("row"), (c("task_id") % 4).cast("int").alias("fold"), c("y").alias("label"))
    weights = written(weights_of(spark, sf), "weights")
    found = R.fold_signals(weights, folds, CLASSES, 4).join(weights.select("row").distinct(), "row", "left_semi")
    return found.select(c("row").alias("task_id"), *[F.round(n, 6).alias(n) for n in SIGNALS])


@query("ft_svd")
def ft_svd(spark, sf):
    """Rows' places along the leading singular vectors of the training rows' terms."""
    return dense(spark, sf).select("task_id", "svd")


@query("ru_linear_terms")
def ru_linear_terms(spark, sf):
    """The largest terms of a linear model of the training rows count in each text; the class with most wins, E0 without any."""
    model, data = featured(spark, sf, [P.Block("word", "task", "word", 1, 1, 2, CAP, 1.0)])
    weights = N.fit(laid(data), [N.Problem(positive=(k,), c=1.0, balanced=True, without=NO_HELD) for k in EACH], model.width)
    n = model.width
    flat = spark.createDataFrame(pa.table({"label": np.repeat(CLASSES, n).tolist(), "index": pa.array(np.tile(np.arange(n, dtype=np.int32), len(CLASSES))), "weight": weights[:-1].T.ravel()}))  # the block's cap a class
    top = R.linear_terms(flat.join(model.terms, "index").select("label", "term", "weight", "index"))
    held = data.where("held = 1").select(c("task_id").alias("row"), "y", "index")
    terms = held.select("row", F.explode("index").alias("term"))  # the rules' terms are the model's own, which the rows have by number
    found = R.apply_rules(terms, top.select("label", c("index").alias("term"), F.lit(1.0).alias("score")), held.select("row"), "E0")
    return found.join(held.select("row", "y"), "row")
