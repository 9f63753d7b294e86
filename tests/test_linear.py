"""Fitted field features and linear models: direct computation, saving, and new sessions."""

import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import ROOT
from taskweave.operators import features, fields, linear
from taskweave.plans import fixtures

SF = "/root/testdata/sf0.001"


def sparse_rows(spark, n=120, width=30, seed=1):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, width)) * (random.random((n, width)) < 0.2)
    x[5] = 0
    y = (x @ random.normal(size=(width, 3)) + 0.3 * random.normal(size=(n, 3))).argmax(axis=1)
    fold = np.arange(n) % 4
    rows = [([int(k) for k in np.flatnonzero(r)], [float(v) for v in r[r != 0]], int(c), int(f), float(c) / 10) for r, c, f in zip(x, y, fold, strict=True)]
    return x, y, fold, spark.createDataFrame(rows, "index array<int>, value array<double>, y int, fold int, target double").repartition(3)


PROBLEMS = [
    linear.Problem(positive=(0,), c=0.5), linear.Problem(positive=(1,), c=2.0, weight=4.0, without=((0, 1),)), linear.Problem(positive=(2,), c=0.2, features=((0, 10), (20, 25))),
    linear.Problem(positive=(1,), c=1.0, loss="logistic", among=(1, 2), free_intercept=True), linear.Problem(c=3.0, loss="square"), linear.Problem(c=3.0, loss="huber", without=((0, 2),)), linear.Problem(c=5.0, loss="insensitive"), linear.Problem(positive=(0, 2), c=1.0, only=((0, 3),)),
]


@pytest.mark.parametrize("cells", [1 << 22, 130])
def test_problems_fitted_together_equal_separate_fits(spark, monkeypatch, cells):
    """Each problem's weights have no slope left in its own objective, written out in numpy, in one group or several."""
    monkeypatch.setattr(linear, "CELLS", cells)
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 300)
    monkeypatch.setattr(linear, "DIRECT", 4 if cells == 130 else 1)
    monkeypatch.setattr(linear, "DENSE", 0 if cells == 130 else 1 << 20)
    monkeypatch.setattr(linear, "AT_ONCE", 40)
    monkeypatch.setattr(linear, "RANGE", 50)
    x, y, fold, rows = sparse_rows(spark)
    found = linear.fit(linear.packed(rows, F.col("y"), F.col("target"), folds=["fold"]), PROBLEMS, x.shape[1], 200, 1e-7)
    wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for p, w in zip(PROBLEMS, found.T, strict=True):
        used = np.array([all(f != v for _, v in p.without) and all(f == v for _, v in p.only) and (p.among is None or c in p.among) for f, c in zip(fold, y, strict=True)])
        sign = np.where(np.isin(y, p.positive), 1.0, -1.0)
        weigh = p.c * used * np.where(np.isin(y, p.positive), p.weight, 1.0)
        z = wide @ w
        if p.loss == "squared_hinge":
            slope = -2 * sign * np.maximum(0, 1 - sign * z)
        elif p.loss == "logistic":
            slope = -sign / (1 + np.exp(sign * z))
        else:
            miss = z - y / 10
            slope = {"square": miss, "huber": np.clip(miss, -linear.HUBER, linear.HUBER), "insensitive": 2 * np.sign(miss) * np.maximum(np.abs(miss) - linear.TUBE, 0)}[p.loss]
        left = wide.T @ (weigh * slope) + w * np.append(np.ones(len(w) - 1), 0.0 if p.free_intercept else 1.0)
        seen = np.array([any(a <= k < b for a, b in p.features) for k in range(len(w) - 1)] + [True])
        assert np.abs(left[seen]).max() < 1e-4 and not w[~seen].any()
    scores = linear.scored(rows.select("index", "value"), found).collect()
    held = sorted(tuple(np.round(wide @ found, 9)[i]) for i in range(len(x)))
    assert np.allclose(held, sorted(tuple(np.round(r.scores, 9)) for r in scores), atol=1e-8)


def small(spark):
    return fixtures.labelled(spark, SF).where("task_id % 4 <> 0"), fixtures.labelled(spark, SF).where("task_id % 4 = 0")


def test_fields_learn_from_training_rows_only(spark):
    """The same vocabulary and weights whatever else is scored; unknown words count for nothing."""
    train = spark.createDataFrame([(1, "The plan is planned", "Chef", "plan", "a menu", None), (2, "the menu", "Chef", "cook", "food", "eat"), (3, "the plan", None, None, None, "")], "task_id long, task string, jobrole_title string, action string, object string, purpose string")
    new = spark.createDataFrame([(9, "the Café plan zebra", "Waiter", "plan", "a menu", "to"), (8, None, None, None, None, None)], train.schema)
    model = fields.FieldFeatures(idCol="task_id").fit(train)
    alone = {r.task_id: (r["index"], r["value"]) for r in model.transform(new.where("task_id = 9")).collect()}
    both = {r.task_id: (r["index"], r["value"]) for r in model.transform(new.unionByName(train)).collect()}
    assert alone[9] == both[9] and both[8][0] == both[3][0][-1:]  # a blank action and object are a term of their own
    word = {r.term: r for r in model.terms.where("block = 0").collect()}
    assert set(word) == {"the", "plan", "the plan"}
    idf = {t: np.log(4 / (1 + n)) + 1 for t, n in {"the": 3, "plan": 2}.items()}
    norm = np.sqrt(sum(v * v for v in idf.values()))
    got = {r.term: r.weight for r in model.weights(new).where("block = 0 and task_id = 9").collect()}
    assert got == pytest.approx({t: v / norm for t, v in idf.items()})


@pytest.mark.parametrize(("kind", "low", "high", "whole"), [("word", 1, 3, features.word_ngrams), ("char", 3, 5, features.char_ngrams), ("char_wb", 2, 4, features.char_wb_ngrams)])
def test_ngrams_counted_in_tasks_equal_exploded_ones(spark, kind, low, high, whole):
    """Without a row for each n-gram; ids that repeat are counted together, as a group-by does."""
    texts = ["a bb ccc bb ccc", "", None, "  Stra\u00dfe\u00a0\u0130x \U0001d54f\U0001d54f\U0001d54f  y ", "ab", "a", "\t\n", "\u03a3\u03b1\u03c2 12_3"]
    rows = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "row long, t string").repartition(3)
    found = features.term_counts(rows, "row", (features.Grams(kind, low, high), F.col("t")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, features.term_counts(rows, "row", whole(F.col("t"), low, high)).collect()))
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_raw_character_ngrams_have_all_sizes_and_no_accents(spark):
    """Three to six characters of the lower-cased text without accents (F18)."""
    from taskweave.operators import text
    from taskweave.plans import features as plans

    def sizes(t):
        t = " ".join(text.without_marks(t.lower()).split())
        return Counter(t[i : i + n] for n in range(3, 7) for i in range(len(t) - n + 1))

    found = {}
    for r in plans.ft_char_ngrams(spark, SF).collect():
        found.setdefault(r.task_id, Counter())[r.term] = r.tf
    texts = [r for r in plans.rows(spark, SF).select("task_id", "task").collect() if len(r.task) > 2]
    assert found == {r.task_id: sizes(r.task) for r in texts} and any(text.without_marks(r.task) != r.task for r in texts)


def test_large_vocabularies_are_joined_to_the_same_features(spark, monkeypatch):
    train, held = small(spark)
    model = fields.FieldFeatures(idCol="task_id").fit(train)
    shown = lambda: {r.task_id: (r["index"], [round(v, 9) for v in r["value"]]) for r in model.transform(held).collect()}
    sent = shown()
    monkeypatch.setattr(fields, "BROADCAST_TERMS", 0)
    assert shown() == sent and sent


SCORE = """
import sys, json
sys.path.insert(0, {root!r}); sys.path.insert(0, {root!r} + '/tests')
from pyspark.sql import SparkSession
from pyspark.ml import PipelineModel
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {folder!r}).getOrCreate()
from taskweave.plans import fixtures
model = PipelineModel.load({path!r})
row = fixtures.labelled(spark, {sf!r}).where('task_id = {task}')
print('SCORES', json.dumps(model.transform(row).first().scores))
"""


def test_saved_model_scores_new_rows_in_a_new_session(spark, tmp_path):
    import json

    train, held = small(spark)
    model = Pipeline(stages=[fields.FieldFeatures(idCol="task_id"), linear.LinearClasses(c=0.2)]).fit(train)
    path = f"file:{tmp_path}/model"
    model.write().overwrite().save(path)
    batch = {r.task_id: r for r in model.transform(held).select("task_id", "scores", "label").collect()}
    again = {r.task_id: r for r in PipelineModel.load(path).transform(held).select("task_id", "scores", "label").collect()}
    one = min(batch)
    alone = PipelineModel.load(path).transform(held.where(F.col("task_id") == one)).first()
    assert len(batch) > 5 and batch.keys() == again.keys() and np.allclose(alone.scores, batch[one].scores, atol=1e-9)
    assert all(np.allclose(batch[k].scores, again[k].scores, atol=1e-9) and batch[k].label == again[k].label for k in batch)
    out = subprocess.run([sys.executable, "-c", SCORE.format(root=str(ROOT), folder=f"file:{tmp_path}/cp", path=path, sf=SF, task=one)], capture_output=True, text=True, timeout=300)
    assert np.allclose(json.loads(out.stdout.split("SCORES", 1)[1]), batch[one].scores, atol=1e-9), out.stderr[-2000:]


def test_singular_values_equal_numpy(spark):
    from taskweave.operators import svd

    x, _, _, rows = sparse_rows(spark, 150, 40, 3)
    values, vectors = svd.truncated(linear.packed(rows, F.col("y")), 40, 10)
    expected = np.linalg.svd(x, compute_uv=False)[:10]
    assert np.allclose(values, expected, rtol=0.01) and np.allclose(vectors.T @ vectors, np.eye(10), atol=1e-8)
    found = np.array([r.svd for r in svd.projected(rows, vectors).collect()])
    assert np.allclose(np.sort((found**2).sum(axis=0))[::-1], expected**2, rtol=0.02)


def test_ordered_model_has_no_slope_left(spark):
    """At the fitted weights and cuts the penalised likelihood, written out by itself, falls to every side."""
    from taskweave.operators import ordered

    random = np.random.default_rng(4)
    x = random.normal(size=(300, 4))
    y = np.digitize(x @ [1.0, -2.0, 0.5, 0.0] + random.logistic(size=300), [-1, 1.5])
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)
    p = ordered.fit(rows, "x", "y", penalty=0.5)

    def likelihood(p):
        below = lambda k: np.ones(len(x)) if k == 2 else np.zeros(len(x)) if k < 0 else 1 / (1 + np.exp(x @ p[:4] - p[4 + k]))
        share = np.choose(y, [below(k) - below(k - 1) for k in range(3)])
        return np.log(share).sum() - 0.25 * (p[:4] ** 2).sum()

    slope = [(likelihood(p + 1e-5 * e) - likelihood(p - 1e-5 * e)) / 2e-5 for e in np.eye(6)]
    assert np.abs(slope).max() < 1e-4 and p[4] < p[5]
    shares = np.array([[r.a, r.b] for r in rows.select(*[v.alias(n) for v, n in zip(ordered.passed(F.col("x"), p), "ab", strict=True)]).collect()])
    assert (shares[:, 0] >= shares[:, 1]).all()


def test_signals_do_not_see_the_rows_own_label(spark):
    """Another label of a row moves the signals of other folds' rows only, and, nested, of none that is scored with its fold."""
    from taskweave.operators import retrieval

    random = np.random.default_rng(5)
    terms = [(i, f"t{int(t)}", float(1 + t % 3)) for i in range(24) for t in random.choice(12, 4, replace=False)]
    weights = spark.createDataFrame(terms, "row long, term string, weight double")

    def signals(label, nested):
        rows = spark.createDataFrame([(i, i % 3 if i < 21 else -1, label if i == 4 else "abc"[i * 7 % 3]) for i in range(24)], "row long, fold int, label string")
        return {(r.row, r["without"] if nested else None): tuple(r)[1 + nested :] for r in retrieval.fold_signals(weights, rows, "abc", 3, nested).collect()}

    one, two = signals("a", False), signals("b", False)
    changed = {i for (i, _) in one if one[i, None] != two[i, None]}
    assert changed and not changed & {i for i in range(21) if i % 3 == 1}
    one, two = signals("a", True), signals("b", True)
    assert {w for (i, w) in one if one[i, w] != two[i, w]} <= {0, 2} and len(one) == 72
    plain = signals("a", False)
    assert all(np.allclose(one[i, i % 3], plain[i, None]) for i in range(21))
    assert all(one[i, 1] == two[i, 1] for i in range(24))


def test_offsets_of_groups_equal_a_search_for_each(spark):
    from taskweave.operators import search

    random = np.random.default_rng(6)
    rows = [(int(i % 3), str(random.choice(list("abc"))), *[float(v) for v in np.round(random.normal(size=3), 2)]) for i in range(240)]
    df = spark.createDataFrame(rows, "g int, y string, s0 double, s1 double, s2 double").repartition(3)
    points = [-0.5, -0.2, 0.2, 0.5]
    found = search.grouped_offsets(df, "g", "y", ["s0", "s1", "s2"], "abc", points)
    for g in range(3):
        assert found[g][1] == search.coordinate_search(df.where(F.col("g") == g), "y", ["s0", "s1", "s2"], "abc", points)


def test_pairs_in_blocks_equal_brute_force(spark, monkeypatch):
    from taskweave.operators import retrieval

    random = np.random.default_rng(7)
    table = {i: {f"t{int(t)}": round(float(random.random()), 2) for t in random.choice(30, 5, replace=False)} for i in range(60)}
    weights = spark.createDataFrame([(i, t, v) for i, d in table.items() for t, v in d.items()], "row long, term string, weight double").repartition(3)
    left, right = weights.where("row < 20"), weights.where("row >= 20")
    near = lambda a, b: sum(v * table[b].get(t, 0) for t, v in table[a].items())
    for entries, products in ((1 << 20, 1 << 22), (60, 50)):
        monkeypatch.setattr(retrieval, "ASK_ENTRIES", entries)
        monkeypatch.setattr(retrieval, "PRODUCTS", products)
        pairs = {(r.row, r.other): r.similarity for r in retrieval.compared(left, right).collect()}
        expected = {(a, b): near(a, b) for a in range(20) for b in range(20, 60) if table[a].keys() & table[b].keys()}
        assert pairs.keys() == expected.keys() and all(abs(pairs[k] - expected[k]) < 1e-12 for k in pairs)
        top = sorted((r.row, r.other) for r in retrieval.compared(left, right, 3).collect())
        assert top == sorted((a, b) for a in range(20) for b in sorted((b for x, b in expected if x == a), key=lambda b: (-round(expected[a, b], 9), b))[:3])  # noqa: B023


def test_all_pairs_are_not_stored(spark, monkeypatch):
    """Pairs are made when they are read: only the lists of both sides are written, and pairs whose sum is 0 are there."""
    from taskweave.operators import retrieval

    weights = spark.createDataFrame([(i, t, v) for i in range(40) for t, v in (("a", 1.0), ("b", 1.0 if i % 2 else -1.0))], "row long, term string, weight double")
    names, write = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: (names.append(name), write(df, name))[1])
    pairs = retrieval.compared(weights.where("row < 10"), weights.where("row >= 10"))
    assert "compared" not in names and {(r.row, r.other): r.similarity for r in pairs.collect()} == {(a, b): 2.0 if a % 2 == b % 2 else 0.0 for a in range(10) for b in range(10, 40)}


def test_common_terms_are_one_matrix(spark, monkeypatch):
    """The same pairs, nearest rows and numbers whichever terms count as common, also of rows that repeat a term."""
    from taskweave.operators import retrieval

    random = np.random.default_rng(9)
    entries = [(i, f"t{int(t)}", float(random.random() + 0.1)) for i in range(80) for t in random.zipf(1.5, 12) % 40]
    weights = spark.createDataFrame(entries, "row long, term string, weight double").repartition(3)
    sides = weights.where("row < 30"), weights.where("row >= 30")
    found = []
    for common, most in ((0.0, 1 << 22), (0.2, 1 << 22), (0.2, 90), (2.0, 1 << 22)):
        monkeypatch.setattr(retrieval, "COMMON", common)
        monkeypatch.setattr(retrieval, "COMMON_ENTRIES", most)
        found.append([sorted((r.row, r.other, round(r.similarity, 9)) for r in retrieval.compared(*sides, k).collect()) for k in (None, 3)])
    assert len(found[0][1]) == 90 and all(f == found[0] for f in found)


def test_fold_signals_hold_a_row_for_each_term(spark, monkeypatch):
    """However many folds there are, no table is longer than the terms of the rows."""
    from taskweave.operators import retrieval

    terms = spark.createDataFrame([(i, f"t{i % 5}", 1.0) for i in range(8)], "row long, term string, weight double")
    rows = spark.createDataFrame([(i, i % 4, "ab"[i % 2]) for i in range(8)], "row long, fold int, label string")
    sizes, write = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: (found := write(df, name), sizes.append(found.count()))[0])
    assert retrieval.fold_signals(terms, rows, "ab", 4, nested=True).count() == 8 * 4 and max(sizes) <= 8


def test_tfidf_counts_texts_once(spark):
    """The same weights as by a join with the vocabulary, from one pass over the texts."""
    rows = fixtures.labelled(spark, SF).select("task_id", "task")
    terms = (features.Grams("word", 1, 2), F.col("task"))
    counts = features.term_counts(rows, "task_id", terms)
    shown = lambda df: sorted((r.task_id, r.term, round(r.weight, 9)) for r in df.collect())
    found = features.tfidf_of(rows, "task_id", terms)
    assert shown(found) == shown(features.tfidf(counts, "task_id", features.vocabulary(counts), rows.agg(F.count("*").alias("n"))))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_numbers_of_features_in_place_of_values(spark):
    import numpy as np
    from taskweave.operators import linear

    rows = spark.createDataFrame([(1, [2, 0], [0.5, 0.5]), (2, [], []), (3, [1], [9.0])], "id int, index array<int>, value array<double>").coalesce(1)
    found = linear.valued(rows, np.array([0.1, -2.0, 3.0]))
    assert {r.id: list(r.value) for r in found.collect()} == {1: [3.0, 0.1], 2: [], 3: [-2.0]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # rows stay where they are


def test_words_that_come_again_are_counted_alike(monkeypatch):
    from collections import Counter

    from taskweave.operators import features

    monkeypatch.setattr(features, "HELD_WORDS", 2)
    g = features.Grams("char_wb", 2, 5)
    count = g.counter()
    for text in ("ab abc ab  abcdef", "", "ab x", "abc ab q ab"):
        assert list(count(text).items()) == list(Counter(g.of(text)).items())


@pytest.mark.parametrize(("most", "least"), [(1000, 1), (12, 1), (12, 2), (40, 3), (1, 1)])
def test_vocabularies_by_levels_equal_counts_of_all_terms(spark, monkeypatch, most, least):
    """Also with ties at the cap, small parts, and rows without words; n-grams of rare words are never made (F24)."""
    from taskweave.operators import coded

    monkeypatch.setattr(coded, "HELD_WORDS", 5)
    monkeypatch.setattr(coded, "WORDS_AT_ONCE", 30)
    random = np.random.default_rng(3)
    words = np.array(["aa", "bb", "été", "dd", "e", "ff", "gg", "hh", "ii_1", "jj"])
    rows = [(i, " ".join(random.choice(words, random.integers(0, 14), p=np.arange(10, 0, -1) / 55)), random.choice(["Chef", "The Chef", None, ""])) for i in range(60)]
    df = spark.createDataFrame([(*map(lambda x: x if x is None or isinstance(x, int) else str(x), r),) for r in rows], "task_id long, task string, jobrole_title string").repartition(3)
    blocks = [fields.Block("word", "task", "word", 1, 3, least, most, 1.0), fields.Block("title", "jobrole_title", "word", 1, 2, 1, most, 0.5)]
    stored = fields.texts(df, "task_id", blocks, ["jobrole_title"])
    old, new = fields.FieldFeatures(idCol="task_id", blocks=blocks).fit(df.where("task_id % 4 <> 0")), fields.FieldFeatures(idCol="task_id", blocks=blocks).fit_texts(stored.where("task_id % 4 <> 0"))
    assert sorted(map(tuple, old.terms.collect())) == sorted(map(tuple, new.terms.collect())) and old.sizes == new.sizes
    shown = lambda found: {r.task_id: (r.jobrole_title, r["index"], [round(v, 9) for v in r["value"]]) for r in found.collect()}
    assert shown(old.transform(df).drop("task")) == shown(new.vectors(stored))
    monkeypatch.setattr(coded, "SENT_WORDS", 0)  # counted as strings
    again = fields.FieldFeatures(idCol="task_id", blocks=blocks).fit_texts(stored.where("task_id % 4 <> 0"))
    assert sorted(map(tuple, old.terms.collect())) == sorted(map(tuple, again.terms.collect()))


def test_texts_are_made_once_for_fit_and_rows(spark, monkeypatch):
    """What a model of words is fitted on and applied to is stored once, and no n-gram is a string in a shuffle (F24)."""
    from taskweave.plans import models

    made, laid = [], fixtures.labelled
    monkeypatch.setattr(models.V, "labelled", lambda *a: made.append("rows") or laid(*a))
    monkeypatch.setattr(fields, "_frequencies", lambda grams: made.append("strings"))
    monkeypatch.setattr(fields, "laid", lambda *a: made.append("texts"))
    models.featured(spark, SF, [models.WORD3, models.TITLED])
    assert made == ["rows"]


def test_marks_are_taken_off_character_by_character():
    """As of the whole text's decomposition, in time that does not depend on how many marks there are (F24, F26)."""
    import unicodedata

    from taskweave.operators import text

    whole = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    random = np.random.default_rng(5)
    ranges = [(32, 127), (160, 1536), (768, 880), (0x1100, 0x1200), (0xAC00, 0xD7A4), (0xF900, 0xFFFE), (0x1D400, 0x1D7FF)]
    texts = ["".join(chr(random.integers(*ranges[k])) for k in random.integers(0, len(ranges), size)) for size in random.integers(0, 150, 400)]
    assert [text.without_marks(s) for s in texts] == [whole(s) for s in texts]
    assert text.without_marks("é́ṩ ﬁ ½ 각") == whole("é́ṩ ﬁ ½ 각") and not hasattr(text, "MARKS")


def test_rules_of_a_model_are_found_in_its_stored_rows(spark, monkeypatch):
    """Held-out texts are not cut into words again, and labels are those of the words themselves (F26)."""
    from taskweave.operators import retrieval
    from taskweave.plans import models

    seen, linear_terms = [], retrieval.linear_terms
    monkeypatch.setattr(features, "counted", lambda *a: pytest.fail("texts are counted again"))
    monkeypatch.setattr(retrieval, "linear_terms", lambda w: seen.append(linear_terms(w)) or seen[-1])
    found = {r.row: r.label for r in models.ru_linear_terms(spark, SF).collect()}
    rules = [(r.label, r.term) for r in seen[0].collect()]
    plain = features.Grams("word").prepared(fields.T.strip_accents(F.col("task")))
    for r in small(spark)[1].select("task_id", plain.alias("t")).collect():
        sums = {k: sum(term in r.t.split() for label, term in rules if label == k) for k in models.CLASSES}
        assert found.pop(r.task_id) == (min(sums, key=lambda k: (-sums[k], k)) if any(sums.values()) else "E0")
    assert not found and len(rules) == 75


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_centroids_shuffle_counts_once(spark, monkeypatch, sent):
    """Lengths sent or joined: the similarities of joined weights, none for a class that shares no term, and in the plan one kind of exchange of counts (F33)."""
    from taskweave.operators import retrieval

    monkeypatch.setattr(retrieval, "SENT_ROWS", sent)
    texts = ["aa bb cc", "aa bb", "cc dd dd", "dd ee", "aa ee ee", "zz", "cc aa", "ff gg", "ff", "gg", None]
    rows = spark.createDataFrame([(i, t, ["E0", "E1"][i % 2]) for i, t in enumerate(texts)], "row long, t string, label string").withColumn("asked", F.col("row") % 3 == 0)
    rows = rows.withColumn("label", F.when(F.col("t").contains("g"), "E23").otherwise(F.col("label"))).repartition(3)
    terms = (features.Grams("word", 1, 2), F.col("t"))
    weights = features.tfidf_of(rows, "row", terms).join(rows.select("row", "asked"), "row")
    joined = retrieval.centroid_similarity(weights.where("asked"), weights.where("not asked"), rows.select("row", "label"))
    plans, stored = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    found = retrieval.tfidf_centroids(features.term_counts(rows, "row", terms), rows.select("row", "label", "asked"), ["E0", "E1", "E23"])
    expected = {(r.row, r.label): r.similarity for r in joined.collect()}
    assert {(r.row, r.label): r.similarity for r in found.collect()} == pytest.approx(expected) and 0 < len(expected) < 12
    if sent:  # twice in the plan, and the same, so it is made once
        assert plans[0].count("Exchange hashpartitioning(term") == 2 and "Exchange hashpartitioning(label" not in plans[0]


@pytest.mark.parametrize(("most", "least"), [(1000, 1), (15, 1), (15, 2), (60, 3), (1, 2)])
def test_character_vocabularies_by_words_equal_counts_of_all_terms(spark, monkeypatch, most, least):
    """Ranked by the counts of words, with ties at the cap and terms that are often in few rows; equal to counts of n-grams as strings, which are never made (F5)."""
    from taskweave.operators import coded

    monkeypatch.setattr(coded, "HELD_WORDS", 5)
    monkeypatch.setattr(coded, "WORDS_AT_ONCE", 30)
    monkeypatch.setattr(coded, "KEPT_WORDS", 3)
    random = np.random.default_rng(4)
    words = np.array(["abc", "bcd", "été", "a", "ab-cd", "xxxxxx", "ab", "cabcab", "\U0001d54fy", "z."])
    texts = ["  ".join(random.choice(words, random.integers(0, 14), p=np.arange(10, 0, -1) / 55)) for _ in range(60)] + [None, "", "qqqqqqqqq"]
    df = spark.createDataFrame([(i, t if t is None else str(t), ["cook", None, "Bake"][i % 3], "a Menu") for i, t in enumerate(texts)], "task_id long, task string, action string, object string").repartition(3)
    blocks = [fields.Block("char", "task", "char_wb", 2, 4, least, most, 0.65), fields.Block("raw", "task", "char", 3, 5, least, most, 0.45), fields.Block("word", "task", "word", 1, 2, least, most, 1.0), fields.Block("slug", "action", "slug", 1, 1, 1, most, 0.7)]
    strings, counted = [], fields._frequencies
    monkeypatch.setattr(fields, "_frequencies", lambda grams: strings.append(grams.analyser) or counted(grams))
    train = df.where("task_id % 4 <> 0")
    new = fields.FieldFeatures(idCol="task_id", blocks=blocks).fit(train)
    assert strings == ["char"]
    monkeypatch.setattr(coded, "SENT_WORDS", 0)
    old = fields.FieldFeatures(idCol="task_id", blocks=blocks).fit(train)
    assert sorted(map(tuple, old.terms.collect())) == sorted(map(tuple, new.terms.collect())) and old.sizes == new.sizes and "char_wb" in strings
    flat = {(r.task_id, r.block, r.term): r.weight for r in new.weights(df).collect()}
    monkeypatch.setattr(fields, "BROADCAST_TERMS", 0)  # counted as strings and joined
    assert {(r.task_id, r.block, r.term): r.weight for r in new.weights(df).collect()} == pytest.approx(flat) and flat


def test_machines_are_fitted_on_stored_features(spark, monkeypatch):
    """The features of the rows that a model is fitted on are made once, not for each step of the fit (F5)."""
    made, weighed = spark.sparkContext.accumulator(0), fields._weighed

    def counted(sent, blocks, kept):
        run = weighed(sent, blocks, kept)

        def with_count(batches):
            for rows, parts in run(batches):
                made.add(len(rows))
                yield rows, parts

        return with_count

    monkeypatch.setattr(fields, "_weighed", counted)
    train, _ = small(spark)
    Pipeline(stages=[fields.FieldFeatures(idCol="task_id"), linear.LinearClasses(c=0.2)]).fit(train)
    assert made.value == train.count()


def test_rows_of_one_file_are_packed_for_all_cores(spark, monkeypatch):
    """Blocks of rows that lie in one part are read by as many tasks as there are cores, none of them empty, and by no more (F8)."""
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 40)
    rows = sparse_rows(spark, 400)[3].coalesce(1)
    blocks = linear.packed(rows, F.col("y"))
    cores = spark.sparkContext.defaultParallelism
    sizes = blocks.groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()
    assert linear.tasks_of(blocks) == len(sizes) == cores and sum(r[1] for r in sizes) == 400 and max(r[1] for r in sizes) < 2 * 400 / cores


def test_signals_of_other_folds_are_added_up_exactly(spark):
    """A weight of the row's own fold so large that taking it off a total would leave nothing of the others' (F8)."""
    from taskweave.operators import retrieval

    weights = [(0, "t", 1e17), (1, "t", 0.1), (2, "t", 0.2), (0, "u", 1.0), (1, "u", 0.3), (2, "u", 0.4)]
    rows = spark.createDataFrame([(0, 0, "a"), (1, 1, "a"), (2, 2, "b")], "row long, fold int, label string")
    found = {r.row: r for r in retrieval.fold_signals(spark.createDataFrame(weights, "row long, term string, weight double"), rows, "ab", 3).collect()}
    assert found[0].near_0 == pytest.approx((1e17 * 0.1 + 0.3) / np.hypot(0.1, 0.3)) and found[0].near_1 == pytest.approx((1e17 * 0.2 + 0.4) / np.hypot(0.2, 0.4))
