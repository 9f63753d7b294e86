"""Golden tables, edge rules and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from taskweave.operators import evaluate, features, graph, models, panel, scoring, search, splits, tables, text
from taskweave.plans import fixtures
from taskweave.sources import tables as sources
from taskweave.streaming import monitor

SF = "/root/testdata/sf0.001"
GOLDEN = {  # published confusion matrices and the metrics published with them
    "test": ([[3519, 176, 471], [199, 2936, 892], [373, 601, 6243]], 0.8240103828682673, 0.8177878753795227, 0.8231822049705138),
    "validation": ([[2882, 135, 371], [185, 2455, 617], [330, 479, 5157]], 0.8321, 0.8258, 0.8316),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_published_confusions(spark, name):
    table, accuracy, macro, weighted = GOLDEN[name]
    classes = ("E0", "E1", "E23")
    rows = [(classes[i], classes[j], n) for i, r in enumerate(table) for j, n in enumerate(r)]
    found = evaluate.metrics(spark.createDataFrame(rows, "truth string, predicted string, n long")).first()
    near = 1e-12 if name == "test" else 1e-4
    assert abs(found.accuracy - accuracy) < near and abs(found.macro_f1 - macro) < near and abs(found.weighted_f1 - weighted) < near


def test_char_wb_rule(spark):
    row = spark.createDataFrame([("a abcd",)], "t string").select(features.char_wb_ngrams(F.col("t"), 3, 4).alias("x")).first()
    assert row.x == [" a ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd "]


def test_text_of_nulls_and_blanks(spark):
    rows = spark.createDataFrame([(None, "x"), ("  a \n b ", None)], "a string, b string")
    found = rows.select(text.normalize_ws(F.col("a")).alias("n"), text.compose_tagged([("A", F.col("a")), ("B", F.col("b"))]).alias("t")).collect()
    assert [(r.n, r.t) for r in found] == [("", "[B] x"), ("a b", "[A] a b")]


def test_parse_label_shapes(spark):
    raws = ['{"label":"E1"}', "LABEL (E0/E1/E2/E3): **E2**", "E3 - because", "E9", None, "nothing", '{"label":"E7"}']
    found = spark.createDataFrame([(r,) for r in raws], "raw string").select(text.parsed_label(F.col("raw")).alias("l")).collect()
    assert [r.l for r in found] == ["E1", "E2", "E3", None, None, None, None]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(21)} == {0} and {found[k] for k in range(100, 120)} == {100} and len(found) == 41


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_to_one_fails_on_repeats(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string"), spark.createDataFrame([(1, "c")], "k int, y string")
    with pytest.raises(Exception, match="repeated k"):
        tables.one_to_one(left, right, "k").collect()


def test_unknown_label_fails_and_leaks_are_refused(spark):
    with pytest.raises(Exception, match="unknown label E9"):
        sources.mapped_or_fail(spark.createDataFrame([("E9",)], "label string"), "label").collect()
    with pytest.raises(ValueError, match="label"):
        sources.forbid(spark.createDataFrame([("E0",)], "label string"))


def test_group_splits_do_not_leak(spark):
    rows = fixtures.labelled(spark, SF)
    held = rows.join(splits.group_holdout(rows, "jobrole_id", "y"), "jobrole_id")
    assert {r.overlap for r in splits.overlaps(held, "split", {"jobrole_id": "fail"}).collect()} == {0}


def test_review_score_of_a_short_text(spark):
    row = spark.range(1).select(scoring.review_score(F.lit(9.0), F.lit(1.0), F.lit(2)).alias("a"), scoring.review_score(F.lit(0.0), F.lit(1.0), F.lit(9)).alias("b")).first()
    assert (row.a, row.b) == (0.25, 0.5)


def test_bootstrap_brackets_the_mean(spark):
    rows = spark.createDataFrame([("g", float(i % 2)) for i in range(200)], "g string, v double")
    r = panel.bootstrap(rows, ["g"], "v", 100).first()
    assert r.mean == 0.5 and 0.4 < r.low < 0.5 < r.high < 0.6 and r.n == 200


def test_fitted_ordered_logit_ranks_rows(spark):
    import numpy as np

    rows = spark.createDataFrame([(float(i % 30) / 10 - 1.5, int((i % 30) // 10)) for i in range(300)], "x double, y int")
    p = models.descend(rows, ["x"], "y", models.ordered_logit_gradient(3), np.zeros(3), 30)
    cuts = (p[1], p[1] + np.exp(p[2]))
    assert p[0] > 0.5 and [sum(x * p[0] > c for c in cuts) for x in (-1.4, 0.0, 1.4)] == [0, 1, 2]


def test_svm_beats_the_majority(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(float(i % 3), Vectors.dense([1.0 if k == i % 3 else 0.1 for k in range(3)]), 1.0) for i in range(60)]
    data = spark.createDataFrame(rows, ["index", "features", "weight"])
    found = models.predicted(models.one_vs_rest(data, 5.0), data)
    assert found.where("label = element_at(array('E0', 'E1', 'E23'), cast(index as int) + 1)").count() == 60


@pytest.mark.parametrize("name", ["class_mix", "review_rate", "mix_shift"])
def test_stream_equals_batch(spark, tmp_path, name):
    """Windows that the watermark has closed, in append mode, against the batch twin."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    operator = {"class_mix": monitor.class_mix, "review_rate": monitor.review_rate, "mix_shift": lambda log: monitor.mix_shift(log, {"E0": 0.5, "E1": 0.3, "E23": 0.2})}[name]
    stream = operator(fixtures.log_of(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))))
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    batch = {tuple(r) for r in operator(fixtures.log_of(events)).collect()}
    closed = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert closed and closed <= batch


def test_stream_keeps_the_first_success(spark, tmp_path):
    rows = [("a", "success", "2024-01-01 00:00:00"), ("a", "success", "2024-01-01 01:00:00"), ("b", "error", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "call_id string, status string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = monitor.first_success(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.call_id for r in spark.table("firsts").collect()] == ["a"]


def streamed(spark, rows, folder, sink):
    """Rows as a stream in two micro-batches into a ``foreachBatch`` sink, whose last batch is then replayed."""
    first, last = rows
    first.coalesce(1).write.parquet(f"{folder}/in/1")
    last.coalesce(1).write.parquet(f"{folder}/in/2")
    seen = []

    def keep(batch, number):
        sink(batch, number)
        sink(batch, number)  # a replay
        seen.append(number)

    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and len(seen) >= 2


def test_the_first_success_is_the_first_by_time(spark, tmp_path):
    schema = "call_id string, status string, label string, ts timestamp"
    row = lambda call, status, label, hour: (call, status, label, datetime.datetime(2024, 1, 1, hour))
    one = spark.createDataFrame([row("a", "success", "late", 5), row("a", "success", "first", 1), row("b", "error", "x", 0), row("a", "error", "y", 0)], schema)
    two = spark.createDataFrame([row("a", "success", "again", 7), row("b", "success", "second", 9)], schema)
    assert {(r.call_id, r.label) for r in monitor.first_success(one.unionByName(two)).collect()} == {("a", "first"), ("b", "second")}
    streamed(spark, (one, two), tmp_path, monitor.ingest_into(f"{tmp_path}/out"))
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.call_id, r.label) for r in found) == [("a", "first"), ("b", "second")]


def test_scores_and_rejects_of_a_stream_equal_the_batch(spark, tmp_path):
    from taskweave.plans import scoring as plans
    from taskweave.plans import streams

    rows = fixtures.labelled(spark, SF)
    coverage = plans.covered(spark, SF).persist()
    halves = rows.where("task_id % 2 = 0"), rows.where("task_id % 2 = 1")
    streamed(spark, halves, tmp_path, monitor.score_into(f"{tmp_path}/out", streams.request_error(), lambda valid: streams.scored(valid, coverage)))
    found = {(r.task_id, r.review_score) for r in spark.read.parquet(f"{tmp_path}/out/scored").collect()}
    rejects = [r.error for r in spark.read.parquet(f"{tmp_path}/out/rejects").collect()]
    assert found == {tuple(r) for r in streams.st_score(spark, SF).collect()} and len(found) + len(rejects) == rows.count() and set(rejects) <= {"task_too_long", "purpose_too_long", "object_too_long"}


@pytest.mark.parametrize("name", ["quality_sample", "retry_latency"])
def test_samples_and_latencies_of_a_stream(spark, tmp_path, name):
    from taskweave.plans import streams

    log = fixtures.scoring_log(spark, SF) if name == "quality_sample" else streams.timed(spark, SF).select("call_id", "model", "status", "attempt_count", "latency_ms", "ts")
    log.repartition(2).write.parquet(str(tmp_path / "in"))
    operator = (lambda df: monitor.quality_sample(df, "event_id").select("event_id", "stratum")) if name == "quality_sample" else lambda df: monitor.retry_latency(df, "model", exact=False)
    stream = operator(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    found = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in operator(log).collect()}
    assert found == batch if name == "quality_sample" else found and found < batch


def test_stored_calibration_is_near_the_exact_one(spark):
    names = list(scoring.REVIEW)
    values = [(i, *[float((i * p) % 997) for p in (7, 11, 13, 17)]) for i in range(997)]
    rows = spark.createDataFrame(values, "id long, " + ", ".join(f"{n} double" for n in names))
    exact = {r.id: r for r in scoring.review_levels(rows, "id", rows).collect()}
    for r in scoring.review_stored(rows, "id", scoring.review_summary(rows)).collect():
        assert abs(r.review_score - exact[r.id].review_score) <= 2 / scoring.SUMMARY and r.review_reasons == exact[r.id].review_reasons


def test_ids_and_fingerprints_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b")], "x string, y string, z string")
    assert len({r[0] for r in rows.select(text.stable_id([F.col(k) for k in "xyz"])).collect()}) == 3
    one = lambda v: sources.fingerprint(spark.createDataFrame([v], "x string, y string")).first().total
    assert len({one(v) for v in ((None, "a"), ("\\N", "a"), ("", "a"), ("a", None))}) == 4


def test_a_model_with_other_classes_is_refused(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.linalg import Vectors

    model = LogisticRegression(labelCol="y").fit(spark.createDataFrame([(0.0, Vectors.dense([0.0])), (1.0, Vectors.dense([1.0]))], ["y", "features"]))
    sources.save_model(model, str(tmp_path / "m"), ("a", "b"), 1, 2)
    assert sources.load_model(spark, LogisticRegressionModel, str(tmp_path / "m"), ("a", "b"), 1).numFeatures == 1
    for classes, version in ((("b", "a"), 1), (("a", "b"), 2)):
        with pytest.raises(ValueError, match="other classes"):
            sources.load_model(spark, LogisticRegressionModel, str(tmp_path / "m"), classes, version)


def test_answers_by_golden_cases(spark):
    """Either case, bold type, a label on a later line, and JSON as it is."""
    cases = {"label (E0/E1/E2/E3): **e2**": "E2", "Well.\n**E1** because": "E1", "first\nsecond\ne3 - x": "E3", '{"label":"e1"}': None, "E10": None, "so E1": None}
    found = spark.createDataFrame(list(cases.items()), "raw string, want string").select("want", text.parsed_label(F.col("raw")).alias("got"), text.answer_reason(F.col("raw")).alias("reason"), "raw").collect()
    assert all(r.got == r.want and r.reason == r.raw[:500] for r in found)


def test_slugs_have_no_edges(spark):
    rows = spark.createDataFrame([(" Plan. ",), ("é B--c",), ("...",), (None,)], "t string").select(features.slug("A_", F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == ["A_plan", "A_b_c", "A_", "A_"]


def test_review_levels_by_golden_cases(spark):
    """Any reason makes the level high, and only that needs review; a high score alone does too."""
    names = list(scoring.REVIEW)
    reference = spark.createDataFrame([(i, *[float(i)] * 4) for i in range(100)], "id long, " + ", ".join(f"{n} double" for n in names))
    rows = spark.createDataFrame([(1, 50.0, 50.0, 50.0, 50.0), (2, 5.0, 50.0, 50.0, 50.0), (3, 50.0, 1.0, 50.0, 50.0), (4, 15.0, 50.0, 50.0, 50.0)], "id long, " + ", ".join(f"{n} double" for n in names))
    found = {r.id: (r.review_reasons, round(r.review_score, 6), r.review_level, r.needs_review) for r in scoring.review_levels(rows, "id", reference).collect()}
    assert found == {1: ([], 0.49, "low", False), 2: (["low_decision_margin"], 0.94, "high", True), 3: (["low_word_coverage"], 0.98, "high", True), 4: ([], 0.84, "medium", False)}


def test_split_cost_is_relative(spark):
    rows = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 4, "g string, y string")
    where = spark.createDataFrame([("a", "train"), ("b", "test")], "g string, split string")
    cost = splits.split_cost(rows, "g", "y", where, {"train": 0.5, "test": 0.5}).first().cost
    assert abs(cost - (2 * 0.2**2 + 4 * 1.0**2)) < 1e-9


def test_bootstrap_in_blocks_is_a_bootstrap(spark, monkeypatch):
    """Replicate means of many distinct values have the mean and spread that theory gives, in one block and in several."""
    import numpy as np

    x = np.random.default_rng(1).normal(size=400)
    rows = spark.createDataFrame([(float(v),) for v in x], "v double")
    for block in (4096, 50):
        monkeypatch.setattr(panel, "BLOCK", block)
        r = panel.bootstrap(rows, [], "v").first()
        assert abs(r.mean - x.mean()) < 1e-9 and r.n == 400
        for end, z in ((r.low, -1.96), (r.high, 1.96)):
            assert abs(end - (x.mean() + z * x.std() / 20)) < 0.015


def test_offsets_equal_brute_force(spark):
    import itertools

    import numpy as np

    random, classes, grid = np.random.default_rng(2), ("a", "b", "c"), [[0.0], [-0.5, 0.0, 0.5], [-1.0, 1.0]]
    s = np.round(random.normal(size=(60, 3)), 1)
    y = random.choice(list(classes), 60)
    found = {(r.b0, r.b1, r.b2): r.macro_f1 for r in search.offset_grid(spark.createDataFrame([(str(t), *map(float, v)) for t, v in zip(y, s, strict=True)], "y string, s0 double, s1 double, s2 double"), "y", ["s0", "s1", "s2"], classes, grid).collect()}
    for b in itertools.product(*grid):
        called = np.array(classes)[np.round(s + np.array(b), 6).argmax(axis=1)]
        f1 = [2 * ((y == c) & (called == c)).sum() / max(((y == c).sum() + (called == c).sum()), 1) for c in classes]
        assert abs(found[b] - np.mean(f1)) < 1e-12


def test_casefold_is_unicodes(spark):
    from pyspark.sql import functions as F

    cases = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne ﬂow", "İstanbul", "µ-Wave", "ŉ ǰ ΐ", "plain", "", None, "ẞ", "ſo"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    found = [r.y for r in rows.select("i", text.casefold(F.col("x")).alias("y")).orderBy("i").collect()]
    assert found == [None if x is None else x.casefold() for x in cases]


def test_thresholds_equal_brute_force(spark):
    rows = [("abc"[i % 3], (i * 7 % 11) / 10, (i * 5 % 13) / 10) for i in range(40)]
    df = spark.createDataFrame(rows, "y string, s0 double, s1 double")
    points = [0.2, 0.5, 0.9]
    found = {(r.b0, r.b1): r.macro_f1 for r in search.passed_grid(df, "y", ["s0", "s1"], ["a", "b", "c"], [points, points]).collect()}
    for (a, b), value in found.items():
        called = ["abc"[(x >= a) + (z >= b)] for _, x, z in rows]
        each = [2 * sum(r[0] == k == p for r, p in zip(rows, called, strict=True)) / max(1, sum(r[0] == k for r in rows) + called.count(k)) for k in "abc"]
        assert abs(value - sum(each) / 3) < 1e-9
    assert len(found) == 9


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_is_dealt_by_parent_once(spark):
    """Units are shuffled once, by parent; cells are hashed where they lie, and what is shuffled after that are combinations."""
    from taskweave.plans import panel as plans

    wide = plan_of(plans.complete(spark, SF))
    assert wide.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in wide and "SortMergeJoin" not in wide
    assert plan_of(plans.parent_and_children(spark, SF)).count("Exchange hashpartitioning") == 2
    rows = plans.complete(spark, SF)
    assert plans.combined(spark, SF).agg(F.sum("weight")).first()[0] == rows.count()


def test_equal_panels_count_as_often_as_they_come(spark):
    """A row with a weight is as good as that many rows."""
    rows = spark.createDataFrame([(0.0,)] * 30 + [(1.0,)] * 70, "v double")
    whole, weighed = panel.bootstrap(rows, [], "v", 50).first(), panel.bootstrap(rows.groupBy("v").agg(F.count("*").alias("w")), [], "v", 50, weight="w").first()
    assert whole == weighed


def test_unanimous_is_one_pass(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("b", 1, 3), ("b", 2, 4), (None, 1, 6), (None, 2, 5), ("c", None, 7), ("d", None, 9), ("d", 1, 8)], "k string, t int, i int")
    found = tables.unanimous(rows, "k", "t", ["i"])
    assert {tuple(r) for r in found.collect()} == {("a", 1, 1), (None, 2, 5), ("c", None, 7), ("d", 1, 8)} and "Join" not in plan_of(found)


def test_tasks_of_odd_texts(spark):
    """Fields from the first words alone are those of the whole list of words, and labelled rows are picked by the text's start."""
    texts = [None, "", "  ", "a", "a b", " a b c", "a\tb\nc", "a  b\r\nc d e\x0bf\x0cg h  i ", "\t a b", "a b c d e f", "a b c d e f g"]
    documents = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    w = [None if t is None else (" ".join(t.split()).split(" ")) for t in texts]
    rest = lambda x, a: None if x is None else " ".join(x[a:])
    expected = {i: (rest(x and x[:2], 0), rest(x, 2), rest(x and x[2:3], 0), rest(x and x[3:6], 0), rest(x, 6) if i % 5 else None) for i, x in enumerate(w)}
    found = {r.task_id: (r.jobrole_title, r.task, r.action, r.object, r.purpose) for r in fixtures._tasks(documents, labels).collect()}
    assert found == expected
    start = documents.where(F.col("text").rlike(fixtures.THREE)).select("doc_id").collect()
    assert sorted(r[0] for r in start) == [i for i, x in enumerate(w) if x and len(x) > 2]
    scan = plan_of(fixtures.labelled(spark, SF).select("task_id", "task"))
    assert not any("split(" in line for line in scan.splitlines() if "Filter" in line)


def test_answers_are_looked_at_once(spark):
    """Answers in odd shapes; no pattern is computed ahead of the ones before it, or a second time."""
    raw = [None, "", "{", '{"label":"E2"}', '{"label":"E9"}\nE1', ' \n{"label": "E0"} x', "label (e0/e1/e2/e3): ** e3**", "so\n**E1** it is", "E12", '["E0"]', '{"label": null}\nE2']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    found = df.select("i", text.parsed_label(F.col("raw")).alias("label"))
    assert [r.label for r in found.orderBy("i").collect()] == [None, None, None, "E2", None, "E0", "E3", "E1", None, None, "E2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2 and plan.count("get_json_object(") == 1


def test_rules_make_terms_once(spark):
    """Shares of labels come from one pass over the terms, and the best phrases of rows from one."""
    from taskweave.operators import retrieval

    made = spark.range(6).select(F.col("id").alias("row"), F.explode(F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id") % 2))).alias("term"))
    labels = spark.createDataFrame([(i, "ab"[i % 2], i % 2) for i in range(5)], "row long, label string, positive int")
    rules = retrieval.association_rules(made, labels.select("row", "label"), 0.1, 1.0)
    scores = retrieval.phrase_scores(made, labels.select("row", "positive"), made.select("row").distinct())
    assert {(r.label, r.term): r.place for r in rules.collect() if r.term != "all"} == {("a", "t0"): 1, ("b", "t1"): 1}
    assert {tuple(r) for r in scores.collect()} == {(i, 1.0, 2) if i % 2 else (i, 0.4, 5) for i in range(6)}
    assert rules._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6") == 1


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_known_shares_equal_counts_joined_with_their_vocabulary(spark, monkeypatch, held):
    """One pass over the texts, in parts of any size; a row that comes twice is one row, and texts may be empty or null."""
    from taskweave.operators import features as T

    monkeypatch.setattr(T, "HELD_NAMES", held)
    texts = ["aa bb aa", "aa bb cc\tdd", "cc ee", "", None, "aa  abc", "ff ff", "ff gg abc", "aa bb zz"]
    df = spark.createDataFrame([*enumerate(texts), (6, "hh ff")], "id long, text string")
    grams = [(T.Grams("word", 1, 2), F.col("text")), (T.Grams("char_wb", 3, 4), F.col("text"))]
    known = T.known_shares(df, "id", grams, F.expr("id % 2 = 0"))
    assert known._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {r.id: r for r in known.collect()}
    assert set(found) == set(range(len(texts))) and found[3].n_0 == found[4].n_1 == 0
    for k, of in enumerate(grams):
        counts = T.term_counts(df, "id", of)
        want = T.activity(counts, "id", T.vocabulary(counts.where("id % 2 = 0"))).collect()
        assert {r.id: r.known_share for r in want} == {i: r[f"known_{k}"] / r[f"n_{k}"] for i, r in found.items() if r[f"n_{k}"]}


def test_ranks_from_a_stored_summary_count_points(spark):
    """As many points as are at most the value: ties count, and so do values beyond both ends; a missing value has none."""
    from taskweave.operators import scoring as C

    points = [0.0, 0.0, 0.1, 0.5, 0.5, 0.5, 1.0]
    rows = spark.createDataFrame([(points, v) for v in (-1.0, 0.0, 0.05, 0.1, 0.5, 0.9, 1.0, 2.0, None)], "at array<double>, v double")
    assert [r[0] for r in rows.select(C._at_most(F.col("at"), F.col("v"))).collect()] == [0, 2, 2, 3, 6, 6, 7, 7, 0]


def test_panels_are_joined_where_they_lie(spark):
    """Both sides lie by their group, of very different sizes; no row travels once more, groups may be missing, and repeats fail whatever they meet."""
    n = 20_000
    left = spark.range(n).select((F.col("id") % 500).alias("g"), F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 2).alias("x"))
    left = left.withColumn("g", F.when(F.col("g") != 3, F.col("g"))).repartition("g")
    right = spark.range(0, n, 100).select((F.col("id") % 500).alias("g"), F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("y"))
    right = right.unionByName(spark.createDataFrame([(None, "k503", 503), (5, "other", 1), (6, None, 2)], "g long, k string, y long")).repartition("g")
    found = tables.one_to_one(left, right, "k", "g")
    assert found.columns == ["g", "k", "x", "y"] and sorted((r.k, r.x, r.y) for r in found.collect()) == sorted((f"k{i}", 2 * i, i) for i in [*range(0, n, 100), 503])
    open_ = tables.without(left.unionByName(left.where("k = 'k1'")), right, "k", "g")
    assert sorted(r.k for r in open_.collect()) == sorted(["k1", *[f"k{i}" for i in range(n) if i % 100 and i != 503]])
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (tables.one_to_one(left, right, "k", "g"), tables.without(left, right, "k", "g"))]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 2]
    for a, b in ((left.unionByName(left.where("k = 'k1'")), right), (left, right.unionByName(right.where("k = 'other'")))):
        with pytest.raises(Exception, match="repeated k"):
            tables.one_to_one(a.repartition("g"), b.repartition("g"), "k", "g").collect()


def lain(spark, n=2000):
    """Two tables that lie by their group; some keys are missing or come more than once."""
    left = spark.range(n).select((F.col("id") % 50).alias("g"), F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 2).alias("x"))
    right = spark.range(0, n, 10).select((F.col("id") % 50).alias("g"), F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("y"))
    odd = spark.createDataFrame([(0, "k0", -1), (5, "other", 1), (6, None, 2)], "g long, k string, y long")
    return left.unionByName(spark.createDataFrame([(0, "k0", -1), (6, None, 2)], "g long, k string, x long")).repartition("g"), right.unionByName(odd).repartition("g")


def test_matched_calls_are_not_sent_to_all_tasks(spark):
    """The rows of a plain join, repeats times repeats; no side travels again, and none is broadcast, however small it looks (F2)."""
    left, right = lain(spark)
    found = tables.matched(left, right, "k", "g")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right, ["g", "k"]).collect())) and found.where("k = 'k0'").count() == 4


def test_successful_calls_meet_the_manifest_without_a_broadcast(spark):
    from taskweave import catalog

    plan = catalog.queries()["join_success_responses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2


def test_keys_that_either_side_lacks_are_counted_in_one_pass(spark):
    """EXCEPT ALL both ways, repeats and missing keys included, without a shuffle of the keys (F13)."""
    left, right = lain(spark)
    for a, b in ((left, right), (right, left), (left, left)):
        k, m = a.select("k"), b.select("k")
        found = tables.except_counts(a, b, "k", "g")
        assert tuple(found.first()) == (k.exceptAll(m).count(), m.exceptAll(k).count())
    plan = tables.except_counts(left, right, "k", "g")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(k" not in plan
    assert tuple(tables.except_counts(left.where("false"), right.where("false"), "k", "g").first()) == (0, 0)


def test_written_csv_is_compressed_and_reads_back(spark, tmp_path):
    """A panel's file takes less than half of its text (F17); strings with quotes and line breaks come back as they were."""
    from taskweave.sources import tables as sources

    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 20).alias("call_id"), F.col("id").alias("parent"), F.lit('raw, "parent"\nof a panel').alias("grain"))
    sources.write_csv(rows, path := f"file://{tmp_path}/panel")
    back = sources.read_strings(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted((r.call_id, str(r.parent), r.grain) for r in rows.collect())
    assert 0 < sum(p.stat().st_size for p in tmp_path.glob("panel/part-*")) < sum(len(",".join(map(str, r))) + 1 for r in rows.collect()) / 2
