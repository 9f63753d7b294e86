"""Every query of the library's own operators against its DuckDB SQL, or for rows where SQL cannot express it."""

import numpy as np
import pytest

from compare import assert_same, connection
from taskweave import catalog
from taskweave.plans import panel

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Fits over the smallest table can lack a class; these run on the next one.
LARGER = "/root/testdata/sf0.01"
HELD_OUT = [
    "ml_svc_ovr", "ml_refit_full", "src_model", "ml_svc_specialists", "ml_char_word_svc", "ml_logreg", "ml_teacher_aided", "ml_nbsvm", "ml_hierarchical", "ml_ordinal_threshold_fit", "ml_ordinal_svm_fit",
    "ml_ridge_score", "ml_huber_score", "ml_svr_score", "ml_platt", "ml_oof_stack", "ml_oof_enriched", "ml_ridge_classifier",
]
#: Tested below, each in a way of its own.
OTHERS = {"ml_ordered_logit", "ml_trees", "ml_dense_probe", "ft_svd", "ru_linear_terms", "pa_bootstrap_ci", "pa_paired_delta", "pa_representation_ci", "split_group_holdout_search", "split_component_holdout_search"}


def test_every_query_has_a_test():
    assert set(QUERIES) == set(ORACLES) | set(HELD_OUT) | OTHERS


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize(("name", "plain", "old"), [("split_group_holdout_search", "split_group_holdout", "serpentine_cost"), ("split_component_holdout_search", "split_component_holdout", "running_sum_cost")])
def test_searched_splits_cost_no_more(spark, name, plain, old):
    rows, known = QUERIES[name](spark, SF).collect(), QUERIES[plain](spark, SF).collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in known) and {r.split for r in rows} <= {"train", "validation", "test"}
    assert all(r.cost <= r[old] for r in rows) and len({r.cost for r in rows}) == 1


def macro(rows):
    """(macro F1, that of a model that always names the commonest class)."""
    truth, called = [r.y for r in rows], [r.label for r in rows]
    f1 = lambda called, k: 2 * sum(t == k == p for t, p in zip(truth, called, strict=True)) / max(1, truth.count(k) + called.count(k))
    classes = sorted(set(truth))
    common = [max(classes, key=truth.count)] * len(truth)
    return sum(f1(called, k) for k in classes) / len(classes), sum(f1(common, k) for k in classes) / len(classes)


def test_trees_on_held_out_rows(spark):
    by = {}
    for r in QUERIES["ml_trees"](spark, LARGER).collect():
        by.setdefault(r.model, []).append(r)
    found = {k: macro(rows) for k, rows in by.items()}
    assert set(found) == {"decision_tree", "random_forest", "extra_trees", "boosted"} and max(a - b for a, b in found.values()) > 0


def test_ordered_shares_rise_with_the_class(spark):
    """Held-out rows of impacted classes get a larger share of them; shares add up to 1."""
    rows = QUERIES["ml_ordered_logit"](spark, LARGER).collect()
    mean = lambda keep: np.mean([1 - r.p_E0 for r in rows if keep(r.y)])
    assert all(abs(r.p_E0 + r.p_E1 + r.p_E23 - 1) < 1e-9 for r in rows) and mean(lambda y: y != "E0") > mean(lambda y: y == "E0")


def test_the_probe_is_picked_on_validation_rows(spark):
    rows = QUERIES["ml_dense_probe"](spark, LARGER).collect()
    known = {r.model: r.macro_f1 for r in rows if r.split == "validation"}
    assert {(r.model, r.split) for r in rows} == {(m, s) for m in ("ridge", "logistic", "svc") for s in ("validation", "test")}
    assert [r.model for r in rows if r.best] == [max(sorted(known), key=known.get)]


def test_places_on_singular_vectors(spark):
    """Squares of all places add up to less than the rows', whose blocks have lengths 1 and 0.5, and the first dimension holds the most."""
    x = np.array([r.svd for r in QUERIES["ft_svd"](spark, SF).collect()])
    held = (x**2).sum(axis=0)
    assert x.shape[1] > 20 and held.sum() <= 1.25 * len(x) + 1e-6 and held[0] == held.max()


def test_linear_terms_name_classes_of_held_out_rows(spark):
    rows = QUERIES["ru_linear_terms"](spark, SF).collect()
    assert rows and all(r.row % 4 == 0 and r.label in ("E0", "E1", "E23") for r in rows) and len({r.row for r in rows}) == len(rows)


VALUES = panel.LONG + " SELECT grain, condition, outcome, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM vals GROUP BY ALL"
PAIRS = panel.WIDE + ", d AS (" + " UNION ALL ".join(f"SELECT grain, '{n}' AS contrast, {a} AS l, {b} AS r FROM complete" for n, a, b in panel.CONTRASTS) + "), v AS (" + " UNION ALL ".join(f"SELECT grain, contrast, '{o}' AS outcome, 100 * (({e.format('l')})::INT - ({e.format('r')})::INT) AS v FROM d" for o, e in {"E0": "{0} = 'E0'", "E1": "{0} = 'E1'", "E2": "{0} = 'E2'", "E3": "{0} = 'E3'", "E23": "{0} IN ('E2', 'E3')", "impacted": "{0} <> 'E0'"}.items()) + ") SELECT grain, contrast, outcome, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM v GROUP BY ALL"
CHILDREN = panel.KIDS + " SELECT condition, outcome, avg(100 * (child_rate - value)) AS m, stddev_pop(100 * (child_rate - value)) AS s, count(*) AS n FROM own JOIN kids USING (parent, condition, outcome) GROUP BY ALL"


@pytest.mark.parametrize(("name", "sql", "keys"), [("pa_bootstrap_ci", VALUES, 3), ("pa_paired_delta", PAIRS, 3), ("pa_representation_ci", CHILDREN, 2)])
def test_means_equal_sql_and_intervals_have_the_width_of_theory(spark, duck, name, sql, keys):
    found = QUERIES[name](spark, SF)
    expected = {tuple(r[:keys]): r[keys:] for r in duck.execute(sql).fetchall()}
    names = [c for c in ("grain", "condition", "contrast", "outcome") if c in found.columns]
    rows = {tuple(r[n] for n in names): r for r in found.collect()}
    assert rows.keys() == expected.keys()
    for k, (mean, spread, n) in expected.items():
        r, half = rows[k], 1.96 * spread / n**0.5
        assert abs(r.mean - mean) < 1e-5 and r.n == n and r.low <= r.mean <= r.high and abs((r.high - r.low) / 2 - half) <= 0.15 * half + 2 * abs(mean) / n + 1e-6


@pytest.mark.parametrize("name", HELD_OUT)
def test_held_out_rows_beat_the_majority(spark, name):
    rows = QUERIES[name](spark, LARGER).select("y", "label").collect()
    found, common = macro(rows)
    assert found > common
