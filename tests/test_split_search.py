"""Restarted split search and gates class by class, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskweave.operators import search as Q
from taskweave.operators import splits as S

SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def cost(rows, at, shares):
    """Squared relative differences of rows and of each class, over splits with a share."""
    classes = sorted({y for _, y in rows if y is not None})
    total = np.array([len(rows), *[sum(y == c for _, y in rows) for c in classes]], dtype=float)
    out = 0.0
    for s, p in shares.items():
        if p is not None:
            inside = [y for g, y in rows if at[g] == s]
            found, goal = np.array([len(inside), *[sum(y == c for y in inside) for c in classes]]), p * total
            out += (((found - goal) / np.maximum(goal, 1)) ** 2).sum()
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, y string")


def made(n, seed, most=9):
    rng = np.random.default_rng(seed)
    return [(f"g{i}", "abc"[rng.choice(3, p=[0.6, 0.3, 0.1])]) for i in range(n) for _ in range(rng.integers(1, most))]


def dealt(df):
    return df.select("g").distinct().select("g", F.lit("train").alias("split"))


@pytest.mark.parametrize("seed", [1, 2])
def test_search_reaches_the_least_cost(spark, seed):
    rows = made(8, seed)
    groups = sorted({g for g, _ in rows})
    df = table(spark, rows)
    found = {r.g: r.split for r in S.searched(df, "g", "y", SHARES, dealt(df)).collect()}
    least = min(cost(rows, dict(zip(groups, c, strict=True)), SHARES) for c in itertools.product(SHARES, repeat=len(groups)))
    assert found.keys() == set(groups) and cost(rows, found, SHARES) <= 1.05 * least + 1e-9


def test_search_of_a_free_split(spark):
    """A group above the share stays in the free split; the other's rows stay under their limit; the least cost of all selections."""
    rows = [*made(9, 3, 6), *[("big", "ab"[i % 2]) for i in range(30)]]
    df, shares = table(spark, rows), {"test": 0.2, "train": None}
    groups = sorted({g for g, _ in rows} - {"big"})
    found = {r.g: r.split for r in S.searched(df, "g", "y", shares, dealt(df), restarts=100, most=1.1, kick=0.015, largest=0.2).collect()}
    choices = [{"big": "train"} | dict(zip(groups, c, strict=True)) for c in itertools.product(shares, repeat=len(groups))]
    able = [c for c in choices if sum(c[g] == "test" for g, _ in rows) <= 1.1 * 0.2 * len(rows)]
    assert found["big"] == "train" and sum(found[g] == "test" for g, _ in rows) <= 0.22 * len(rows)
    assert cost(rows, found, shares) <= 1.05 * min(cost(rows, c, shares) for c in able) + 1e-9


def test_blocks_and_a_hot_group(spark):
    """Blocks of 16 groups, one group with a third of all rows: every group once, near the best that the hot group leaves, the same on reruns."""
    rows = made(100, 4)
    rows += [("hot", "abc"[i % 3]) for i in range(len(rows) // 2)]
    df = table(spark, rows)
    found = S.searched(df, "g", "y", SHARES, dealt(df), restarts=4, block=16)
    at = {r.g: r.split for r in found.collect()}
    again = {r.g: r.split for r in S.searched(df.repartition(7), "g", "y", SHARES, dealt(df), restarts=4, block=16).collect()}
    assert at == again and at.keys() == {g for g, _ in rows} and cost(rows, at, SHARES) < 0.5


def test_start_is_never_made_worse(spark):
    rows = made(60, 5)
    df = table(spark, rows)
    start = S.group_holdout(df, "g", "y")
    before = {r.g: r.split for r in start.collect()}
    after = {r.g: r.split for r in S.searched(df, "g", "y", SHARES, start, restarts=1).collect()}
    assert cost(rows, after, SHARES) <= cost(rows, before, SHARES) + 1e-9


def test_odd_rows(spark):
    """Nothing from an empty table; a null group is left out, a null label counts among all rows; columns of the operator's own names do not clash."""
    empty = table(spark, [])
    assert S.searched(empty, "g", "y", SHARES, dealt(empty)).count() == 0
    df = table(spark, [(None, "a"), ("x", None), ("x", "a"), ("y", "b"), ("z", None)]).withColumns({c: F.lit("?") for c in ("key", "counts", "block", "split", "start")})
    start = df.where("g is not null").select("g").distinct().select("g", F.lit("test").alias("split"))
    assert {r.g for r in S.searched(df, "g", "y", SHARES, start).collect()} == {"x", "y", "z"}


def test_gates_class_by_class(spark):
    rng = np.random.default_rng(6)
    rows = [("abc"[rng.integers(3)], "abc"[rng.integers(3)], *map(float, rng.normal(size=3).round(3))) for _ in range(300)] + [("a", None, None, 0.3, None)]
    df = spark.createDataFrame(rows, "y string, p string, s0 double, s1 double, s2 double")
    points, scores = [round(-2 + 0.25 * k, 2) for k in range(17)], {"b": "s1", "c": "s2", "a": "s0"}

    def macro(calls):
        one = lambda c: 2 * sum(r[0] == c == p for r, p in zip(rows, calls, strict=True)) / max(1, sum(r[0] == c for r in rows) + calls.count(c))
        return sum(map(one, "abc")) / 3

    calls, expected = [r[1] for r in rows], []
    for name, column in scores.items():
        k = 2 + int(column[1])
        trials = [(t, [name if r[k] is not None and r[k] >= t else p for r, p in zip(rows, calls, strict=True)]) for t in points]
        t, trial = max(trials, key=lambda x: (round(macro(x[1]), 9), -x[0]))
        before = macro(calls)
        if macro(trial) > before + 1e-9:
            calls = trial
        else:
            t = None
        expected.append((name, t, before, macro(calls)))
    found = Q.class_gates(df, "y", "p", scores, points, "abc")
    assert [g[:2] for g in found] == [g[:2] for g in expected] and np.allclose([g[2:] for g in found], [g[2:] for g in expected])
    assert any(t is not None for _, t, *_ in found)
    assert [r[0] for r in df.select(Q.gated_call(F.col("p"), scores, found)).collect()] == calls
    assert all(t is None for _, t, *_ in Q.class_gates(df.limit(0), "y", "p", scores, points, "abc"))
