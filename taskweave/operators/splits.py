"""Folds, splits, samples and leak checks. All randomness is the MD5 of a seed and a key, so it doesn't depend on partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskweave.shared import partitions, written

#: Groups that one task searches at once.
BLOCK = 4096


def draw(seed: str, key: Column | str) -> Column:
    """A fixed random text for a key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def ranked(df: DataFrame, by: list[str], order: Column, name: str = "rank") -> DataFrame:
    """Zero-based ranks within ``by``, in the order of a hex text: by its first two digits, then inside those, so that no task gets a whole group."""
    df = df.withColumn("_order", order).withColumn("_head", F.substring("_order", 1, 2))
    counts = df.groupBy(*by, "_head").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_head")) - F.col("_n")).drop("_n")
    w = Window.partitionBy(*by, "_head").orderBy("_order")
    return df.withColumn("_own", F.row_number().over(w) - 1).join(before, [*by, "_head"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_order", "_head", "_own", "_before")


def group_sizes(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, size, dominant): rows of each group and its commonest class (ties: the lowest)."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("size"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("dominant"))


def serpentine(i: Column, k: int) -> Column:
    """0..k-1, k-1..0, 0..k-1, ..."""
    return F.when(F.floor(i / k) % 2 == 0, i % k).otherwise(k - 1 - i % k).cast("int")


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42, within: list[str] | None = None) -> DataFrame:
    """(group, size, dominant, fold): groups dealt to folds like a snake, largest first, within their dominant class."""
    sizes = df if "dominant" in df.columns else group_sizes(df, group, label)
    w = Window.partitionBy(*(within or []), "dominant").orderBy(F.desc("size"), draw(str(seed), group))
    return sizes.withColumn("i", F.row_number().over(w) - 1).withColumn("fold", serpentine(F.col("i"), k)).drop("i")


def group_holdout(df: DataFrame, group: str, label: str, seed: int = 42) -> DataFrame:
    """(group, split): 70 / 15 / 15 % of the groups of each dominant class, by 20 serpentine slots."""
    slots = group_folds(df, group, label, 20, seed)
    return slots.select(group, F.when(F.col("fold") < 14, "train").when(F.col("fold") < 17, "validation").otherwise("test").alias("split"))


def split_cost(df: DataFrame, group: str, label: str, splits: DataFrame, target: dict[str, float]) -> DataFrame:
    """(cost): squared relative differences of each split's rows from its share of all rows, and of its rows of each class from its share of the class."""
    rows = df.join(splits, group)
    each = rows.groupBy("split", label).agg(F.count("*").alias("n"))
    wanted = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
    grid = rows.groupBy(label).agg(F.count("*").alias("t")).select(label, "t", F.explode(wanted).alias("split", "want"))  # classes by splits
    cells = grid.join(each, ["split", label], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("goal", F.col("want") * F.col("t"))
    miss = lambda n, goal: F.pow((n - goal) / F.greatest(goal, F.lit(1.0)), 2)
    by_split = cells.groupBy("split").agg(F.sum(miss(F.col("n"), F.col("goal"))).alias("class_cost"), F.sum("n").alias("n"), F.sum("goal").alias("goal"))
    return by_split.agg(F.sum(F.col("class_cost") + miss(F.col("n"), F.col("goal"))).alias("cost"))


def row_folds(df: DataFrame, row: str, label: str, k: int = 5, seed: int = 7) -> DataFrame:
    """Rows with a fold, stratified by label, without groups."""
    return ranked(df, [label], draw(str(seed), row), "_i").withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i")


def nested_folds(df: DataFrame, group: str, label: str, k: int = 5, inner: int = 4, seed: int = 42) -> DataFrame:
    """(outer, group, inner): for each outer fold the inner folds of all groups outside it."""
    outer = group_folds(df, group, label, k, seed)
    apart = outer.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("outer <> fold").drop("fold")
    return group_folds(apart, group, label, inner, seed + 1, within=["outer"]).select("outer", group, F.col("fold").alias("inner"))


def component_holdout(rows: DataFrame, component: str, label: str, share: float = 0.2) -> DataFrame:
    """(component, split): whole components up to a share of the rows of each dominant class; larger ones stay in train."""
    sizes = group_sizes(rows, component, label)
    total = sizes.withColumn("_total", F.sum("size").over(Window.partitionBy("dominant")))
    fits = F.col("size") <= share * F.col("_total")
    w = Window.partitionBy("dominant").orderBy(F.desc("size"), component).rowsBetween(Window.unboundedPreceding, 0)
    running = total.withColumn("_run", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(w))
    return running.select(component, F.when(fits & (F.col("_run") <= share * F.col("_total")), "test").otherwise("train").alias("split"))


def placed(counts: np.ndarray, goals: np.ndarray, start: np.ndarray, rng: np.random.Generator, most: float = np.inf, kick: float = 0.0, mixed: bool = False, bound: np.ndarray | None = None, shakes: int = 20) -> tuple[float, np.ndarray]:
    """(cost, split by group): a greedy start, then the best single move again and again until none lowers the cost.

    ``counts`` has a row for each group (all its rows, then those of each class), ``goals`` one for each split; a split whose goals are
    NaN is free and costs nothing. ``start`` has a split for each group, or -1 where the greedy pass has to choose, groups of many
    classes and many rows first, ties by ``rng``, or all in an order by ``rng`` if ``mixed``. No move takes a split with goals above
    ``most`` times its rows; ``kick`` is the chance that the greedy pass puts a group into the first split in any case. Groups that are
    ``bound`` stay where they start. At the end three groups are moved at random and the search goes on from there, ``shakes`` times;
    what costs no less is taken back.
    """
    goal, weight = np.nan_to_num(goals), np.where(np.isnan(goals), 0.0, 1 / np.maximum(np.nan_to_num(goals), 1.0) ** 2)
    limit = np.where(np.isnan(goals[:, 0]), np.inf, most * goal[:, 0])
    bound = np.zeros(len(counts), dtype=bool) if bound is None else bound
    rows, classes = np.arange(len(counts)), counts[:, 1:]

    def filled(at: np.ndarray) -> np.ndarray:
        return np.stack([counts[at == s].sum(axis=0) for s in range(len(goals))])

    def descended(at: np.ndarray) -> tuple[float, np.ndarray]:
        full = filled(at)
        while len(counts):
            entering = np.stack([(counts * (2 * (f - g) + counts) * w).sum(axis=1) for f, g, w in zip(full, goal, weight, strict=True)], axis=1)
            gain = entering + (counts * (counts - 2 * (full - goal)[at]) * weight[at]).sum(axis=1)[:, None]
            gain[full[None, :, 0] + counts[:, :1] > limit] = np.inf
            gain[rows, at] = gain[bound] = np.inf
            i, s = divmod(int(gain.argmin()), len(goals))
            if gain[i, s] >= -1e-9:
                break
            full[at[i]] -= counts[i]
            full[s] += counts[i]
            at[i] = s
        return float((weight * (full - goal) ** 2).sum()), at

    at = start.copy()
    full = filled(at)
    order = rng.permutation(len(counts)) if mixed else np.lexsort((rng.random(len(counts)), -counts[:, 0], -classes.max(axis=1, initial=0), -(classes > 0).sum(axis=1)))
    for i in order[at[order] < 0].tolist():
        dearer = (counts[i] * (2 * (full - goal) + counts[i]) * weight).sum(axis=1)
        dearer[full[:, 0] + counts[i, 0] > limit] = np.inf
        s = 0 if kick and rng.random() < kick and dearer[0] < np.inf else int(dearer.argmin())
        at[i], full[s] = s, full[s] + counts[i]
    best, at = descended(at)
    free = np.flatnonzero(~bound)
    for _ in range(shakes if len(free) else 0):
        trial = at.copy()
        trial[rng.choice(free, min(3, len(free)), replace=False)] = rng.integers(len(goals), size=min(3, len(free)))
        if (filled(trial)[:, 0] <= limit).all():
            cost, trial = descended(trial)
            if cost < best - 1e-9:
                best, at = cost, trial
    return best, at


def _searcher(shares: list[float | None], restarts: int, turns: int, seed: int, most: float, kick: float, allowed: float | None):
    """Searches a block of groups, restarts ``turn``, ``turn + turns``, ... of it; the first starts from ``start``, every second one places groups in a random order."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block, turn = map(int, key)
        group = group.sort_values("key", kind="stable")
        counts = np.array(group["counts"].tolist(), dtype=np.float64).reshape(len(group), -1)
        filled = np.array(group["filled"].iloc[0], dtype=np.float64).reshape(len(shares), -1)
        total = counts.sum(axis=0) + filled.sum(axis=0)
        goals = np.array([np.full(len(total), np.nan) if p is None else np.maximum(p * total - f, 0) for p, f in zip(shares, filled, strict=True)])
        given, free = group["start"].to_numpy(dtype=np.int64), next((s for s, p in enumerate(shares) if p is None), None)
        fixed = np.full(len(group), -1)
        if allowed is not None:
            fixed[counts[:, 0] > allowed] = free
        found = []
        for r in range(turn, restarts, turns):
            start = fixed if r else np.where(fixed < 0, given, fixed)
            found.append((*placed(counts, goals, start, np.random.default_rng([seed, block, r]), most, kick if r else 0.0, r % 2 == 1, fixed >= 0), r))
        cost, at, r = min(found, key=lambda x: (round(x[0], 12), x[2]))
        return pd.DataFrame({"block": [block], "cost": [cost], "restart": [r], "keys": [group["key"].tolist()], "at": [at.tolist()]})

    return run


def searched(rows: DataFrame, group: str, label: str, shares: dict[str, float | None], start: DataFrame, restarts: int = 25, seed: int = 42, most: float = float("inf"), kick: float = 0.0, largest: float | None = None, block: int = BLOCK) -> DataFrame:
    """(group, split) by restarted local search over the table of groups by classes; whole groups stay together.

    ``shares`` names each split's share of the rows and of each class, None for one split that takes what is left and costs nothing.
    ``start`` is a known (group, split), which the first restart improves. ``largest``: groups with a larger share of all rows stay in the
    free split. The other arguments are those of ``placed``.

    Up to ``block`` groups are one search, whose restarts are dealt to tasks. Beyond that, groups with more than one ``block``-th of all
    rows, so fewer than ``block``, are placed first; the others are dealt to blocks by a hash, and each block is searched for its part of
    what the large ones left open, so no task sees more than a block. A split's miss over all blocks is at most the sum of theirs.
    A class is counted as its rows; rows with a null label count among all rows alone, and a null group is left out, as in ``start``'s
    join. An empty table gives no rows. Classes and splits are few.
    """
    names, free = list(shares), [s for s, p in shares.items() if p is None]
    if len(free) > 1 or (largest is not None and not free):
        raise ValueError("one split at most is free, and a largest share needs one")
    spark = rows.sparkSession
    classes = sorted((r[0] for r in rows.select(label).distinct().collect() if r[0] is not None), key=str)  # a row for each class
    base = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("key")).agg(F.array(F.count("*"), *[F.count_if(F.col(label) == c) for c in classes]).alias("counts"))
    place = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])
    table = written(base.join(start.select(F.col(group).alias("key"), place[F.col("split")].alias("start")), "key"), "groups")
    n, total = table.agg(F.count("*"), F.sum(F.col("counts")[0])).first()
    none = np.zeros((len(names), 1 + len(classes)))
    allowed = None if largest is None else largest * (total or 0)

    def blocks(some: DataFrame, n_blocks: int, number: Column, filled: Column) -> DataFrame:
        turns = max(1, min(restarts, partitions(spark) // n_blocks))
        run = _searcher(list(shares.values()), restarts, turns, seed, most, kick, allowed)
        dealt = some.withColumn("block", number).withColumn("filled", filled).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        key_type = table.schema["key"].dataType.simpleString()
        tried = dealt.groupBy("block", "turn").applyInPandas(run, f"block long, cost double, restart int, keys array<{key_type}>, at array<int>")
        won = tried.groupBy("block").agg(F.min_by(F.struct("keys", "at"), F.struct(F.round("cost", 12), F.col("restart"))).alias("w"))
        return won.select(F.explode(F.arrays_zip("w.keys", "w.at")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.at").alias("at"))

    flat = lambda a: F.array(*[F.lit(float(x)) for x in a.ravel()])
    if n <= block:
        found = blocks(table, 1, F.lit(0).cast("long"), flat(none))
    else:
        heavy = F.col("counts")[0] * block > total
        first = written(blocks(table.where(heavy), 1, F.lit(0).cast("long"), flat(none)), "large")
        light, n_blocks = table.where(~heavy), -(-n // block)
        sums = lambda t: [F.sum(F.col("counts")[k]).cast("double") for k in range(1 + len(classes))]
        taken = none.copy()
        for r in table.join(first, "key").groupBy("at").agg(F.array(*sums(0)).alias("c")).collect():  # a row for each split
            taken[r["at"]] = r["c"]
        left = np.array([x or 0.0 for x in light.agg(F.array(*sums(0))).first()[0]])
        numbered = light.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n_blocks)))
        own = numbered.groupBy("_b").agg(F.array(*[s / F.lit(max(x, 1.0)) for s, x in zip(sums(0), left, strict=True)]).alias("_part"))
        part = F.array(*[F.lit(float(taken[s, k])) * F.col("_part")[k] for s in range(len(names)) for k in range(taken.shape[1])])
        found = first.unionByName(blocks(numbered.join(own, "_b"), n_blocks, F.col("_b"), part))
    return found.select(F.col("key").alias(group), F.array(*[F.lit(s) for s in names])[F.col("at")].alias("split"))


def best_of(rows: DataFrame, group: str, label: str, candidates: list[DataFrame], target: dict[str, float]) -> tuple[DataFrame, list[float]]:
    """The (group, split) with the least ``split_cost``, the first of equals, and all their costs (one number each)."""
    costs = [s.first().cost for s in (split_cost(rows, group, label, c, target) for c in candidates)]
    costs = [float("inf") if c is None else c for c in costs]
    return candidates[min(range(len(costs)), key=lambda i: (round(costs[i], 12), i))], costs


def overlaps(rows: DataFrame, split: str, columns: dict[str, str]) -> DataFrame:
    """(check, severity, left_split, right_split, overlap): shared values of each column between each two splits. ``columns``: name -> severity."""
    value = lambda c: F.unhex(F.md5(F.col(c).cast("string")))  # noqa: E731  (texts of any length meet by their digests)
    every = rows.select(split, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), value(c))])).alias("check", "value")).where("value is not null").distinct()
    left = every.withColumnRenamed(split, "left_split")
    both = left.join(every.withColumnRenamed(split, "right_split"), ["check", "value"]).where("left_split < right_split").groupBy("check", "left_split", "right_split").agg(F.count("*").alias("n"))
    names = rows.select(split).distinct()
    pairs = names.withColumnRenamed(split, "left_split").crossJoin(names.withColumnRenamed(split, "right_split")).where("left_split < right_split")  # a few splits
    wanted = pairs.withColumn("check", F.explode(F.array(*[F.lit(c) for c in columns])))
    severity = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])[F.col("check")]
    return wanted.join(both, ["check", "left_split", "right_split"], "left").select("check", severity.alias("severity"), "left_split", "right_split", F.coalesce("n", F.lit(0)).alias("overlap"))


def simple_random(df: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    return df.orderBy(draw(seed, key), key).limit(n)


def quotas(counts: DataFrame, name: str, n: Column | int, within: list[str] | None = None) -> DataFrame:
    """Largest-remainder shares of ``n`` by the column ``n_rows``, as ``quota``."""
    w = Window.partitionBy(*(within or [F.lit(1)]))
    exact = F.col("_want") * F.col("n_rows") / F.sum("n_rows").over(w)
    out = counts.withColumn("_want", n if isinstance(n, Column) else F.lit(n)).withColumn("_exact", F.round(exact, 9)).withColumn("_floor", F.floor("_exact"))
    out = out.withColumn("_left", F.col("_want") - F.sum("_floor").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), name)))
    return out.withColumn("quota", (F.col("_floor") + (F.col("_r") <= F.col("_left")).cast("int")).cast("int")).drop("_want", "_exact", "_floor", "_left", "_r")


def stratified(df: DataFrame, key: str, label: str, sector: str, role: str, wanted: dict[str, int], cap: int = 3, seed: str = "panel") -> DataFrame:
    """Quotas by label, shared over sectors; at most ``cap`` rows a role; what a sector lacks is filled from the label's other rows."""
    order = [draw(seed, key), key]
    able = df.withColumn("_c", F.row_number().over(Window.partitionBy(role).orderBy(*order))).where(F.col("_c") <= cap).drop("_c")
    want = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[F.col(label)]
    counts = quotas(able.groupBy(label, sector).agg(F.count("*").alias("n_rows")), sector, want, [label])
    inside = able.join(counts, [label, sector]).withColumn("_q", F.row_number().over(Window.partitionBy(label, sector).orderBy(*order)) <= F.col("quota"))
    chosen = ranked(inside, [label], F.concat(F.when(F.col("_q"), "0").otherwise("1"), draw(seed, key)), "_r")
    return chosen.where(F.col("_r") < want).select(df.columns)


def oversampled(df: DataFrame, key: str, label: str, n: int, classes, seed: str = "draw") -> DataFrame:
    """``n`` draws with replacement, classes in turn, rows of a class alike: (draw, key, label)."""
    rows = ranked(df, [label], draw(seed, key), "_i").select(key, label, "_i")
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    turn = F.element_at(F.array(*[F.lit(c) for c in classes]), (F.col("draw") % len(classes) + 1).cast("int"))
    number = F.conv(F.substring(draw(seed, "draw"), 1, 8), 16, 10).cast("long")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn(label, turn).join(F.broadcast(sizes), label).withColumn("_i", number % F.col("_n"))
    return draws.join(rows, [label, "_i"]).select("draw", key, label)
