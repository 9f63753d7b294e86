"""Approximate nearest neighbours by cosine: an inverted file whose lists hold the vectors themselves.

Vectors are scaled to length 1. The number of lists grows with the square root of the rows, up to ``MOST_LISTS``. Coarse centroids are
fitted on ``PER_LIST`` vectors for each list, picked by a hash of their ids; every vector is indexed. Lists are laid into blocks of about
``BLOCK_ROWS`` vectors, several short lists in one block, a long list in several. A query probes the lists nearest to it and travels once
to each block that holds one of them; a block keeps its ``RANKED`` best of the query by inner products in double precision, so vectors
that lie close together are told apart. The best of all are ranked again by the cosine of the original vectors. Equal vectors are searched
as one, which stands for its smallest ids, so copies take no places from each other and ties go to the smaller vec_id.

The data's structure decides how many lists have to be probed: ``MEASURED`` of the queries are compared with all rows, and as many lists
are probed as hold the share ``COVERED`` of their nearest neighbours. A query that finds fewer than ``k`` in its lists is searched in all
lists. Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take no part, as
queries or as candidates; nor do rows with a null id. Components so large or small that their squares leave the range of doubles are
scaled by the largest first. Of rows that repeat an id the first in the order of their bytes counts. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskweave.shared import written

FEWEST_LISTS, MOST_LISTS, PER_LIST = 16, 1024, 32
COVERED, MEASURED = 0.97, 512
RANKED = 32
BLOCK_ROWS, BLOCK_QUERIES = 16384, 4096
#: Products that a task holds at once, and components of a block's rows or queries.
CELLS, COMPONENTS = 1 << 22, 1 << 21


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centers**2).sum(axis=1) - 2 * x[i : i + 4096] @ centers.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def centers_of(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; at most as many centers as rows."""
    found = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, found)
        count = np.bincount(at, minlength=len(found))
        total = np.stack([np.bincount(at, weights=x[:, d], minlength=len(found)) for d in range(x.shape[1])], axis=1)
        found[count > 0] = (total[count > 0] / count[count > 0, None]).astype(x.dtype)
    return found


def lists_by_nearness(x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """For each vector the lists, nearest first."""
    return np.argsort((lists**2).sum(axis=1) - 2 * x @ lists.T, axis=1, kind="stable")


def _packed(x: np.ndarray) -> bytes:
    """A vector in single precision where that loses nothing."""
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _units(batches):
    for batch in batches:
        ids, widths, rows = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and i is not None else np.zeros(0)
            if len(x) and np.isfinite(x).all() and x.any():
                ids.append(i)
                widths.append(len(x))
                rows.append(_packed(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "width", "vector"])


def _exact(column, width: int) -> np.ndarray:
    """The original vectors; those whose squares overflow or vanish are scaled by the largest component."""
    x = np.stack([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * width else np.float64).astype(np.float64) for v in column])
    with np.errstate(over="ignore", under="ignore"):
        square = (x * x).sum(axis=1)
    odd = ~np.isfinite(square) | (square < np.finfo(np.float64).tiny / np.finfo(np.float64).eps)
    x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
    return x


def _unit(column, width: int) -> np.ndarray:
    x = _exact(column, width)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, width: int) -> np.ndarray:
    return _unit(column, width).astype(np.float32)


@dataclass
class Layout:
    """Where each list lies: the first of its blocks, and how many it has. A block holds short lists together or a part of a long one."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, rows: int | None = None) -> Layout:
        rows = BLOCK_ROWS if rows is None else rows
        first, parts = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // rows))
        free, held = 0, 0  # the open block, and its rows
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > rows:
                free, held = free + 1, 0
            first[i] = free
            if parts[i] > 1:
                free, held = free + int(parts[i]), 0
            else:
                held += n
        return cls(first, parts)

    def blocks(self, lists: np.ndarray) -> dict[int, list[int]]:
        """The blocks that hold these lists, and which of the lists each holds."""
        found: dict[int, list[int]] = {}
        for i in lists.tolist():
            for b in range(int(self.first[i]), int(self.first[i] + self.parts[i])):
                found.setdefault(b, []).append(i)
        return found


def _listed(lists_of, width: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = nearest(_matrix(batch.column(1).to_pylist(), width), lists_of.value)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1)], names=["list", "vec_id", "vector"])

    return run


def _near_lists(asked_of, width: int, k: int):
    """Of each measured query the lists of a task's ``k`` nearest vectors other than its own."""

    def run(batches):
        asked = asked_of.value
        x, own = _unit(asked, width), {}
        for i, v in enumerate(asked):
            own.setdefault(v, []).append(i)
        near, at = np.zeros((len(x), 0)), np.zeros((len(x), 0), dtype=np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, step := max(1, CELLS // len(x))):
                lists, column = batch.column(0).slice(a, step).to_numpy(), batch.column(1).slice(a, step).to_pylist()
                some = x @ _unit(column, width).T
                for j, v in enumerate(column):
                    if v in own:
                        some[own[v], j] = -np.inf
                near, at = np.hstack([near, some]), np.hstack([at, np.repeat(lists[None, :], len(x), axis=0)])
                if near.shape[1] > k:
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    near, at = np.take_along_axis(near, best, axis=1), np.take_along_axis(at, best, axis=1)
        query, place = np.nonzero(near > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(at[query, place], pa.int32()), pa.array(near[query, place])], names=["query", "list", "near"])

    return run


def probes_for(asked: DataFrame, listed: DataFrame, lists: np.ndarray, width: int, k: int) -> int:
    """How many lists hold ``COVERED`` of the ``k`` nearest others of ``MEASURED`` queries, among all rows."""
    some = [bytes(r.vector) for r in asked.orderBy(F.xxhash64(F.lit("measured"), "vec_id"), "vec_id").limit(MEASURED).collect()]
    if not some:
        return 1
    sent = listed.sparkSession.sparkContext.broadcast(some)
    near = listed.select("list", "vector").mapInArrow(_near_lists(sent, width, k), "query int, list int, near double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "list"))).where(F.col("r") <= k)
    rows = best.select("query", "list").collect()  # at most MEASURED * k
    if not rows:
        return len(lists)
    place = np.argsort(lists_by_nearness(_matrix(some, width), lists), axis=1)  # of each list in the query's order
    return int(np.quantile([place[r.query, r.list] for r in rows], COVERED, method="higher")) + 1


def _probe(lists_of, layout_of, width: int, probes: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1).to_pylist(), width)
                to = [layout_of.value.blocks(lists) for lists in lists_by_nearness(x, lists_of.value)[:, :probes]]
                row = pa.array(np.repeat(np.arange(len(x)), [len(t) for t in to]))
                block, lists = [b for t in to for b in t], [np.array(v, dtype=np.int32).tobytes() for t in to for v in t.values()]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column(0).take(row), batch.column(1).take(row), pa.array(lists, pa.binary())], names=["block", "query_id", "vector", "lists"])

    return run


def _search(width: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(queries) and len(rows):
            rows = rows.sort_values(["list", "vec_id"])
            ids, held = rows["vec_id"].to_numpy(), _unit(rows["vector"], width)
            lists, edges = np.unique(rows["list"].to_numpy(), return_index=True)
            edges = np.append(edges, len(ids))
            own, x = queries["query_id"].to_numpy(), _unit(queries["vector"], width)
            probed = np.stack([np.isin(lists, np.frombuffer(v, dtype=np.int32)) for v in queries["lists"]])
            by_id = np.argsort(ids, kind="stable")
            step = max(1, CELLS // len(ids))
            for i in range(0, len(own), step):
                near = np.full((len(own[i : i + step]), len(ids)), -np.inf)
                for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    here = np.flatnonzero(probed[i : i + step, j])
                    near[here, a:b] = x[i : i + step][here] @ held[a:b].T
                near = np.round(near[:, by_id], 14)  # what differs by rounding alone is a tie, and goes to the smaller id
                keep = min(RANKED + 1, len(ids))  # one may be the query alone
                least = np.partition(near, len(ids) - keep, axis=1)[:, len(ids) - keep, None]
                above, tied = near > least, (near == least) & (near > -np.inf)
                at, one = np.nonzero(above | tied & (np.cumsum(tied, axis=1) <= keep - above.sum(axis=1, keepdims=True)))
                found.append((own[i + at], ids[by_id][one], near[at, one]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "near"), zip(*found, strict=True), strict=True)})

    return run


def _cosines(width: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _exact(batch.column(2).to_pylist(), width), _exact(batch.column(3).to_pylist(), width)
            score = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["query_id", "of", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): of the rows that ``is_query`` picks, the ``k`` nearest other rows that are found.

    ``probes`` lists are probed for each query; where it is not given, as many as the sample asks for.
    """
    context = vectors.sparkSession.sparkContext
    units = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_units, "vec_id long, width int, vector binary")
    units = units.groupBy("vec_id").agg(F.min_by(F.struct("width", "vector"), F.struct("width", "vector")).alias("x")).select("vec_id", "x.width", "x.vector")
    units = written(units, "units")
    widths = units.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths[0].width
    units = units.where(F.col("width") == width).select("vec_id", "vector")
    same = Window.partitionBy("vector")
    first_ids = units.withColumn("n", F.row_number().over(same.orderBy("vec_id"))).where(F.col("n") <= k + 1)  # a query may be one of them
    copies = written(first_ids.withColumn("of", F.min("vec_id").over(same)), "copies")
    distinct, members = copies.where("n = 1").select("vec_id", "vector"), copies.select("of", F.col("vec_id").alias("member"))
    n_lists = int(np.clip(2 ** round(np.log2(distinct.count()) / 2), FEWEST_LISTS, MOST_LISTS))
    sample = _matrix([r.vector for r in distinct.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(n_lists * PER_LIST).collect()], width)  # at most MOST_LISTS * PER_LIST
    fitted = centers_of(sample, n_lists)
    lists = context.broadcast(fitted)
    listed = written(distinct.mapInArrow(_listed(lists, width), "list int, vec_id long, vector binary"), "lists")
    asked = units.where(is_query)
    probes = probes_for(asked, listed, fitted, width, k) if probes is None else probes
    sizes = np.zeros(len(fitted), dtype=np.int64)
    for r in listed.groupBy("list").count().collect():  # a row for each list
        sizes[r.list] = r["count"]
    layout = Layout.of(sizes, max(1, min(BLOCK_ROWS, COMPONENTS // width)))
    placed = context.broadcast(layout)
    place = vectors.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(zip(layout.first.tolist(), layout.parts.tolist(), strict=True))], "list int, first int, parts int")

    def found(asked: DataFrame, probes: int) -> DataFrame:
        n_parts = asked.count() // max(1, min(BLOCK_QUERIES, COMPONENTS // width)) + 1
        queries = asked.mapInArrow(_probe(lists, placed, width, probes), "block int, query_id long, vector binary, lists binary").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int"))
        block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
        rows = listed.join(F.broadcast(place), "list").select("list", "vec_id", "vector", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
        keys = ["block", "part"]
        near = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_search(width), "query_id long, vec_id long, near double")
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
        likely = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= RANKED + 1).select("query_id", "vec_id")
        pairs = likely.join(distinct.select("vec_id", F.col("vector").alias("b")), "vec_id").join(units.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("a")), "query_id")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        scored = pairs.select("query_id", "vec_id", "a", "b").mapInArrow(_cosines(width), "query_id long, of long, score double")
        every = scored.join(members, "of").where("member <> query_id").select("query_id", F.col("member").alias("vec_id"), "score")
        return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = written(found(asked, probes), "neighbours")
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(asked.join(full, "vec_id", "left_anti"), "short")
    if probes >= len(fitted) or not short.limit(1).count():
        return first
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(found(short, len(fitted)))


def op9(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
