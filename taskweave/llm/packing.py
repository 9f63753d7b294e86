"""Best-fit packing of token sequences.

Lengths are counted over all pieces, which gives a histogram of at most ``capacity`` entries however many documents there are. The
configuration linear program over it (how often to use each multiset of length classes that fits a sequence, so that every class is
covered) is solved by multiplicative weights: a class of n pieces and weight w has the price w / n, a knapsack dynamic program finds the
dearest configuration, and the weights of what it covers fall. Prices over the dearest configuration's price are a dual solution, whose
best value bounds every packing of the classes from below. The fractional counts are rounded down, filled with exact lengths, and the
rest goes by best fit, all on the histogram. Pieces then find their places by their rank among pieces of equal length.

A null text is empty, and an empty document is one piece that holds only the end id. Very long texts are cut into as many pieces as they
need. Rows that repeat a doc_id or have a null one are packed each by itself; pieces of equal length are in the order of doc_id, piece
and checksum. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskweave.llm.tokens import Encoder
from taskweave.llm.words import slices
from taskweave.shared import partitions, written

CAPACITY, END_ID = 4096, 1
CLASSES, SMALL = 256, 4
SALTS = 32
#: How far the weights' steps go, the gap to the dual bound that is near enough, and steps at most.
RATE, GAP, STEPS = 0.02, 0.01, 20_000
SLICE_BYTES = 4 << 20

#: Degrees of rounding: how much of a fractional count is used; the plan with the fewest sequences is taken.
SHARES = (1.0, 0.9, 0.5)

Plan = list[tuple[tuple[int, ...], int]]


# --- tokens ---------------------------------------------------------------------------------------------------------


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        encoder = Encoder.of(path)
        try:
            for batch in slices(batches, "text", SLICE_BYTES):
                docs = batch.column(0)
                row, piece, start, length, crc, body = [], [], [], [], [], []
                for i, found in enumerate(encoder.encode(batch.column(1))):
                    ids = np.append(found.astype("<u4"), np.uint32(end_id))
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a : a + capacity].tobytes()
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            body.append(part)
                columns = [docs.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(body, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
        finally:
            encoder.forget()  # the worker serves other operators next

    return run


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian 32-bit numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(path, capacity, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# --- the plan -------------------------------------------------------------------------------------------------------


def knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """How many of each class the dearest configuration takes; any number of each may be taken."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = int(np.searchsorted(sizes, w, side="right"))
        if fits:
            worth = prices[:fits] + best[w - sizes[:fits]]
            k = int(worth.argmax())
            best[w], choice[w] = worth[k], k
    taken, w = np.zeros(len(sizes), dtype=np.int64), room
    while w > 0 and choice[w] >= 0:
        taken[choice[w]] += 1
        w -= int(sizes[choice[w]])
    return taken


def _completed(used: np.ndarray, covered: np.ndarray, sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[float, np.ndarray, float]:
    """The scale of ``used`` and the further sequences of one class each that cover everything with the least total, and that total."""
    each = room // sizes
    best = (0.0, counts / each, float((counts / each).sum()))
    for q in np.unique(np.quantile(covered[covered > 0], np.linspace(0, 1, 41))) if (covered > 0).any() else ():
        rest = np.maximum(1 - covered / q, 0) * counts / each
        if (total := used.sum() / q + rest.sum()) < best[2]:
            best = (1 / q, rest, float(total))
    return best


def solve(sizes: np.ndarray, counts: np.ndarray, room: int, rate: float = RATE, gap: float = GAP, steps: int = STEPS) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional counts of configurations that cover ``counts`` of ascending ``sizes``, and a lower bound on every cover's total.

    Weights begin at the room that a class takes. Prices only fall, so the price of the last dearest configuration bounds all that come:
    a known configuration is used again while it is within ``gap`` of that, and the knapsack runs when none is.
    """
    configurations, used = np.zeros((len(sizes), 0)), np.zeros(0)
    weights, covered = counts * sizes / (counts * sizes).max(), np.zeros(len(sizes))
    top, bound = np.inf, 0.0
    known: dict[tuple[int, ...], int] = {}
    for step in range(steps):
        prices = weights / counts
        worth = prices @ configurations
        k = int(worth.argmax()) if len(worth) else -1
        if k < 0 or worth[k] < (1 - gap) * top:
            taken = knapsack(prices, sizes, room)
            top = float(prices @ taken)
            bound = max(bound, float(weights.sum()) / top)
            k = known.setdefault(tuple(taken.tolist()), len(known))
            if k == len(used):
                configurations, used = np.concatenate([configurations, taken[:, None]], axis=1), np.append(used, 0.0)
        share = configurations[:, k] / counts
        many = 1 / share.max()  # its scarcest class is covered once
        used[k] += many
        covered += share * many
        weights *= np.exp(-rate * share * many)
        if weights.max() < 1e-200:  # the scale of prices is free
            top /= weights.max()
            weights /= weights.max()
        if step % 200 == 199 and _completed(used, covered, sizes, counts, room)[2] <= (1 + gap) * bound:
            break
    scale, rest, _ = _completed(used, covered, sizes, counts, room)
    out = {taken: float(used[k]) * scale for taken, k in known.items()}
    for i in np.flatnonzero(rest).tolist():
        alone = tuple(int(room // sizes[i]) if j == i else 0 for j in range(len(sizes)))
        out[alone] = out.get(alone, 0.0) + float(rest[i])
    return out, bound


class _Rest:
    """Lengths that are still to be placed, and how many of each."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in histogram.items():
            self.left[length] = n

    def largest(self, most: int, least: int = 1) -> int:
        """The largest length up to ``most``, or 0."""
        found = np.flatnonzero(self.left[least : most + 1]) if most >= least else ()
        return int(found[-1]) + least if len(found) else 0


def _fill(rest: _Rest, taken: tuple[int, ...], tops: np.ndarray, bottoms: np.ndarray, times: int, capacity: int, plan: Plan) -> None:
    """Uses a configuration of classes ``times`` times: exact lengths from each class, the last one as large as fits."""
    slots = [k for k in range(len(taken) - 1, -1, -1) for _ in range(taken[k])]
    while times > 0:
        chosen: list[int] = []
        room = capacity
        for i, k in enumerate(slots):
            last = i == len(slots) - 1
            most = room if last else min(int(tops[k]), room)
            need = 1
            length = rest.largest(most, 1 if last else int(bottoms[k]))
            while length and rest.left[length] < (need := chosen.count(length) + 1):
                length = rest.largest(length - 1, 1 if last else int(bottoms[k]))
            if length:
                chosen.append(length)
                room -= length
        if len(chosen) < len(slots):
            return
        each = {length: chosen.count(length) for length in set(chosen)}
        n = min(times, *(int(rest.left[length]) // c for length, c in each.items()))
        for length, c in each.items():
            rest.left[length] -= c * n
        plan.append((tuple(sorted(chosen, reverse=True)), n))
        times -= n


def best_fit(rest: _Rest, capacity: int, plan: Plan) -> None:
    """Best fit, longest first, for whole counts at a time; sequences of ``plan`` with room take part."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, n in plan:
        open_.setdefault(capacity - sum(lengths), []).append((lengths, n))
    plan.clear()
    for length in range(capacity, 0, -1):
        n = int(rest.left[length])
        room = length
        while n > 0:
            room = next((r for r in range(room, capacity) if open_.get(r)), capacity)
            lengths, many = open_[room].pop() if room < capacity else ((), 1 << 62)
            fit = room // length
            full = min(many, n // fit)
            if full:
                open_.setdefault(room - fit * length, []).append(((*lengths, *[length] * fit), full))
                n -= full * fit
                many -= full
            if 0 < n < fit and many:
                open_.setdefault(room - n * length, []).append(((*lengths, *[length] * n), 1))
                n, many = 0, many - 1
            if room < capacity and many:
                open_[room].append((lengths, many))
        rest.left[length] = 0
    plan += [x for groups in open_.values() for x in groups]


def plan_for(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences as (lengths, number of such sequences); of several ways to round the program, the one with the fewest sequences.

    Lengths are rounded up to classes, and down, where a configuration's exact lengths have to fit anew. Lengths under ``SMALL`` classes,
    which rounding would distort, are kept out of the program and fill what it leaves.
    """
    if not histogram:
        return []
    width = -(-capacity // CLASSES)
    lengths = np.array([x for x in histogram if x >= SMALL * width], dtype=np.int64)
    best: Plan = []
    for up in (width - 1, 0):
        classes, at = np.unique((lengths + up) // width, return_inverse=True)
        counts = np.bincount(at, weights=[histogram[x] for x in lengths.tolist()], minlength=len(classes))
        fractional = solve(classes, counts, capacity // width)[0] if len(classes) else {}
        for share in SHARES:
            rest, plan = _Rest(histogram, capacity), []
            for taken, x in sorted(fractional.items(), key=lambda c: -c[1]):
                _fill(rest, taken, classes * width - up + width - 1, classes * width - up, int(x * share), capacity, plan)
            best_fit(rest, capacity, plan)
            if not best or sum(n for _, n in plan) < sum(n for _, n in best):
                best = plan
    return best


@dataclass
class Places:
    """Of each length, in which sequences its pieces go, by their rank."""

    upto: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]

    @classmethod
    def of(cls, plan: Plan) -> Places:
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        base = 0
        for lengths, n in plan:
            offset = 0
            for length in sorted(set(lengths), reverse=True):
                c = lengths.count(length)
                found.setdefault(length, []).append((base, c, offset, c * n))
                offset += c * length
            base += n
        rows = {k: np.array(v, dtype=np.int64) for k, v in found.items()}
        return cls({k: np.cumsum(v[:, 3]) for k, v in rows.items()}, rows)

    def at(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces of a length."""
        upto, rows = self.upto[length], self.rows[length]
        k = np.searchsorted(upto, rank, side="right")
        base, c, offset, all_ = rows[k].T
        inside = rank - (upto[k] - all_)
        return base + inside // c, offset + inside % c * length


def _place(places_of):
    def run(batches):
        places: Places = places_of.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                at = length == x
                sequence[at], offset[at] = places.at(x, rank[at])
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``tokenize``) with sequence_id and offset. They are written to the shared folder first, without ids."""
    pieces = written(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    salts = max(SALTS, partitions(pieces.sparkSession))  # pieces of one length are ranked in so many tasks
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    places = pieces.sparkSession.sparkContext.broadcast(Places.of(plan_for(histogram, capacity)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(places), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents tokenised, cut and packed: a row for each piece with its place."""
    return pack(tokenize(docs, path, id_col, text_col, capacity, end_id), capacity)


def sequences(docs: DataFrame, placed: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, the ids of its pieces in their order, and where each piece begins."""
    keys = ["doc_id", "piece", "length", "ids_crc32"]
    ids = tokenize(docs, path, capacity=capacity, end_id=end_id, with_ids=True).select(*[F.col(c).alias(f"own_{c}") for c in keys], "ids").dropDuplicates([f"own_{c}" for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in keys]  # rows that repeat an id have equal ids where these agree
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has ``capacity`` ids at most
    joined = placed.join(ids, same[0] & same[1] & same[2] & same[3]).groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.transform("parts", lambda p: p["offset"]).alias("offsets"), F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
