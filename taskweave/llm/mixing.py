"""Mixing sources to target weights: words in blocks of one length, drawn shard by shard.

Of each source the words of all documents, in an order by hash, are cut into blocks of ``BLOCK`` words; its last block may be shorter. A
source's target is its share by weight of all words to take, at most ``most`` times its words, the excess being shared again by weight among
the others. Each output shard draws how many of its slots go to each source from a multinomial distribution over what the sources' targets
still ask for, and never more than that. A source's slots are numbered through the shards, and slot k holds the block at place k modulo the
number of blocks of the source's own pseudorandom permutation, so no block comes a second time before all have come once. The slot in which
a source reaches its target is cut there. Slots and blocks meet in a join by source and block.

Counts of words a source and the shards' draws (``SHARDS`` of them at most) go through the driver: a row for each source, and one for each
shard and source. Documents' places are sums within buckets and running sums of the buckets, so a hot source is no hot task.

A null text has no words and, like an empty one, is taken 0 times. A null source is a source of its own, last in order. Null ids and rows
that repeat each get a row. All draws come from hashes and a fixed seed: the same rows give the same mix, whatever their partitions. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskweave.llm.words import mix as scrambled
from taskweave.shared import partitions, written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
#: Slots of an output shard, and the most shards there are; beyond them shards grow.
SHARD_SLOTS, SHARDS = 1 << 16, 4096
BUCKET_DOCS = 1 << 14
PIECE_SLOTS = 1 << 18
#: Sources that are broadcast; a table of more is joined in a shuffle.
FEW_SOURCES = 1 << 16
SEED = 20240501
ROUNDS = 6


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what that cuts off is shared again."""
    out, left, open_ = [0.0] * len(sizes), float(total), list(range(len(sizes)))
    while open_:
        of = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / of > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / of
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, i: int, mask: np.uint64) -> np.ndarray:
    return scrambled(x ^ np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % (1 << 64))) & mask


def permuted(at: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1, or its inverse: a Feistel network walked until it is below n."""
    half = np.uint64(_half(n))
    mask = np.uint64((1 << int(half)) - 1)
    x = at.astype(np.uint64)
    out, todo = np.empty(len(x), dtype=np.int64), np.arange(len(x))
    while len(todo):
        a, b = x >> half, x & mask
        for i in range(ROUNDS):
            if back:
                a, b = b ^ _round(a, key, ROUNDS - 1 - i, mask), a
            else:
                a, b = b, a ^ _round(b, key, i, mask)
        x = (a << half) | b
        done = x < n
        out[todo[done]] = x[done].astype(np.int64)
        x, todo = x[~done], todo[~done]
    return out


@dataclass
class Source:
    """A source's number, words, target, blocks, slots, and the words of its last slot."""

    number: int
    size: int
    target: float
    block: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def tail(self) -> int:
        """Words of the last block."""
        return self.size - (self.blocks - 1) * self.block

    def filled(self, slots: int, tail_at: int) -> int:
        """Words of the first slots, where the last block is at place ``tail_at`` of each turn."""
        turns, rest = divmod(slots, self.blocks)
        return slots * self.block - (self.block - self.tail) * (turns + (rest > tail_at))

    def slots(self) -> tuple[int, int]:
        """How many slots reach the target's whole words, and the words of the last one."""
        words = round(self.target)
        if not words or not self.size:
            return 0, 0
        tail_at = int(permuted(np.array([self.blocks - 1]), self.blocks, SEED + self.number, back=True)[0])
        n = words // self.block
        while (lacking := words - self.filled(n, tail_at)) > 0:
            n += max(1, lacking // self.block)
        return n, words - self.filled(n - 1, tail_at)


def draws(slots: np.ndarray, per_shard: int, seed: int = SEED):
    """Each shard's slots by source: multinomial over what is left of all slots, and never more than is left."""
    left, random = slots.astype(np.int64).copy(), np.random.Generator(np.random.Philox(seed))
    while left.sum():
        drawn, n = np.zeros(len(left), dtype=np.int64), int(min(per_shard, left.sum()))
        if n == left.sum():
            drawn, left, n = left.copy(), np.zeros_like(left), 0
        while n:
            some = np.minimum(random.multinomial(n, left / left.sum()), left)
            drawn, left, n = drawn + some, left - some, n - int(some.sum())
        yield drawn


def _slots(batches):
    """Plan pieces (shard, source, first, n, blocks, block, tail, last, last_words) as slots: the block of each and the words taken of it."""
    names = ["shard", "source_no", "slot", "block", "words"]
    for batch in batches:
        for p in batch.to_pylist():
            for a in range(p["first"], p["first"] + p["n"], 1 << 16):
                k = np.arange(a, min(a + (1 << 16), p["first"] + p["n"]))
                block = permuted(k % p["blocks"], p["blocks"], SEED + p["source_no"])
                words = np.where(block == p["blocks"] - 1, p["tail"], p["block"])
                words = np.where(k == p["last"], np.minimum(words, p["last_words"]), words)
                same = [np.full(len(k), p[c]) for c in ("shard", "source_no")]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (*same, k, block, words)], names=names)


@dataclass
class Mixture:
    """The words of documents (``docs``: row, key, doc_id, source, size, source_no), sources, and who holds which words in which slot.

    ``spans``: (row, shard, source_no, slot, begin, end), words begin to end of a document in a slot, numbered within the document.
    """

    docs: DataFrame
    sources: DataFrame
    spans: DataFrame


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mixture:
    """``weights`` go to the sources in the order of their code points, again and again; ``share`` of all words is taken."""
    spark = docs.sparkSession
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), text).alias("key"))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    counted = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    counted.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in counted]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    sources = [Source(i, s, t, block) for i, (s, t) in enumerate(zip(sizes, goals, strict=True))]
    named = spark.createDataFrame([(r.source, s.number, s.size, s.target) for r, s in zip(counted, sources, strict=True)], "source string, source_no int, source_size long, target double")
    table = F.broadcast(named) if len(sources) <= FEW_SOURCES else named
    ends = [s.slots() for s in sources]
    slots = np.array([n for n, _ in ends], dtype=np.int64)
    per_shard = max(SHARD_SLOTS, -(-int(slots.sum()) // SHARDS))
    first, plan = np.zeros_like(slots), []
    for shard, drawn in enumerate(draws(slots, per_shard)):
        plan += [(shard, i, int(first[i]), int(drawn[i]), sources[i].blocks, block, sources[i].tail, ends[i][0] - 1, ends[i][1]) for i in np.flatnonzero(drawn).tolist()]
        first += drawn
    schema = "shard int, source_no int, first long, n long, blocks long, block long, tail long, last long, last_words long"
    begun = spark.createDataFrame(plan, schema).select("*", (F.col("first") + F.col("n")).alias("stop"))
    pieces = begun.select(*[c for c in begun.columns if c != "first"], F.explode(F.sequence("first", F.col("stop") - 1, F.lit(PIECE_SLOTS).cast("long"))).alias("first"))
    pieces = pieces.withColumn("n", F.least(F.lit(PIECE_SLOTS).cast("long"), F.col("stop") - F.col("first"))).drop("stop")
    filled = pieces.repartition(partitions(spark)).mapInArrow(_slots, "shard long, source_no long, slot long, block long, words long")

    n_buckets = sum(r.n for r in counted) // BUCKET_DOCS + 1
    numbered = sized.join(table.select(F.col("source").alias("_source"), "source_no"), F.col("source").eqNullSafe(F.col("_source"))).select(sized["*"], "source_no")
    full = numbered.where("size > 0").withColumn("bucket", F.pmod("key", F.lit(n_buckets)).cast("int"))
    sums = full.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.select("source_no", "bucket", (F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("begun"))
    within = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = full.join(starts.hint("merge"), ["source_no", "bucket"]).withColumn("start", F.col("begun") + F.sum("size").over(within) - F.col("size"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = placed.select("row", "source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    origin = F.col("block") * block
    cut = cut.select("row", F.col("source_no").cast("long").alias("source_no"), "block", "start", F.greatest("start", origin).alias("from"), F.least(F.col("start") + F.col("size"), origin + block).alias("to"))
    joined = cut.join(filled.hint("merge"), ["source_no", "block"])
    stop = F.least("to", F.col("block") * block + F.col("words"))
    spans = joined.where(stop > F.col("from")).select("row", "shard", "source_no", "slot", (F.col("from") - F.col("start")).alias("begin"), (stop - F.col("start")).alias("end"))
    return Mixture(numbered, table, spans)


def taken(mixture: Mixture) -> DataFrame:
    """(doc_id, size, source_size, target, taken): of each document the words that the mix takes, repeats counted."""
    got = mixture.spans.select("row", (F.col("end") - F.col("begin")).alias("words"))
    every = mixture.docs.select("row", "doc_id", "size", "source_no", F.lit(0).cast("long").alias("words"))
    rows = every.unionByName(got, allowMissingColumns=True).groupBy("row").agg(F.first("source_no", True).alias("source_no"), F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sum("words").alias("taken"))
    return rows.join(mixture.sources.select("source_no", "source_size", "target"), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def texts(mixture: Mixture, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, source, slot, text): the words of each slot, joined by single spaces."""
    held = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("all")).dropDuplicates(["key"])
    parts = mixture.spans.join(mixture.docs.select("row", "key", "source"), "row").join(held, "key")
    words = F.array_join(F.slice("all", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")), " ")
    slots = parts.select("shard", "source", "slot", F.struct("key", "row", "begin", words.alias("words")).alias("p")).groupBy("shard", "source", "slot").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return slots.select("shard", "source", "slot", F.array_join(F.transform("p", lambda p: p["words"]), " ").alias("text"))


def op12(spark, sf_dir: str) -> DataFrame:
    return taken(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
