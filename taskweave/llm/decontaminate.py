"""Benchmark decontamination: an FM-index for every shard of the corpus, searched for all windows of the benchmark.

A shard is a slice of a partition's texts. All its words are numbered by the shard's own vocabulary; a terminator ends each text, as no
window can reach across it. The index holds the whole shard and does not depend on the benchmark, whose windows are mapped to the
shard's numbers: a Burrows-Wheeler transform, a wavelet matrix of packed bits for ranks, and suffix positions sampled at every
``SAMPLE``-th place and at each text's start.

A null text has no words; empty texts, texts without words and an empty benchmark give rows without hits. Items without words have
no window; of items that repeat an id the windows are one item's. Rows that repeat a doc_id or have a null one each get their own row,
by what their own text holds. Texts of any length are one shard at least and are indexed whole. An empty table gives no rows. The size
of the benchmark's blocks changes no result. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.llm.words import LETTERED, Words, scan, slices
from taskweave.shared import written

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20

FOUND = "key long, n_words long, n_hit long, items array<string>, words array<struct<first:int,stop:int>>, spans array<struct<start:int,stop:int>>"


@dataclass
class Phrases:
    """The distinct windows of a block of the benchmark, as numbers from 1 in its vocabulary, filled up with 0, and the items that have each."""

    vocabulary: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    first_item: np.ndarray
    names: list[str]

    def within(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows whose words are all in a shard's vocabulary: their numbers, and their codes in it."""
        near = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        own = np.concatenate([[0], np.where(vocabulary[near] == self.vocabulary, near + 1, -1)])[self.codes]
        whole = np.flatnonzero((own >= 0).all(axis=1))
        return whole, own[whole]


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of (name, text) rows; an item with fewer words than ``window`` is one window."""
    w = scan(pa.array([t for _, t in items], type=pa.string()), LETTERED, lower=True)
    vocabulary, numbers = np.unique(w.hash, return_inverse=True)
    size = np.diff(w.first)
    many = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), many)
    start = np.repeat(w.first[:-1], many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(size[item], window)
    codes = np.zeros((len(item), window), dtype=np.int32)
    for k in range(window):
        at = np.flatnonzero(length > k)
        codes[at, k] = numbers[start[at] + k] + 1
    codes, which = np.unique(codes, axis=0, return_inverse=True) if len(codes) else (codes, item)
    owners = np.unique(which.reshape(-1).astype(np.int64) * max(len(items), 1) + item)
    first_item = np.searchsorted(owners, np.arange(len(codes) + 1) * max(len(items), 1))
    return Phrases(vocabulary, codes, (codes > 0).sum(axis=1), owners % max(len(items), 1), first_item, [n for n, _ in items])


class WaveletMatrix:
    """Ranks of symbols in a sequence: for each bit of a symbol a vector of packed bits, and how many are set before each of its words."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.words, self.counts, self.zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            ones = ((symbols >> b) & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(64 + -len(ones) % 64, dtype=bool)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed)[:-1])]).astype(np.int32))
            self.zeros.append(len(symbols) - int(ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, before: np.ndarray) -> np.ndarray:
        word, bit = before >> 6, (before & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(before), before
        for level, zeros in enumerate(self.zeros):
            one = (symbols >> (len(self.zeros) - 1 - level)) & 1 == 1
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; ``symbols`` ends each text with a number that no other place has.

    As many symbols as fit a 64-bit key are compared at first; from then on only suffixes that are not told apart yet are sorted again.
    """
    n = len(symbols)
    bits = int(symbols.max(initial=0) + 1).bit_length()
    step = max(1, 63 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:] + 1
    order = np.argsort(key, kind="stable")
    at, key = np.arange(n), key[order]  # places in the order that are open, and what was compared
    rank = np.empty(n, dtype=np.int64)
    while True:
        new = np.ones(len(at) + 1, dtype=bool)
        new[1:-1] = key[1:] != key[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(new[:-1], at, 0))
        at = at[~(new[:-1] & new[1:])]
        if not len(at):
            return order
        suffix = order[at]
        follow = np.zeros(len(at), dtype=np.int64)
        inside = suffix + step < n
        follow[inside] = rank[suffix[inside] + step] + 1
        key = rank[suffix] * (n + 1) + follow
        again = np.argsort(key, kind="stable")
        order[at], key = suffix[again], key[again]
        step *= 2


class FMIndex:
    """``text``: symbols from 1, each text ended by a 0."""

    def __init__(self, text: np.ndarray, largest: int):
        self.n = len(text)
        ends = text == 0
        order = suffix_order(np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) - 1 + text))
        self.last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))]).astype(np.int64)
        self.tree = WaveletMatrix(self.last, max(1, int(largest).bit_length()))
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.tree.rank(symbols, rows)

    def search(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases that occur: their numbers and their rows, from and to."""
        alive = np.arange(len(lengths))
        low, high = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), self.n, dtype=np.int64)
        for back in range(1, codes.shape[1] + 1):
            going = lengths[alive] >= back
            at = alive[going]
            symbols = codes[at, lengths[at] - back]
            low[at], high[at] = self.step(symbols, low[at]), self.step(symbols, high[at])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: walks back to the next sampled one."""
        out, walked = np.zeros(len(rows), dtype=np.int64), 0
        at, rows = np.arange(len(rows)), rows.copy()
        while len(at):
            known = self.sampled[rows]
            out[at[known]] = self.samples[self.sample_rank[rows[known]]] + walked
            at, rows = at[~known], rows[~known]
            rows = self.step(self.last[rows], rows)
            walked += 1
        return out


def occurrences(w: Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """All places where a phrase occurs in a shard: the first word's number and the phrase's number."""
    none = np.zeros(0, dtype=np.int64)
    if not len(p.lengths) or not len(w.start):
        return none, none
    vocabulary, numbers = np.unique(w.hash, return_inverse=True)
    asked, codes = p.within(vocabulary)
    place = np.arange(len(w.start)) + w.text  # a terminator stands before each text but the first
    text = np.zeros(len(w.start) + len(w.first) - 1, dtype=np.int64)
    text[place] = numbers + 1
    word = np.zeros(len(text), dtype=np.int64)
    word[place] = np.arange(len(w.start))
    index = FMIndex(text, len(vocabulary))
    found, low, high = index.search(codes, p.lengths[asked])
    each = high - low
    rows = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
    return word[index.locate(rows)], np.repeat(asked[found], each)


def _merged(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, sorted by where they begin, that touch or overlap."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(stop[order]) if len(order) else stop
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return first[at], np.concatenate([reach[at[1:] - 1], reach[-1:]])


def hit_words(w: Words, p: Phrases) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Words inside occurrences (0 or 1 each), (text, item) pairs, and word spans as rows of (text, first, stop)."""
    first, which = occurrences(w, p)
    change = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + p.lengths[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    many = p.first_item[which + 1] - p.first_item[which]
    item = p.items[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(p.first_item[which], many)]
    pairs = np.unique(np.stack([np.repeat(w.text[first], many), item]), axis=1).T if len(item) else np.zeros((0, 2), dtype=np.int64)
    spans = np.zeros((0, 3), dtype=np.int64)
    if len(first):
        a, b = _merged(first, first + p.lengths[which])
        cut = [(w.text[x], x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        whole = []
        for t, x, y in cut:  # spans of neighbouring texts may touch
            while w.text[y - 1] != t:
                z = int(w.first[t + 1])
                whole.append((t, x, z))
                t, x = w.text[z], z
            whole.append((t, x, y))
        spans = np.array(whole, dtype=np.int64)
    return hit, [(int(t), int(i)) for t, i in pairs], spans


def _shards(batches, column: str, p: Phrases):
    for batch in slices(batches, column, SHARD_BYTES):
        w = scan(batch.column(batch.schema.get_field_index(column)), LETTERED, lower=True)
        yield batch, w, *hit_words(w, p)


def _char(data: np.ndarray, text_start: int, place: int) -> int:
    """Code points between a text's start and a byte of it."""
    return int(((data[text_start:place] & 0xC0) != 0x80).sum())


def _find(p_of):
    def run(batches):
        p: Phrases = p_of.value
        for batch, w, hit, pairs, spans in _shards(batches, "text", p):
            n = batch.num_rows
            items: list[list[str]] = [[] for _ in range(n)]
            for t, i in pairs:
                items[t].append(p.names[i])
            words: list[list[dict]] = [[] for _ in range(n)]
            chars: list[list[dict]] = [[] for _ in range(n)]
            for t, a, b in spans.tolist():
                words[t].append({"first": a - int(w.first[t]), "stop": b - int(w.first[t])})
                begin = _char(w.data, w.texts[t], w.start[a])
                chars[t].append({"start": begin, "stop": begin + _char(w.data, w.start[a], w.end[b - 1])})
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(np.bincount(w.text[hit], minlength=n), pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                    pa.array(words, pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))), pa.array(chars, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ],
                names=["key", "n_words", "n_hit", "items", "words", "spans"],
            )

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """How many blocks of about ``block_bytes`` of text the benchmark has, and their windows, read to the driver one at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("name"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("name"), F.lit(n))
    return n, (phrases([(r.name if r.name is not None else "", r.text) for r in rows.where(block == b).collect()], window) for b in range(n))


def _searched(rows: DataFrame, blocks: Iterator[Phrases], search, schema: str) -> DataFrame:
    """What ``search`` finds for each block, written before the next block is read: one block is broadcast at a time."""
    every = None
    for p in blocks:
        held = rows.sparkSession.sparkContext.broadcast(p)
        part = written(rows.mapInArrow(search(held), schema), "block")
        held.destroy()
        every = part if every is None else every.unionByName(part)
    return every


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: id, words, words hit, items whose windows occur (sorted), and removal spans in words and in code points."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    n, blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    if n == 1:
        return rows.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(next(blocks))), FOUND).withColumnRenamed("key", id_col)
    keyed = written(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    every = _searched(keyed.select(F.col("row").alias("key"), "text"), blocks, _find, FOUND)
    merge = lambda c, a, b: F.aggregate(
        F.array_sort(F.flatten(F.collect_list(c))),
        F.array().cast(f"array<struct<{a}:int,{b}:int>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)[b] >= x[a]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)[a].alias(a), F.greatest(F.element_at(out, -1)[b], x[b]).alias(b))))).otherwise(F.concat(out, F.array(x))),
    )
    merged = every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), merge("words", "first", "stop").alias("words"), merge("spans", "start", "stop").alias("spans"))
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda out, x: out + x["stop"] - x["first"])
    own = keyed.select("row", F.col("key").alias(id_col))
    return merged.join(own, F.col("key") == F.col("row")).select(id_col, "n_words", n_hit.alias("n_hit"), "items", "words", "spans")


def _without(body: bytes, cuts: list[tuple[int, int]]) -> str:
    out, place = [], 0
    for a, b in cuts:
        out.append(body[place:a])
        place = b
    return b"".join([*out, body[place:]]).decode()


def _spans(p_of):
    """Of rows (row, text), the spans of one block: by words, and as bytes of the text."""

    def run(batches):
        p: Phrases = p_of.value
        for batch, w, _, _, spans in _shards(batches, "text", p):
            t, a, b = spans[:, 0], spans[:, 1], spans[:, 2]
            row = batch.column(0).take(pa.array(t, pa.int64()))
            word, byte = w.first[t].astype(np.int64), w.texts[t].astype(np.int64)
            places = [a - word, b - word, w.start[a] - byte, w.end[b - 1] - byte]
            yield pa.RecordBatch.from_arrays([row, *[pa.array(x.astype(np.int64)) for x in places]], names=["row", "first", "stop", "start", "end"])

    return run


def _cut_all(column: str, schema: pa.Schema):
    """Cuts the union of a text's spans, which are in the last column."""

    def run(batches):
        at = schema.get_field_index(column)
        for batch in batches:
            texts, n = batch.column(at).to_pylist(), len(schema)
            for i, spans in enumerate(batch.column(n).to_pylist()):
                if spans:
                    cuts: list[list[int]] = []
                    for s in sorted(spans, key=lambda s: (s["first"], s["stop"])):
                        if cuts and s["first"] <= cuts[-1][0]:
                            cuts[-1][0], cuts[-1][2] = max(cuts[-1][0], s["stop"]), max(cuts[-1][2], s["end"])
                        else:
                            cuts.append([s["stop"], s["start"], s["end"]])
                    texts[i] = _without(texts[i].encode(), [(a, b) for _, a, b in cuts])
            yield pa.RecordBatch.from_arrays([pa.array(texts, schema.field(i).type) if i == at else batch.column(i).cast(schema.field(i).type) for i in range(n)], schema=schema)

    return run


def _cut(p_of, column: str, schema: pa.Schema):
    def run(batches):
        p: Phrases = p_of.value
        for batch, w, _, _, spans in _shards(batches, column, p):
            at = batch.schema.get_field_index(column)
            texts: list[str | None] = batch.column(at).to_pylist()
            by_text: dict[int, list[tuple[int, int]]] = {}
            for t, a, b in spans.tolist():
                by_text.setdefault(t, []).append((int(w.start[a]), int(w.end[b - 1])))
            for t, cuts in by_text.items():
                begin = int(w.texts[t])
                texts[t] = _without(w.data[begin : w.texts[t + 1]].tobytes(), [(a - begin, b - begin) for a, b in cuts])
            yield pa.RecordBatch.from_arrays([pa.array(texts, schema.field(i).type) if i == at else c.cast(schema.field(i).type) for i, c in enumerate(batch.columns)], schema=schema)

    return run


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every removal span cut out of the text; all other columns stay. The spans of all blocks of a large benchmark are cut at once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)
    n, blocks = _blocks(benchmark, "item_id", "text", window, block_bytes)
    if n == 1:
        return docs.mapInArrow(_cut(docs.sparkSession.sparkContext.broadcast(next(blocks)), text_col, schema), docs.schema)
    keyed = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    found = _searched(keyed.select("row", F.col("doc")[text_col].alias("text")), blocks, _spans, "row long, first long, stop long, start long, end long")
    spans = found.groupBy("row").agg(F.collect_list(F.struct("first", "stop", "start", "end")).alias("spans"))
    spare = "spans" + "_" * max(map(len, docs.columns))  # no column has this name
    joined = keyed.join(spans, "row", "left").select(*[F.col("doc")[c].alias(c) for c in docs.columns], F.col("spans").alias(spare))
    return joined.mapInArrow(_cut_all(text_col, schema), docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM item_windows))
), matches AS (
  SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM matches) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM matches) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
