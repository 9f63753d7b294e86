"""Spelling variants: words that differ by one code point, found by probing Bloom filters with edits.

Words are counted in one shuffle. The vocabulary's hashes fill blocked Bloom filters, one for each word length and in parts of ``PART``
blocks; parts are sent to the tasks in groups of at most ``FILTER_BYTES``, a job for each group, so no broadcast grows with the
vocabulary. Each word's deletions probe the filter of the next shorter length, and its replacements by a later letter that of its own
length; the mirrored edits, insertions and replacements by an earlier letter, are the same pairs seen from the other word. Hashes are sums
of a hash for each place and letter, so an edit costs a few operations whatever the word's length. Only positives become strings, and are
joined exactly with the vocabulary, which removes what the filters let through falsely.

A null text has no words; a null id counts as an empty one in the checksum. Repeated rows count again. Runs and words may have any length.
Of near words with equal counts the first in code-point order is the form. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.llm.words import mix
from taskweave.shared import partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]{%d,}"
#: All letters of words, as Latin-1 bytes.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.uint8)
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
BITS, PROBES, BLOCK_BITS = 20, 7, 512
PART, FILTER_BYTES = 1 << 14, 64 << 20
CELLS = 1 << 19


def noisy(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, or for one in ``one_in`` checksums of id and run, the run without one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int | None = None) -> DataFrame:
    """(word, n): all runs of letters, A-Z lower-cased, that are long and frequent enough; ``one_in`` loses letters as in ``noisy``."""
    low = F.translate(text_col, UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("_id"), F.explode(F.regexp_extract_all(low, F.lit(RUN % least_length), F.lit(0))).alias("run"))
    word = F.col("run") if one_in is None else noisy(F.col("_id"), F.col("run"), one_in)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def place_hash(places, letters: np.ndarray) -> np.ndarray:
    return mix(np.asarray(places, dtype=np.uint64) * np.uint64(256) + letters.astype(np.uint64) + np.uint64(1))


def by_length(words: list[str]):
    """(length, which words, their letters as a matrix), for each length."""
    sizes = np.array(list(map(len, words)), dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        size = int(sizes[order[a]])
        step = max(1, CELLS // max(size, len(LETTERS)))
        for i in range(a, b, step):
            which = order[i : min(i + step, b)]
            yield size, which, np.frombuffer("".join([words[k] for k in which.tolist()]).encode("latin-1"), dtype=np.uint8).reshape(len(which), size)


def hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(place_hash(np.arange(letters.shape[1]), letters), axis=1)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def bits_of(h: np.ndarray, i: int) -> np.ndarray:
    return (mix(h) >> np.uint64(9 * i) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def blocks_for(n: int) -> int:
    return -(-n * BITS // BLOCK_BITS)


def _placed(blocks_by_length):
    """Words as (length, part, hash)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for size, _, letters in by_length(batch.column(0).to_pylist()):
                    h = hashes(letters)
                    part = block_of(h, blocks_by_length.value[size]) // PART
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, dtype=np.int32)), pa.array(part.astype(np.int32)), pa.array(h.view(np.int64))], names=["length", "part", "hash"])

    return run


def _filled(blocks_by_length):
    """The bits of one part of a length's filter."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size, part, h = int(rows["length"].iloc[0]), int(rows["part"].iloc[0]), rows["hash"].to_numpy().view(np.uint64)
        blocks = blocks_by_length.value[size]
        bits = np.zeros(min(PART, blocks - part * PART) * BLOCK_BITS // 64, dtype=np.uint64)
        block = block_of(h, blocks) - part * PART
        for i in range(PROBES):
            at = bits_of(h, i)
            np.bitwise_or.at(bits, block * (BLOCK_BITS // 64) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return pd.DataFrame({"length": [size], "part": [part], "bits": [bits.tobytes()]})

    return run


class Filters:
    """A group of filter parts: for each length how many blocks it has in all, and the bits from one block to another."""

    def __init__(self, parts: list[tuple[int, int, bytes]], blocks_by_length: dict[int, int]):
        self.of: dict[int, tuple[int, int, np.ndarray]] = {}
        for size in {p[0] for p in parts}:
            own = sorted((part, bits) for s, part, bits in parts if s == size)
            first, last = own[0][0], own[-1][0]
            whole, stop = dict(own), min((last + 1) * PART, blocks_by_length[size])
            bits = np.zeros((stop - first * PART) * BLOCK_BITS // 64, dtype=np.uint64)
            for part, b in whole.items():
                at = (part - first) * PART * BLOCK_BITS // 64
                bits[at : at + len(b) // 8] = np.frombuffer(b, dtype=np.uint64)
            self.of[size] = blocks_by_length[size], first * PART, bits

    def hold(self, size: int, h: np.ndarray) -> np.ndarray:
        """Which of the hashes (an array of any shape) the filter of a length may hold, as flat places."""
        blocks, first, bits = self.of[size]
        flat = h.ravel()
        block = block_of(flat, blocks) - first
        found = np.flatnonzero((block >= 0) & (block < len(bits) * 64 // BLOCK_BITS))
        for i in range(PROBES):
            at = bits_of(flat[found], i)
            word = bits[block[found] * (BLOCK_BITS // 64) + (at >> 6)]
            found = found[(word >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
        return found


def _strings(letters: np.ndarray) -> list[str]:
    n, size = letters.shape
    whole = letters.tobytes().decode("latin-1")
    return [whole[i : i + size] for i in range(0, n * size, size)]


def edits(letters: np.ndarray, filters: Filters):
    """(which word, edited words) of the deletions and later-letter replacements that the filters may hold, for words of one length."""
    n, size = letters.shape
    places = np.arange(size)
    each = place_hash(places, letters)
    if size - 1 in filters.of:
        before, moved = np.zeros((n, size), dtype=np.uint64), np.zeros((n, size), dtype=np.uint64)
        before[:, 1:] = np.bitwise_xor.accumulate(each[:, :-1], axis=1)
        shifted = place_hash(places[:-1], letters[:, 1:])
        moved[:, :-1] = np.bitwise_xor.accumulate(shifted[:, ::-1], axis=1)[:, ::-1]
        new = np.ones((n, size), dtype=bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]  # of equal letters in a row one deletion is enough
        which, at = np.nonzero(new)
        good = filters.hold(size - 1, (before ^ moved)[which, at])
        which, at = which[good], at[good]
        if len(which):
            kept = places[None, :-1] + (places[None, :-1] >= at[:, None])
            yield which, _strings(letters[which[:, None], kept])
    if size in filters.of:
        rest = np.bitwise_xor.reduce(each, axis=1)[:, None] ^ each
        for at in range(size):
            found = filters.hold(size, rest[:, at, None] ^ place_hash(at, LETTERS)[None, :])
            which, letter = found // len(LETTERS), LETTERS[found % len(LETTERS)]
            later = letter > letters[which, at]
            which, letter = which[later], letter[later]
            if len(which):
                changed = letters[which].copy()
                changed[:, at] = letter
                yield which, _strings(changed)


def _probe(filters_of):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_pylist()
            for _, own, letters in by_length(words):
                for which, found in edits(letters, filters_of.value):
                    at = pa.array(own[which])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.string())], names=["word", "n", "other"])

    return run


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words that differ by one code point, once. ``vocab``: a stored table of (word, n)."""
    spark = vocab.sparkSession
    sizes = {r.length: r["count"] for r in vocab.groupBy(F.length("word").alias("length")).count().collect()}  # a row for each length
    blocks = {size: blocks_for(n) for size, n in sizes.items()}
    sent = spark.sparkContext.broadcast(blocks)
    parts = vocab.select("word").mapInArrow(_placed(sent), "length int, part int, hash long").groupBy("length", "part").applyInPandas(_filled(sent), "length int, part int, bits binary")
    parts = written(parts, "filters")
    groups, held = [], 0
    for size in sorted(blocks):
        for part in range(-(-blocks[size] // PART)):
            bytes_ = min(PART, blocks[size] - part * PART) * BLOCK_BITS // 8
            if not groups or held + bytes_ > FILTER_BYTES:
                groups, held = [*groups, []], 0
            groups[-1].append((size, part))
            held += bytes_
    out = None
    for group in groups:
        low, high = group[0], group[-1]
        key = F.struct("length", "part")
        inside = (key >= F.struct(F.lit(low[0]).alias("length"), F.lit(low[1]).alias("part"))) & (key <= F.struct(F.lit(high[0]).alias("length"), F.lit(high[1]).alias("part")))
        filters = spark.sparkContext.broadcast(Filters([(r.length, r.part, bytes(r.bits)) for r in parts.where(inside).collect()], blocks))  # FILTER_BYTES at most
        asked = vocab.where(F.length("word").between(low[0], high[0] + 1))
        found = written(asked.select("word", "n").mapInArrow(_probe(filters), "word string, n long, other string"), "positives")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    return out.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word's end of the chain of forms. ``forms``: (word, form), without circles. Chains halve with each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            return now


def grouped(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n): the form is the near word of largest n, if that is ``times`` the word's."""
    vocab = written(vocab.select("word", "n").repartition(partitions(vocab.sparkSession), "word"), "vocabulary")
    pairs = near_pairs(vocab)
    both = F.array(F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = pairs.select(F.explode(both).alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("top"))
    far = F.col("n_near").isNotNull() & (-F.col("top.m") >= times * F.col("n"))
    found = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("top.near")).alias("form"), F.when(far, -F.col("top.m")).alias("form_n"))
    found = written(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13(spark, sf_dir: str) -> DataFrame:
    words = vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), one_in=199)
    return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The checksum is that of IEEE 802.3 by a table of its 256 remainders, byte by byte.
ORACLE = """
WITH RECURSIVE step AS (
  SELECT b AS byte, b::UBIGINT AS c, 0 AS i FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE i = 8),
run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents
), one AS (SELECT doc_id, run, count(*) AS k FROM run GROUP BY ALL),
coded AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM one),
summed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(strlen(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::UBIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM coded, crc
), made AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM summed
), vocab AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
place AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM vocab),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM place),
pair AS (
  SELECT less.word AS a, less.n AS a_n, vocab.word AS b, vocab.n AS b_n FROM less JOIN vocab ON short = vocab.word
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM place x JOIN place y ON x.i = y.i AND substr(x.word, 1, x.i - 1) = substr(y.word, 1, y.i - 1) AND substr(x.word, x.i + 1) = substr(y.word, y.i + 1) AND x.word < y.word
), near AS (SELECT a AS word, b AS other, b_n AS m FROM pair UNION ALL SELECT b, a, a_n FROM pair),
best AS (SELECT word, count(*) AS n_near, arg_min((other, m), (-m, encode(other))) AS top FROM near GROUP BY word),
found AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top[2] >= 5 * n THEN top[1] END AS form, CASE WHEN top[2] >= 5 * n THEN top[2] END AS form_n FROM vocab LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM found UNION ALL SELECT chain.word, chain.next, found.form FROM chain JOIN found ON found.word = chain.next)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM found JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""
