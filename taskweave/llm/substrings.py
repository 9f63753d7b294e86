"""Substring dedup by super-k-mers.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the smallest hash among its runs of ``GRAM`` words, so it
depends on the window's words alone. Consecutive windows with one minimiser travel as one packed string, the words that they span,
to the bucket of that minimiser; there a sort brings equal windows together and the words themselves confirm that they are equal.
Before anything travels, equal packed strings of a slice are reduced to the earliest, so that thousands of copies cost one string
for each slice. A run of words that is frequent in many contexts would fill one bucket: minimisers are counted first, and windows whose
minimiser is as heavy as an average bucket go by the hash of the whole window instead, which spreads all but equal windows. What comes back are ranges of repeated windows, which cut words from the documents.

Windows are ordered by (doc_id, start); of equal windows all that come first in this order stay, so windows at the same place of rows
that repeat a doc_id do not count as copies of one another. Such rows are told apart by a hash of their text and are each cut by
themselves. Null and empty texts have no words. A null doc_id comes before all others. An empty table gives no rows. Texts of any length
are cut whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.llm.words import SPACED, hash_words, mix, runs, scan, slices
from taskweave.shared import partitions, written

WINDOW, GRAM = 20, 3
SLICE_BYTES = 8 << 20
BUCKETS_PER_PARTITION = 4
CELL_BITS, HOT = 16, 1.0
NULL_ID = -(1 << 63)
_LOW = (1 << 32) - 1

PACKED = "bucket int, strings binary, docs binary, starts binary"
RANGES = "doc long, key int, start int, n int"


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every ``n`` consecutive numbers."""
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _ranges(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows as ranges of consecutive ones: documents, keys, starts and numbers of windows."""
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], key[at], start[at], np.diff(np.append(at, len(doc)))


def _strings(texts: pa.Array, hot: np.ndarray, bits: int):
    """The words, and of each packed string the first word, the number of windows and the key; None without windows.

    The key is the minimiser of the string's windows, or the hash of the whole window where the minimiser's cell is one of ``hot``.
    """
    joined = [b" ".join(x.as_buffer().to_pybytes().split()) if x.is_valid else b"" for x in texts.cast(pa.binary())]
    w = scan(pa.array(joined, pa.binary()), SPACED)
    if len(w.start) < WINDOW:
        return None
    least = _sliding_min(runs(w.hash, GRAM), WINDOW - GRAM + 1)
    inside = np.flatnonzero(w.text[: len(least)] == w.text[WINDOW - 1 : WINDOW - 1 + len(least)])
    if not len(inside):
        return None
    key = least[inside]
    if len(hot):
        heavy = np.isin(_cell(key, bits), hot)
        key[heavy] = runs(w.hash, WINDOW)[inside[heavy]]
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (inside[1:] != inside[:-1] + 1)
    at = np.flatnonzero(new)
    return w, inside[at], np.diff(np.append(at, len(inside))), key[at]


def _cell(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - bits)).astype(np.int64)


def _weigh(bits: int):
    """Cells of minimisers, with the windows of their strings that differ within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            if (found := _strings(batch.column(1), np.zeros(0, dtype=np.int64), bits)) is not None:
                w, first, n, key = found
                _, one = np.unique(mix(runs(w.hash, WINDOW)[first]) + n.astype(np.uint64), return_index=True)
                total += np.bincount(_cell(key[one], bits), weights=n[one], minlength=len(total)).astype(np.int64)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], names=["cell", "n"])

    return run


def _pack(n_buckets: int, hot: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, row_key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            if (found := _strings(batch.column(1), hot, bits)) is None:
                continue
            w, first, n, key = found
            text = w.text[first]
            order = np.lexsort((first - w.first[text], ids[text]))  # the earliest of equal strings comes first
            first, n, text = first[order], n[order], text[order]
            bucket = (mix(key[order]) % np.uint64(n_buckets)).astype(np.int64)
            doc, mark = ids[text], row_key[text] << 32 | (first - w.first[text])  # the row's key and the place in it
            body, a, b = w.data.tobytes(), w.start[first].tolist(), w.end[first + n + WINDOW - 2].tolist()
            least: dict[bytes, int] = {}
            state = np.zeros(len(first), dtype=np.int8)  # 0: goes to its bucket; 1: an equal string is earlier in this slice; 2: the same place of an equal row
            strings, owner, low, full = [], doc.tolist(), (mark & _LOW).tolist(), mark.tolist()
            for i in range(len(a)):
                s = body[a[i] : b[i]]
                if (j := least.setdefault(s, i)) != i:
                    state[i] = 1 if (owner[i], low[i]) != (owner[j], low[j]) else 2 if full[i] == full[j] else 0
                strings.append(s)
            again = np.flatnonzero(state == 1)
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([doc[again].tobytes()], pa.binary()), pa.array([np.stack([mark[again], n[again]]).tobytes()], pa.binary())], names=["bucket", "strings", "docs", "starts"])
            kept = np.flatnonzero(state == 0)
            kept = kept[np.argsort(bucket[kept], kind="stable")]
            edges = np.flatnonzero(np.diff(bucket[kept], prepend=-1))
            rows = [(int(bucket[k[0]]), packer.compress(b"\n".join([strings[i] for i in k])), doc[k].tobytes(), mark[k].tobytes()) for k in np.split(kept, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "strings", "docs", "starts"])

    return run


def _repeated(strings: list[bytes], docs: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of the windows in a bucket's strings, the ranges that are not the earliest of their words."""
    body = b"\n".join(strings)
    data = np.frombuffer(body, dtype=np.uint8)
    spaces = np.flatnonzero((data == 0x20) | (data == 0x0A))
    start, end = np.concatenate([[0], spaces + 1]), np.append(spaces, len(data))
    string = np.cumsum(np.concatenate([[0], data[spaces] == 0x0A]))
    first_word = np.searchsorted(string, np.arange(int(string[-1]) + 1))
    hashes = runs(hash_words(data, start, end, False), WINDOW)
    inside = np.flatnonzero(string[: len(hashes)] == string[WINDOW - 1 : WINDOW - 1 + len(hashes)])
    hashes = hashes[inside]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    many = np.zeros(len(order), dtype=bool)
    many[1:] |= same
    many[:-1] |= same
    pick = order[many]
    word = inside[pick]
    doc = np.concatenate(docs)[string[word]]
    mark = np.concatenate(starts)[string[word]]
    key, place = mark >> 32, (mark & _LOW) + word - first_word[string[word]]
    a, b = start[word], end[word + WINDOW - 1]
    order = np.lexsort((place, doc, hashes[pick]))
    doc, key, place, a, b, keys = doc[order], key[order], place[order], a[order].tolist(), b[order].tolist(), hashes[pick][order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(head, np.diff(np.append(head, len(keys)))).tolist()
    later = np.zeros(len(keys), dtype=bool)
    others: dict[bytes, int] = {}
    for i, h in enumerate(owner):
        if i != h:
            s = body[a[i] : b[i]]
            if s != body[a[h] : b[h]]:  # another window with the same hash
                h = others.setdefault(s, i)
            later[i] = doc[i] != doc[h] or place[i] != place[h]
    return _ranges(doc[later], key[later], place[later])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    current, strings, docs, starts = None, [], [], []

    def out(doc, key, start, n):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *[pa.array(x.astype(np.int32)) for x in (key, start, n)]], names=["doc", "key", "start", "n"])

    for batch in batches:
        for bucket, s, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s is None:
                mark, n = np.frombuffer(t, dtype=np.int64).reshape(2, -1)
                yield out(np.frombuffer(d, dtype=np.int64), mark >> 32, mark & _LOW, n)
                continue
            if bucket != current:
                if strings:
                    yield out(*_repeated(strings, docs, starts))
                current, strings, docs, starts = bucket, [], [], []
            strings.append(unpacker.decompress(s))
            docs.append(np.frombuffer(d, dtype=np.int64))
            starts.append(np.frombuffer(t, dtype=np.int64))
    if strings:
        yield out(*_repeated(strings, docs, starts))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ranges (doc, key, start, n): of the rows with this id and hash of the text, the ``n`` windows from word ``start`` on stand earlier elsewhere."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"), F.hash(text_col).alias("key"))
    n_buckets = n * BUCKETS_PER_PARTITION
    bits = max(CELL_BITS, (16 * n_buckets - 1).bit_length())  # an average cell is a small part of a bucket
    cells = written(rows.mapInArrow(_weigh(bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    mean = (cells.agg(F.sum("n")).first()[0] or 0) / n_buckets
    hot = np.array([r.cell for r in cells.where(F.col("n") > HOT * mean).collect()], dtype=np.int64)  # fewer than buckets / HOT
    packed = rows.mapInArrow(_pack(n_buckets, hot, bits), PACKED)
    dealt = F.when(F.col("bucket") >= 0, F.col("bucket") % n).otherwise(F.pmod(F.xxhash64("docs"), F.lit(n))).cast("int")
    return packed.repartitionById(n, dealt).sortWithinPartitions("bucket").mapInArrow(_count, RANGES)


CUT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        ids, n_words, n_removed, kept = batch.column(0), [], [], []
        for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            words = text.as_py().split() if text.is_valid else []
            if found:
                stay = np.ones(len(words) + 1, dtype=np.int64)
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for start, n in ((r["start"], r["n"]) for r in found):
                    change[start] += 1
                    change[min(start + n + WINDOW - 1, len(words))] -= 1
                stay = np.cumsum(change)[:-1] == 0
                left = [words[i] for i in np.flatnonzero(stay).tolist()]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, words, words removed, and the words kept, joined by one space."""
    ranges = repeated_windows(docs, id_col, text_col).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.hash(text_col).alias("own"))
    joined = rows.join(ranges, (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("doc")) & (F.col("own") == F.col("key")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, CUT).withColumnRenamed("doc_id", id_col)


def op3(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), removed AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
