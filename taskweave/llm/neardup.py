"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of consecutive words. A sketch has a register for each of ``REGISTERS`` buckets of hashes: the
leading-zero count and some mantissa bits of the bucket's smallest hash. Bands of registers make candidates, each set with the first
one in its band; the collision-corrected Jaccard estimate of two sketches drops chance meetings. Members of a band that are not close to
its first one are candidates with each other, in blocks; what hangs together by all these pairs is a cluster. Within clusters full sets
are compared, so links are exact: each member against the cluster's first, and those that it does not reach against all members, in
blocks of bounded size. No pairs are made within a group of copies: equal sets count once, as one node, and a block reports a spanning
forest of its links.

Two documents are linked when their sets' Jaccard similarity reaches the threshold; a component is named by the smallest doc_id in it.
Null and empty texts have empty sets and no links. A row with a null doc_id is linked with nothing and has a null component. Rows that
repeat a doc_id are told apart by their text: each is in the component of its own text. Texts of any length are taken whole. An empty
table gives no rows. Other columns, whatever their names, are carried by ``dedup`` and not looked at otherwise.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.llm.words import SPACED, mix, runs, scan, slices
from taskweave.operators.graph import connected_components
from taskweave.shared import partitions, written

REGISTERS, BAND = 200, 5
MANTISSA = 10
SHINGLE, PERCENT = 5, 80
#: Pairs below LOOSE are dropped. What a CLOSE member is linked with is at 0.5 or more to the band's first document too, so it pairs with no others.
LOOSE, CLOSE = 0.4, 0.7
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
SMALL_ROWS = 500_000
SALTS = 16
SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]"
_U = np.uint64


def _sets(column: pa.Array, words: int):
    """Each text's distinct shingle hashes, ascending."""
    w = scan(column, SPACED, lower=True)
    every = runs(w.hash, words)
    for i in range(len(column)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= words:
            yield np.unique(every[a : b - words + 1])
        elif b > a:
            yield mix(runs(w.hash[a:b], b - a) ^ _U(b - a))
        else:
            yield every[:0]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set: 0 for an empty bucket, else leading zeros and mantissa of the bucket's smallest hash, plus 1."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    mixed = mix(hashes)
    bucket = ((mixed >> _U(32)) * _U(REGISTERS)) >> _U(32)
    low = mix(mixed ^ _U(0x5851F42D4C957F2D)) >> _U(12)
    least = np.full(REGISTERS, (1 << 52) - 1, dtype=_U)
    np.minimum.at(least, bucket.astype(np.int64), low)
    full = np.unique(bucket.astype(np.int64))
    fraction, exponent = np.frexp(np.maximum(least[full], 1).astype(np.float64))
    zeros = np.minimum(52 - exponent, 62)
    out[full] = (zeros << MANTISSA) + ((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64) + 1
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of rows of sketches of sets of the given sizes, without the registers that are equal by chance.

    The smallest hashes of two independent buckets, exponential with the sets' sizes as rates, lie in one cell with this chance: a cell
    at x is 0.72 x / 2 ** MANTISSA wide on average (1 / (2 ln 2)), and x times both densities integrates to n_a n_b / (n_a + n_b) ** 2.
    """
    both = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    n_a, n_b = np.asarray(n_a, dtype=np.float64), np.asarray(n_b, dtype=np.float64)
    chance = 2.0**-MANTISSA / (2 * np.log(2)) * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2
    return np.clip((same / np.maximum(both, 1) - chance) / (1 - chance), 0, 1)


def _sign(words: int):
    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            n, digest, sketches = [], [], []
            for found in _sets(batch.column(1), words):
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketches.append(sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "text_key", "n_shingles", "digest", "sketch"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        table = _matrix(batch.column(1)).reshape(batch.num_rows, -1, BAND).astype(_U)
        key = np.zeros(table.shape[:2], dtype=_U) + np.arange(table.shape[1], dtype=_U)
        for k in range(BAND):
            key = mix(key * _U(0x9E3779B97F4A7C15) + table[:, :, k])
        filled = table.any(axis=2)
        rep = np.repeat(batch.column(0).to_numpy(), filled.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(key[filled].view(np.int64)), pa.array(rep)], names=["band", "rep"])


def _stars(batches):
    """Of rows sorted by band and document, each document with its band's first one."""
    band = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bands, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(bands), dtype=bool)
        new[1:] = bands[1:] != bands[:-1]
        new[0] = band is None or bands[0] != band
        leaders = np.where(new, reps, 0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(bands)), -1))
        leaders = np.where(at >= 0, reps[np.maximum(at, 0)], first if first is not None else 0)
        band, first = bands[-1], leaders[-1]
        other = leaders != reps
        yield pa.RecordBatch.from_arrays([pa.array(bands[other]), pa.array(leaders[other]), pa.array(reps[other])], names=["band", "a", "b"])


def _likely(batches):
    for batch in batches:
        if batch.num_rows:
            near = estimate(_matrix(batch.column(2)), _matrix(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy())
            keep = pa.array(near >= LOOSE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(near >= CLOSE).filter(keep)], names=["a", "b", "close"])


def _forest(reps: np.ndarray, sketches: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sketches at LOOSE or more."""
    root, out = np.arange(len(reps)), []
    for i in range(len(reps) - 1):
        rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        for j in rest[estimate(sketches[i : i + 1], sketches[rest], sizes[i], sizes[rest]) >= LOOSE].tolist():
            if root[j] != root[i]:
                out.append((int(reps[i]), int(reps[j])))
                root[root == root[j]] = root[i]
    return out


def _among(batches):
    """Of rows (band, low, high, rep, sketch, size) sorted by the first four, likely pairs within each band's block."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks() if held is not None or batch is not None else None
        if table is None:
            return
        rows = table.to_batches()[0]
        keys = np.stack([rows.column(k).to_numpy() for k in range(3)], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(keys))
        if batch is not None:  # the last group may go on
            held = rows.slice(int(starts[-1]))
            starts, ends = starts[:-1], ends[:-1]
        reps, found = rows.column(3).to_numpy(), []
        if len(starts):
            sketches, sizes = _matrix(rows.column(4)), rows.column(5).to_numpy()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                found += _forest(reps[a:b], sketches[a:b], sizes[a:b])
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _unled(stars: DataFrame, likely: DataFrame, sketches: DataFrame, n: int) -> DataFrame:
    """Likely pairs (a, b) among the members of a band that are not close to its first document."""
    apart = written(stars.join(likely.where("close"), ["a", "b"], "left_anti").select("band", F.col("b").alias("rep")), "apart")
    sizes = apart.groupBy("band").agg(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)).cast("int").alias("n_blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    members = apart.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    others = F.when(F.col("n_blocks") > 1, F.array_remove(F.sequence(F.lit(0), F.col("n_blocks") - 1), F.col("block"))).otherwise(F.array(F.lit(0)))
    met = members.join(sketches, "rep").withColumn("other", F.explode(others)).select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "sketch", "n_shingles")
    return met.repartition(n, "band", "low", "high").sortWithinPartitions("band", "low", "high", "rep").mapInArrow(_among, "a long, b long")


def _full_sets(words: int):
    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch.column(1), words)], pa.binary())], names=["rep", "hashes"])

    return run


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; ids ascend. With ``probes``, of the links that these have."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(codes.max()) + 1, dtype=bool)
    root, out = np.arange(len(ids)), []
    for i in range(len(ids)) if probes is None else np.flatnonzero(probes).tolist():
        if probes is None and i and root[i] == root[0]:
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[own] = False
        near = 100 * shared >= percent * (sizes + sizes[i] - shared)
        for j in np.flatnonzero(near & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((int(ids[i]), int(ids[j])))
                low, high = min(root[i], root[j]), max(root[i], root[j])
                root[root == high] = low
    return out


def _linked(percent: int, probing: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep").drop_duplicates("rep") if not probing else group.sort_values(["rep", "probe"], ascending=[True, False]).drop_duplicates("rep")
        sets = [np.frombuffer(x, dtype=_U) for x in group["hashes"]]
        return pd.DataFrame(links(group["rep"].to_numpy(), sets, percent, group["probe"].to_numpy() if probing else None), columns=["a", "b"], dtype="int64")

    return run


def _exact_links(docs: DataFrame, clusters: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning edges (a, b) of all links between nodes of one cluster. ``clusters``: (node, component); ``nodes``: (rep, n_shingles, doc_id, text_key)."""
    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(nodes, "rep")
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("n_blocks"))
    members = written(members.join(blocks, "cluster").select("rep", "doc_id", "text_key", "cluster", "n_blocks", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int").alias("block")), "members")
    wanted = members.select("rep", "doc_id", "text_key")
    if members.count() <= SMALL_ROWS:  # checked: 24 bytes a row
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, ["doc_id", "text_key"]).select("rep", "text").mapInArrow(_full_sets(words), "rep long, hashes binary")
    held = written(members.select("rep", "cluster", "n_blocks", "block").join(sets.dropDuplicates(["rep"]), "rep"), "sets")  # rows may repeat
    leader = held.where((F.col("rep") == F.col("cluster")) & (F.col("n_blocks") > 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    edges = held.unionByName(leader).groupBy("cluster", "block").applyInPandas(_linked(percent, False), "a long, b long")
    large = held.where("n_blocks > 1")
    if not large.limit(1).count():
        return edges
    edges = written(edges, "links")
    reached = connected_components(edges)
    apart = large.select("rep", "cluster", "hashes", "n_blocks").join(reached.withColumnRenamed("node", "rep"), "rep", "left").where(F.coalesce("component", "rep") != F.col("cluster"))
    groups = apart.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)).cast("int").alias("n_probes"))
    probes = apart.join(groups, "cluster").select("cluster", "rep", "hashes", F.pmod(F.xxhash64("rep"), F.col("n_probes")).cast("int").alias("probes"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(True).alias("probe"))
    others = large.join(groups, "cluster").select("cluster", "rep", "hashes", F.explode(F.sequence(F.lit(0), F.col("n_probes") - 1)).alias("probes"), "block", F.lit(False).alias("probe"))
    more = probes.unionByName(others).groupBy("cluster", "block", "probes").applyInPandas(_linked(percent, True), "a long, b long")
    return written(edges.unionByName(more), "links")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, component_id) of each row: ``node`` is the same for all rows of a component, null for rows without links or copies."""
    n = partitions(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).alias("salt")
    signed = written(docs.mapInArrow(_sign(words), "doc_id long, text_key long, n_shingles long, digest binary, sketch binary"), "signatures")
    parts = signed.where("digest is not null and doc_id is not null").groupBy("digest", salt).agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    reps = written(parts.groupBy("digest").agg(F.min("first").alias("first")).select("digest", "first.*", F.monotonically_increasing_id().alias("rep")), "nodes")
    kept = written(signed.join(reps, ["doc_id", "text_key", "digest"]).dropDuplicates(["rep"]).select("rep", "n_shingles", "sketch", "doc_id", "text_key"), "sketches")
    bands = kept.select("rep", "sketch").mapInArrow(_bands, "band long, rep long")
    stars = written(bands.repartition(n, "band").sortWithinPartitions("band", "rep").mapInArrow(_stars, "band long, a long, b long"), "stars")
    sketches = lambda end: kept.select(F.col("rep").alias(end), F.col("sketch").alias(f"sketch_{end}"), F.col("n_shingles").alias(f"n_{end}"))
    pairs = stars.select("a", "b").distinct().join(sketches("b"), "b").join(sketches("a"), "a")
    likely = written(pairs.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(_likely, "a long, b long, close boolean"), "likely")
    clusters = connected_components(likely.select("a", "b").unionByName(_unled(stars, likely, kept.select("rep", "sketch", "n_shingles"), n)))
    found = connected_components(_exact_links(docs, clusters, kept.select("rep", "n_shingles", "doc_id", "text_key"), words, percent))
    linked = written(reps.select("rep", "digest", "doc_id").join(found.select(F.col("node").alias("rep"), F.col("component").alias("node")), "rep", "left").select("digest", "doc_id", F.coalesce("node", "rep").alias("node")), "linked")
    names = linked.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    named = parts.select("digest", "salt").join(linked.join(names, "node").select("digest", "node", "component_id"), "digest")
    rows = signed.select("doc_id", "text_key", "n_shingles", "digest", salt).join(named, ["digest", "salt"], "left")
    known = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "text_key", "n_shingles", F.when(known, F.col("node")).alias("node"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row; a component is named by its smallest id."""
    return _grouped(docs, id_col, text_col, words, percent).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, less all but one row of each component: the one with its smallest id stays. Rows with a null id or without words stay."""
    found = _grouped(docs, id_col, text_col, words, percent).where("node is not null")
    stay = found.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(text_col).rlike(WORD) & F.col(id_col).isNotNull(), F.lit(False)).alias("judged"))
    first = rows.where("judged").join(stay, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return first.select("row.*").unionByName(rows.where("not judged").select("row.*"))


def op7(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM d WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * n_shared >= 80 * (x.n + y.n - n_shared)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT a, b FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) r USING (doc_id)
"""
