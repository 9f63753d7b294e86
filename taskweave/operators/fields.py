"""Field-aware text features: fitted on training rows, saved, and applied to rows never seen before.

A block is a text column cut into terms by one analyser, with its own vocabulary, inverse document frequencies and weight. Vocabularies
have caps, so the fitted table is bounded by the sum of the blocks' caps and is broadcast; a row's terms are counted, weighed and
gathered inside a task where its texts are (``coded``), so only texts and a task's sums by word are shuffled. Weights are those of ``features.tfidf``: sublinear counts, smooth inverse document
frequencies of the training rows, length 1 within a block, times the block's weight.

A null text has no terms; a row without known terms has empty arrays. Ids must not repeat.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.operators import coded as C
from taskweave.operators import features as X
from taskweave.operators import text as T
from taskweave.shared import written

VERSION = 1
#: The most terms of all blocks that are broadcast; a larger table is joined in a shuffle.
BROADCAST_TERMS = 2_000_000
TERMS = "block int, term string, index int, idf double"


@dataclass(frozen=True)
class Block:
    name: str
    column: str
    analyser: str  # word, char, char_wb or slug, which joins the columns action and object into one term
    low: int
    high: int
    least_df: int
    most: int
    weight: float

    def grams(self) -> X.Grams:
        return X.Grams("whole") if self.analyser == "slug" else X.Grams(self.analyser, self.low, self.high)

    def lookup(self, terms: list[str], index: np.ndarray):
        """Finds terms in prepared texts; indexes rise."""
        if self.analyser == "char_wb":
            return C.Inside(self.grams(), terms, index)
        return C.Lookup(terms, index) if self.analyser == "word" else C.Strings(self.grams().of, terms, index)

    def text(self) -> Column:
        """What n-grams are taken of, from columns without accents."""
        plain = lambda c: T.strip_accents(F.col(c))
        if self.analyser == "slug":
            return F.lower(F.concat(X.slug("A_", plain("action")), X.slug("__O_", plain("object"))))
        return plain(self.column) if self.analyser == "word" else T.normalize_ws(plain(self.column))  # words are cut from white space anyway


#: Names, columns, analysers, n-gram ranges, least document frequencies, caps and weights of the two profiles.
PROFILES = {
    "champion": (
        Block("task_word", "task", "word", 1, 2, 2, 220_000, 1.0),
        Block("task_char_wb", "task", "char_wb", 2, 6, 2, 220_000, 0.65),
        Block("task_char_raw", "task", "char", 3, 6, 2, 250_000, 0.45),
        Block("title_word", "jobrole_title", "word", 1, 3, 1, 100_000, 0.5),
        Block("action_word", "action", "word", 1, 2, 1, 20_000, 0.9),
        Block("object_word", "object", "word", 1, 2, 1, 120_000, 0.8),
        Block("purpose_word", "purpose", "word", 1, 2, 1, 60_000, 0.5),
        Block("action_object_word", "action", "slug", 1, 1, 1, 120_000, 0.7),
    ),
    "basic": (
        Block("task_word", "task", "word", 1, 2, 2, 40_000, 1.0),
        Block("task_char_wb", "task", "char_wb", 3, 5, 2, 30_000, 0.65),
        Block("title_word", "jobrole_title", "word", 1, 2, 1, 8_000, 0.5),
        Block("action_word", "action", "word", 1, 2, 1, 2_000, 0.9),
        Block("object_word", "object", "word", 1, 2, 1, 30_000, 0.8),
        Block("purpose_word", "purpose", "word", 1, 2, 1, 15_000, 0.5),
        Block("action_object_word", "action", "slug", 1, 1, 1, 15_000, 0.7),
    ),
}


def prepared(blocks) -> list[Column]:
    """The blocks' texts, as ``_t0`` and so on."""
    return [b.grams().prepared(b.text()).alias(f"_t{i}") for i, b in enumerate(blocks)]


def dealt(df: DataFrame, row: str) -> DataFrame:
    """Rows in as many parts as a shuffle makes, whatever the files were; texts are made after that."""
    return df.repartition(X.partitions(df.sparkSession), row)


def laid(df: DataFrame, row: str, blocks, kept: list) -> DataFrame:
    """Some columns and the blocks' texts."""
    return dealt(df, row).select(*kept, *prepared(blocks))


def texts(df: DataFrame, row: str, blocks, kept: list[str]) -> DataFrame:
    """Stored: the row's id, other columns, and the blocks' texts, for ``fit_texts`` and ``vectors``."""
    return written(dealt(df, row).select(row, *kept, *prepared(blocks)), "texts")


def block_counts(df: DataFrame, row: str, blocks) -> DataFrame:
    """(row, block, term, tf)."""
    return X.counted(df, row, [(b.grams(), b.text()) for b in blocks])


def _frequencies(grams: X.Grams):
    """(term, df, total) of n-grams that are counted as strings."""
    return C.term_counts(lambda text: grams.of(text) if text is not None else [])


class _Known:
    """The fitted terms as they are sent to tasks; a worker makes its look-up tables once."""

    def __init__(self, table: pa.Table):
        self.table, self.tables = table, None

    def __getstate__(self):
        return (self.table,)

    def __setstate__(self, state):
        (self.table,), self.tables = state, None

    def lookups(self, blocks) -> tuple[list, np.ndarray]:
        """For each block a lookup of its terms, and by number the inverse document frequencies."""
        if self.tables is None:
            block, term, index, idf = (self.table.column(c) for c in ("block", "term", "index", "idf"))
            block, index = block.to_numpy(), index.to_numpy().astype(np.int64)
            weights = np.zeros(int(index.max()) + 1 if len(index) else 0)
            weights[index] = idf.to_numpy()
            made = []
            for k, b in enumerate(blocks):
                of = np.flatnonzero(block == k)
                of = of[np.argsort(index[of])]
                made.append(b.lookup(term.take(pa.array(of)).to_pylist(), index[of]))
            self.tables = made, weights
        return self.tables

    def names(self) -> pa.Array:
        """Terms by number."""
        index = self.table.column("index").to_numpy()
        out = np.empty(int(index.max()) + 1 if len(index) else 0, dtype=np.int64)
        out[index] = np.arange(len(index))
        return self.table.column("term").combine_chunks().take(pa.array(out))


def _weighed(sent, blocks, kept: int):
    """Of rows of columns that stay, then texts: (a few of the rows, of each block the rows' numbers, indexes and weights). Weights are scaled to length 1 and by the block's weight."""

    def run(batches):
        lookups, idf = sent.value.lookups(blocks)
        width = max(1, len(idf))
        for batch in batches:
            columns = [batch.column(kept + k).to_pylist() for k in range(len(blocks))]
            for a, z in C.parts_of(columns[0]) if len(blocks) == 1 else C.parts_of(["".join(t or "" for t in row) for row in zip(*columns, strict=True)]):
                parts = []
                for lookup, b, column in zip(lookups, blocks, columns, strict=True):
                    at, of, tf = lookup.counts(column[a:z], width)
                    raw = (1 + np.log(tf)) * idf[of]
                    norm = np.sqrt(np.bincount(at, weights=raw * raw, minlength=z - a))
                    parts.append((at, of, raw * (b.weight / norm[at])))
                yield batch.slice(a, z - a), parts

    return run


def _lists(kind: pa.DataType, offsets, values):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(offsets)]), pa.int32()), pa.array(values, kind))


def _block_lists(sent, blocks):
    def run(batches):
        names = None
        for rows, parts in _weighed(sent, blocks, 1)(batches):
            names = sent.value.names() if names is None else names
            for k, (at, of, weights) in enumerate(parts):
                sizes = np.bincount(at, minlength=len(rows))
                full = np.flatnonzero(sizes)
                if len(full):
                    terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[full])]), pa.int32()), names.take(pa.array(of)))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(full)), pa.array(np.full(len(full), k, dtype=np.int32)), terms, _lists(pa.int32(), sizes[full], of.astype(np.int32)), _lists(pa.float64(), sizes[full], weights)], names=["row", "block", "terms", "indexes", "weights"])

    return run


def _vectors(sent, blocks, kept: int):
    """Rows of columns that stay, then texts, with the latter's known terms in place of them."""

    def run(batches):
        for few, parts in _weighed(sent, blocks, kept)(batches):
            rows, index, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(rows, kind="stable")  # blocks' numbers follow each other
            sizes = np.bincount(rows, minlength=len(few))
            yield pa.RecordBatch.from_arrays([*few.columns[:kept], _lists(pa.int32(), sizes, index[order].astype(np.int32)), _lists(pa.float64(), sizes, value[order])], names=[*few.schema.names[:kept], "index", "value"])

    return run


def of_block(blocks, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("block") + 1)


class _Shared(Params):
    idCol = Param(Params._dummy(), "idCol", "column of the row's id", TypeConverters.toString)
    blocks = Param(Params._dummy(), "blocks", "the blocks, each as a list of its fields", TypeConverters.toList)

    def own_blocks(self) -> tuple[Block, ...]:
        return tuple(Block(*b) for b in self.getOrDefault(self.blocks))


class FieldFeatures(Estimator, _Shared):
    """Vocabularies and frequencies of the rows it is fitted on."""

    @keyword_only
    def __init__(self, *, idCol="task_id", blocks=None):
        super().__init__()
        self._set(idCol=idCol, blocks=[list(astuple(b)) if isinstance(b, Block) else list(b) for b in (blocks or PROFILES["basic"])])

    def _fit(self, dataset: DataFrame) -> FieldFeaturesModel:
        return self.fit_texts(texts(dataset, self.getOrDefault(self.idCol), self.own_blocks(), []))

    def fit_texts(self, stored: DataFrame) -> FieldFeaturesModel:
        """The same of rows of ``texts``. Vocabularies of words are found level by level, those of n-grams inside words by the counts of words."""
        found = [self._vocabulary(stored, f"_t{i}", b) for i, b in enumerate(self.own_blocks())]
        n, sizes = stored.count(), list(map(len, found))
        block = pa.array(np.repeat(np.arange(len(found), dtype=np.int32), sizes))
        term, df = (pa.array([x[k] for v in found for x in v], kind) for k, kind in enumerate((pa.string(), pa.int64())))
        known = stored.sparkSession.createDataFrame(pa.table({"block": block, "term": term, "index": pa.array(range(len(term)), pa.int32()), "df": df}))  # as many as the caps allow
        terms = known.select("block", "term", "index", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
        return FieldFeaturesModel(idCol=self.getOrDefault(self.idCol), blocks=[list(astuple(b)) for b in self.own_blocks()])._with(written(terms, "terms"), n, sizes)

    @staticmethod
    def _vocabulary(stored: DataFrame, column: str, b: Block) -> list[tuple[str, int]]:
        """(term, df) of a block's vocabulary, the most frequent first."""
        found = None
        if b.analyser == "slug":
            found = C.whole_vocabulary(stored, column, b.least_df, b.most)
        elif b.analyser == "char_wb":
            found = C.inside_vocabulary(stored, column, b.grams(), b.least_df, b.most)
        elif b.analyser == "word" and b.low == 1:
            found = C.vocabulary(stored, column, b.high, b.least_df, b.most)
        if found is not None:
            return found
        parts = stored.select(column).mapInArrow(_frequencies(b.grams()), "term string, df long, total long")
        every = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= b.least_df)
        table = every.orderBy(F.desc("total"), "term").limit(b.most).select("term", "df").toArrow()
        return list(zip(table.column("term").to_pylist(), table.column("df").to_pylist(), strict=True))


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"version": VERSION, **self.instance.extra()})
        self.instance.table().write.parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        if held.get("version") != VERSION:
            raise ValueError("the model has another version")
        found = self.kind()
        DefaultParamsReader.getAndSetParams(found, held)
        return found.restored(self.sparkSession.read.schema(self.kind.SCHEMA).parquet(f"{path}/table"), held)


class Stored(MLWritable, MLReadable):
    """A model that is a table and some metadata. Kinds have ``SCHEMA``, ``table()``, ``extra()`` and ``restored()``."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class FieldFeaturesModel(Model, _Shared, Stored):
    """Adds ``index`` and ``value``, a row's features in the order of their numbers."""

    SCHEMA = TERMS

    @keyword_only
    def __init__(self, *, idCol="task_id", blocks=None):
        super().__init__()
        self._set(idCol=idCol, blocks=blocks or [])
        self.terms, self.rows, self.sizes = None, 0, []

    def _with(self, terms: DataFrame, rows: int, sizes: list[int]) -> FieldFeaturesModel:
        self.terms, self.rows, self.sizes = terms, rows, sizes
        return self

    def table(self) -> DataFrame:
        return self.terms

    def extra(self) -> dict:
        return {"rows": self.rows, "sizes": self.sizes}

    def restored(self, table: DataFrame, held: dict) -> FieldFeaturesModel:
        return self._with(table, held["rows"], held["sizes"])

    @property
    def width(self) -> int:
        return sum(self.sizes)

    def ranges(self, *names: str) -> tuple[tuple[int, int], ...]:
        """The numbers of some blocks' features, each block's as (first, past the last)."""
        out, start = [], 0
        for b, size in zip(self.own_blocks(), self.sizes, strict=True):
            if b.name in names:
                out.append((start, start + size))
            start += size
        return tuple(out)

    def _sent(self):
        known = _Known(self.terms.select("block", "term", "index", "idf").toArrow().combine_chunks())  # BROADCAST_TERMS at most
        return self.terms.sparkSession.sparkContext.broadcast(known)

    def lists(self, dataset: DataFrame) -> DataFrame:
        """(row, block, terms, indexes, weights) of the known terms, as arrays in the order of the indexes; blocks without any are left out."""
        row, blocks = self.getOrDefault(self.idCol), self.own_blocks()
        if self.width <= BROADCAST_TERMS:
            kind = dataset.schema[row].dataType.simpleString()
            return laid(dataset, row, blocks, [F.col(row).alias("row")]).mapInArrow(_block_lists(self._sent(), blocks), f"row {kind}, block int, terms array<string>, indexes array<int>, weights array<double>").withColumnRenamed("row", row)
        raw = block_counts(dataset, row, blocks).join(self.terms, ["block", "term"]).withColumn("raw", (1 + F.ln("tf")) * F.col("idf"))
        x = raw.groupBy(row, "block").agg(F.array_sort(F.collect_list(F.struct("index", "term", "raw"))).alias("x"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        weight = of_block(blocks, [b.weight for b in blocks]) / F.col("norm")
        return x.withColumn("by", weight).select(row, "block", F.transform("x", lambda t: t["term"]).alias("terms"), F.transform("x", lambda t: t["index"]).alias("indexes"), F.transform("x", lambda t: t["raw"] * F.col("by")).alias("weights"))

    def weights(self, dataset: DataFrame) -> DataFrame:
        """(row, block, term, index, weight) of the known terms."""
        flat = self.lists(dataset).select(self.getOrDefault(self.idCol), "block", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("indexes").alias("index"), F.col("weights").alias("weight"))))
        return flat.toDF(*flat.columns[:2], "term", "index", "weight")

    def vectors(self, stored: DataFrame) -> DataFrame:
        """Rows of ``texts`` with ``index`` and ``value`` in place of their texts, where they are. At most ``BROADCAST_TERMS`` terms."""
        blocks = self.own_blocks()
        own = [f"_t{i}" for i in range(len(blocks))]
        kept = stored.drop(*own)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        return stored.select(*kept.columns, *own).mapInArrow(_vectors(self._sent(), blocks, len(kept.columns)), f"{columns}, index array<int>, value array<double>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        row, blocks = self.getOrDefault(self.idCol), self.own_blocks()
        if self.width <= BROADCAST_TERMS:
            return self.vectors(laid(dataset, row, blocks, dataset.columns))
        x = self.lists(dataset).groupBy(row).agg(F.array_sort(F.collect_list(F.struct("block", "indexes", "weights"))).alias("x"))  # blocks' numbers follow each other
        vectors = x.select(row, F.flatten(F.transform("x", lambda t: t["indexes"])).alias("index"), F.flatten(F.transform("x", lambda t: t["weights"])).alias("value"))
        empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
        return dataset.join(vectors, row, "left").select(*dataset.columns, empty("index", "int"), empty("value", "double"))
