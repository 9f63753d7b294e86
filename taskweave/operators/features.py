"""Text features as long tables (row, term, ...) by joins and aggregates; vectors only for estimators."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskweave.operators.text import strip_accents
from taskweave.shared import partitions

#: Words that ``Grams.counter`` remembers.
HELD_WORDS = 1 << 15
WORD = r"[\p{L}\p{N}_]{2,}"
#: A short list of English words that carry little in titles and tasks; operators take another as ``stop``.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def word_tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside the lambdas of ``use`` the expression itself would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def _grams_of(tokens: Column, n: int, glue: str) -> Column:
    count = F.size(tokens) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), glue))).otherwise(F.array().cast("array<string>"))


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    """All word n-grams, with repeats."""
    return bound(word_tokens(text), lambda tokens: F.concat(*[_grams_of(tokens, n, " ") for n in range(low, high + 1)]))


def char_ngrams(text: Column, low: int = 3, high: int = 4) -> Column:
    """All character n-grams of the lower-cased, collapsed text."""
    characters = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "), F.lit("(?s)."), F.lit(0))
    return bound(characters, lambda c: F.concat(*[_grams_of(c, n, "") for n in range(low, high + 1)]))


def char_wb_ngrams(text: Column, low: int = 3, high: int = 4) -> Column:
    """Character n-grams inside words padded by spaces; a padded word that is no longer than n comes once and has no longer n-grams."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(w)

        def one(n: int) -> Column:
            whole = F.when(size > n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
            return whole.when((size <= n) & ((size > n - 1) | F.lit(n == low)), F.array(w)).otherwise(F.array().cast("array<string>"))

        return F.concat(*[one(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, of))


@dataclass(frozen=True)
class Grams:
    """The n-grams of a text, like ``word_ngrams``, ``char_ngrams`` and ``char_wb_ngrams``, in a form that is counted row by row inside a task."""

    analyser: str  # word, char, char_wb, letters (runs of two or more of a to z), split (what spaces part), or whole, whose only term is the text
    low: int = 1
    high: int = 1
    plain: bool = False  # marks are taken off, as "strip_accents" does

    def prepared(self, text: Column) -> Column:
        """The text as ``of`` takes it."""
        text = strip_accents(F.lower(text)) if self.plain else text
        if self.analyser == "word":
            return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
        if self.analyser == "letters":
            return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " ")
        return text if self.analyser == "whole" else F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")

    def of(self, text: str) -> list[str]:
        """All n-grams of a prepared text, with repeats."""
        sizes = range(self.low, self.high + 1)
        if self.analyser == "whole":
            return [text]
        if self.analyser == "split":
            return [w for w in text.split(" ") if w]
        if self.analyser in ("word", "letters"):
            tokens = [t for t in text.split(" ") if len(t) > 1]
            return [t for n in sizes for t in (tokens if n == 1 else map(" ".join, zip(*[tokens[i:] for i in range(n)], strict=False)))]
        if self.analyser == "char":
            return [text[i : i + n] for n in sizes for i in range(len(text) - n + 1)]
        return [t for word in text.split(" ") if word for t in self.inside(word)]

    def inside(self, word: str) -> list[str]:
        """The n-grams of one word, padded by spaces."""
        w, out = f" {word} ", []
        size = len(w)
        for n in range(self.low, self.high + 1):
            if size > n:
                out += [w[i : i + n] for i in range(size - n + 1)]
            elif size == n or n == self.low:
                out.append(w)
        return out

    def counter(self):
        """A function that counts a prepared text's n-grams; words that come again are not taken apart again."""
        if self.analyser != "char_wb":
            return lambda text: Counter(self.of(text))
        held: dict[str, list[str]] = {}

        def count(text: str) -> Counter:
            words = [w for w in text.split(" ") if w]
            if len(held) > HELD_WORDS:
                held.clear()
            for w in words:
                if w not in held:
                    held[w] = self.inside(w)
            return Counter(chain.from_iterable(map(held.__getitem__, words)))

        return count


def laid_texts(df: DataFrame, row: str, texts: list[Column]) -> DataFrame:
    """(row, a column for each text), rows of one id side by side in one partition."""
    return df.select(row, *[t.alias(f"_t{i}") for i, t in enumerate(texts)]).repartition(partitions(df.sparkSession), row).sortWithinPartitions(row)


def row_counts(batches, grams: list[Grams]):
    """(row, [terms and their numbers for each of ``grams``]) of what ``laid_texts`` has laid; rows that repeat an id are counted together."""
    held, counts, ways = None, [], [g.counter() for g in grams]
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(1 + len(grams))]
        for i, row in enumerate(columns[0]):
            if counts and row != held:
                yield held, counts
                counts = []
            found = [count(columns[k + 1][i]) if columns[k + 1][i] is not None else Counter() for k, count in enumerate(ways)]
            held, counts = row, [a + b for a, b in zip(counts, found, strict=True)] if counts else found
    if counts:
        yield held, counts


#: Terms that a task holds before it sends them on.
TERMS_AT_ONCE = 1 << 18


def _counted(grams: list[Grams], kind: pa.DataType):
    def out(rows, sizes, block, terms, tf):
        return pa.RecordBatch.from_arrays([pa.array(rows, kind).take(pa.array(np.repeat(np.arange(len(rows)), sizes))), pa.array(np.repeat(np.array(block, dtype=np.int32), sizes)), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=["row", "block", "term", "tf"])

    def run(batches):
        rows, sizes, block, terms, tf = [], [], [], [], []
        for row, counts in row_counts(batches, grams):
            for k, count in enumerate(counts):
                rows.append(row)
                block.append(k)
                sizes.append(len(count))
                terms += count.keys()
                tf += count.values()
            if len(terms) >= TERMS_AT_ONCE:
                yield out(rows, sizes, block, terms, tf)
                rows, sizes, block, terms, tf = [], [], [], [], []
        if terms:
            yield out(rows, sizes, block, terms, tf)

    return run


def counted(df: DataFrame, row: str, texts: list[tuple[Grams, Column]]) -> DataFrame:
    """(row, block, term, tf) of several texts, numbered as blocks. Only texts are shuffled, by row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[row].dataType
    laid = laid_texts(df, row, [g.prepared(text) for g, text in texts])
    return laid.mapInArrow(_counted([g for g, _ in texts], to_arrow_type(kind)), f"row {kind.simpleString()}, block int, term string, tf long").withColumnRenamed("row", row)


def term_counts(df: DataFrame, row: str, terms: Column | tuple[Grams, Column]) -> DataFrame:
    """(row, term, tf) of an array of terms, or of a text's n-grams."""
    if isinstance(terms, tuple):
        return counted(df, row, [terms]).select(row, "term", "tf")
    return df.select(row, F.explode(terms).alias("term")).groupBy(row, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, least_df: int = 2, most: int | None = None) -> DataFrame:
    """(term, df, total): terms in enough rows; of those the most frequent, ties by term."""
    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least_df)
    return v if most is None else v.orderBy(F.desc("total"), "term").limit(most)


#: Distinct terms, and terms of rows, that a task of ``known_shares`` holds before it sends on what it does not know.
HELD_NAMES, HELD_PAIRS = 1 << 20, 1 << 24


def _unknown(grams: list[Grams], least_df: int, kind: pa.DataType):
    """Of a task's rows what its own reference rows leave open; see ``known_shares``."""

    def out(rows, block, term, n, known, seen):
        return pa.RecordBatch.from_arrays([rows, pa.array(np.full(len(n), block, dtype=np.int32)), term, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(seen, pa.int64())], names=["row", "block", "term", "n", "known", "seen"])

    def sent(rows, of, block, names, parts, tfs):
        sizes = np.array([len(p) for p in parts])
        at, term, tf = np.repeat(np.arange(len(rows)), sizes), np.concatenate(parts), np.concatenate(tfs)
        ref = np.array(of)[at]
        common = np.bincount(term[ref], minlength=len(names)) >= least_df
        total = lambda keep: np.bincount(at[keep], weights=tf[keep], minlength=len(rows)).astype(np.int64)
        ids, nothing = pa.array(rows, kind), np.zeros(len(rows), dtype=np.int64)
        yield out(ids, block, pa.nulls(len(rows), pa.string()), total(slice(None)), total(common[term]), nothing)
        terms, sure = pa.array(list(names), pa.string()), np.flatnonzero(common)
        open_ = np.flatnonzero(~common[term])
        for i in range(0, len(sure), TERMS_AT_ONCE):
            own = sure[i : i + TERMS_AT_ONCE]
            none = np.zeros(len(own), dtype=np.int64)
            yield out(pa.nulls(len(own), kind), block, terms.take(pa.array(own)), none, none, none + least_df)
        for i in range(0, len(open_), TERMS_AT_ONCE):
            own = open_[i : i + TERMS_AT_ONCE]
            yield out(ids.take(pa.array(at[own])), block, terms.take(pa.array(term[own])), tf[own], np.zeros(len(own), dtype=np.int64), ref[own].astype(np.int64))

    def empty():
        names = [defaultdict() for _ in grams]
        for known in names:
            known.default_factory = known.__len__  # a new term gets the next number
        return [], [], names, [{} for _ in grams], [[] for _ in grams], [[] for _ in grams], 0

    def numbered(count, names):
        return np.fromiter(map(names.__getitem__, count), dtype=np.int32, count=len(count)), np.fromiter(count.values(), dtype=np.int32, count=len(count))

    def of_words(count, g, names, words):
        """The same of n-grams inside words, from how often a row has each word: a word is taken apart once."""
        for w in count:
            if w not in words:
                words[w] = np.fromiter(map(names.__getitem__, own := g.inside(w)), dtype=np.int32, count=len(own))
        if not count:
            return numbered(count, names)
        lists = [words[w] for w in count]
        term, at = np.unique(np.concatenate(lists), return_inverse=True)
        return term, np.bincount(at, weights=np.repeat(np.fromiter(count.values(), dtype=np.int64), [len(x) for x in lists])).astype(np.int32)

    def run(batches):
        rows, of, names, words, parts, tfs, size = empty()
        for row, (*counts, ref) in row_counts(batches, [*[Grams("split") if g.analyser == "char_wb" else g for g in grams], Grams("whole")]):
            rows.append(row)
            of.append(bool(ref))
            for k, (g, count) in enumerate(zip(grams, counts, strict=True)):
                term, tf = of_words(count, g, names[k], words[k]) if g.analyser == "char_wb" else numbered(count, names[k])
                parts[k].append(term)
                tfs[k].append(tf)
                size += len(term)
            if size >= HELD_PAIRS or sum(map(len, names)) >= HELD_NAMES:
                for k in range(len(grams)):
                    yield from sent(rows, of, k, names[k], parts[k], tfs[k])
                rows, of, names, words, parts, tfs, size = empty()
        if rows:
            for k in range(len(grams)):
                yield from sent(rows, of, k, names[k], parts[k], tfs[k])

    return run


def known_shares(df: DataFrame, row: str, texts: list[tuple[Grams, Column]], of: Column, least_df: int = 2) -> DataFrame:
    """(row, n_0, known_0, n_1, ...): of each text how many terms a row has, with repeats, and how many of them ``least_df`` rows ``of`` the reference have.

    A task counts its rows once. Terms that enough of its own reference rows have are known whatever others hold, so it sends only their
    names, each row's totals, and the rarer terms with their rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, grams = df.schema[row].dataType, [g for g, _ in texts]
    rows = laid_texts(df, row, [*[g.prepared(text) for g, text in texts], F.when(of, "")])
    found = rows.mapInArrow(_unknown(grams, least_df, to_arrow_type(kind)), f"row {kind.simpleString()}, block int, term string, n long, known long, seen long")
    own = F.when(F.col("term").isNull(), F.col("row"))  # totals lie by row
    met = found.withColumn("_df", F.sum("seen").over(Window.partitionBy("term", "block", own))).where(F.col("term").isNull() | ((F.col("seen") < least_df) & (F.col("_df") >= least_df)))
    total, more = F.when(F.col("term").isNull(), F.col("n")), F.when(F.col("term").isNull(), F.col("known")).otherwise(F.col("n"))
    each = lambda value, k: F.sum(F.when(F.col("block") == k, value))
    return met.groupBy("row").agg(*[x for k in range(len(texts)) for x in (each(total, k).alias(f"n_{k}"), each(more, k).alias(f"known_{k}"))]).withColumnRenamed("row", row)


def tfidf(counts: DataFrame, row: str, vocab: DataFrame, n_rows: DataFrame, sublinear: bool = True, normalize: bool = True, idf: bool = True) -> DataFrame:
    """(row, term, weight): ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, scaled to length 1 in each row. ``n_rows``: one row, ``n``."""
    return _weighed(counts.join(vocab.select("term", "df"), "term"), row, n_rows, sublinear, normalize, idf)


def _weighed(known: DataFrame, row: str, n_rows: DataFrame, sublinear: bool = True, normalize: bool = True, idf: bool = True) -> DataFrame:
    """``tfidf`` of (row, term, tf, df)."""
    tf = 1 + F.ln("tf") if sublinear else F.col("tf").cast("double")
    known = known.crossJoin(F.broadcast(n_rows))
    raw = known.select(row, "term", (tf * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1 if idf else 1.0)).alias("weight"))
    if not normalize:
        return raw
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(row)))  # a row's terms travel once
    return raw.select(row, "term", (F.col("weight") / norm).alias("weight"))


def tfidf_of(df: DataFrame, row: str, terms: Column | tuple[Grams, Column], least_df: int = 2, most: int | None = None) -> DataFrame:
    """``tfidf`` with the vocabulary of the rows themselves. Without ``most``, counts are made once and meet their term's frequency where they lie by term."""
    counts, n_rows = term_counts(df, row, terms), df.agg(F.count("*").alias("n"))
    if most is not None:
        return tfidf(counts, row, vocabulary(counts, least_df, most), n_rows)
    frequency = F.count("*").over(Window.partitionBy("term"))
    return _weighed(counts.withColumn("df", frequency).where(F.col("df") >= least_df), row, n_rows)


def blocks(df: DataFrame, row: str, specs: list[tuple[str, Column | tuple[Grams, Column], float]], least_df: int = 2, most: int | None = None) -> DataFrame:
    """(row, term, weight) of several weighted views; terms carry the block's name."""
    out = None
    for name, terms, weight in specs:
        part = tfidf_of(df, row, terms, least_df, most).select(row, F.concat(F.lit(f"{name}="), "term").alias("term"), (F.col("weight") * weight).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def slug(prefix: str, text: Column) -> Column:
    """ASCII letters and digits of a text, with one underscore for what lies between them."""
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_")
    return F.concat(F.lit(prefix), F.regexp_replace(joined, "^_|_$", ""))


def cross_pairs(left: Column, right: Column, most_left: int, most_right: int, mark: str = "__X__", stop=STOP) -> Column:
    """Pairs of the first content words of two texts."""
    content = lambda c, n: F.slice(F.filter(word_tokens(c), lambda t: ~t.isin(*stop)), 1, n)
    a = content(left, most_left)
    return bound(content(right, most_right), lambda b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(mark), y)))))


def nb_ratio(counts: DataFrame, row: str, labels: DataFrame, positive: Column) -> DataFrame:
    """(term, ratio): the log of the term's smoothed share among positive rows over that among the others, rows counted once a term."""
    seen = counts.join(labels, row)
    each = seen.groupBy("term").agg((F.sum(positive.cast("int")) + 1).alias("p"), (F.sum((~positive).cast("int")) + 1).alias("q"))
    total = each.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return each.crossJoin(F.broadcast(total)).select("term", (F.ln(F.col("p") / F.col("_p")) - F.ln(F.col("q") / F.col("_q"))).alias("ratio"))


def scaled(df: DataFrame, columns: list[str], with_mean: bool = True, of: Column | None = None) -> DataFrame:
    """Columns divided by their standard deviation (0 leaves them), after taking off the mean; both are those of the rows ``of``, or of all."""
    value = (lambda c: F.col(c)) if of is None else (lambda c: F.when(of, F.col(c)))
    stats = df.agg(*[F.mean(value(c)).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(value(c)).alias(f"_s_{c}") for c in columns])
    one = lambda c: (F.col(c) - (F.col(f"_m_{c}") if with_mean else 0)) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).select(*[F.col(c) if c not in columns else one(c).alias(c) for c in df.columns])


def unit(vector: Column) -> Column:
    """An array scaled to length 1; zero vectors stay."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def top_terms(counts: DataFrame, most: int = 50, least_df: int = 2) -> DataFrame:
    """(term, df), the most widely used first."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df).orderBy(F.desc("df"), "term").limit(most)


def activity(counts: DataFrame, row: str, vocab: DataFrame) -> DataFrame:
    """(row, active, known_share): distinct known terms, and the share of known ones among the row's terms, with repeats."""
    seen = counts.join(vocab.select("term", F.lit(1).alias("_k")), "term", "left")
    return seen.groupBy(row).agg(F.count("_k").alias("active"), (F.coalesce(F.sum(F.when(F.col("_k") == 1, F.col("tf"))), F.lit(0)) / F.sum("tf")).alias("known_share"))


def vectors(weights: DataFrame, row: str, size: int = 1 << 18) -> DataFrame:
    """(row, features): hashed sparse vectors for Spark ML."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    slots = weights.groupBy(row, F.pmod(F.xxhash64("term"), F.lit(size)).cast("int").alias("_i")).agg(F.sum("weight").alias("_w"))
    lists = slots.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("_i", "_w"))).alias("_x"))

    @F.udf(VectorUDT())  # Spark ML's vectors have no built-in constructor of sparse rows
    def vector(x):
        return SparseVector(size, [i["_i"] for i in x], [i["_w"] for i in x])

    return lists.select(row, vector("_x").alias("features"))
