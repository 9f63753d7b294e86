"""Word n-grams and n-grams inside words as numbers: fitted and looked up over whole batches of texts, without a string for each n-gram.

An n-gram comes no more often, and in no more rows, than the (n-1)-grams that it is made of. So a vocabulary of the most frequent terms grows
level by level: all words are counted; of longer n-grams only those whose parts are in enough rows and come as often as the last term that the
cap has room for so far. What is left out cannot be in the vocabulary. From the second level on, numbers are shuffled in place of strings.

n-grams inside words come as often as their words say, so a vocabulary of them is ranked by the counts of words; texts are read once more for
the rows that have them. A word is taken apart once, not each time it comes.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a task whose counts it holds, and words that it takes at once.
HELD_WORDS, WORDS_AT_ONCE = 1 << 18, 1 << 21
#: Texts whose words are taken apart together, and words that a lookup of n-grams inside words holds taken apart.
TEXTS_AT_ONCE, KEPT_WORDS = 64, 1 << 16
#: The most words that are sent to tasks; texts with more such words are counted as strings.
SENT_WORDS = 2_000_000


def tokens(text: str | None) -> list[str]:
    """The words of a text that ``features.Grams`` has prepared."""
    return [t for t in text.split(" ") if len(t) > 1] if text else []


def split_words(text: str | None) -> list[str]:
    """What spaces part."""
    return [w for w in text.split(" ") if w] if text else []


def term_counts(terms):
    """(term, df, total) of a task's texts, in parts of at most ``HELD_WORDS`` terms and a text's. ``terms``: a text's terms, with repeats."""

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(map(df.__getitem__, total), pa.int64()), pa.array(total.values(), pa.int64())], names=["term", "df", "total"])

        df, total = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(text)
                total.update(found)
                df.update(set(found))
                if len(total) >= HELD_WORDS:
                    yield out()
                    df, total = Counter(), Counter()
        yield out()

    return run


class Levels:
    """Words and the n-grams of each level, by number. An n-gram of level n is the (n-1)-gram that it begins with, times the number of words, and its last word."""

    def __init__(self, words: list[str]):
        self.words, self.size, self.codes, self._ids = words, max(1, len(words)), [], None

    def __getstate__(self):
        return self.words, self.size, self.codes

    def __setstate__(self, state):
        (self.words, self.size, self.codes), self._ids = state, None

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word of each place, text of each place); unknown words, and a place after each text, are -1."""
        if self._ids is None:  # once a worker
            self._ids = dict(zip(self.words, range(len(self.words)), strict=True))
        known, places, sizes = self._ids.get, [], []
        for text in texts:
            words = tokens(text)
            sizes.append(len(words) + 1)
            places += [known(w, -1) for w in words]
            places.append(-1)
        return np.array(places, dtype=np.int64), np.repeat(np.arange(len(texts)), sizes)

    def longer(self, words: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """The codes of the n-grams that begin at each place, or -1, from the (n-1)-grams there."""
        out = np.full(len(words), -1, dtype=np.int64)
        if len(words) >= n:
            start, end = last[: len(words) - n + 1], words[n - 1 :]
            out[: len(end)] = np.where((start >= 0) & (end >= 0), start * self.size + end, -1)
        return out

    def numbered(self, codes: np.ndarray, n: int) -> np.ndarray:
        """The numbers of level n's n-grams, or -1."""
        known = self.codes[n - 2]
        if not len(known):
            return np.full(len(codes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, at, -1)

    def terms(self, n: int) -> list[str]:
        if n == 1:
            return self.words
        shorter, known = self.terms(n - 1), self.codes[n - 2]
        return [f"{shorter[a]} {self.words[b]}" for a, b in zip((known // self.size).tolist(), (known % self.size).tolist(), strict=True)]


def parts_of(texts: list[str | None]):
    """(first, past the last) of texts that are taken at once."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") // 4
        if size >= WORDS_AT_ONCE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _gram_counts(sent, n: int):
    """(code, df, total) of the n-grams whose parts are known."""

    def run(batches):
        levels = sent.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in parts_of(texts):
                words, row = levels.flat(texts[a:b])
                last = words
                for k in range(2, n):
                    last = levels.numbered(levels.longer(words, last, k), k)
                codes = levels.longer(words, last, n)
                if n > 2:  # the n-gram's end is known too
                    codes[:-1] = np.where(last[1:] >= 0, codes[:-1], -1)
                at = np.flatnonzero(codes >= 0)
                at = at[np.argsort(codes[at], kind="stable")]
                if not len(at):
                    continue
                code, of = codes[at], row[at]
                new = np.append(True, code[1:] != code[:-1])
                starts = np.flatnonzero(new)
                df = np.add.reduceat((new | np.append(True, of[1:] != of[:-1])).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(code[starts]), pa.array(df), pa.array(np.diff(np.append(starts, len(at))))], names=["code", "df", "total"])

    return run


def totals_of(counts: DataFrame) -> dict[int, int]:
    """How many terms have a total."""
    return {r.total: r["count"] for r in counts.groupBy("total").count().collect()}  # as many as there are different totals


def last_total(totals: dict[int, int], most: int) -> int:
    """The total of the last term that a cap has room for."""
    for total in sorted(totals, reverse=True):
        most -= totals[total]
        if most <= 0:
            return total
    return 1


def vocabulary(texts: DataFrame, column: str, high: int, least_df: int, most: int) -> list[tuple[str, int]] | None:
    """(term, df) of the ``most`` most frequent n-grams of 1 to ``high`` words in at least ``least_df`` rows, ties by term; None if too many words are as frequent as the last of them.

    ``texts``: a prepared text for each row, stored, as it is read once for each level.
    """
    context, own = texts.sparkSession.sparkContext, texts.select(column)
    totals: Counter = Counter()

    def floor(counts: DataFrame) -> int:
        totals.update(totals_of(counts))
        return last_total(totals, most)

    from taskweave.shared import written

    summed = lambda counts, key, least: written(counts.groupBy(key).agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where((F.col("df") >= least_df) & (F.col("total") >= least)), "levels")
    counts = summed(own.mapInArrow(term_counts(tokens), "term string, df long, total long"), "term", 1)
    least = floor(counts)
    kept = counts.where(F.col("total") >= least)
    if kept.count() > SENT_WORDS:
        return None
    table = kept.toArrow()  # the cap, and the words that are as frequent as its last
    levels, found = Levels(table.column("term").to_pylist()), []
    for n in range(1, high + 1):
        df, total = table.column("df").to_numpy(), table.column("total").to_numpy()
        order = np.argsort(table.column("code").to_numpy()) if n > 1 else slice(None)
        if n > 1:
            levels.codes.append(table.column("code").to_numpy()[order])
        found.append((df[order], total[order]))
        if n == high or not len(df):
            break
        sent = context.broadcast(levels)
        counts = summed(own.mapInArrow(_gram_counts(sent, n + 1), "code long, df long, total long"), "code", least)
        least = floor(counts)
        kept = counts.where(F.col("total") >= least)
        if kept.count() > SENT_WORDS:
            return None
        table = kept.toArrow()
    every = [(-t, term, d) for n, (df, total) in enumerate(found, 1) for term, d, t in zip(levels.terms(n), df.tolist(), total.tolist(), strict=True) if t >= least]
    return [(term, d) for _, term, d in sorted(every)[:most]]


def _points(text: str) -> np.ndarray:
    """The numbers of a text's characters."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _inside_counts(grams):
    """(term, total, sure, open) of the n-grams of words (term, df, total): how often they come, and in how many rows at least and at most."""

    def run(batches):
        total, sure, open_ = {}, {}, {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64()), pa.array(map(sure.__getitem__, total), pa.int64()), pa.array(map(open_.__getitem__, total), pa.int64())], names=["term", "total", "sure", "open"])

        for batch in batches:
            for word, df, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                terms = grams.inside(word)
                for term in terms:
                    total[term] = total.get(term, 0) + n
                for term in set(terms):
                    open_[term] = open_.get(term, 0) + df
                    if sure.get(term, 0) < df:
                        sure[term] = df
                if len(total) >= HELD_WORDS:
                    yield out()
                    total, sure, open_ = {}, {}, {}
        yield out()

    return run


def _inside_rows(sent):
    """(index, df): in how many of a task's rows the terms of a lookup are."""

    def run(batches):
        lookup = sent.value
        df = np.zeros(lookup.size, dtype=np.int64)
        for batch in batches:
            for places in lookup.places(batch.column(0).to_pylist()):
                df[np.unique(places)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["index", "df"])

    return run


def inside_vocabulary(texts: DataFrame, column: str, grams, least_df: int, most: int) -> list[tuple[str, int]] | None:
    """``vocabulary`` of n-grams inside words, which words' counts rank; None if too many are as frequent as the last of them. ``texts`` are read twice."""
    from taskweave.shared import written

    context, own = texts.sparkSession.sparkContext, texts.select(column)
    words = own.mapInArrow(term_counts(split_words), "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    parts = words.mapInArrow(_inside_counts(grams), "term string, total long, sure long, open long")
    known = written(parts.groupBy("term").agg(F.sum("total").alias("total"), F.max("sure").alias("sure"), F.sum("open").alias("open")).where(F.col("open") >= least_df), "levels")
    least = last_total(totals_of(known.where(F.col("sure") >= least_df)), most)  # terms that are in enough rows whatever texts say
    kept = known.where(F.col("total") >= least).select("term", "total")
    if kept.count() > SENT_WORDS:
        return None
    table = kept.toArrow()  # the cap, those as frequent as its last, and those that may be in too few rows
    terms, total = table.column("term").to_pylist(), table.column("total").to_pylist()
    if not terms:
        return []
    sent = context.broadcast(Inside(grams, terms))
    df = dict(own.mapInArrow(_inside_rows(sent), "index long, df long").groupBy("index").agg(F.sum("df")).collect())  # a row for each of the terms
    every = [(-t, term, df.get(i, 0)) for i, (term, t) in enumerate(zip(terms, total, strict=True)) if df.get(i, 0) >= least_df]
    return [(term, d) for _, term, d in sorted(every)[:most]]


def whole_vocabulary(texts: DataFrame, column: str, least_df: int, most: int) -> list[tuple[str, int]]:
    """``vocabulary`` of texts that are one term each."""
    counts = texts.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("term")).agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    table = counts.orderBy(F.desc("df"), "term").limit(most).toArrow()
    return list(zip(table.column("term").to_pylist(), table.column("df").to_pylist(), strict=True))


class Inside:
    """The numbers of n-grams inside words in texts. The words of a few texts are taken apart together, each once, by the codes of their characters."""

    def __init__(self, grams, terms: list[str], index: np.ndarray | None = None):
        self.grams, self.terms, self.size, self.index = grams, terms, len(terms), index
        self.codes, self.words = None, {}

    def __getstate__(self):
        return self.grams, self.terms, self.index

    def __setstate__(self, state):
        self.__init__(*state)

    def _coded(self) -> None:
        """The terms' characters, and for each size the terms' codes in order, with their places. Codes of too many characters would not fit; then terms are looked up as strings."""
        self.known = dict(zip(self.terms, range(self.size), strict=True))
        self.letters = np.unique(_points("".join(self.terms)))
        self.codes = {}
        if (len(self.letters) + 1) ** max(self.grams.high, 1) < 1 << 62:
            sizes = np.fromiter(map(len, self.terms), dtype=np.int64, count=self.size)
            for n in range(self.grams.low, self.grams.high + 1):
                at = np.flatnonzero(sizes == n)
                points = np.searchsorted(self.letters, _points("".join(self.terms[i] for i in at.tolist()))).reshape(-1, n) + 1
                code = np.zeros(len(at), dtype=np.int64)
                for k in range(n):
                    code = code * (len(self.letters) + 1) + points[:, k]
                order = np.argsort(code)
                self.codes[n] = code[order], at[order].astype(np.int32)

    def _take_apart(self, words: list[str]) -> None:
        """Holds the places of words' n-grams, as bytes."""
        if not self.size:
            self.words |= dict.fromkeys(words, b"")
            return
        if not self.codes or not words:
            for w in words:
                at = np.fromiter(map(self.known.get, self.grams.inside(w), repeat(-1)), dtype=np.int32)
                self.words[w] = at[at >= 0].tobytes()
            return
        points, base = _points("".join(f" {w} " for w in words)), len(self.letters) + 1
        of = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2)
        near = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        letter = np.where(self.letters[near] == points, near + 1, 0).astype(np.int64)
        code, good, found = letter, letter > 0, []
        for n in range(1, self.grams.high + 1):
            if n > 1:
                code, good = code[:-1] * base + letter[n - 1 :], good[:-1] & (letter[n - 1 :] > 0) & (of[: len(of) - n + 1] == of[n - 1 :])
            if n >= self.grams.low and len(self.codes[n][0]):
                known, place = self.codes[n]
                at = np.flatnonzero(good)
                own = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
                hit = known[own] == code[at]
                found.append((of[at[hit]], place[own[hit]]))
        word, place = (np.concatenate([f[k] for f in found]) if found else np.empty(0, dtype=np.int32) for k in range(2))
        order = np.argsort(word, kind="stable")
        body, ends = place[order].tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        start = 0
        for w, end in zip(words, ends, strict=True):
            short = self.known.get(f" {w} ") if len(w) + 2 < self.grams.low else None  # a padded word that is shorter than all sizes comes once
            self.words[w], start = body[start:end] if short is None else np.int32(short).tobytes(), end

    def places(self, texts: list[str | None]):
        """Of each text the places of its known terms in ``terms``, with repeats."""
        if self.codes is None:  # once a worker
            self._coded()
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            words = [split_words(text) for text in texts[i : i + TEXTS_AT_ONCE]]
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            self._take_apart([w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.words])
            for own in words:
                yield np.frombuffer(b"".join(map(self.words.__getitem__, own)), dtype=np.int32)

    def counts(self, texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, index, tf) of the known terms, by text and index, if indexes rise with the places."""
        rows, found, tf = [], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for places in self.places(texts):
            if len(places) * 8 < self.size:
                at, times = np.unique(places, return_counts=True)
            else:
                times = np.bincount(places, minlength=self.size)
                at = np.flatnonzero(times)
                times = times[at]
            rows.append(len(at))
            found.append(at)
            tf.append(times)
        return np.repeat(np.arange(len(texts)), rows), self.index[np.concatenate(found)], np.concatenate(tf)


class Strings:
    """The numbers of terms in texts that are counted as strings."""

    def __init__(self, terms_of, terms: list[str], index: np.ndarray):
        self.terms_of, self.known = terms_of, dict(zip(terms, index.tolist(), strict=True))

    def counts(self, texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, index, tf) of the known terms, by text and index."""
        rows, found, tf = [], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for text in texts:
            places = np.fromiter(map(self.known.get, self.terms_of(text) if text is not None else (), repeat(-1)), dtype=np.int64)
            at, times = np.unique(places[places >= 0], return_counts=True)
            rows.append(len(at))
            found.append(at)
            tf.append(times)
        return np.repeat(np.arange(len(texts)), rows), np.concatenate(found), np.concatenate(tf)


class Lookup:
    """The numbers of a vocabulary's terms in texts."""

    def __init__(self, terms: list[str], index: np.ndarray):
        split = [t.split(" ") for t in terms]
        words = list(dict.fromkeys(w for t in split for w in t))
        self.levels, ids = Levels(words), dict(zip(words, range(len(words)), strict=True))
        nodes, self.index = {(): 0}, []
        for n in range(1, max(map(len, split), default=0) + 1):
            if n == 1:
                nodes = {(w,): i for w, i in ids.items()}
                own = np.full(len(words), -1, dtype=np.int64)
            else:
                codes = {tuple(t[:n]): nodes[tuple(t[: n - 1])] * self.levels.size + ids[t[n - 1]] for t in split if len(t) >= n}  # what longer terms begin with, too
                known = np.array(sorted(codes.values()), dtype=np.int64)
                self.levels.codes.append(known)
                nodes = dict(zip(codes, np.searchsorted(known, np.fromiter(codes.values(), dtype=np.int64)).tolist(), strict=True))
                own = np.full(len(known), -1, dtype=np.int64)
            for t, i in zip(split, index.tolist(), strict=True):
                if len(t) == n:
                    own[nodes[tuple(t)]] = i
            self.index.append(own)

    def counts(self, texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, index, tf) of the known terms, by text and index. ``width``: a number above all indexes."""
        words, row = self.levels.flat(texts)
        keys, last = [np.empty(0, dtype=np.int64)], words
        for n, own in enumerate(self.index, 1):
            last = words if n == 1 else self.levels.numbered(self.levels.longer(words, last, n), n)
            at = np.flatnonzero(last >= 0)
            of = own[last[at]]
            keys.append((row[at] * width + of)[of >= 0])
        found, tf = np.unique(np.concatenate(keys), return_counts=True)
        return found // width, found % width, tf
