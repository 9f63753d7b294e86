"""Hard negatives, mixtures and spelling variants against brute force, on small tables with awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskweave.llm import mixing, negatives, variants

SF = "/root/testdata/sf0.001"
CLASHES = ["row", "group", "score", "place", "block", "size", "key", "word", "n", "v", "x", "square", "words", "slot"]


def with_clashes(df):
    return df.select("*", *[F.lit("kept").alias(c) for c in CLASHES if c not in df.columns]).repartition(3)


# --- hard negatives ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "size"), [(1, 5), (64, 300), (3000, 1 << 10), (40, 1 << 28), (2, 1 << 30)])
def test_residue_products_are_exact(width, size):
    random = np.random.default_rng(width)
    a, b = random.integers(-size, size + 1, (7, width)), random.integers(-size, size + 1, (9, width))
    a[0], b[0] = size, size
    b[1] = -size
    primes = negatives.primes_for(width * size * size)
    found = negatives.products([negatives.residues(a, p) for p in primes], [negatives.residues(b, p) for p in primes], primes)
    assert found.tolist() == [[sum(x * y for x, y in zip(p, q, strict=True)) for q in b.tolist()] for p in a.tolist()]
    product = 1
    for p in primes[:-1]:
        product *= p
    assert product <= 2 * width * size * size + 1 < product * primes[-1]


def brute_negatives(rows, asked, k=5):
    """Rows in the order they were given stand for themselves, also where ids repeat."""
    good = []
    for i, label, v in rows:
        if i is not None and label is not None and v and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for at, (i, label, v) in enumerate(good):
        if not asked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, lab) for n, (j, lab, w) in enumerate(good) if n != at)
        for p, j, lab in [s for s in scored if s[2] == label][:k]:
            band = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, j, r + 1, o, -p, -s) for r, (s, o, _) in enumerate(band)]
    return sorted(out)


def vectors(spark):
    random = np.random.default_rng(3)
    rows = [(int(i), int(random.integers(0, 3)), [float(x) for x in np.round(random.normal(size=3) + 1, 1)]) for i in range(150)]
    rows += [(i, 1, rows[0][2]) for i in (150, 151, 152)] + [(7, 2, [2.0, 1.0, 0.5]), (10, 0, [2.0, 2.0, 2.0]), (10, 0, [1.0, 0.0, 1.0])]  # copies and repeated ids
    rows += [(200, None, [1.0, 1.0, 1.0]), (210, 1, None), (None, 1, [1.0, 1.0, 1.0]), (220, 1, [None, 1.0, 1.0]), (230, 1, [float("nan"), 1.0, 1.0]), (240, 1, [float("inf"), 1.0, 1.0]), (250, 1, []), (260, 1, [1.0]), (270, 1, [1e300, 1.0, 1.0]), (280, 0, [0.0, 0.0, 0.0])]
    return rows, with_clashes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))


@pytest.mark.parametrize("small", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, small):
    rows, table = vectors(spark)
    if small:
        monkeypatch.setattr(negatives, "ANCHORS", 5)
        monkeypatch.setattr(negatives, "CELLS", 40)
        monkeypatch.setattr(negatives, "WAITING", 7)
    found = sorted(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 10 == 0).collect())
    assert found == brute_negatives([r for r in rows if r[0] != 270], lambda i: i % 10 == 0) and len(found) > 50


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(1, 0, [1.0])], "vec_id long, label int, embedding array<double>")
    assert negatives.mine(one, F.col("vec_id") % 10 == 0).count() == 0 and negatives.mine(one, F.col("vec_id") == 1).count() == 0


# --- mixtures ---------------------------------------------------------------------------------------------------------


def test_targets_share_by_weight_below_the_caps():
    random = np.random.default_rng(5)
    for _ in range(50):
        sizes = random.integers(0, 1000, random.integers(1, 12)).tolist()
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        found = mixing.targets(sizes, weights, 1.5 * sum(sizes))
        assert abs(sum(found) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes, strict=True))
        below = [t / w for t, w, s in zip(found, weights, sizes, strict=True) if t < 2 * s - 1e-9]
        assert not below or max(below) - min(below) < 1e-6 and all(t / w <= max(below) + 1e-6 for t, w in zip(found, weights, strict=True))
    assert mixing.targets([], [], 0) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutations_and_their_inverses(n):
    to = mixing.permuted(np.arange(n), n, 11)
    assert sorted(to.tolist()) == list(range(n)) and mixing.permuted(to, n, 11, back=True).tolist() == list(range(n))
    assert n < 17 or to.tolist() != mixing.permuted(np.arange(n), n, 12).tolist()


def test_draws_use_up_all_slots_and_no_more():
    slots = np.array([500, 0, 3, 90, 1000])
    each = list(mixing.draws(slots, 100))
    assert sum(each).tolist() == slots.tolist() and all(d.sum() == 100 for d in each[:-1]) and all((d >= 0).all() for d in each)
    assert all(abs(d[4] - 62.8) < 25 for d in each[:8])  # near its share in each shard, not laid one after another


def brute_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block", [4, 16, 256])
def test_mixture_reaches_its_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 20)
    monkeypatch.setattr(mixing, "PIECE_SLOTS", 7)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 16)
    table = with_clashes(spark.read.parquet(f"{SF}/documents.parquet"))
    mixture = mixing.mix(table, block=block)
    rows = mixing.taken(mixture).collect()
    size = {r.doc_id: (r.source, brute_size(r.text)) for r in table.collect()}
    assert {(r.doc_id, r.size) for r in rows} == {(i, s) for i, (_, s) in size.items()} and len(rows) == len(size)
    got, of = Counter(), Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        got[size[r.doc_id][0]] += r.taken
        of[size[r.doc_id][0]] += r.size
    names = sorted(of)
    goals = dict(zip(names, mixing.targets([of[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(of.values())), strict=True))
    for r in rows:
        assert r.source_size == of[size[r.doc_id][0]] and abs(r.target - goals[size[r.doc_id][0]]) < 1e-6
    assert all(abs(got[n] - goals[n]) <= 1 for n in names)
    again = mixing.taken(mixing.mix(table.repartition(7, "text"), block=block)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_texts_of_slots_are_whole_blocks(spark):
    docs = [(1, "a b c d e f g", "s"), (2, "h i\tj", "s"), (3, None, "s"), (4, "", None), (5, "k " * 20, None), (5, "k " * 20, None), (None, "l m n", "t"), (6, "q", "t")]
    table = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    mixture = mixing.mix(table, block=4)
    rows = mixing.taken(mixture).collect()
    assert len(rows) == len(docs) and {r.taken for r in rows if r.size == 0} == {0} and all(r.taken <= 2 * r.size for r in rows)
    slots = mixing.texts(mixture, table).collect()
    words = Counter(w for s in slots for w in s.text.split())
    assert sum(words.values()) == sum(r.taken for r in rows) and max(words[w] for w in "abcdefghij") <= 2
    assert all(len(s.text.split()) <= 4 for s in slots) and len({(s.source, s.slot) for s in slots}) == len(slots)
    one = {s.text for s in slots if s.source == "s"}
    assert one <= {" ".join(x[i : j]) for x in (list("abcdefghij"), list("hijabcdefg")) for i in range(0, 10, 4) for j in range(i + 1, i + 5)}


def test_mixture_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mix(empty)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.taken(mixing.mix(blank)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# --- spelling variants ------------------------------------------------------------------------------------------------


def brute_words(docs, one_in=199):
    count = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(count):
    form, near = {}, {}
    for w, n in count.items():
        near[w] = sorted((-count[v], v) for v in count if one_edit(w, v))
        form[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 5 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found_variants(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("one_in", [3, 199])
def test_words_equal_brute_force(spark, one_in):
    docs = [(i, f"Straße ÉCOLE École Colour colours{'' if i % 2 else 'x'} abcdéf×÷þ ÀÀÀÀÀÀ short a1bcdefg2hijklmn") for i in range(30)] + [(None, "Colour colours " * 6), (3, None), (4, ""), (4, "wordword " * 300_000), (5, "y" * 70_000 + " "), (5, "y" * 70_000), (6, ("y" * 70_000 + " ") * 4)]
    table = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.word: r.n for r in variants.vocabulary(table, one_in=one_in).collect()} == brute_words(docs, one_in)


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(variants, "PART", 2)
        monkeypatch.setattr(variants, "FILTER_BYTES", 700)
        monkeypatch.setattr(variants, "CELLS", 400)
    random = np.random.default_rng(8)
    base = ["".join(random.choice(list("abcé"), random.integers(6, 10))) for _ in range(250)]
    words = {w: int(5 ** random.integers(1, 5) + random.integers(0, 4)) for w in base}
    words |= {"aaaaaaa": 40, "aaaaaaaa": 8, "aaaaaa": 9000, "þ×÷ÿàa": 5, "þ×÷ÿàaa": 30, "z" * 3000: 5, "z" * 2999: 500, "z" * 1500 + "y" + "z" * 1499: 60}
    table = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("root", F.lit(1)).repartition(3)
    found = found_variants(variants.grouped(table))
    assert found == brute_variants(words) and sum(r[1] is not None for r in found) > 10 and any(r[2] not in (r[0], r[1]) for r in found)


def test_chains_of_forms_end(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(26)]
    assert {r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w26"}


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.grouped(variants.vocabulary(empty)).count() == 0
