import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from tests.llm import data
from tidemark.llm import jaccard_join as J
from tidemark.llm import textsets as T
from tidemark.llm.graph import components

SPLIT = r"[^\x20\x09-\x0D]+"


def set_of(t):
    w = re.findall(SPLIT, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [set_of(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_against_brute_force(spark):
    for seed in (5, 6):
        got = Counter(tuple(r) for r in J.ngram_jaccard_join(data.docs(spark, seed)).collect())
        assert got == brute(data.rows(seed))


def test_a_family_and_its_outsiders(spark):
    """Many copies of one text, changed little to much: hubs, chains and sets that only an outsider links."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        v = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 6, 8, 10))):
            v[rnd.randrange(len(v))] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(v[: rnd.choice((150, 150, 140, 120))])))
    got = Counter(tuple(r) for r in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_nested_texts_that_grow(spark):
    """Small sets of which one stands alone in its range of sizes, and is similar to a set of the range before."""
    rnd = random.Random(4)
    rows = []
    for family in range(40):
        words = [f"f{family}w{i}" for i in range(40)]
        n = rnd.randint(8, 14)
        sizes = [10, 12, 13] if not family else [n]
        while family and sizes[-1] < 34:
            sizes.append(sizes[-1] + rnd.randint(1, 6))
        rows += [(len(rows) + k, " ".join(words[:m])) for k, m in enumerate(sizes)]
    rnd.shuffle(rows)
    got = Counter(tuple(r) for r in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_one_of_each(spark):
    d = data.docs(spark)
    kept = J.one_of_each(d)
    assert kept.columns == d.columns
    want = {k for k in brute(data.rows()) if k[0] == k[2]}
    assert {r["doc_id"] for r in kept.collect()} == {k[0] for k in want}
    assert J.one_of_each(data.nothing(spark)).count() == 0


def test_nothing(spark):
    assert J.ngram_jaccard_join(data.nothing(spark)).count() == 0


def test_words_of_long_texts_and_slices(monkeypatch):
    texts = [t for t in data.texts() if t is not None]
    whole = [w.tolist() for w in T.words_of(pa.array(texts))]
    monkeypatch.setattr(T, "PIECE", 50)
    assert [w.tolist() for w in T.words_of(pa.array(["x", *texts]).slice(1))] == whole
    assert [len(w) for w in whole] == [len(re.findall(SPLIT, t)) for t in texts]
    assert list(T.words_of(pa.array([None, ""], pa.string())))[1].size == 0


def test_marks_bound_the_overlap():
    rnd = np.random.default_rng(1)
    for n, m, k in ((300, 310, 250), (60, 900, 10), (5, 5, 5), (0, 10, 0)):
        x = rnd.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = x[:n], np.concatenate((x[:k], x[n : n + m - k]))
        assert (n + m - J.apart(J.mark_of(a), J.mark_of(b))) // 2 >= k


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in links)}


def test_words_that_a_polynomial_hash_confuses():
    """The Thue-Morse word and its complement agree under any polynomial modulo a power of two."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (8, 16, 24, 32, 256, 1024):
        one, two = T.words_of(pa.array([a[:n], b[:n]]))
        assert one[0] != two[0]


def test_word_hashes_tell_words_apart():
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abcé\x00") for _ in range(rnd.randint(1, 40))) for _ in range(50_000)}
    words |= {"x" * n for n in range(1, 60)} | {"\x00" * n for n in range(1, 30)}
    (got,) = T.words_of(pa.array([" ".join(words)]))
    assert len(got) == len(words) == len(np.unique(got))


def test_similar_words_are_not_linked(spark):
    a = "ab" * 512
    got = [tuple(r) for r in J.ngram_jaccard_join(spark.createDataFrame([(1, a), (2, a[1:] + "a"), (3, a.upper())], "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_counts_are_thinned_and_filled():
    rnd = np.random.default_rng(1)
    for density in (0, 0.001, 0.5, 1):
        x = np.where(rnd.random(1 << J.SLICE_BITS) < density, rnd.integers(0, 65536, 1 << J.SLICE_BITS), 0).astype(np.uint16)
        assert (J.filled(J.thinned(x)) == x).all()


def test_lists_dealt_over_shares_and_cells_give_the_same(spark, monkeypatch):
    """With small limits every list is dealt over shares by its level, and over cells, and every family too."""
    monkeypatch.setattr(J, "LIST_ENTRIES", 4)
    monkeypatch.setattr(J, "CELL", 8)
    monkeypatch.setattr(J, "LEAST_SHARE", 6)
    monkeypatch.setattr(J, "SHARES", 4)
    monkeypatch.setattr(J, "MOST_SHARE", 9)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(80):
        v = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 6, 8))):
            v[rnd.randrange(len(v))] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(v[: rnd.choice((90, 90, 80, 70))])))
    rows += [(1000 + n, " ".join(f"chain{k}" for k in range(n))) for n in range(4, 40)]
    got = Counter(tuple(r) for r in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_one_list_of_many_sets(spark, monkeypatch):
    """3,000 texts hold one passage each, and its shingles stand first in the order, so that all meet in one list. The
    passage is too small a part to link them; every hundredth has a near copy, which by construction is its only link."""
    monkeypatch.setattr(J, "leveller", lambda usual: reversed_levels)
    passage = " ".join(f"p{i}" for i in range(8))
    n = 3_000
    texts = [f"{passage} " + " ".join(f"t{i}x{k}" for k in range(12)) for i in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[i] + " end") for i in range(0, n, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in J.ngram_jaccard_join(df).collect()}
    assert got == {i: i - n if i >= n else i for i, _ in rows}


def reversed_levels(batches):
    """Levels that put frequent shingles first."""
    import zlib

    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = J.filled(raw)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.where(x > 100, -1, 0).astype(np.int8).tobytes(), 1)], pa.binary())], names=["slice", "levels"])
