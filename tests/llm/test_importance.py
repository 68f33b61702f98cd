import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import data
from tidemark.llm import importance as I
from tidemark.llm import queries


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]


def buckets_of(words):
    return [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target):
    """doc_id, n_features, weight, score, rank of each (doc_id, text), by plain loops."""
    words = [words_of(t) for _, t in docs]
    found = [buckets_of(w) for w in words]
    s, t = Counter(b for x in found for b in x), Counter(b for x in target for b in buckets_of(words_of(x)))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    rows = []
    for (i, _), w, f in zip(docs, words, found, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    long = [r for r in rows if r[5] >= 20]
    for k, r in enumerate(sorted(long, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: 5 * len(long) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("piece", [1, 2, 7, 50, 1 << 20])
def test_one_scan_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(I, "PIECE", piece)
    rnd = random.Random(piece)
    for _ in range(300):
        text = "".join(rnd.choice("aBZ é1 .-\x7f\t\x00ß日") for _ in range(rnd.randint(0, 60)))
        n, found = I.features(text.encode(), 3, 10_000)
        assert n == len(words_of(text)) and Counter(found.tolist()) == Counter(buckets_of(words_of(text)))


@pytest.mark.parametrize("runs", [1, 2, 5])
def test_runs_of_other_lengths(runs):
    words = [b"a", b"b", b"c", b"d"]
    _, found = I.features(b"a b c d", runs, 10**9)
    assert sorted(found.tolist()) == sorted(zlib.crc32(b" ".join(words[i : i + k])) % 10**9 for k in range(1, runs + 1) for i in range(len(words) - k + 1))


def long_rows():
    """Documents of which one in twenty is drawn: some hundred of them, with ties and repeated rows."""
    rnd = random.Random(8)
    out = [(r[0], r[1]) for r in data.rows()]
    out += [(1000 + i, data.prose(rnd, rnd.randint(15, 60))) for i in range(200)]
    return out + [out[-1], out[-1], (None, out[-2][1])]


def test_resample_against_brute_force(spark):
    rows, target = long_rows(), [data.prose(random.Random(1), 40), None, "", "alpha beta"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.resample(docs, bench).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, target))
    drawn = [r["rank"] for r in got if r["rank"]]
    assert sorted(drawn) == list(range(1, len(drawn) + 1)) and drawn


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op11_importance_resample(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, target))


def test_draw_follows_the_target(spark):
    """Of documents of two kinds, those like the target are drawn first."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(("red green blue" if i % 4 == 0 else "one two three").split()) for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("red green blue green red",)] * 50, "text string")
    assert {r["doc_id"] % 4 for r in I.resampled(docs, target).collect()} == {0}


def test_clashing_columns_and_empty_tables(spark):
    docs = data.docs(spark).select("*", *[F.lit("own").alias(x) for x in ("rank", "score", "weight", "place", "n_words", "buckets", "__row_key")])
    bench = spark.createDataFrame([("alpha beta", 1)], "text string, key int")
    out = I.resample(docs, bench)
    want = brute([(r[0], r[1]) for r in data.rows()], ["alpha beta"])
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()) == Counter(want)
    assert I.resampled(docs, bench).columns == docs.columns
    assert I.resample(data.nothing(spark), bench).count() == 0
    none = spark.createDataFrame([], "text string")
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in I.resample(data.docs(spark), none).collect()) == Counter(brute([(r[0], r[1]) for r in data.rows()], []))
