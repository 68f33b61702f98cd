"""Searches from the index of terms give what the scans give, and read what they say."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import knowledge, postings, retrieval

WORDS = "red green blue yellow black white house garden river stone under_score well-known don't Über naïve a1b2".split()


def texts(n=400, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 30))] + ["the", "quick"] * (i % 3 == 0)
        if i % 40 == 0:
            words.append(f"rare{i}word")
        rnd.shuffle(words)
        out.append(rnd.choice((" ", "  ", ", ", "\n")).join(words))
    return [*out, None, "", "STONE stone Stone", "housegarden", "x" * 60]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(f"e{i:04}", i * 7, t, f"v{i % 5}", [f"s{i % 3}"], ["t"] if i % 2 else []) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "id string, ord long, content string, video_id string, speakers array<string>, topics array<string>").repartition(5).persist()


@pytest.fixture(scope="module")
def dates(spark):
    return spark.createDataFrame([(f"v{i}", f"2024-0{i + 1}-01") for i in range(4)], "video_id string, date string").withColumn("date", F.col("date").cast("date"))


@pytest.fixture()
def small(monkeypatch):
    """Many blocks of few documents, read a few at a time."""
    monkeypatch.setattr(postings, "BLOCK_BITS", 3)
    monkeypatch.setattr(postings, "FIRST_BLOCKS", 2)


def hits(df, *columns):
    return [tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in ("id", *columns)) for r in df.collect()]


QUERIES = ["red stone in the garden", "rare40word and house", "rare80word", "quick", "housegarden garden", "rare40word rare80word rare120word", "nothing here zzz", "the of", "", "house " * 3]


def test_tfidf_equals_the_scan(entries, dates, small, tmp_path):
    index, idf = postings.build(entries, f"file://{tmp_path}/i"), knowledge.idf(entries)
    as_of = F.lit("2024-06-30 00:00:00").cast("timestamp")
    for i, q in enumerate(QUERIES):
        for more in ({}, {"dates": dates, "as_of": as_of}, {"speaker": "s1", "k": 5})[i % 3 :][:1]:
            order = ("distance", "ord")
            want = hits(retrieval.tfidf_search(entries, idf, q, **more).orderBy(*order), "distance", "score")
            assert hits(postings.tfidf_search(index, q, **more).hits.orderBy(*order), "distance", "score") == want, (q, more)


def test_blocks_that_cannot_win_are_not_read(entries, small, tmp_path):
    index = postings.build(entries, f"file://{tmp_path}/i")
    found = postings.tfidf_search(index, "rare40word rare80word rare120word garden", 2)
    assert 0 < found.read <= 3 < found.blocks
    assert found.hits.count() == 2
    # many blocks can score as well as the best hit, but stand behind it
    found = postings.tfidf_search(index, "red", 1)
    assert found.read < found.blocks / 2
    assert hits(found.hits) == hits(retrieval.tfidf_search(entries, knowledge.idf(entries), "red", 1))


def test_a_common_term_is_spread_over_blocks(entries, small, tmp_path):
    index = postings.build(entries, f"file://{tmp_path}/i")
    rows = index.postings(["red"]).collect()
    assert len(rows) > 20 and max(r["docs"] for r in rows) <= 8
    assert sum(r["docs"] for r in rows) == postings.known(index, ["red", "zzz"])["red"]


def test_only_the_terms_buckets_are_read(spark, entries, tmp_path):
    index = postings.build(entries, f"file://{tmp_path}/i")
    files = lambda df: {x.rsplit("/", 2)[1] for x in df.select(F.col("_metadata.file_path")).distinct().toPandas()["file_path"]}
    assert files(index.postings(["red"])) == {f"bucket={r[0]}" for r in spark.sql(f"select pmod(xxhash64('red'), {postings.BUCKETS})").collect()}
    plan = postings.beginning(index, "ga")._jdf.queryExecution().executedPlan().toString()
    assert "head" in plan.split("PartitionFilters")[1].split("]")[0] and "StringStartsWith(term,ga)" in plan
    assert {r["term"] for r in postings.beginning(index, "ga").collect()} == {"garden"}


def test_keyword_equals_the_scan(entries, small, tmp_path):
    index = postings.build(entries, f"file://{tmp_path}/w", postings.underscored)
    for i, q in enumerate([*QUERIES[:4], "under", "gar garden garden", "dont well", "a1b", ""]):
        for more in ({}, {"topic": "t", "speaker": "s1"})[i % 2 :][:1]:
            assert hits(postings.keyword_search(index, q, **more), "score") == hits(retrieval.keyword_search(entries, q, **more), "score"), q


def test_substring_equals_the_scan(entries, small, tmp_path):
    index = postings.build(entries, f"file://{tmp_path}/p", postings.pieces)
    for q in [*QUERIES[1:5], "segar tone", "l-know don't", "über ïve,", "_sco _sco", "stone, well-"]:
        assert hits(postings.substring_search(index, q), "score") == hits(retrieval.substring_search(entries, q), "score"), q


def test_terms_that_contain_something(entries, tmp_path):
    index = postings.build(entries, f"file://{tmp_path}/i")
    of = lambda text: {r["term"] for r in postings.containing(index, text).collect()}
    assert of("gar") == {"garden", "housegarden"} and of("segard") == {"housegarden"} and of("zzz") == set()
    assert of("w") == {t["term"] for t in index.table("terms").where("term like '%w%'").collect()} != set()


def test_no_entries(entries, tmp_path):
    index = postings.build(entries.limit(0), f"file://{tmp_path}/i")
    assert postings.tfidf_search(index, "red stone").hits.count() == 0
    assert postings.keyword_search(index, "red stone").count() == 0
    assert postings.substring_search(index, "stone").count() == 0
