import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("ms", "want"), [(3_661_000, "01:01:01"), (360_000_000, "100:00:00"), (0, "00:00:00")])
def test_format_hms(spark, ms, want):
    assert one(spark, T.format_hms("ms"), ms=ms) == want


@pytest.mark.parametrize(("s", "want"), [(65, "1:05"), (3723, "1:02:03")])
def test_format_chapter(spark, s, want):
    assert one(spark, T.format_chapter("s"), s=s) == want


@pytest.mark.parametrize(("parts", "want"), [(("12", "34", None), 754), (("1", "02", "03"), 3723), (("1", "02", ""), 62)])
def test_parse_timestamp(spark, parts, want):
    df = spark.createDataFrame([parts], "h string, m string, s string")
    assert df.select(T.parse_timestamp("h", "m", "s").alias("x")).first()["x"] == want


@pytest.mark.parametrize(("text", "want"), [("", 1), ("a b", 2), (" a b", 3), ("a b ", 3)])
def test_word_count(spark, text, want):
    assert one(spark, T.word_count("t"), t=text) == want


def test_recency(spark):
    as_of = F.lit("2024-06-30").cast("timestamp")
    for days, want in ((-1, 1.0), (0, 1.0), (30, 0.907889), (180, 0.620728), (365, 0.478977), (730, 0.410396)):
        date = F.date_sub(F.lit("2024-06-30").cast("date"), F.lit(days))
        assert one(spark, T.recency_weight(date, as_of)) == pytest.approx(want, abs=1e-6)
    assert one(spark, T.recency_weight(F.lit(None).cast("date"), as_of)) == 0.85


def test_jaccard(spark):
    a, b = T.tokens_title(F.lit("Trade War, Tariffs & the Fed")), T.tokens_title(F.lit("Tariffs and Trade war: markets react"))
    assert one(spark, T.jaccard(a, b)) == 0.5
    assert one(spark, T.jaccard(T.tokens_title(F.lit("a b")), T.tokens_title(F.lit("c d")))) == 0


@pytest.mark.parametrize(("word", "bucket"), [("ai", 40), ("tariffs", 49), ("recession", 243), ("crypto", 319)])
def test_hash_bucket(spark, word, bucket):
    assert one(spark, V.hash_bucket(F.lit(word))) == bucket == V.hash_project(word)


def test_hash_bucket_random(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randint(1, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", V.hash_bucket(F.col("w")).alias("b")).collect()
    assert all(r["b"] == V.hash_project(r["w"]) for r in rows)


def test_counts(spark):
    assert one(spark, F.size(T.whole_words(F.lit("x ab ab_ab abc AB"), ["ab"]))) == 4
    assert one(spark, T.whole_words(F.lit("b a cc A"), ["a", "cc"])) == ["a", "cc", "a"]
    assert one(spark, T.prefix_count(F.lit("recession recessionary prerecession"), ["recession"])) == 2
    assert one(spark, T.prefix_count(F.lit("rate rates rating _rate x-rate"), ["rat", "rate", "rate"])) == 4 + 3 + 3
    assert one(spark, T.prefix_count(F.lit("any"), [])) == 0


def test_whole_word_count_equals_tokens(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab9_- .") for _ in range(40)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(T.whole_words("t", ["ab"])).alias("n")).collect()
    assert all(r["n"] == re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", r["t"])).count("ab") for r in rows)


def test_prefix_count_equals_a_pattern(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abAB9_- .é") for _ in range(60)) for _ in range(200)]
    terms = ["aba", "ab9", "bab", "aba"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.prefix_count("t", terms).alias("n")).collect()
    assert all(r["n"] == sum(len(re.findall(rf"\b{t}", r["t"].lower(), re.A)) for t in terms) for r in rows)


def test_trimmed_takes_white_space_of_any_kind(spark):
    assert one(spark, T.trimmed(F.lit("\ufeff\u00a0\u2003 a b\u3000\n"))) == "a b"


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_words_of_a_batch_are_hashed_like_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_BYTES", block)
    rnd = random.Random(block)
    bits = ["abc", "Don't", "a", " ", "  ", "\t", "\u212aelvin", "\u0130stanbul", "éa", "zz9", "-", "\u00a0", "\n", "x" * 70, "日本", "\x1c"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(80)] + [None, "", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = {r["id"]: r["w"] or [] for r in df.select("id", T.tokens_plain("text").alias("w")).collect()}
    got = {i: [] for i in words}
    for first, _, row, bucket in V.word_buckets(pa.array(texts, pa.string())):
        for i, b in zip(row.tolist(), bucket.tolist(), strict=True):
            got[first + i].append(b)
    assert got == {i: [V.hash_project(w) for w in ws] for i, ws in words.items()}


def test_hashed_cosine_equals_the_long_form(spark):
    rnd = random.Random(8)
    words = [f"w{i}x" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randint(0, 80)))) for i in range(60)], "id long, text string")
    q = V.hashed_query(rnd.choices(words, k=9))
    long = {}
    for r in V.hashed_embedding(docs, "id", "text").collect():
        long[r["id"]] = long.get(r["id"], 0.0) + r["weight"] * q.get(r["bucket"], 0.0)
    for r in docs.select("id", V.hashed_cosine("text", q).alias("c")).collect():
        assert r["c"] == pytest.approx(long.get(r["id"], 0.0))


def test_strip_citations(spark):
    text = "x [3] y [13]. z [7, 3] w [7] ."
    assert one(spark, T.strip_citations("t", F.array(F.lit(3), F.lit(7))), t=text) == "x y [13]. z w."


def test_markers(spark):
    assert one(spark, T.markers(F.lit("a [3] b [4, 7] c [3]"))) == [3]
    assert one(spark, T.markers(F.lit("a [3] b [4, 7] c [3]"), lists=True)) == [3, 4, 7]


def test_clean_topic_decodes_the_ampersand_first(spark):
    assert one(spark, T.clean_topic(F.lit("  <b>a &amp;quot;x&amp;quot;</b>  &nbsp; b "))) == 'a "x" b'


def test_cache_key(spark):
    import hashlib

    want = hashlib.sha256(b"v1|||will rates fall?").hexdigest()[:15]
    assert one(spark, T.cache_key(F.lit("  Will  Rates fall? "), "v1")) == want


def test_rss_date(spark):
    assert str(one(spark, T.rss_date(F.lit("Fri, 10 Apr 2026 23:30:00 -0700")))) == "2026-04-11"
    assert one(spark, T.rss_date(F.lit("not a date"))) is None


def test_model_json(spark):
    assert one(spark, T.model_json(F.lit('```json\n{"scores": [1, 2]}\n```'), "scores array<int>"))["scores"] == [1, 2]
    assert one(spark, T.model_json(F.lit('So: {"scores": [3]} is it'), "scores array<int>"))["scores"] == [3]


def test_markdown(spark):
    assert one(spark, T.markdown_html(F.lit("# A\n- b\n**c** *d* `e`"))) == "<h1>A</h1>\n<ul><li>b</li>\n</ul><strong>c</strong> <em>d</em> <code>e</code>"


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "id int, v array<float>")
    rows = {r["id"]: r for r in df.select("id", V.l2_normalize("v").alias("u"), V.cosine_distance("v", [3, 4]).alias("d")).collect()}
    assert rows[1]["u"] == pytest.approx([0.6, 0.8]) and rows[1]["d"] == pytest.approx(0)
    assert rows[2]["u"] == [0, 0] and rows[2]["d"] == 1
    assert rows[3]["d"] is None and rows[4]["d"] is None
    assert math.isclose(V.hashed_query(["ai", "ai", "crypto"])[40], 2 / math.sqrt(5))
