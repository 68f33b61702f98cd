import random
import re
from datetime import date, timedelta
from decimal import Decimal, localcontext
from math import log

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cache, chapters, chunking, citations, knowledge, quality, retrieval

SEG = "video_id string, seg_no long, text string, start_ms long, end_ms long"


def greedy(segs, span):
    out, open_, anchor = [], [], None
    for s in segs:
        anchor = s[3] if anchor is None else anchor
        open_.append(s)
        if s[4] - anchor >= span:
            out.append(open_)
            open_, anchor = [], None
    return out + ([open_] if open_ else [])


def test_chunks_equal_a_greedy_loop(spark):
    rnd, rows = random.Random(3), []
    for v in range(40):
        at = 0
        for k in range(rnd.randint(1, 40)):
            dur = rnd.randint(0, 20_000)
            rows.append((f"v{v}", k, f"w{k}", at, at + dur))
            at += dur + rnd.choice((0, 0, 500, -300 if at > 300 else 0))
    got = chunking.chunk(spark.createDataFrame(rows, SEG), 30_000).collect()
    for v in {r[0] for r in rows}:
        want = [(" ".join(s[2] for s in g), g[0][3], g[-1][4]) for g in greedy([r for r in rows if r[0] == v], 30_000)]
        assert [(r["text"], r["start_ms"], r["end_ms"]) for r in sorted((r for r in got if r["video_id"] == v), key=lambda r: r["chunk_index"])] == want


def test_chunk_bounds_are_inclusive(spark):
    rows = [("a", 0, "x", 0, 10_000), ("a", 1, "x", 10_000, 29_000), ("a", 2, "x", 29_000, 31_000), ("a", 3, "x", 31_000, 40_000), ("b", 0, "y", 0, 30_000)]
    got = {(r["video_id"], r["chunk_index"]): r["segments"] for r in chunking.chunk(spark.createDataFrame(rows, SEG), 30_000).collect()}
    assert got == {("a", 0): 3, ("a", 1): 1, ("b", 0): 1}


def test_segments(spark):
    kind = "video_id string, events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"
    rows = [("v", [(0, 10, None), (None, 5, [("\n a",), (None,), ("b ",)]), (7, None, [(" ",)]), (9, 1, [("c",)])])]
    got = [tuple(r) for r in chunking.extract_segments(spark.createDataFrame(rows, kind)).collect()]
    assert got == [("v", 0, "ab", 0, 5), ("v", 1, "c", 9, 10)]


def test_idf(spark):
    docs = ["alpha beta beta gamma", "alpha gamma gamma", "alphabet beta", "delta alpha alpha alpha alpha"]
    rows = spark.createDataFrame(list(enumerate(docs)), "ord long, content string")
    got = {r["term"]: round(r["idf"], 6) for r in knowledge.idf(rows).collect()}
    assert got == {"alpha": 0.287682, "beta": 0.693147, "gamma": 0.693147}
    e = rows.withColumn("id", F.col("ord")).withColumn("speakers", F.array(F.lit("x")))
    hit = retrieval.tfidf_search(e, knowledge.idf(rows), "alpha delta").collect()
    assert [(h["id"], round(h["score"], 6), round(h["raw_distance"], 6)) for h in hit] == [(3, 6.186494, 0.287395)]
    assert retrieval.tfidf_search(e, knowledge.idf(rows), "the and").count() == 0
    assert retrieval.tfidf_search(e, knowledge.idf(rows), "alpha delta", speaker="y").count() == 0


def test_equal_scores_of_sums_in_any_order_are_ties(spark):
    """An entry that has each term of the query once scores half of the most, as nearly as its sum is rounded: it is as near
    as one that scores more, and their order decides."""
    for n in (11, 17):
        terms = [f"term{i:02}" for i in range(n)]
        idf = spark.createDataFrame([(t, log(1000 / (7 * i + 3))) for i, t in enumerate(terms)], "term string, idf double")
        texts = [(1, terms), (2, [*terms, terms[0]]), (3, terms[::-1]), (4, terms * 2), (5, terms)]
        e = spark.createDataFrame([(k, k, " ".join(t)) for k, t in texts], "id long, ord long, content string")
        hit = retrieval.tfidf_search(e, idf, " ".join(terms)).collect()
        assert [(h["id"], h["distance"]) for h in hit] == [(k, 0.0) for k in range(1, 6)], n


def exact_ranks(texts, df, n, days):
    """Ids by distance in 50 digits, then by themselves; texts are (id, terms), days the age of each or None."""
    with localcontext() as c:
        c.prec = 50
        w = {t: (Decimal(n) / k).ln() for t, k in df.items()}
        rare = {t for t in w if w[t] > Decimal("2.5")}
        out = []
        for i, ts in texts:
            score = sum((1 + Decimal(ts.count(t)).ln()) * w[t] for t in sorted(set(ts)))
            score *= 1 + Decimal("0.5") * len(rare & set(ts)) / len(rare)
            age = days[i]
            weight = Decimal("0.85") if age is None else Decimal(1) if age < 0 else Decimal("0.4") + Decimal("0.6") * (Decimal(-age) / 180).exp()
            out.append((round((1 - min(Decimal(1), score / (3 * sum(w.values()) / 2))) / weight, 40), i))
        return [i for _, i in sorted(out)]


def tied_hits(spark):
    """200 hits, many of which score half of the most or are copies, and their ids in exact order. SQL whose sums of doubles
    depend on threads ranks them anyhow."""
    rnd, as_of = random.Random(7), date(2024, 6, 30)
    terms = [f"term{i:02}" for i in range(21)]
    df = {t: 7 * i + 3 for i, t in enumerate(terms)}
    texts = [(k, rnd.choice((rnd.sample(terms, 21), rnd.sample(terms, 20), terms + rnd.sample(terms, 2), terms[:20]))) for k in range(200)]
    days = {k: rnd.choice((None, -5, 0, 40, 400)) for k in range(200)}
    e = spark.createDataFrame([(k, k, " ".join(t), str(k)) for k, t in texts], "id long, ord long, content string, video_id string")
    dates = spark.createDataFrame([(str(k), as_of - timedelta(d)) for k, d in days.items() if d is not None], "video_id string, date date")
    idf = spark.createDataFrame([(t, log(1000 / k)) for t, k in df.items()], "term string, idf double")
    hit = retrieval.tfidf_search(e, idf, " ".join(terms), 200, dates, F.lit("2024-06-30 00:00:00").cast("timestamp"))
    return hit, exact_ranks(texts, df, 1000, days)


def test_ranks_are_those_of_exact_arithmetic(spark):
    hit, want = tied_hits(spark)
    assert [h["id"] for h in hit.collect()] == want


def test_lines_of_ties_are_numbered_in_exact_order(spark):
    hit, want = tied_hits(spark)
    none = F.array().cast("array<string>")
    lines = retrieval.rerank_lines(hit.withColumns({"speakers": none, "topics": none})).collect()
    assert {r["i"]: r["id"] for r in lines} == dict(enumerate(want)) and all(r["line"].startswith(f"[{r['i']}] ") for r in lines)


def test_citations_of_ties_are_numbered_in_exact_order(spark):
    hit, want = tied_hits(spark)
    none = F.array().cast("array<string>")
    shown = hit.withColumns({"speakers": none, "topics": none, "start_time": F.lit(""), "url": F.lit("")})
    cites = retrieval.citations(retrieval.rerank(shown, None)).collect()
    assert {r["n"]: r["id"] for r in cites} == dict(enumerate(want[:12], 1))


def test_a_tier_gives_ties_in_exact_order(spark):
    hit, want = tied_hits(spark)
    mode, found = retrieval.first_tier([("exact", lambda: hit.limit(0)), ("ann", lambda: None), ("tfidf", lambda: hit)])
    assert mode == "tfidf" and [r["id"] for r in found.collect()] == want


def test_interleave(spark):
    def lists(*xs):
        return [spark.createDataFrame([(x, i) for i, x in enumerate(l)], "id string, rank int") for l in xs]

    got = retrieval.interleaved(*lists(["a", "b"], ["b", "c", "d"])).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["a", "b", "c", "d"]
    rnd = random.Random(4)
    for _ in range(8):
        a, b = ([str(x) for x in rnd.sample(range(50), rnd.randint(0, 25))] for _ in range(2))
        want: list[str] = []
        i = 0
        while len(want) < 30 and i < max(len(a), len(b)):
            for side in (a, b):
                if i < len(side) and side[i] not in want:
                    want.append(side[i])
            i += 1
        assert [r["id"] for r in retrieval.interleaved(*lists(a, b)).orderBy("pos").collect()] == want


def test_rerank_falls_back(spark):
    hits = spark.createDataFrame([(i, i, i / 10) for i in range(13)], "id long, ord long, distance double")
    scores = spark.createDataFrame([(i, float(i)) for i in range(12)], "id long, score double")
    assert [r["id"] for r in retrieval.rerank(hits, scores).orderBy("n").collect()] == list(range(12))
    whole = spark.createDataFrame([(i, float(i)) for i in range(13)], "id long, score double")
    assert [r["id"] for r in retrieval.rerank(hits, whole).orderBy("n").collect()] == list(range(12, 0, -1))


def test_tiers_by_plan(spark):
    t = spark.createDataFrame([(1,)], "id long")
    rows = retrieval.tiers_by_plan([("exact", t.limit(0)), ("tfidf", t)]).collect()
    assert [(r["id"], r["mode"]) for r in rows] == [(1, "tfidf")]


def test_verdicts(spark):
    said = [(1, "YES"), (1, "NO"), (2, "NO"), (2, "PARTIAL"), (3, "PARTIAL"), (4, "UNKNOWN")]
    pairs = spark.createDataFrame([(0, i, n, "c") for i, (n, _) in enumerate(said)], "report_id long, pid int, n int, claim string")
    verdicts = spark.createDataFrame([(0, i, v) for i, (_, v) in enumerate(said)], "report_id long, pid int, verdict string")
    per = citations.citation_verdicts(pairs, verdicts)
    assert {r["n"]: r["verdict"] for r in per.collect()} == {1: "YES", 2: "NO", 3: "PARTIAL", 4: "YES"}
    assert {r["pid"] for r in citations.failed_claims(pairs, per).collect()} == {2, 3}
    reports = spark.createDataFrame([(0, "a [1]. b [2]. c [2, 1]."), (1, "no marks")], "report_id long, report string")
    got = {r["report_id"]: (r["report"], r["checked"], r["unsupported"]) for r in citations.cleaned(reports, per).collect()}
    assert got == {0: ("a [1]. b. c [1].", 4, 1), 1: ("no marks", 0, 0)}


def test_chapters(spark):
    eps = spark.createDataFrame([(1, "(0:00) Intro<p>(1:02:03) Topic &amp; x</p>"), (2, "(0:00) Only"), (3, "(0:10) ab</p>")], "ep_key long, description string")
    got = [(r["ep_key"], r["start_sec"], r["start_time"], r["topic"]) for r in chapters.extract_chapters(eps).orderBy("ep_key", "pos").collect()]
    assert got == [(1, 0, "0:00", "Intro"), (1, 3723, "1:02:03", "Topic & x")]


def test_cache(spark):
    h = 3_600_000
    at = [0, 71 * h, 72 * h, 72 * h + 1, 100 * h]
    got = cache.replay(spark.createDataFrame([("k", t) for t in at], "key string, at_ms long")).first()
    assert (got["requests"], got["hits"]) == (5, 3)
    m = cache.MemoryCache(size=2)
    m.put("a", 1, 0)
    m.put("b", 2, 0)
    assert m.get("a", 72 * h) == 1 and m.get("a", 72 * h + 1) is None
    m.put("c", 3, 0)
    m.put("c", 4, 0)  # a full store drops its oldest, also where the key is there
    assert m.get("b", 0) is None and m.get("c", 0) == 4


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache.store(spark, path, "k" * 15, '{"report": "r"}', "2024-01-01 00:00:00", ["t"])
    cache.store(spark, path, "k" * 15, "broken", "2024-01-02 00:00:00", ["t"])
    at = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert cache.valid(spark.read.parquet(path), "k" * 15, "t", at).count() == 1
    assert cache.valid(spark.read.parquet(path), "k" * 15, "other", at).count() == 0


def test_scorecard_of_nothing(spark):
    row = quality.scorecard(spark.createDataFrame([], "id long, overall double")).first()
    assert (row["questions"], row["mean_overall"], row["good"]) == (0, None, 0)


def test_consensus(spark):
    rows = [("a", "high"), ("b", "high"), ("c", "low"), ("d", "low")]
    views = spark.createDataFrame(rows, "speaker string, confidence string").withColumn("segments", F.lit(None).cast("array<struct<rank:int,id:string,text:string,topics:array<string>>>"))
    assert retrieval.consensus(views).first()["average_confidence"] == "medium"


def test_order_of_rows_does_not_matter(spark):
    rows = [(i, f"alpha beta {i % 5} gamma delta") for i in range(50)]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        e = spark.createDataFrame(rows, "id long, content string").withColumn("ord", F.col("id")).withColumn("topics", F.array().cast("array<string>")).withColumn("speakers", F.array().cast("array<string>"))
        assert [r["id"] for r in retrieval.keyword_search(e, "alpha gamma", 7).collect()] == list(range(7))


def test_contained_titles(spark):
    cat = spark.createDataFrame([("v", "Great tariffs debate about markets")], "video_id string, title string")
    feed = spark.createDataFrame([(0, "nothing here"), (1, "Tariffs debate markets now")], "item_ord int, title string")
    assert knowledge.contained_titles(cat, feed).first()["item_ord"] == 1


def test_titles_against_brute_force(spark, monkeypatch):
    """Both ways of matching, over titles with common words, contained words, ties and none alike."""
    rnd = random.Random(11)
    words = ["market", "markets", "tariff", "tariffs", "debate", "energy", "season", "report", "about", "great", "union", "trade"]
    title = lambda n: " ".join(rnd.choice(words + ["x%d" % rnd.randrange(30)]) + rnd.choice(("", "", "s", ",")) for _ in range(n))
    cat = [(f"v{i}", title(rnd.randint(0, 14))) for i in range(80)]
    feed = [(i, title(rnd.randint(0, 9)), None) for i in range(40)]
    c, f = spark.createDataFrame(cat, "video_id string, title string"), spark.createDataFrame(feed, "item_ord int, title string, date date")
    plain = lambda t: {w for w in re.sub(r"[^a-z0-9]+", " ", t.lower()).split() if len(w) > 3}
    want, held = {}, {}
    for v, t in cat:
        scores = [(len(plain(t) & plain(u)) / len(plain(t) | plain(u)) if plain(t) | plain(u) else 0, -i) for i, u, _ in feed]
        if max(scores)[0] >= 0.2:
            want[v] = (-max(scores)[1], round(max(scores)[0], 9))
        for i, u, _ in feed:
            long = {w for w in u.lower().split() if len(w) > 4}
            hits = sum(w in t.lower() for w in long)
            if hits >= 3 and hits / len(long) > 0.4:
                held.setdefault(v, i)
    for _ in range(2):
        assert {r["video_id"]: (r["item_ord"], round(r["score"], 9)) for r in knowledge.best_title_matches(c, f).collect()} == want and want
        monkeypatch.setattr(knowledge, "FEED_TOKENS", 0)  # by a join
    assert {r["video_id"]: r["item_ord"] for r in knowledge.contained_titles(c, f).collect()} == held and held


def test_words_of_a_feed_are_counted_in_tasks(spark, monkeypatch):
    """Long texts are not made into five characters each where the feed is small; results are those of the join."""
    rnd = random.Random(3)
    words = ["Ångström", "tariff", "tariffs", "antitariff", "debate", "market", "supermarkets", "about", "tar", "ÉTUDES", "x" * 100 + "debates"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice((" ", "\n", "\t ", ",", "", "\u00a0")) for _ in range(n))
    cat = [(i % 290, text(rnd.randint(0, 12))) for i in range(300)] + [(300, None), (301, ""), (302, " ")]
    feed = [(i, text(rnd.randint(0, 14))) for i in range(60)] + [(60, None), (61, ""), (None, "tariff debate market"), (3, "tariff debate about")]
    c, f = spark.createDataFrame(cat, "video_id long, title string").repartition(3), spark.createDataFrame(feed, "item_ord int, title string")
    want = {}
    for v, t in cat:
        for i, u in feed:
            long = {w for w in re.split("[ \\t\\n]+", (u or "").lower()) if len(w) > 4}
            hits = sum(w in (t or "").lower() for w in long)
            if i is not None and hits >= 3 and hits / len(long) > 0.4:
                want[v] = min(want.get(v, i), i)
    got = lambda: {r["video_id"]: r["item_ord"] for r in knowledge.contained_titles(c, f).collect()}
    plan = lambda: knowledge.contained_titles(c, f)._jdf.queryExecution().optimizedPlan().toString()
    assert got() == want and want and "Join" not in plan()
    for name in ("TITLES", "COUNTS", "KNOWN_PIECES"):
        monkeypatch.setattr(knowledge, name, 7)
    assert got() == want
    assert knowledge.contained_titles(c, f.limit(0)).count() == 0 and knowledge.contained_titles(c.limit(0), f).count() == 0
    monkeypatch.setattr(knowledge, "FEED_TOKENS", 0)
    assert got() == want and "Join" in plan()


@pytest.mark.parametrize("n", [0, 3])
def test_hashed_search(spark, n):
    e = spark.createDataFrame([(i, i, "alpha beta") for i in range(n)], "id long, ord long, content string").withColumn("speakers", F.array(F.lit("s"))).withColumn("topics", F.array(F.lit("t")))
    assert retrieval.hashed_search(e, "alpha beta", speaker="s", topic="t").count() == n
