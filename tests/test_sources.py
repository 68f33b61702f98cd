import json
import struct

from pyspark.sql import functions as F

from tidemark.operators import ann
from tidemark.operators.cache import MemoryCache, TableCache
from tidemark.plans import adapters as A
from tidemark.plans.ask import Knowledge, Models, ask
from tidemark.plans.build import build_all, weekly
from tidemark.operators import knowledge
from tidemark.sources import readers, sinks
from tidemark.streaming import ingest

SF = "/root/testdata/sf0.001"


def caption_files(folder, n=3):
    folder.mkdir(parents=True, exist_ok=True)
    for v in range(n):
        events = [{"tStartMs": k * 20_000, "dDurationMs": 20_000, "segs": [{"utf8": f"token talk {k} "}, {"utf8": "of oil"}]} for k in range(10)]
        (folder / f"vid{v}.en.json3").write_text(json.dumps({"events": events}))
    (folder / "bad.en.json3").write_text('{"events": [')
    return folder


def test_files_are_written_in_tasks_under_their_names(spark, tmp_path):
    """Odd names, a name of two rows, one without a name, null contents; what was there before goes."""
    path = tmp_path / "named"
    rows = [("a b", "1"), ("x+y", "2"), ("ä%2F:=", "Ünï\r\n3"), ("same", "4"), ("same", "4"), ("empty", None), (None, "5")]
    want = {f"{n}.json": f"{t}\n" for n, t in (("a b", "1"), ("x+y", "2"), ("ä%2F:=", "Ünï\r\n3"), ("same", "4\n4"), ("empty", ""), ("__HIVE_DEFAULT_PARTITION__", "5"))}
    for more in ([("old", "0")], []):
        sinks.named_files(spark.createDataFrame(rows + more, "n string, t string"), "n", "t", f"file://{path}", ".json")
    assert {f.name: f.read_bytes().decode() for f in path.iterdir()} == want


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "TASKS", 1, raising=False)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4m")
    try:
        rows = readers.all_captions(spark, str(caption_files(tmp_path / "many", 20)), ".en.json3")
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {r["video_id"] for r in rows.collect()} == {"bad", *(f"vid{v}" for v in range(20))}
    finally:
        spark.conf.set(key, before)


def test_a_build_reads_caption_files_once(spark, tmp_path, monkeypatch):
    reads = []
    monkeypatch.setattr(readers, "all_captions", lambda *a, f=readers.all_captions: reads.append(1) or f(*a))
    made = build_all(spark, str(caption_files(tmp_path / "in")), None, None, str(tmp_path / "out"), {}, {})
    assert len(reads) == 1
    assert made["entries"].count() == 6 and [tuple(r) for r in made["bad_captions"].collect()] == [("bad", "not readable as JSON")]


FEED = """<rss><channel><item><title>Trade war tariffs debate</title><pubDate>Fri, 10 May 2024 10:00:00 GMT</pubDate>
<description><![CDATA[<p>(0:00) Intro to it</p><p>(12:34) Oil &amp; gas</p>]]></description><enclosure url="https://e.org/a.mp3"/></item>
<item><title>Old one</title><pubDate>Fri, 10 May 2019 10:00:00 GMT</pubDate><description>x</description></item></channel></rss>"""


def test_readers(spark, tmp_path):
    assert readers.captions(spark, str(caption_files(tmp_path / "c"))).count() == 3
    (tmp_path / "feed.xml").write_text(FEED)
    assert [r["title"] for r in readers.rss_items(spark, str(tmp_path / "feed.xml"), "2024-04-01").collect()] == ["Trade war tariffs debate"]
    (tmp_path / "list.tsv").write_text("v1\tTariffs debate\twith tab\n\tno id\nv2\\tescaped\n")
    assert {tuple(r) for r in readers.catalogue(spark, str(tmp_path / "list.tsv"), repair=True).collect()} == {("v1", "Tariffs debate\twith tab"), ("v2", "escaped")}
    (tmp_path / "idf.json").write_text('{"a": 1.5, "b": 2}')
    assert {tuple(r) for r in readers.idf(spark, str(tmp_path / "idf.json")).collect()} == {("a", 1.5), ("b", 2.0)}
    assert readers.idf(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.bin").write_bytes(struct.pack("<6f", *range(6)))
    assert [r["vec"] for r in readers.flat_vectors(spark, str(tmp_path / "m.bin"), 3).orderBy("place").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "index.json").write_text('{"x": {"c": "text", "v": "v1", "t": "00:00:01", "s": 1000, "p": ["AI"], "m": [], "u": "u"}}')
    assert readers.content_index(spark, str(tmp_path / "index.json")).first()["start_ms"] == 1000
    assert readers.freshness(spark, str(tmp_path / "nope.json")) is None


def test_sinks(spark, tmp_path):
    e = A.entries(spark, SF).limit(30)
    sinks.batches(e, str(tmp_path / "b"), 7)
    assert spark.read.json(str(tmp_path / "b")).count() == 30
    sinks.vectors(e, lambda texts: [[float(len(t)), 1.0] for t in texts], str(tmp_path / "v"), "lengths", chars=10, batch=4)
    rows = spark.read.parquet(str(tmp_path / "v")).collect()  # in unit length
    assert {round(r["vec"][0] / r["vec"][1]) for r in rows} <= set(range(11)) and all(abs(r["vec"][0] ** 2 + r["vec"][1] ** 2 - 1) < 1e-6 for r in rows)
    sinks.json_map(knowledge.idf(A.entries(spark, SF)), "term", "idf", str(tmp_path / "idf"))
    part = next((tmp_path / "idf").glob("part-*"))
    assert readers.idf(spark, str(part)).count() == knowledge.idf(A.entries(spark, SF)).count()


def test_a_map_in_several_files(spark, tmp_path):
    """Each file is an object of its own, with a range of the keys in order."""
    import json

    idf = knowledge.idf(A.entries(spark, SF))
    sinks.json_map(idf, "term", "idf", str(tmp_path / "many"), rows=100)
    files = sorted((tmp_path / "many").glob("part-*"))
    maps = [json.loads(f.read_text()) for f in files]
    assert len(files) > 3 and all(list(m) == sorted(m) for m in maps)
    assert {k: v for m in maps for k, v in m.items()} == {r["term"]: r["idf"] for r in idf.collect()}
    assert {r["term"]: r["idf"] for r in readers.idf(spark, str(tmp_path / "many")).collect()} == {r["term"]: r["idf"] for r in idf.collect()}
    sinks.json_map(idf.limit(0), "term", "idf", str(tmp_path / "none"))
    assert readers.idf(spark, str(tmp_path / "none")).count() == 0


def test_build_and_stream(spark, tmp_path):
    folder = caption_files(tmp_path / "c")
    (tmp_path / "feed.xml").write_text(FEED)
    (tmp_path / "list.tsv").write_text("vid0\tTrade war tariffs debate\n")
    made = build_all(spark, str(folder), str(tmp_path / "feed.xml"), str(tmp_path / "list.tsv"), str(tmp_path / "out"), {"t": ["token"], "z": ["zzz"]})
    assert made["manifest"].first()["episode_count"] == 3
    assert made["chapters"].count() == 2 and made["episode_dates"].count() == 1
    assert {r["speaker"]: r["episodes"] for r in made["profiles"].collect()} == {"t": 3, "z": 0}
    out = str(tmp_path / "stream")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, str(folder), out, str(tmp_path / "ck"), {"energy": ["oil"]}, {"t": ["token"]}).awaitTermination()
    assert spark.read.parquet(out).count() == made["chunks"].count()


def test_ask(spark):
    e = A.entries(spark, SF)
    kb = Knowledge(e, knowledge.idf(e), A.dates(spark, SF))
    q = A.query_text(spark, SF)
    store = MemoryCache()
    models = Models(score=lambda q, lines: [float(len(x)) for x in lines], write=lambda q, c, f: "So it is [1]. And not [2].", judge=lambda pairs: {p["pid"]: "NO" if p["n"] == 2 else "YES" for p in pairs})
    a = ask(kb, models, q, A.as_of(), 0, store)
    assert a.report == "So it is [1]. And not." and (a.checked, a.unsupported) == (2, 1)
    assert [c["n"] for c in a.citations] == list(range(1, len(a.citations) + 1)) and a.search_mode == "tfidf"
    assert ask(kb, models, q, A.as_of(), 1, store).cache_hit
    assert ask(kb, Models(), q, A.as_of(), 0, speaker="tion").citations
    assert not ask(kb, Models(), "zzzzqqq", A.as_of(), 0).citations
    try:
        ask(kb, Models(), "  ", A.as_of(), 0)
        raise AssertionError
    except ValueError:
        pass


def test_ask_with_a_table_and_facts(spark, tmp_path):
    """What one process stored another finds, as long as it is valid; facts go to the writer."""
    e = A.entries(spark, SF)
    facts = spark.createDataFrame([(0, "Ann", "host", "none", ["likes tea"], "dry")], "ord int, name string, role string, political_alignment string, current_positions array<string>, style string")
    kb = Knowledge(e, knowledge.idf(e), A.dates(spark, SF), facts=facts)
    seen = []
    models = Models(write=lambda q, c, f: seen.append(f) or "Done [1].")
    table, hour = TableCache(spark, str(tmp_path / "answers")), 3_600_000
    first = ask(kb, models, A.query_text(spark, SF), A.as_of(), 0, MemoryCache(), table=table)
    assert first.total_entries == e.count() and first.latency_ms > 0
    assert not first.cache_hit and len(seen) == 1 and seen[0].startswith("• **Ann** — host")
    store = MemoryCache()
    again = ask(kb, models, A.query_text(spark, SF).upper(), A.as_of(), 71 * hour, store, table=table)
    assert (again.cache_hit, again.cache_source, again.report) == (True, "table", "Done [1].") and len(seen) == 1
    assert [c["id"] for c in again.citations] == [c["id"] for c in first.citations]
    assert ask(kb, models, A.query_text(spark, SF), A.as_of(), 71 * hour, store, table=table).cache_source == "memory"
    assert not ask(kb, models, A.query_text(spark, SF), A.as_of(), 73 * hour, None, table=table).cache_hit
    assert not ask(kb, models, A.query_text(spark, SF), A.as_of(), 0, None, mode="forecast", table=table).cache_hit


def test_a_search_is_run_once(spark):
    """Hits are a table in memory: what follows reads no file."""
    from tidemark.plans.ask import retrieved

    e = A.entries(spark, SF)
    for speaker in (None, "tion"):
        hits = retrieved(Knowledge(e, knowledge.idf(e), A.dates(spark, SF)), Models(), A.query_text(spark, SF), A.as_of(), speaker)[1]
        assert "FileScan" not in hits._jdf.queryExecution().executedPlan().toString()


def test_index_recall(spark, tmp_path):
    """Every row whose id is divisible by 50 as a query, cells that a few probes reach, against all rows."""
    v = A.vectors(spark, "/root/testdata/sf0.01")
    path = str(tmp_path / "index")
    assert ann.build(v, path, 64, cells=12) == (v.count(), 0)
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    exact = {(r["query_id"], r["id"]) for r in ann.search_many(v, path, queries, 10, 12, 64).collect()}
    near = {(r["query_id"], r["id"]) for r in ann.search_many(v, path, queries, 10, None, 64).collect()}
    assert len(exact) == 10 * queries.count() and len(near & exact) >= 0.9 * len(exact)
    # cells that no query looks into are not read
    one = ann.search_many(v, path, queries.limit(1), 10, 2, 64)
    assert 0 < one.count() <= 10 and "cell#" in str(one._jdf.queryExecution().executedPlan().toString()).split("PartitionFilters")[1][:120]
    plan = ann.search(spark, path, [1.0] * 64, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_weekly(spark, tmp_path):
    folder = caption_files(tmp_path / "c")
    (tmp_path / "feed.xml").write_text(FEED)
    (tmp_path / "list.tsv").write_text("vid0\tTrade war tariffs debate\n")
    nothing = lambda: None

    def fails():
        raise OSError("no network")

    at = (spark, str(folder), str(tmp_path / "feed.xml"), str(tmp_path / "list.tsv"), str(tmp_path / "out"), {"t": ["token"]})
    done = weekly(*at, fetch_feed=nothing, fetch_catalogue=fails, fetch_captions=nothing, publish=fails)
    assert [(n, s) for n, s, _ in done] == [("feed", "ok"), ("catalogue", "warned"), ("captions", "ok"), ("build", "ok"), ("publish", "warned")]
    assert spark.read.parquet(str(tmp_path / "out" / "entries")).count() > 0
    assert [(n, s) for n, s, _ in weekly(*at, fetch_feed=fails, fetch_catalogue=nothing, fetch_captions=nothing)] == [("feed", "failed"), ("catalogue", "not run"), ("captions", "not run"), ("build", "not run")]


def test_items_alike_are_two_episodes_in_the_feeds_order(spark, tmp_path):
    item = "<item><title>Same</title><pubDate>Fri, 10 May 2024 10:00:00 GMT</pubDate><description><![CDATA[<p>(0:00) Part {}</p>]]></description></item>"
    (tmp_path / "feed.xml").write_text("<rss><channel>" + "".join(item.format(k) for k in "zyx") + "</channel></rss>")
    made = build_all(spark, str(caption_files(tmp_path / "c")), str(tmp_path / "feed.xml"), None, str(tmp_path / "out"), {"t": ["token"]})
    assert [(r["episode_id"], r["topic"]) for r in made["chapters"].orderBy("id").collect()] == [("ep_0000", "Part z"), ("ep_0001", "Part y"), ("ep_0002", "Part x")]


def test_plans(spark):
    """Filters and columns reach the scan, searches end in a top-k, and no search shuffles documents."""
    from tidemark.operators import retrieval

    v = A.vectors(spark, SF)
    plan = retrieval.cosine_search(v.where("label = 3"), [1.0] * 64)._jdf.queryExecution().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan
    e = A.entries(spark, SF)
    plan = retrieval.keyword_search(e, "than the")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "n_chars" not in plan
    plan = retrieval.hashed_search(e, "than the")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    plan = retrieval.tfidf_search(e, knowledge.idf(e), A.query_text(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1  # one pass over the texts, whatever the number of terms
    assert retrieval.substring_search(e.where(F.col("video_id") == "src1"), "than that").count() >= 0
