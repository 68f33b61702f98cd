"""Queries that go through files: tables of the driver are written as the files that this engine reads and writes, and
read back. Beside them those of the build, of the answer path, and of the functions around model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ann, cache, chapters, chunking, knowledge, quality, retrieval
from tidemark.plans import adapters as A
from tidemark.plans import catalogue as C
from tidemark.plans.ask import Knowledge, Models, ask, retrieved
from tidemark.plans.build import Step, build_all, run_steps
from tidemark.plans.registry import query
from tidemark.sources import readers, sinks

#: Turns as caption events; each third has no text.
CAPTIONS = """seg AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn * 20000 AS st, 20000 AS dur, t AS text
  FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE turn % 3 <> 2) WHERE t <> '')"""


def caption_files(spark: SparkSession, sf_dir: str) -> str:
    """A file for each conversation, and one that breaks off."""
    c = A.table(spark, sf_dir, "conversations")
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda *cs: F.struct(F.concat(*cs).alias("utf8"))
    segs = F.array(part(F.lit("\n  "), F.substring("text", 1, half)), F.struct(F.lit(None).cast("string").alias("utf8")), part(F.substring("text", half + 1, F.length("text")), F.lit(" ﻿")))
    event = F.struct((F.col("turn") * 20_000).cast("long").alias("tStartMs"), F.lit(20_000).cast("long").alias("dDurationMs"), F.when(F.col("turn") % 3 != 2, segs).alias("segs"))
    events = F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"])
    rows = c.groupBy(F.col("conv_id").cast("string").alias("name")).agg(F.to_json(F.struct(events.alias("events"))).alias("value"))
    path = A.files(spark, "captions")
    sinks.named_files(rows.union(spark.createDataFrame([("bad", '{"events": [')], rows.schema)), "name", "value", path, ".en.json3")
    return path


@query(f"WITH {CAPTIONS} SELECT video_id, k - 1 AS seg_no, text, st AS start_ms, st + dur AS end_ms FROM seg")
def captions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.extract_segments(readers.captions(spark, caption_files(spark, sf_dir)))


@query("SELECT 'bad' AS video_id, 'not readable as JSON' AS reason")
def captions_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.bad_captions(spark, caption_files(spark, sf_dir))


@query(f"WITH RECURSIVE {C.sql_chunks(120000)} SELECT {C.CHUNK_COLUMNS} FROM ch")
def transcripts_by_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs, path = A.segments(spark, sf_dir), A.files(spark, "transcripts")
    grains = [chunking.chunk(segs, ms).withColumn("grain", F.lit(name)) for name, ms in (("short", chunking.SHORT_MS), ("long", chunking.LONG_MS))]
    sinks.transcripts(grains[0].union(grains[1]), path)
    return spark.read.parquet(path).where("grain = 'long'").selectExpr("video_id", "chunk_index", "cast(segments as bigint) segments", "start_ms", "end_ms")


@query(f"WITH RECURSIVE {C.sql_chunks(30000)} SELECT CAST(video_id AS VARCHAR) AS video_id, chunk_index, text, CAST(len(regexp_split_to_array(text, '\\s+')) AS BIGINT) AS word_count FROM ch")
def transcripts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as JSON files, one of them hidden by its name."""
    rows = chunking.chunk(A.segments(spark, sf_dir), chunking.SHORT_MS)
    one = F.struct("chunk_index", "text", "word_count")
    whole = F.struct(F.col("video_id").cast("string").alias("videoId"), F.transform("all", lambda c: F.struct(c["chunk_index"].alias("chunkIndex"), c["text"].alias("text"), c["word_count"].alias("wordCount"))).alias("chunks"))
    files = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("all")).select(F.col("video_id").cast("string").alias("name"), F.to_json(whole).alias("value"))
    path = A.files(spark, "transcript-files")
    sinks.named_files(files.union(files.limit(1).withColumn("name", F.lit("_manifest"))), "name", "value", path, ".json")
    read = readers.transcripts(spark, path).select("videoId", F.explode("chunks").alias("c"))
    return read.select(F.col("videoId").alias("video_id"), F.col("c.chunkIndex").cast("long").alias("chunk_index"), F.col("c.text").alias("text"), F.col("c.wordCount").cast("long").alias("word_count"))


@query(f"WITH {C.ENTRIES} SELECT CAST(id AS VARCHAR) AS id, content, video_id, word_count FROM e")
def entry_batches_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir)
    meta = F.struct(F.col("video_id").alias("videoId"), F.col("word_count").alias("wordCount"))
    path = A.files(spark, "batches")
    sinks.batches(e.select("ord", F.col("id").cast("string").alias("id"), "content", meta.alias("metadata")), path, 37)
    return readers.entry_batches(spark, path, "part-*", lines=True).select("id", "content", F.col("metadata.videoId").alias("video_id"), F.col("metadata.wordCount").cast("long").alias("word_count"))


@query(f"WITH {C.ENTRIES} SELECT CAST(id AS VARCHAR) AS id, content, video_id, id * 1000 AS start_ms, array_to_string(topics, ',') AS topics, array_to_string(speakers, ',') AS speakers FROM e")
def content_index_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir).withColumn("s", F.col("id") * 1000)
    row = F.struct(F.col("content").alias("c"), F.col("video_id").alias("v"), F.col("start_time").alias("t"), "s", F.col("topics").alias("p"), F.col("speakers").alias("m"), F.col("url").alias("u"))
    path = A.files(spark, "content-index")
    sinks.json_map(e.select("id", row.alias("row")), "id", "row", path)
    return readers.content_index(spark, path).select("id", "content", "video_id", "start_ms", F.array_join("topics", ",").alias("topics"), F.array_join("speakers", ",").alias("speakers"))


@query(f"WITH {C.IDF} SELECT term, round(idf, 6) AS idf FROM idf")
def idf_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = A.files(spark, "idf")
    sinks.json_map(knowledge.idf(A.entries(spark, sf_dir)), "term", "idf", path)
    return readers.idf(spark, path).union(readers.idf(spark, path + "-that-is-not-there")).select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {C.DATES} SELECT video_id, date FROM dates")
def dates_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = A.files(spark, "dates")
    sinks.json_map(A.dates(spark, sf_dir).withColumn("date", F.col("date").cast("string")), "video_id", "date", path)
    return readers.episode_dates(spark, path)


FACTS = "f AS (SELECT n_nationkey AS ord, n_name AS name, r_name AS role, 'in ' || r_name AS political_alignment, ['plain ' || lower(n_name), 'of ' || r_name] AS current_positions, 'short' AS style FROM nation JOIN region ON n_regionkey = r_regionkey)"


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.array(F.concat(F.lit("plain "), F.lower("n_name")), F.concat(F.lit("of "), "r_name"))
    return both.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.col("r_name").alias("role"), F.concat(F.lit("in "), "r_name").alias("political_alignment"), said.alias("current_positions"), F.lit("short").alias("style"))


@query(f"WITH {FACTS} SELECT CAST(ord AS VARCHAR) AS key, name, role, array_to_string(current_positions, '|') AS current_positions FROM f")
def facts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = A.files(spark, "facts")
    f = fact_rows(spark, sf_dir)
    sinks.json_map(f.select("ord", F.struct(*f.columns[1:]).alias("row")), "ord", "row", path)
    return readers.facts(spark, path).select("key", "name", "role", F.array_join("current_positions", "|").alias("current_positions"))


@query(f"WITH {FACTS} SELECT string_agg('• **' || name || '** — ' || role || chr(10) || '  Political: ' || political_alignment || chr(10) || '  Current positions:' || chr(10) || '  - ' || current_positions[1] || chr(10) || '  - ' || current_positions[2] || chr(10) || '  Voice: ' || style, chr(10) || chr(10) ORDER BY ord) AS facts FROM f")
def facts_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.facts_text(fact_rows(spark, sf_dir))


@query(f"WITH {C.EPISODES} SELECT chs.id, topic, episode_title, episode_date, start_sec, {C.CLOCK} AS start_time FROM chs")
def chapter_lookup_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = C.episodes(spark, sf_dir)[1]
    row = F.struct("topic", F.col("episode_title").alias("episodeTitle"), F.col("episode_date").cast("string").alias("episodeDate"), F.col("audio_url").alias("audioUrl"), F.col("start_time").alias("startTime"), F.col("start_sec").alias("startSec"))
    path = A.files(spark, "chapter-lookup")
    sinks.json_map(named.select("id", row.alias("row")), "id", "row", path)
    return readers.chapter_lookup(spark, path).select("id", "topic", "episode_title", "episode_date", F.col("start_sec").cast("long").alias("start_sec"), "start_time")


@query(f"WITH {C.EPISODES} SELECT kept.id, title, CAST(date AS VARCHAR) AS date, chapter_count, string_agg(topic, '|' ORDER BY start_sec) AS topics FROM kept JOIN chs ON episode_id = kept.id GROUP BY 1, 2, 3, 4")
def chapters_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, named = C.episodes(spark, sf_dir)
    listed = named.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_sec").alias("startSec"), "topic", "id", F.col("start_time").alias("startTime")))).alias("chapters"))
    row = F.struct("id", "title", F.col("date").cast("string").alias("date"), F.col("audio_url").alias("audioUrl"), F.col("chapter_count").alias("chapterCount"), "chapters")
    path = A.files(spark, "chapters")
    sinks.named_files(kept.join(listed, kept["id"] == listed["episode_id"]).select("id", F.to_json(row).alias("value")), "id", "value", path, ".json")
    return readers.chapters(spark, path).select("id", "title", "date", F.col("chapterCount").cast("long").alias("chapter_count"), F.array_join(F.transform("chapters", lambda c: c["topic"]), "|").alias("topics"))


@query(f"WITH {C.EPISODES} SELECT count(*) AS episode_count, CAST(min(date) AS VARCHAR) AS oldest, arg_min(title, id) AS latest_title FROM kept")
def freshness_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = chapters.freshness(C.episodes(spark, sf_dir)[0])
    row = F.struct(F.col("episode_count").alias("episodeCount"), F.struct(F.col("oldest").cast("string").alias("oldest")).alias("dateRange"), F.struct(F.col("latest_title").alias("title")).alias("latestEpisode"))
    path = A.files(spark, "freshness")
    sinks.json_rows(f.select(row.alias("r")).select("r.*"), path)
    assert readers.freshness(spark, path + "-that-is-not-there") is None
    return readers.freshness(spark, path).select(F.col("episodeCount").cast("long").alias("episode_count"), F.col("dateRange.oldest").alias("oldest"), F.col("latestEpisode.title").alias("latest_title"))


#: Conversations as items of a feed, five of which fall on one day; each seventh has no date that can be read.
FEED = "fd AS (SELECT conv_id, 'Talk ' || conv_id || ' on tariffs' AS title, DATE '2024-03-01' + CAST(conv_id // 5 AS INTEGER) + 1 AS date FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 <> 6)"


def feed_file(spark: SparkSession, sf_dir: str) -> str:
    d = A.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    day = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), F.floor(F.col("conv_id") / 5).cast("int")), "dd MMM yyyy")
    when = F.when(F.col("conv_id") % 7 == 6, "some day").otherwise(F.concat(F.lit("Fri, "), day, F.lit(" 23:30:00 -0700")))
    n = F.col("conv_id").cast("string")
    item = F.concat(F.lit("<item><title>Talk "), n, F.lit(" on tariffs</title><pubDate>"), when, F.lit("</pubDate><description><![CDATA[<p>(0:00) Opening "), n, F.lit("</p><p>(1:02:03) Oil &amp; gas</p>]]></description><enclosure url=\"https://example.org/"), n, F.lit('.mp3"/></item>'))
    path = A.files(spark, "feed")
    ends = spark.createDataFrame([(-1, "<rss><channel>"), (1 << 60, "</channel></rss>")], "conv_id long, value string")
    d.select("conv_id", item.alias("value")).union(ends).repartition(1).sortWithinPartitions("conv_id").select("value").write.text(path)
    return path


@query(f"WITH {FEED} SELECT title, date, 'https://example.org/' || conv_id || '.mp3' AS audio_url FROM fd")
def feed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.rss_items(spark, feed_file(spark, sf_dir)).select("title", "date", "audio_url")


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS video_id, CASE WHEN conv_id % 2 = 0 THEN 'Talk ' || conv_id || chr(9) || 'on tariffs' ELSE 'Talk ' || conv_id || ' on tariffs' END AS title FROM conversations")
def list_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with tabs, lines without an id, and backslash-t pairs instead of tabs."""
    return readers.catalogue(spark, list_file(spark, sf_dir), repair=True)


def list_file(spark: SparkSession, sf_dir: str) -> str:
    d = A.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    n = F.col("conv_id").cast("string")
    line = F.when(F.col("conv_id") % 2 == 0, F.concat(n, F.lit("\tTalk "), n, F.lit("\ton tariffs"))).otherwise(F.concat(n, F.lit("\\tTalk "), n, F.lit(" on tariffs")))
    path = A.files(spark, "list")
    d.select(line.alias("value")).union(spark.createDataFrame([("\tno id",), ("",)], "value string")).write.text(path)
    return path


@query(f"WITH {C.ENTRIES} SELECT 'sp ' || speaker AS key, count(*) AS total_mentions FROM (SELECT unnest(speakers) AS speaker FROM e) WHERE speaker IN ('sch', 'tion') GROUP BY 1")
def profiles_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by file name; keys without a file are left out."""
    p = knowledge.speaker_stats(A.entries(spark, sf_dir), list(A.TEST_SPEAKERS)).where("total_mentions > 0")
    row = F.struct(F.col("speaker").alias("name"), F.col("total_mentions").alias("totalMentions"))
    path = A.files(spark, "profiles")
    sinks.named_files(p.select(F.concat(F.lit("sp "), "speaker").alias("name"), F.to_json(row).alias("value")), "name", "value", path, ".json")
    return readers.profiles(spark, path, ["sp sch", "sp tion", "sp nobody"]).select("key", F.col("totalMentions").cast("long").alias("total_mentions"))


@query(f"WITH {C.ENTRIES} SELECT count(*) AS total_entries, count(DISTINCT video_id) AS videos, CAST(sum(word_count) AS BIGINT) AS words FROM e")
def manifest_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = A.files(spark, "manifest")
    sinks.table(knowledge.kb_manifest(A.entries(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query(f"WITH {C.GRADES} SELECT id, CAST(overall AS DOUBLE) AS overall FROM g")
def grades_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = A.files(spark, "grades")
    sinks.json_rows(C.grades(spark, sf_dir), path)
    return spark.read.schema("id long, overall double").json(path)


def lengths(texts: list[str]) -> list[list[float]]:
    """An embedder for tests: a text's length, and 1."""
    return [[float(len(t)), 1.0] for t in texts]


def first_millionths() -> Column:
    return F.round(1_000_000 * F.get("vec", F.lit(0)).cast("double")).cast("long")


def sql_unit(n: str) -> str:
    """The first number of the unit vector of (n, 1), as a float of 32 bits, in whole millionths."""
    return f"CAST(round(1000000 * CAST({n} / sqrt({n}::DOUBLE * {n} + 1) AS FLOAT)::DOUBLE) AS BIGINT)"


@query(f"SELECT doc_id AS id, doc_id AS ord, {sql_unit('length(substr(text, 1, 2000))')} AS x, 'lengths' AS model FROM documents")
def vectors_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = A.files(spark, "vectors")
    sinks.vectors(A.entries(spark, sf_dir), lengths, path, "lengths", batch=7)
    return spark.read.parquet(path).select("id", "ord", first_millionths().alias("x"), "model")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def flat_vectors_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of vectors as one flat file of 32-bit floats, which is written on the driver, as it is the format of small ones."""
    m = A.vectors(spark, sf_dir).orderBy("id").select("vec").toArrow().column("vec").combine_chunks().flatten().to_numpy().astype("<f4")
    path = A.files(spark, "matrix") + "/embeddings.bin"
    sinks.binary_file(spark, m.tobytes(), path)
    return readers.flat_vectors(spark, path, 64).select("place", F.get("vec", F.lit(0)).cast("double").alias("first"), F.get("vec", F.lit(63)).cast("double").alias("last"))


@query("SELECT item_id, CASE WHEN item_id % 3 < 2 THEN item_id END AS score FROM benchmark")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with code fences, with prose around the object, and without one."""
    n = F.col("item_id").cast("string")
    reply = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('```json\n{"score": '), n, F.lit("}\n```"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("So it is {\"score\": "), n, F.lit("} as I said"))).otherwise(F.lit("nothing to be read"))
    return A.table(spark, sf_dir, "benchmark").select("item_id", T.model_json(reply, "score long")["score"].alias("score"))


@query("SELECT item_id, '<h1>' || w || '</h1>' || chr(10) || '<ul><li>' || w || '</li>' || chr(10) || '</ul><strong>' || w || '</strong> <em>x</em> <code>' || w || '</code></p><p><hr />' AS html FROM (SELECT item_id, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM benchmark)")
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    page = F.concat(F.lit("# "), w, F.lit("\n- "), w, F.lit("\n**"), w, F.lit("** *x* `"), w, F.lit("`\n\n---"))
    return A.table(spark, sf_dir, "benchmark").select("item_id", T.markdown_html(page).alias("html"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN CAST((doc_id % 5 - 1) * 25 AS INTEGER) || '% match' END AS shown, CASE WHEN length(q) >= 395 THEN q || '…' ELSE q END AS quote FROM (SELECT doc_id, substr(text, 1, 400) AS q FROM documents)")
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = T.cut("text", 400)
    return A.table(spark, sf_dir, "documents").select("doc_id", T.match_percent((F.col("doc_id") % 5 - 1) * 0.25).alias("shown"), T.ellipsis(quote).alias("quote"))


@query("SELECT item_id AS id, text AS query FROM benchmark ORDER BY item_id LIMIT 5")
def pilot_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pilot(A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query")))


@query(
    """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: length(t) > 4)) AS ws FROM benchmark),
c AS (SELECT doc_id AS video_id, lower(text) AS low FROM documents),
h AS (SELECT video_id, item_id, len(list_filter(ws, lambda t: contains(low, t))) AS hits, len(ws) AS n FROM c, w)
SELECT video_id, min(item_id) AS item_ord FROM h WHERE hits >= 3 AND hits / n > 0.4 GROUP BY 1"""
)
def title_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.col("text").alias("title"))
    return knowledge.contained_titles(titles, A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item_ord"), F.col("text").alias("title")))


@query("SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'new ' || item_id WHEN 1 THEN 'old ' || item_id END AS report FROM benchmark")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers that are the newer of two, fresh, too old, of another tag, and broken."""
    b = A.table(spark, sf_dir, "benchmark").select("item_id", T.cache_key("text", "v1", mode=F.col("item_id").cast("string")).alias("key15"))
    kind, n = F.col("item_id") % 5, F.col("item_id").cast("string")
    said = lambda word: F.concat(F.lit(f'{{"report": "{word} '), n, F.lit('"}'))
    at = lambda hours: A.as_of() - F.make_dt_interval(hours=F.lit(hours))
    old = b.select("key15", F.when(kind == 4, F.lit("{broken")).otherwise(said("old")).alias("payload"), F.when(kind == 2, at(73)).otherwise(at(72)).alias("stored_at"), F.array(F.when(kind == 3, "other").otherwise("answer")).alias("tags"))
    new = b.where(kind == 0).select("key15", said("new").alias("payload"), at(1).alias("stored_at"), F.array(F.lit("answer")).alias("tags"))
    path = A.files(spark, "answers")
    sinks.table(old.union(new), path)
    found = cache.lookup(b, spark.read.parquet(path), "answer", A.as_of())
    return found.select("item_id", F.get_json_object("payload", "$.report").alias("report"))


@query(f"WITH {C.CITED} SELECT n, CAST(id AS VARCHAR) AS id, round(1 - distance, 3) AS relevance, CASE WHEN n = 2 THEN 'NO' WHEN n = 1 THEN 'YES' ELSE 'UNCHECKED' END AS verdict, 'So it is [1]. And not.' AS report, 2 AS checked, 1 AS unsupported, 'tfidf' AS search_mode FROM ci WHERE n <= 12")
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer path with models of fixed replies: retrieval, citations, writing with facts, validation."""
    e = A.entries(spark, sf_dir)
    kb = Knowledge(e, knowledge.idf(e), A.dates(spark, sf_dir), facts=fact_rows(spark, sf_dir))

    def write(query: str, context: str, facts: str) -> str:
        return "So it is [1]. And not [2]." if context.startswith("[1] ") and facts.startswith("• **") else "?"

    models = Models(write=write, judge=lambda pairs: {p["pid"]: "NO" if p["n"] == 2 else "YES" for p in pairs})
    a = ask(kb, models, A.query_text(spark, sf_dir), A.as_of(), 0)
    rows = [(c["n"], str(c["id"]), c["relevance"], c["verdict"], a.report, a.checked, a.unsupported, a.search_mode) for c in a.citations]
    return spark.createDataFrame(rows, "n long, id string, relevance double, verdict string, report string, checked int, unsupported int, search_mode string")


#: What the weekly build makes of caption files, feed and list.
BUILT = f"""{C.sql_chunks(120000, CAPTIONS)}, {FEED},
ks AS (SELECT row_number() OVER (ORDER BY date DESC, conv_id) - 1 AS r, * FROM fd WHERE date >= DATE '2024-04-01')"""


@query(
    f"""WITH RECURSIVE {BUILT} SELECT 'entry' AS kind, video_id || '_long_' || chunk_index AS id, text, CAST(NULL AS DATE) AS date FROM ch
UNION ALL SELECT 'episode', printf('ep_%04d', r), title, date FROM ks
UNION ALL SELECT 'chapter', printf('ep_%04d_ch_00', r), 'Opening ' || conv_id, date FROM ks UNION ALL SELECT 'chapter', printf('ep_%04d_ch_01', r), 'Oil & gas', date FROM ks
UNION ALL SELECT 'bad', 'bad', 'not readable as JSON', NULL UNION ALL SELECT 'vector', video_id || '_long_' || chunk_index, CAST({sql_unit('length(substr(text, 1, 2000))')} AS VARCHAR), NULL FROM ch"""
)
def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = build_all(spark, caption_files(spark, sf_dir), feed_file(spark, sf_dir), None, A.files(spark, "built"), A.TEST_SPEAKERS, A.TEST_TOPICS, embed=lengths, model="lengths")
    none = F.lit(None).cast("date")
    row = lambda kind, name, id_, text, date=none: made[name].select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), text.alias("text"), date.alias("date"))
    out = row("entry", "entries", "id", F.col("content")).union(row("episode", "episodes", "id", F.col("title"), F.col("date")))
    out = out.union(row("chapter", "chapters", "id", F.col("topic"), F.col("episode_date"))).union(row("bad", "bad_captions", "video_id", F.col("reason")))
    return out.union(row("vector", "vectors", "id", first_millionths().cast("string")))


@query(
    f"""WITH {FEED}, t AS (SELECT DISTINCT conv_id FROM conversations), x AS (SELECT t.conv_id, fd.conv_id AS item, fd.date, CASE WHEN t.conv_id = fd.conv_id AND length(CAST(fd.conv_id AS VARCHAR)) > 3 THEN 1.0 ELSE 2 / (2 + CAST(length(CAST(t.conv_id AS VARCHAR)) > 3 AS INTEGER) + CAST(length(CAST(fd.conv_id AS VARCHAR)) > 3 AS INTEGER)) END AS score FROM t, fd)
SELECT CAST(conv_id AS VARCHAR) AS video_id, date FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, item) AS r FROM x) WHERE r = 1"""
)
def dates_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that all are much alike: the first item of the feed wins among equals."""
    items = readers.rss_items(spark, feed_file(spark, sf_dir)).withColumnRenamed("place", "item_ord")
    path = A.files(spark, "feed-items")
    sinks.table(items, path)
    return knowledge.best_title_matches(readers.catalogue(spark, list_file(spark, sf_dir), repair=True), spark.read.parquet(path)).select("video_id", "date")


@query(
    """WITH n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM documents WHERE coalesce(source, 'src19') = 'src19') AS undated, (SELECT count(*) FROM embeddings) AS v)
SELECT 'entries' AS step, 'ok' AS status, '' AS reason UNION ALL
SELECT 'dates', CASE WHEN undated = 0 THEN 'ok' ELSE 'warned' END, CASE WHEN undated = 0 THEN '' ELSE 'LookupError: ' || undated || ' entries without a date' END FROM n UNION ALL
SELECT 'vectors', CASE WHEN v = d THEN 'ok' ELSE 'failed' END, CASE WHEN v = d THEN '' ELSE 'ValueError: ' || v || ' vectors of ' || d || ' entries' END FROM n UNION ALL
SELECT 'publish', CASE WHEN v = d THEN 'ok' ELSE 'not run' END, '' FROM n"""
)
def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over the tables: entries are written and read back, dates may be missing, a vector for each entry may not."""
    path = A.files(spark, "job")

    def dates() -> None:
        if n := spark.read.parquet(path).join(A.dates(spark, sf_dir), "video_id", "left_anti").count():
            raise LookupError(f"{n} entries without a date")

    def vectors() -> None:
        v, d = A.vectors(spark, sf_dir).count(), spark.read.parquet(path).count()
        if v != d:
            raise ValueError(f"{v} vectors of {d} entries")

    steps = [
        Step("entries", lambda: sinks.table(A.entries(spark, sf_dir).select("id", "video_id", "word_count"), path)),
        Step("dates", dates, needed=False),
        Step("vectors", vectors),
        Step("publish", lambda: sinks.table(knowledge.kb_manifest(spark.read.parquet(path)), path + "-manifest"), needed=False),
    ]
    return spark.createDataFrame(run_steps(steps), "step string, status string, reason string")


EXACT = "x AS (SELECT q.vec_id AS query_id, v.vec_id AS id, 1 - list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"


def indexed(spark: SparkSession, sf_dir: str) -> tuple[str, tuple[int, int]]:
    """The index of all vectors and of two that cannot be in it."""
    v = A.vectors(spark, sf_dir).select("id", "ord", "vec", "speakers", "video_id")
    odd = spark.createDataFrame([(-1, [1.0]), (-2, None)], "id long, vec array<float>")
    path = A.files(spark, "index")
    return path, ann.build(v.unionByName(odd, allowMissingColumns=True), path, 64)


@query("SELECT count(*) AS accepted, CAST(2 AS BIGINT) AS rejected FROM embeddings")
def index_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([indexed(spark, sf_dir)[1]], "accepted long, rejected long")


@query(f"WITH {C.COSINE} SELECT id, round(d, 6) AS distance FROM cs ORDER BY d, id LIMIT 30")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that looks into every cell, which is exact."""
    hits = ann.search(spark, indexed(spark, sf_dir)[0], A.query_vector(spark, sf_dir), probes=1 << 30)
    return hits.select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {EXACT} SELECT query_id, id, round(d, 6) AS distance, r - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM x) WHERE r <= 10")
def index_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 as a query against all, looking into every cell."""
    v = A.vectors(spark, sf_dir)
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    rows = ann.search_many(v, indexed(spark, sf_dir)[0], queries, 10, 1 << 30, 64)
    return rows.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {C.COSINE} SELECT id, 'ann' AS mode, (SELECT count(*) FROM documents) AS total_entries FROM (SELECT id FROM cs ORDER BY d, id LIMIT 1)")
def answered_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer path without a table of vectors: the index is the tier that answers. The vector asked for is in its cell."""
    e, path = A.entries(spark, sf_dir), indexed(spark, sf_dir)[0]
    entries = e.select("id", "ord", "content", "start_time", "url", "topics")
    kb = Knowledge(entries, knowledge.idf(e), A.dates(spark, sf_dir), index=path)
    vector = A.query_vector(spark, sf_dir)
    label, hits = retrieved(kb, Models(embed=lambda _: vector), "any", A.as_of(), None)
    return hits.orderBy("raw_distance", "ord").limit(1).select("id", F.lit(label).alias("mode"), F.lit(entries.count()).alias("total_entries"))


@query("SELECT count(*) AS queries, 10 * count(*) AS hits, true AS nine_tenths FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 as a query, looking into as many cells as were measured when the index was
    built: how many hits there are, and whether nine tenths of the 10 nearest of all rows are among them."""
    v, path = A.vectors(spark, sf_dir), indexed(spark, sf_dir)[0]
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    near = ann.search_many(v, path, queries, 10, None, 64).select("query_id", "id", F.lit(1).alias("found"))
    exact = ann.search_many(v, path, queries, 10, 1 << 30, 64).select("query_id", "id")
    shared = exact.join(near, ["query_id", "id"], "left")
    return shared.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("hits"), (F.count("found") >= 0.9 * F.count("*")).alias("nine_tenths"))


@query(f"WITH {C.EPISODES} SELECT chs.id, {sql_unit('length(topic)')} AS x FROM chs")
def chapter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters' topics embedded, as entries are."""
    named = C.episodes(spark, sf_dir)[1].select("id", F.col("id").alias("ord"), F.col("topic").alias("content"))
    path = A.files(spark, "chapter-vectors")
    sinks.vectors(named, lengths, path, "lengths", chars=512, batch=64)
    return spark.read.parquet(path).select("id", first_millionths().alias("x"))
