"""The queries of this engine over the driver's tables, each beside the SQL that says the same.

Searches, lists and reports end in top-k limits, which are what they are for; everything else returns all it finds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import cache, chapters, chunking, citations, knowledge, postings, quality, retrieval
from tidemark.plans import adapters as A
from tidemark.plans.registry import query
from tidemark.sources import readers

def sql_tags(column: str, dictionary: dict[str, list[str]]) -> str:
    each = [f"CASE WHEN {' OR '.join(f'''contains(lower({column}), '{w}')''' for w in words)} THEN '{key}' END" for key, words in dictionary.items()]
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


ENTRIES = f"""e AS (SELECT doc_id AS id, doc_id AS ord, text AS content, source AS video_id, {sql_tags("text", A.TEST_TOPICS)} AS topics,
  {sql_tags("text", A.TEST_SPEAKERS)} AS speakers, CAST(len(regexp_split_to_array(text, '\\s+')) AS BIGINT) AS word_count FROM documents)"""
DATES = "dates AS (SELECT DISTINCT source AS video_id, DATE '2024-01-01' + CAST(substr(source, 4) AS INTEGER) * 20 AS date FROM documents WHERE source <> 'src19')"
WEIGHT = "CASE WHEN date IS NULL THEN 0.85 WHEN date > DATE '2024-06-30' THEN 1.0 ELSE 0.4 + 0.6 * exp(-(DATE '2024-06-30' - date) / 180.0) END"
SEGMENTS = """s AS (SELECT conv_id AS video_id, turn, text, length(text) * 60 AS dur FROM conversations),
seg AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn) AS k,
  CAST(coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM s)"""


def sql_chunks(span: int, segments: str = SEGMENTS) -> str:
    return f"""{segments},
c AS (SELECT video_id, k, st, st + dur AS en, st AS anchor, 0 AS chunk, dur >= {span} AS closes FROM seg WHERE k = 1
  UNION ALL SELECT n.video_id, n.k, n.st, n.st + n.dur, CASE WHEN c.closes THEN n.st ELSE c.anchor END, c.chunk + CAST(c.closes AS INTEGER),
    n.st + n.dur - CASE WHEN c.closes THEN n.st ELSE c.anchor END >= {span}
  FROM c JOIN seg n ON n.video_id = c.video_id AND n.k = c.k + 1),
ch AS (SELECT c.video_id, c.chunk AS chunk_index, count(*) AS segments, min(c.st) AS start_ms, arg_max(c.en, c.k) AS end_ms, string_agg(seg.text, ' ' ORDER BY c.k) AS text
  FROM c JOIN seg ON seg.video_id = c.video_id AND seg.k = c.k GROUP BY 1, 2)"""


TOKENS = "unnest(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'))"
STOP = "(" + ", ".join(f"'{w}'" for w in T.RETRIEVAL_STOPWORDS) + ")"
KSTOP = "(" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS) + ")"
IDF = f"""tok AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents) WHERE length(t) > 2 AND length(t) < 30),
idf AS (SELECT t AS term, count(*) AS df, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM tok GROUP BY t HAVING count(*) >= 2)"""


@query(f"WITH {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.idf(A.entries(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {IDF} SELECT * FROM (SELECT term, round(idf, 6) AS idf, 'rare' AS \"end\" FROM idf ORDER BY idf.idf DESC, term LIMIT 20) UNION ALL SELECT * FROM (SELECT term, round(idf, 6) AS idf, 'common' FROM idf ORDER BY idf.idf, term LIMIT 20)")
def idf_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.term_extremes(knowledge.idf(A.entries(spark, sf_dir)), 20).select("term", F.round("idf", 6).alias("idf"), "end")


def sql_tfidf(entries: str, speaker: str = "true", limit: int = 30) -> str:
    return f"""{IDF},
q AS (SELECT t, coalesce(idf, 5.5) AS w FROM (SELECT DISTINCT t FROM (SELECT {TOKENS.format("text")} AS t FROM benchmark WHERE item_id = 2) WHERE length(t) >= 3 AND t NOT IN {STOP}) x LEFT JOIN idf ON term = t),
p AS (SELECT count(*) FILTER (w > 2.5) AS n, coalesce(nullif(sum(3 * w), 0), 1) AS most FROM q),
g AS (SELECT * FROM {entries} e WHERE {speaker} AND ((SELECT n FROM p) = 0 OR EXISTS (SELECT 1 FROM q WHERE w > 2.5 AND contains(lower(e.content), q.t)))),
cnt AS (SELECT id, t, count(*) AS c FROM (SELECT id, {TOKENS.format("content")} AS t FROM g) GROUP BY 1, 2),
sc AS (SELECT id, sum((1 + ln(c)) * w) * CASE WHEN (SELECT n FROM p) > 1 THEN 1 + 0.5 * count(*) FILTER (w > 2.5) / (SELECT n FROM p) ELSE 1 END AS score FROM cnt JOIN q USING (t) GROUP BY id HAVING sum((1 + ln(c)) * w) > 0),
tf AS (SELECT g.*, score, 1 - least(1, score / (most * 0.5)) AS raw, (1 - least(1, score / (most * 0.5))) / ({WEIGHT}) AS distance
  FROM g JOIN sc USING (id) LEFT JOIN dates USING (video_id), p ORDER BY distance, ord LIMIT {limit})"""


@query(f"WITH {ENTRIES}, {DATES}, {sql_tfidf('e')} SELECT id, round(score, 6) AS score, round(raw, 6) AS raw_distance, round(distance, 6) AS distance FROM tf")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir)
    hits = retrieval.tfidf_search(e, knowledge.idf(e), A.query_text(spark, sf_dir), dates=A.dates(spark, sf_dir), as_of=A.as_of())
    return hits.select("id", *[F.round(c, 6).alias(c) for c in ("score", "raw_distance", "distance")])


@query(f"WITH {ENTRIES}, {DATES}, {sql_tfidf('e', '''list_contains(speakers, 'tion')''', 20)} SELECT id, round(distance, 6) AS distance FROM tf")
def tfidf_search_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir)
    hits = retrieval.tfidf_search(e, knowledge.idf(e), A.query_text(spark, sf_dir), 20, A.dates(spark, sf_dir), A.as_of(), "tion")
    return hits.select("id", F.round("distance", 6).alias("distance"))


#: The items whose texts the indexes are asked for.
ASKED = "item_id % 50 = 0"


def asked(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    return [tuple(r) for r in A.table(spark, sf_dir, "benchmark").where(ASKED).select("item_id", "text").orderBy("item_id").collect()]


def of_items(spark: SparkSession, sf_dir: str, search: Callable[[str], DataFrame]) -> DataFrame:
    """The hits of each item that is asked for, as one table."""
    hits = [search(text).withColumn("item_id", F.lit(item).cast("long")) for item, text in asked(spark, sf_dir)]
    return reduce(DataFrame.unionByName, hits)


@query(
    f"""WITH {ENTRIES}, {DATES}, {IDF},
q AS (SELECT item_id, t, coalesce(idf, 5.5) AS w FROM (SELECT DISTINCT item_id, t FROM (SELECT item_id, {TOKENS.format("text")} AS t FROM benchmark WHERE {ASKED}) WHERE length(t) >= 3 AND t NOT IN {STOP}) x LEFT JOIN idf ON term = t),
p AS (SELECT item_id, count(*) FILTER (w > 2.5) AS n, coalesce(nullif(sum(3 * w), 0), 1) AS most FROM q GROUP BY item_id),
cnt AS (SELECT id, t, count(*) AS c FROM (SELECT id, {TOKENS.format("content")} AS t FROM e) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
sc AS (SELECT item_id, id, sum((1 + ln(c)) * w) * CASE WHEN any_value(p.n) > 1 THEN 1 + 0.5 * count(*) FILTER (w > 2.5) / any_value(p.n) ELSE 1 END AS score, any_value(p.n) AS n, any_value(most) AS most FROM cnt JOIN q USING (t) JOIN p USING (item_id) GROUP BY item_id, id),
g AS (SELECT item_id, e.*, score, 1 - least(1, score / (most * 0.5)) AS raw FROM sc JOIN e USING (id) WHERE score > 0 AND (n = 0 OR EXISTS (SELECT 1 FROM q WHERE q.item_id = sc.item_id AND w > 2.5 AND contains(lower(e.content), q.t)))),
tf AS (SELECT item_id, id, raw / ({WEIGHT}) AS distance, row_number() OVER (PARTITION BY item_id ORDER BY raw / ({WEIGHT}), ord) AS r FROM g LEFT JOIN dates USING (video_id))
SELECT item_id, id, round(distance, 6) AS distance FROM tf WHERE r <= 30"""
)
def tfidf_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF search of every fiftieth item from postings."""
    index = postings.build(A.entries(spark, sf_dir), A.files(spark, "postings"))
    dates = A.dates(spark, sf_dir)
    return of_items(spark, sf_dir, lambda q: postings.tfidf_search(index, q, dates=dates, as_of=A.as_of()).hits.select("id", F.round("distance", 6).alias("distance")))


COSINE = "cs AS (SELECT vec_id AS id, label, 1 - list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(q, q)) AS d FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0))"
RECENT = f"rc AS (SELECT id, label, d / ({WEIGHT}) AS distance FROM cs LEFT JOIN dates ON video_id = 'src' || label)"


@query(f"WITH {COSINE} SELECT id, round(d, 6) AS distance FROM cs ORDER BY d, id LIMIT 30")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine_search(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir)).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {COSINE} SELECT id, label, round(d, 6) AS distance FROM cs WHERE label = 3 ORDER BY d, id LIMIT 20")
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine_search(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir), 20, speaker="3").select("id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {DATES}, {COSINE}, {RECENT} SELECT id, round(distance, 6) AS distance FROM rc ORDER BY rc.distance, id LIMIT 30")
def cosine_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.cosine_search(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir), dates=A.dates(spark, sf_dir), as_of=A.as_of())
    return hits.select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {COSINE} SELECT id, round(d, 6) AS distance FROM (SELECT * FROM cs ORDER BY d, id LIMIT 36) WHERE label % 2 = 0 ORDER BY d, id LIMIT 12")
def over_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = A.query_vector(spark, sf_dir), A.vectors(spark, sf_dir)
    return retrieval.over_fetched(lambda k: retrieval.cosine_search(v, q, k), F.col("label") % 2 == 0, 12).select("id", F.round("distance", 6).alias("distance"))


@query("WITH o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS label FROM embeddings) SELECT label, id FROM o WHERE label IN (1, 2, 7, 40)")
def labels_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.createDataFrame([(0,), (1,), (2,), (7,), (40,), (10**9,)], "label long")
    order = A.vectors(spark, sf_dir).select("id", F.col("id").alias("place"))
    return retrieval.by_label(hits, order).select("label", "id")


@query("SELECT id, i, round(x, 6) AS x FROM (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS x FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.vectors(spark, sf_dir).select("id", F.posexplode(V.l2_normalize("vec")).alias("i", "x"))
    return rows.select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def chunk_rows(spark: SparkSession, sf_dir: str, span: int) -> DataFrame:
    return chunking.chunk(A.segments(spark, sf_dir), span)


CHUNK_COLUMNS = "video_id, chunk_index, segments, start_ms, end_ms"


@query(f"WITH RECURSIVE {sql_chunks(30000)} SELECT {CHUNK_COLUMNS} FROM ch")
def chunk_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(spark, sf_dir, chunking.SHORT_MS).selectExpr("video_id", "chunk_index", "cast(segments as bigint) segments", "start_ms", "end_ms")


@query(f"WITH RECURSIVE {sql_chunks(120000)} SELECT {CHUNK_COLUMNS} FROM ch")
def chunk_120s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(spark, sf_dir, chunking.LONG_MS).selectExpr("video_id", "chunk_index", "cast(segments as bigint) segments", "start_ms", "end_ms")


@query(
    f"""WITH RECURSIVE {sql_chunks(120000)}
SELECT video_id || '_long_' || chunk_index AS id, text, CAST(len(regexp_split_to_array(text, '\\s+')) AS BIGINT) AS word_count,
  printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS start_time, 'https://youtube.com/watch?v=' || video_id || '&t=' || start_ms // 1000 || 's' AS url,
  array_to_string({sql_tags("text", A.TEST_TOPICS)}, ',') AS topics FROM ch"""
)
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.enrich(chunk_rows(spark, sf_dir, chunking.LONG_MS), A.TEST_TOPICS, A.TEST_SPEAKERS, "long")
    return rows.select("id", "text", F.col("word_count").cast("long").alias("word_count"), "start_time", "url", F.array_join("topics", ",").alias("topics"))


@query(
    f"""WITH RECURSIVE {sql_chunks(30000)}, l AS (SELECT video_id, max(st + dur) AS duration_ms FROM seg GROUP BY 1)
SELECT video_id, duration_ms, CAST(sum(len(regexp_split_to_array(text, '\\s+'))) AS BIGINT) AS total_words, count(*) AS chunk_count FROM ch JOIN l USING (video_id) GROUP BY 1, 2"""
)
def transcript_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = A.segments(spark, sf_dir)
    return chunking.transcript_totals(segs, chunking.chunk(segs, chunking.SHORT_MS), chunking.chunk(segs, chunking.LONG_MS)).select("video_id", "duration_ms", "total_words", "chunk_count")


@query(f"WITH RECURSIVE {sql_chunks(30000)} SELECT count(DISTINCT video_id) AS episode_count, count(*) AS total_chunks, CAST(sum(len(regexp_split_to_array(text, '\\s+'))) AS BIGINT) AS total_words FROM ch")
def transcript_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = A.segments(spark, sf_dir)
    return chunking.manifest(chunking.transcript_totals(segs, chunking.chunk(segs, chunking.SHORT_MS), chunking.chunk(segs, chunking.LONG_MS)))


@query(f"WITH {ENTRIES} SELECT id, i, topics[i + 1] AS topic FROM (SELECT id, topics, unnest(range(len(topics))) AS i FROM e)")
def detect_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entries(spark, sf_dir).select("id", F.posexplode("topics").alias("i", "topic")).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {ENTRIES} SELECT id, i, speakers[i + 1] AS speaker FROM (SELECT id, speakers, unnest(range(len(speakers))) AS i FROM e)")
def detect_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entries(spark, sf_dir).select("id", F.posexplode("speakers").alias("i", "speaker")).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {ENTRIES} SELECT topic, count(*) AS entries FROM (SELECT unnest(topics) AS topic FROM e) GROUP BY topic")
def topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.topic_distribution(A.entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT count(*) AS total_entries, count(DISTINCT video_id) AS videos, CAST(sum(word_count) AS BIGINT) AS words FROM e")
def kb_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.kb_manifest(A.entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT speaker, count(video_id) AS total_mentions, count(DISTINCT video_id) AS episodes FROM (SELECT unnest(['sch', 'eux', 'tion', 'nobody']) AS speaker) d LEFT JOIN (SELECT unnest(speakers) AS speaker, video_id FROM e) USING (speaker) GROUP BY speaker")
def speaker_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.speaker_stats(A.entries(spark, sf_dir), [*A.TEST_SPEAKERS, "nobody"])


PAIRS = f"WITH {ENTRIES}, st AS (SELECT speaker, topic, count(*) AS n, min(ord * 100 + k) AS f FROM (SELECT ord, speaker, unnest(topics) AS topic, unnest(range(len(topics))) AS k FROM (SELECT ord, topics, unnest(speakers) AS speaker FROM e)) GROUP BY ALL)"


@query(f"{PAIRS} SELECT speaker, rank, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY n DESC, f) AS rank FROM st) WHERE rank <= 10")
def speaker_topic_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.top_topics(A.entries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {ENTRIES} SELECT * FROM (SELECT speaker, row_number() OVER (PARTITION BY speaker ORDER BY ord) AS rank, video_id, substr(content, 1, 300) AS quote FROM (SELECT ord, video_id, content, unnest(speakers) AS speaker FROM e WHERE word_count > 20)) WHERE rank <= 50")
def speaker_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.sample_quotes(A.entries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"{PAIRS}, t AS (SELECT speaker, string_agg(topic || ':' || n, ',' ORDER BY n DESC, f) AS top_topics, count(*) AS topics FROM st GROUP BY 1), m AS (SELECT unnest(speakers) AS speaker FROM e) SELECT speaker, top_topics, topics, count(*) AS total_mentions FROM m JOIN t USING (speaker) GROUP BY 1, 2, 3")
def speaker_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = knowledge.profiles(A.entries(spark, sf_dir), list(A.TEST_SPEAKERS))
    top = F.array_join(F.transform("top_topics", lambda t: F.concat(t["topic"], F.lit(":"), t["n"].cast("string"))), ",")
    return p.select("speaker", top.alias("top_topics"), F.size("topic_counts").cast("long").alias("topics"), "total_mentions").where("topics > 0")


TITLE = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3))"
MATCH = f"""a AS (SELECT doc_id AS video_id, {TITLE.format("text")} AS t FROM documents), b AS (SELECT item_id, {TITLE.format("text")} AS t FROM benchmark),
x AS (SELECT video_id, unnest(t) AS w, len(t) AS n FROM a), y AS (SELECT item_id, unnest(t) AS w, len(t) AS m FROM b),
sc AS (SELECT video_id, item_id, count(*) / (any_value(n) + any_value(m) - count(*)) AS score FROM x JOIN y USING (w) GROUP BY 1, 2),
best AS (SELECT video_id, item_id AS item_ord, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, item_id) AS r FROM sc WHERE score >= 0.2)"""


def title_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    titles = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.col("text").alias("title"))
    feed = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item_ord"), F.col("text").alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("item_id").cast("int")).alias("date"))
    return titles, knowledge.best_title_matches(titles, feed)


@query(f"WITH {MATCH} SELECT video_id, item_ord, round(score, 6) AS score, DATE '2024-01-01' + CAST(item_ord AS INTEGER) AS date FROM best WHERE r = 1")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_matches(spark, sf_dir)[1].select("video_id", "item_ord", F.round("score", 6).alias("score"), "date")


@query(f"WITH {MATCH} SELECT count(*) AS matched, (SELECT count(*) FROM documents) - count(*) AS unmatched, DATE '2024-01-01' + CAST(min(item_ord) AS INTEGER) AS first_date, DATE '2024-01-01' + CAST(max(item_ord) AS INTEGER) AS last_date FROM best WHERE r = 1")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.match_summary(*title_matches(spark, sf_dir))


KEYWORDS = f"unnest(list_filter(regexp_split_to_array(regexp_replace(lower((SELECT text FROM benchmark WHERE item_id = 2)), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2 AND t NOT IN {KSTOP}))"


def sql_keyword(boost: str = "1") -> str:
    return f"""kw AS (SELECT {KEYWORDS} AS t), ks AS (SELECT id, sum(len(regexp_extract_all(lower(content), '\\b' || t))) AS s FROM e, kw GROUP BY id),
k AS (SELECT e.*, s * ({boost}) AS score FROM e JOIN ks USING (id) WHERE s > 0)"""


@query(f"WITH {ENTRIES}, {sql_keyword()} SELECT id, CAST(score AS DOUBLE) AS score FROM k ORDER BY k.score DESC, ord LIMIT 20")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_search(A.entries(spark, sf_dir), A.query_text(spark, sf_dir)).select("id", "score")


BOOST = "CASE WHEN list_contains(topics, 'suffix') THEN 1.5 ELSE 1 END * CASE WHEN list_contains(speakers, 'tion') THEN 2 ELSE 1 END"


@query(f"WITH {ENTRIES}, {sql_keyword(BOOST)} SELECT id, CAST(score AS DOUBLE) AS score FROM k ORDER BY k.score DESC, ord LIMIT 20")
def keyword_search_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_search(A.entries(spark, sf_dir), A.query_text(spark, sf_dir), topic="suffix", speaker="tion").select("id", "score")


@query(f"WITH {ENTRIES}, w AS (SELECT unnest(list_filter(regexp_split_to_array(lower((SELECT text FROM benchmark WHERE item_id = 2)), '\\s+'), lambda t: length(t) > 3)) AS t), s AS (SELECT id, any_value(ord) AS ord, count(*) AS score FROM e, w WHERE contains(lower(content), t) GROUP BY id) SELECT id, score FROM s ORDER BY s.score DESC, ord LIMIT 30")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.substring_search(A.entries(spark, sf_dir), A.query_text(spark, sf_dir)).select("id", F.col("score").cast("long").alias("score"))


@query(
    f"""WITH {ENTRIES}, kw AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2 AND t NOT IN {KSTOP})) AS t FROM benchmark WHERE {ASKED}),
ks AS (SELECT item_id, id, any_value(ord) AS ord, sum(len(regexp_extract_all(lower(content), '\\b' || t))) AS score FROM e, kw GROUP BY item_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord) AS r FROM ks WHERE score > 0)
SELECT item_id, id, CAST(score AS DOUBLE) AS score FROM r WHERE r <= 20"""
)
def keyword_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search of every fiftieth item: beginnings are ranges of the term dictionary."""
    index = postings.build(A.entries(spark, sf_dir), A.files(spark, "words"), postings.underscored)
    return of_items(spark, sf_dir, lambda q: postings.keyword_search(index, q).select("id", "score"))


@query(
    f"""WITH {ENTRIES}, w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: length(t) > 3)) AS t FROM benchmark WHERE {ASKED}),
s AS (SELECT item_id, id, any_value(ord) AS ord, count(*) AS score FROM e, w WHERE contains(lower(content), t) GROUP BY item_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord) AS r FROM s)
SELECT item_id, id, score FROM r WHERE r <= 30"""
)
def substring_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search of every fiftieth item: what contains a word goes through its grams."""
    index = postings.build(A.entries(spark, sf_dir), A.files(spark, "pieces"), postings.pieces)
    return of_items(spark, sf_dir, lambda q: postings.substring_search(index, q).select("id", F.col("score").cast("long").alias("score")))


HASH = "abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, x: (((a * 31 + x + 2147483648) & 4294967295) - 2147483648))) % 512"
HASHED = f"""hw AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2)) AS w FROM documents),
hd AS (SELECT w, CAST({HASH} AS INTEGER) AS bucket FROM (SELECT DISTINCT w FROM hw)), hb AS (SELECT id, bucket, count(*) AS n FROM hw JOIN hd USING (w) GROUP BY 1, 2),
hv AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM hb)"""


@query(f"WITH {HASHED} SELECT id, bucket, round(weight, 6) AS weight FROM hv")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hashed_embedding(A.entries(spark, sf_dir), "id", "content").withColumn("weight", F.round("weight", 6))


HASHED_HITS = f"""{HASHED}, qw AS (SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(lower((SELECT text FROM benchmark WHERE item_id = 2)), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2)) AS w),
qb AS (SELECT CAST({HASH} AS INTEGER) AS bucket, count(*) AS n FROM qw GROUP BY 1), qv AS (SELECT bucket, n / sqrt(sum(n * n) OVER ()) AS qweight FROM qb),
hh AS (SELECT id, 1 - sum(weight * qweight) AS distance FROM hv JOIN qv USING (bucket) GROUP BY id ORDER BY 2, id LIMIT 20)"""


@query(f"WITH {HASHED_HITS} SELECT id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM hh")
def hashed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hashed_search(A.entries(spark, sf_dir), A.query_text(spark, sf_dir))
    return hits.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {COSINE}, f AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM cs WHERE label = 3 ORDER BY rank LIMIT 20), u AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM cs ORDER BY rank LIMIT 20),
m AS (SELECT id, rank, leg FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, leg) AS r FROM (SELECT id, rank, 0 AS leg FROM f UNION ALL SELECT id, rank, 1 FROM u)) WHERE r = 1)
SELECT id, row_number() OVER (ORDER BY rank, leg) - 1 AS pos FROM m WHERE (SELECT count(*) FROM m n WHERE n.rank < m.rank) < 30"""
)
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = A.query_vector(spark, sf_dir), A.vectors(spark, sf_dir)
    return retrieval.speaker_mode(lambda s: retrieval.cosine_search(v, q, 20, speaker=s), "3").select("id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {ENTRIES}, {DATES}, {sql_tfidf('e')} SELECT id, 'tfidf' AS mode FROM tf")
def tier_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No vector has the speaker asked for and there is no index, so the last tier answers."""
    e, q = A.entries(spark, sf_dir), A.query_vector(spark, sf_dir)
    exact = lambda: retrieval.cosine_search(A.vectors(spark, sf_dir), q, speaker="nobody")
    lexical = lambda: retrieval.tfidf_search(e, knowledge.idf(e), A.query_text(spark, sf_dir), dates=A.dates(spark, sf_dir), as_of=A.as_of())
    mode, hits = retrieval.first_tier([("exact", exact), ("ann", lambda: None), ("tfidf", lexical)])
    return hits.select("id", F.lit(mode).alias("mode"))


CHAPTER_ROWS = """ct AS (SELECT conv_id AS ep_key, turn, turn * 7 * 60 + turn * 11 % 60 AS start_sec,
  trim(regexp_replace(substr(regexp_replace(text, '[<(\\[]', ' ', 'g'), 1, 40), '\\s+', ' ', 'g')) AS topic FROM conversations),
cc AS (SELECT ep_key, row_number() OVER (PARTITION BY ep_key ORDER BY turn) - 1 AS pos, start_sec, topic FROM ct WHERE length(topic) BETWEEN 3 AND 300 AND turn * 7 < 100)"""
EPISODES = f"""{CHAPTER_ROWS}, ep AS (SELECT conv_id AS ep_key, 'Episode ' || conv_id AS title, DATE '2024-03-01' + CAST(conv_id % 90 AS INTEGER) AS date FROM (SELECT DISTINCT conv_id FROM conversations)),
kept AS (SELECT *, printf('ep_%04d', row_number() OVER (ORDER BY date DESC, ep_key) - 1) AS id FROM ep JOIN (SELECT ep_key, count(*) AS chapter_count FROM cc GROUP BY 1) USING (ep_key) WHERE date >= DATE '2024-04-01'),
chs AS (SELECT kept.id AS episode_id, kept.id || printf('_ch_%02d', pos) AS id, title AS episode_title, date AS episode_date, start_sec, topic FROM cc JOIN kept USING (ep_key))"""
CLOCK = "CASE WHEN start_sec >= 3600 THEN printf('%d:%02d:%02d', start_sec // 3600, start_sec // 60 % 60, start_sec % 60) ELSE printf('%d:%02d', start_sec // 60, start_sec % 60) END"


@query(f"WITH {CHAPTER_ROWS} SELECT ep_key, pos, start_sec, {CLOCK} AS start_time, topic FROM cc")
def chapter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapters.extract_chapters(A.descriptions(spark, sf_dir))
    return rows.select("ep_key", F.col("pos").cast("long").alias("pos"), F.col("start_sec").cast("long").alias("start_sec"), "start_time", "topic")


def episodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = A.descriptions(spark, sf_dir)
    return chapters.catalogue(d, chapters.extract_chapters(d), "2024-04-01")


@query(f"WITH {EPISODES}, w AS (SELECT unnest(['than', 'the', 'tion', 'in']) AS t), s AS (SELECT chs.*, (SELECT count(*) FROM w WHERE length(t) > 2 AND contains(lower(topic), t)) AS score FROM chs) SELECT id, topic, episode_title, episode_date, score FROM s WHERE score > 0 ORDER BY s.score DESC, episode_date DESC, id LIMIT 50")
def chapter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.search(episodes(spark, sf_dir)[1], "than the tion in").select("id", "topic", "episode_title", "episode_date", F.col("score").cast("long").alias("score"))


@query(f"WITH {EPISODES} SELECT id, title, date, chapter_count FROM kept WHERE date >= DATE '2024-05-26' - 42 ORDER BY id LIMIT 50")
def episode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.listing(episodes(spark, sf_dir)[0], 6, F.lit("2024-05-26").cast("timestamp"))[0]


@query(f"WITH {EPISODES} SELECT count(*) AS episode_count FROM kept WHERE date >= DATE '2024-05-26' - 42")
def episode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.listing(episodes(spark, sf_dir)[0], 6, F.lit("2024-05-26").cast("timestamp"))[1]


@query(f"WITH {EPISODES} SELECT kept.id, title, string_agg(topic, '|' ORDER BY start_sec) AS topics FROM kept JOIN chs ON episode_id = kept.id WHERE kept.id = 'ep_0003' GROUP BY 1, 2")
def chapter_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapters.detail(*episodes(spark, sf_dir), "ep_0003")
    return rows.select("id", "title", F.array_join(F.transform("chapters", lambda c: c["topic"]), "|").alias("topics"))


@query(f"WITH {EPISODES} SELECT count(*) AS episode_count, CAST(sum(chapter_count) AS BIGINT) AS chapter_count, min(date) AS oldest, max(date) AS newest, arg_min(title, id) AS latest_title, arg_min(date, id) AS latest_date FROM kept")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.freshness(episodes(spark, sf_dir)[0])


@query("SELECT doc_id AS video_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 100")
def catalog_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"))
    return readers.to_fetch(listed, A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id")), 100)


RERANKED = f"{COSINE}, c30 AS (SELECT * FROM cs ORDER BY d, id LIMIT 30), rr AS (SELECT *, row_number() OVER (ORDER BY id % 7 DESC, d, id) AS n FROM c30)"


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.cosine_search(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir))
    scores = A.vectors(spark, sf_dir).select("id", (F.col("id") % 7).alias("score"))
    return retrieval.rerank(hits, scores)


@query(f"WITH {RERANKED} SELECT id, n FROM rr WHERE n <= 12")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("id", F.col("n").cast("long").alias("n"))


@query(f"WITH {COSINE}, c30 AS (SELECT * FROM cs ORDER BY d, id LIMIT 30) SELECT id, row_number() OVER (ORDER BY d, id) AS n FROM c30 ORDER BY n LIMIT 12")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some candidate has no score."""
    hits = retrieval.cosine_search(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir))
    return retrieval.rerank(hits, A.vectors(spark, sf_dir).where("id > 3").select("id", F.col("id").alias("score"))).select("id", F.col("n").cast("long").alias("n"))


CITED = f"{ENTRIES}, {DATES}, {sql_tfidf('e', 'true', 30)}, ci AS (SELECT tf.*, date, row_number() OVER (ORDER BY distance, ord) AS n FROM tf LEFT JOIN dates USING (video_id))"


def cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, when = A.entries(spark, sf_dir), A.dates(spark, sf_dir)
    hits = retrieval.rerank(retrieval.tfidf_search(e, knowledge.idf(e), A.query_text(spark, sf_dir), dates=when, as_of=A.as_of()), None)
    return retrieval.citations(hits, when), hits


@query(f"WITH {CITED} SELECT n, id, printf('%02d:%02d:%02d', id // 3600, id // 60 % 60, id % 60) AS time, date, video_id, 'https://example.org/' || video_id AS url, array_to_string(topics, ',') AS topics, array_to_string(speakers, ',') AS speakers, substr(content, 1, 400) AS quote, round(1 - distance, 3) AS relevance FROM ci WHERE n <= 12")
def citations_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cited(spark, sf_dir)[0]
    return rows.withColumns({"n": F.col("n").cast("long"), "topics": F.array_join("topics", ","), "speakers": F.array_join("speakers", ",")})


@query(
    f"""WITH {CITED} SELECT string_agg('[' || n || '] episode-date: ' || coalesce(CAST(date AS VARCHAR), 'date-unknown') || ' · timestamp: ' || printf('%02d:%02d:%02d', id // 3600, id // 60 % 60, id % 60) || ' · topics: ' || array_to_string(topics, ', ')
  || CASE WHEN len(speakers) > 0 THEN ' · voices: ' || array_to_string(speakers, ', ') ELSE '' END || chr(10) || 'SEGMENT: "' || substr(content, 1, 600) || '"', chr(10) || chr(10) ORDER BY n) AS context FROM ci WHERE n <= 12"""
)
def citation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.context(*cited(spark, sf_dir))


@query(
    f"""WITH {CITED} SELECT id, n - 1 AS i, '[' || (n - 1) || ']' || CASE WHEN len(speakers) > 0 THEN ' voices=' || array_to_string(speakers, '/') ELSE '' END || CASE WHEN len(topics) > 0 THEN ' topics=' || array_to_string(topics, '/') ELSE '' END
  || ' "' || regexp_replace(substr(content, 1, 320), '\\s+', ' ', 'g') || '"' AS line FROM ci"""
)
def rerank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir)
    hits = retrieval.tfidf_search(e, knowledge.idf(e), A.query_text(spark, sf_dir), dates=A.dates(spark, sf_dir), as_of=A.as_of())
    return retrieval.rerank_lines(hits).withColumn("i", F.col("i").cast("long"))


REPORTS = """rp AS (SELECT conv_id * 100 + turn AS report_id, text || ' First [' || (turn + 1) || ']. Then [' || (turn + 2) || '] and [' || (turn + 1) || '] end! Last [' || (turn + 2) || ', ' || (turn + 1) || '] one.'
  || CASE WHEN conv_id % 10 = 0 THEN (SELECT string_agg(' Claim ' || i || ' [' || (turn + 1 + i % 2) || '].', '' ORDER BY i) FROM range(50) AS r(i)) ELSE '' END AS report, turn FROM conversations WHERE role = 'assistant'),
ln AS (SELECT report_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT report_id, regexp_split_to_array(report, '\\n+') AS l FROM rp)),
sn AS (SELECT report_id, i, unnest(range(len(l))) AS j, trim(unnest(l)) AS claim FROM (SELECT report_id, i, string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ln)),
cl AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY i, j) - 1 AS claim_no, claim, list_transform(regexp_extract_all(claim, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)) AS m FROM sn WHERE regexp_matches(claim, '\\[\\d+\\]')),
mk AS (SELECT report_id, claim_no, claim, n, min(k) AS k FROM (SELECT report_id, claim_no, claim, unnest(m) AS n, unnest(range(len(m))) AS k FROM cl) GROUP BY ALL),
pr AS (SELECT report_id, claim_no, claim, n, row_number() OVER (PARTITION BY report_id ORDER BY claim_no, k) - 1 AS pid FROM (SELECT report_id, claim_no, claim, n, min(k) AS k FROM mk GROUP BY 1, 2, 3, 4) QUALIFY pid < 40),
vd AS (SELECT *, (report_id // 100 + CASE WHEN report_id % 3 = 0 THEN pid ELSE 0 END + n) % 4 AS v FROM pr),
pc AS (SELECT report_id, n, count(*) FILTER (v = 0) AS yes, count(*) FILTER (v = 1) AS partial, count(*) FILTER (v = 2) AS no, min(pid) AS first_pid FROM vd GROUP BY 1, 2),
vc AS (SELECT *, CASE WHEN no > 0 AND yes = 0 THEN 'NO' WHEN partial > 0 AND yes = 0 THEN 'PARTIAL' ELSE 'YES' END AS verdict FROM pc)"""


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paired = citations.pairs(citations.claims(A.reports(spark, sf_dir)), A.report_citations(spark, sf_dir))
    return paired, citations.citation_verdicts(paired, A.verdicts(paired))


@query(f"WITH {REPORTS} SELECT report_id, claim_no, claim, array_to_string(list_sort(list_distinct(m)), ',') AS markers FROM cl")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.claims(A.reports(spark, sf_dir)).withColumn("markers", F.array_join(F.array_sort("markers"), ","))


@query(f"WITH {REPORTS} SELECT report_id, n, yes, partial, no, verdict FROM vc")
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)[1].drop("first_pid")


@query(f"WITH {REPORTS} SELECT report_id, pid, n, substr(claim, 1, 280) AS claim, verdict FROM pr JOIN vc USING (report_id, n) WHERE verdict = 'NO'")
def failed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.failed_claims(*judged(spark, sf_dir)).withColumn("pid", F.col("pid").cast("long"))


SQL_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\s?\\[' || {1} || '\\]', '', 'g'), '\\[' || {1} || ',\\s*(\\d+)\\]', '[\\1]', 'g'), '\\[(\\d+),\\s*' || {1} || '\\]', '[\\1]', 'g'), '  +', ' ', 'g'), '\\s+([.,!?;])', '\\1', 'g')"


@query(
    f"""WITH {REPORTS}, gone AS (SELECT report_id, list(n ORDER BY first_pid) AS g FROM vc WHERE verdict = 'NO' GROUP BY 1), k AS (SELECT report_id, count(*) AS checked FROM vc GROUP BY 1),
one AS (SELECT report_id, g, CASE WHEN g[1] IS NULL THEN report ELSE {SQL_STRIP.format("report", "g[1]")} END AS r FROM rp LEFT JOIN gone USING (report_id))
SELECT report_id, CASE WHEN g[2] IS NULL THEN r ELSE {SQL_STRIP.format("r", "g[2]")} END AS report, coalesce(checked, 0) AS checked, coalesce(len(g), 0) AS unsupported FROM one LEFT JOIN k USING (report_id)"""
)
def strip_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.cleaned(A.reports(spark, sf_dir).drop("turn"), judged(spark, sf_dir)[1])
    return rows.withColumns({"checked": F.col("checked").cast("long"), "unsupported": F.col("unsupported").cast("long")})


@query(f"WITH {REPORTS}, c AS (SELECT report_id, unnest([turn + 1, turn + 2, 99]) AS n FROM rp) SELECT report_id, CAST(n AS INTEGER) AS n, coalesce(verdict, 'UNCHECKED') AS verdict FROM c LEFT JOIN vc USING (report_id, n)")
def citations_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = A.reports(spark, sf_dir).select("report_id", F.explode(F.array((F.col("turn") + 1).cast("int"), (F.col("turn") + 2).cast("int"), F.lit(99))).alias("n"))
    return citations.with_verdicts(cites, judged(spark, sf_dir)[1])


@query("SELECT item_id, substr(sha256('v1||' || CASE WHEN item_id % 2 = 0 THEN 'forecast' ELSE '' END || '|' || regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')), 1, 15) AS key15 FROM benchmark")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "benchmark").select("item_id", T.cache_key("text", "v1", mode=F.when(F.col("item_id") % 2 == 0, "forecast")).alias("key15"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id || ':' || event_type AS key, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM events),
f AS (SELECT key, k, t AS stored, 0 AS hit FROM r WHERE k = 1 UNION ALL SELECT r.key, r.k, CASE WHEN r.t - f.stored <= 259200000 THEN f.stored ELSE r.t END, CASE WHEN r.t - f.stored <= 259200000 THEN 1 ELSE 0 END FROM f JOIN r ON r.key = f.key AND r.k = f.k + 1)
SELECT key, count(*) AS requests, CAST(sum(hit) AS BIGINT) AS hits FROM f GROUP BY key"""
)
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return cache.replay(e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), at.alias("at_ms")))


VIEWS = f"{ENTRIES}, {sql_keyword()}, k20 AS (SELECT * FROM k ORDER BY k.score DESC, ord LIMIT 20), sp AS (SELECT unnest(['sch', 'eux', 'tion']) AS speaker), vr AS (SELECT speaker, id, topics, row_number() OVER (PARTITION BY speaker ORDER BY k20.score DESC, ord) AS r FROM sp, k20 WHERE list_contains(speakers, speaker) OR k20.score > 3), v5 AS (SELECT * FROM vr WHERE r <= 5), vw AS (SELECT speaker, count(id) AS segment_count FROM sp LEFT JOIN v5 USING (speaker) GROUP BY speaker), vf AS (SELECT *, CASE WHEN segment_count >= 3 THEN 'high' WHEN segment_count >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM vw)"


def speaker_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.keyword_search(A.entries(spark, sf_dir), A.query_text(spark, sf_dir))
    return retrieval.perspectives(hits.withColumn("id", F.col("id").cast("string")), list(A.TEST_SPEAKERS))


@query(f"WITH {VIEWS} SELECT speaker, segment_count, confidence FROM vf")
def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_views(spark, sf_dir).select("speaker", F.col("segment_count").cast("long").alias("segment_count"), "confidence")


@query(f"WITH {VIEWS}, a AS (SELECT avg(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS m FROM vf) SELECT round(m, 6) AS mean_confidence, CASE WHEN m > 2 THEN 'high' WHEN m > 1 THEN 'medium' ELSE 'low' END AS average_confidence, coalesce((SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT unnest(topics) AS t FROM v5)), '') AS common_topics FROM a")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.consensus(speaker_views(spark, sf_dir))
    return rows.select(F.round("mean_confidence", 6).alias("mean_confidence"), "average_confidence", F.array_join("common_topics", ",").alias("common_topics"))


GRADES = "g AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (quality * 90 + doc_id % 10) END AS overall FROM labels)"


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("quality") * 90 + F.col("doc_id") % 10).cast("double").alias("overall"))


@query(f"WITH {GRADES} SELECT count(*) AS questions, round(avg(nullif(overall, 0)), 6) AS mean_overall, CAST(min(nullif(overall, 0)) AS DOUBLE) AS min_overall, CAST(max(nullif(overall, 0)) AS DOUBLE) AS max_overall, count(*) FILTER (coalesce(overall, 0) >= 98) AS good, count(*) FILTER (coalesce(overall, 0) < 85) AS poor FROM g")
def qa_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scorecard(grades(spark, sf_dir)).withColumn("mean_overall", F.round("mean_overall", 6))


@query("SELECT doc_id AS id, round((2 * quality + 2 * toxic + doc_id % 3 + doc_id % 4 + doc_id % 5) / 7, 6) AS weighted FROM labels")
def qa_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("voice"), F.col("toxic").alias("grounding"), (F.col("doc_id") % 3).alias("citations"), (F.col("doc_id") % 4).alias("recency"), (F.col("doc_id") % 5).alias("usefulness"))
    return quality.weighted_overall(rows).select("id", F.round("weighted", 6).alias("weighted"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS topic FROM pages")
def clean_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", T.clean_topic("html").alias("topic"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), '') AS ref, CASE WHEN page_id % 2 = 0 THEN 'id' || page_id END AS video FROM pages")
def watch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://youtube.com/watch?a=1&v=id"), F.col("page_id").cast("string"), F.lit("&t=3s"))).otherwise(F.lit("https://example.org/"))
    return p.select("page_id", F.nullif(F.regexp_extract("url", r"[?&]ref=([^&#]+)", 1), F.lit("")).alias("ref"), T.watch_id(url).alias("video"))


@query("SELECT event_id, printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) AS hms, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS chapter FROM (SELECT event_id, event_id * 97001 AS ms, event_id * 7 AS s FROM events)")
def format_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", T.format_hms(F.col("event_id") * 97001).alias("hms"), T.format_chapter(F.col("event_id") * 7).alias("chapter"))


@query(f"SELECT item_id, n, m, CAST(len({TITLE.format('text')}) AS BIGINT) AS title FROM (SELECT item_id, text, CAST(len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2 AND t NOT IN {KSTOP})) AS BIGINT) AS n, CAST(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: length(t) > 2)) AS BIGINT) AS m FROM benchmark)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.size(c).cast("long")
    return A.table(spark, sf_dir, "benchmark").select("item_id", count(T.tokens_keyword("text")).alias("n"), count(T.tokens_over("text", 2)).alias("m"), count(T.tokens_title("text")).alias("title"))


@query(f"WITH {DATES} SELECT video_id, date, round({WEIGHT}, 6) AS weight FROM (SELECT DISTINCT source AS video_id FROM documents) LEFT JOIN dates USING (video_id)")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = A.table(spark, sf_dir, "documents").select(F.col("source").alias("video_id")).distinct()
    return sources.join(A.dates(spark, sf_dir), "video_id", "left").select("video_id", "date", F.round(T.recency_weight("date", A.as_of()), 6).alias("weight"))
