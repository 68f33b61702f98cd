"""Ranked retrieval. Every search scans its documents once, filters before it scores, and ends in a top-k; none shuffles documents.

Hits have id, ord, distance (smaller is better) and raw_distance. Ties keep the documents' order, ord.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import collapsed, confidence, cut, keyword_terms, long_terms, prefix_count, query_terms, recency_weight, relevance, strings, whole_words
from tidemark.functions.vectors import hashed_cosine, hashed_query, nearest, similarity
from tidemark.operators.joins import once, with_lookup

UNKNOWN_IDF, PRIMARY_IDF = 5.5, 2.5
#: Decimals of a TF-IDF distance. Sums of one value that were added up in another order differ behind them.
DECIMALS = 12


def of_speaker(entries: DataFrame, speaker: str | None) -> DataFrame:
    return entries if speaker is None else entries.where(F.array_contains("speakers", speaker))


def with_recency(hits: DataFrame, dates: DataFrame | None, as_of: Column | None) -> DataFrame:
    """raw_distance over the weight of the entry's date; unknown dates weigh 0.85."""
    if dates is None or as_of is None:
        return hits.withColumn("distance", F.col("raw_distance"))
    dated = with_lookup(hits, dates.select("video_id", "date"), "video_id")
    return dated.withColumn("distance", F.col("raw_distance") / recency_weight("date", as_of)).drop("date")


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy("distance", "ord").limit(k)


def cosine_search(vectors: DataFrame, query: list[float], k: int = 30, dates: DataFrame | None = None, as_of: Column | None = None, speaker: str | None = None) -> DataFrame:
    """Exact cosine over (id, ord, vec, ...): filter, score, recency, top-k. A task gives what may be among the k nearest."""
    rows = of_speaker(vectors, speaker)
    if dates is None or as_of is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = with_lookup(rows, dates.select("video_id", "date"), "video_id").withColumn("weight", recency_weight("date", as_of)).drop("date")
    return top(nearest(rows, query, k), k)


def by_label(hits: DataFrame, order: DataFrame) -> DataFrame:
    """Index labels, which count from 1, to ids by their place; labels out of bounds go."""
    return hits.join(order.withColumn("label", F.col("place") + 1), "label").drop("place")


def over_fetched(search: Callable[[int], DataFrame], keep: Column, k: int) -> DataFrame:
    """Three times k hits, filtered, in order, cut to k."""
    return top(search(3 * k).where(keep), k)


def term_weights(idf: DataFrame, terms: list[str]) -> list[tuple[str, float]]:
    """The query's terms with their idf, in order; at most one row for each reaches the driver."""
    known = {r["term"]: r["idf"] for r in idf.where(F.col("term").isin(terms)).select("term", "idf").collect()} if terms else {}
    return [(t, known.get(t, UNKNOWN_IDF)) for t in terms]


def shortfall(score: str, most: float) -> Column:
    """What a score lacks of half of `most`, as a distance from 0 to 1: equal for equal scores, however they were summed."""
    return F.round(1 - F.least(F.lit(1.0), F.col(score) / (most * 0.5)), DECIMALS)


def tfidf_search(entries: DataFrame, idf: DataFrame, query: str, k: int = 30, dates: DataFrame | None = None, as_of: Column | None = None, speaker: str | None = None) -> DataFrame:
    """TF-IDF with a gate: where the query has rare terms, a document must contain one as a substring."""
    weights = term_weights(idf, query_terms(query))
    primary = [t for t, w in weights if w > PRIMARY_IDF]
    most = sum(3 * w for _, w in weights) or 1.0
    rows = of_speaker(entries, speaker)
    if not weights:
        rows = rows.limit(0)
    # the terms' places in one pass; texts with none of them as a word score nothing and need no gate
    rows = once(rows, found=whole_words("content", [t for t, _ in weights])).where(F.size("found") > 0)
    if primary:
        low = F.lower("content")
        rare = F.exists("found", lambda t: F.array_contains(strings(primary), t))
        rows = rows.where(reduce(Column.__or__, [F.contains(low, F.lit(t)) for t in primary], rare))
    counts = F.array(*[F.size(F.filter("found", lambda x: x == t)) for t, _ in weights]).cast("array<int>")  # noqa: B023
    rows = once(rows, counts=counts)
    parts = F.zip_with("counts", F.array(*[F.lit(w) for _, w in weights]).cast("array<double>"), lambda c, w: F.when(c > 0, (1 + F.ln(c.cast("double"))) * w).otherwise(0.0))
    score = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    if len(primary) > 1:
        of = F.array(*[F.lit(w > PRIMARY_IDF) for _, w in weights])
        matched = F.size(F.filter(F.zip_with("counts", of, lambda c, p: p & (c > 0)), lambda x: x))
        score = score * (1 + F.lit(0.5) * matched / len(primary))
    rows = once(rows, score=score).where("score > 0").drop("found", "counts")
    rows = rows.withColumn("raw_distance", shortfall("score", most))
    return top(with_recency(rows, dates, as_of), k)


def keyword_search(entries: DataFrame, query: str, k: int = 20, topic: str | None = None, speaker: str | None = None) -> DataFrame:
    """Counts of words that begin with the query's terms; a matching topic raises the score by half, a matching speaker doubles it."""
    rows = once(entries, score=prefix_count("content", keyword_terms(query)).cast("double")).where("score > 0")
    score = F.col("score")
    if topic is not None:
        score = F.when(F.array_contains("topics", topic), score * 1.5).otherwise(score)
    if speaker is not None:
        score = F.when(F.array_contains("speakers", speaker), score * 2).otherwise(score)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "ord").limit(k)


def substring_search(entries: DataFrame, query: str, k: int = 30) -> DataFrame:
    """How many of the query's words of more than 3 characters are part of the text."""
    low = F.lower("content")
    score = sum((F.contains(low, F.lit(t)).cast("int") for t in long_terms(query, 3)), F.lit(0))
    return once(entries, score=score).where("score > 0").orderBy(F.desc("score"), "ord").limit(k)


def hashed_search(entries: DataFrame, query: str, k: int = 20, topic: str | None = None, speaker: str | None = None) -> DataFrame:
    """Cosine in the space of hashed words, documents and query alike; topic and speaker filter."""
    rows = of_speaker(entries, speaker)
    if topic is not None:
        rows = rows.where(F.array_contains("topics", topic))
    q = hashed_query(keyword_words(query))
    if not q:
        return rows.limit(0).withColumn("distance", F.lit(0.0)).withColumn("score", F.lit(0.0))
    found = rows.withColumn("cosine", hashed_cosine("content", q)).where("cosine > 0")
    found = found.withColumn("distance", 1 - F.col("cosine")).drop("cosine")
    return found.withColumn("score", similarity("distance")).orderBy("distance", "ord").limit(k)


def keyword_words(query: str) -> list[str]:
    return keyword_terms(query, ())


def interleaved(filtered: DataFrame, unfiltered: DataFrame, limit: int = 30) -> DataFrame:
    """Two ranked lists (id, rank from 0) taken in turn, each id once; a round of two begins while fewer than `limit` are kept.

    Since the limit is looked at before a round only, limit + 1 ids may come out. Returns id and pos, from 0.
    """
    both = filtered.select("id", "rank", F.lit(0).alias("leg")).union(unfiltered.select("id", "rank", F.lit(1).alias("leg")))
    first = Window.partitionBy("id").orderBy("rank", "leg")
    kept = both.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    # at most both lists' lengths
    order = Window.orderBy("rank", "leg")
    before = F.count("*").over(Window.orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("pos", F.row_number().over(order) - 1).withColumn("before", before).where(F.col("before") < limit).select("id", "pos")


def ranked(hits: DataFrame) -> DataFrame:
    """A top-k result with its ranks from 0."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", "ord")) - 1)


def speaker_mode(search: Callable[[str | None], DataFrame], speaker: str, limit: int = 30) -> DataFrame:
    """A speaker's hits and all hits in turn."""
    return interleaved(ranked(search(speaker)), ranked(search(None)), limit)


def in_memory(hits: DataFrame) -> DataFrame:
    """A top-k result as a table of its rows, so that what is done with it does not search again."""
    return hits.sparkSession.createDataFrame(hits.toArrow(), hits.schema)


def first_tier(tiers: list[tuple[str, Callable[[], DataFrame | None]]]) -> tuple[str, DataFrame]:
    """The first tier that has hits, with its label; the last one if none has. A tier without an index gives None.

    Each tier is a top-k result and is searched once: its rows are the answer.
    """
    label, hits = "", None
    for label, search in tiers:  # noqa: B007
        found = search()
        if found is None:
            continue
        hits = in_memory(found)
        if not hits.isEmpty():
            break
    if hits is None:
        raise ValueError("no tier can be searched")
    return label, hits


def tiers_by_plan(tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """The same within one plan, for tiers that are top-k results alike in columns: rows of the first tier that has any."""
    parts = [t.withColumn("tier", F.lit(i)).withColumn("mode", F.lit(label)) for i, (label, t) in enumerate(tiers)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("least", F.min("tier").over(Window.partitionBy(F.lit(1)))).where("tier = least").drop("tier", "least")


def rerank(hits: DataFrame, scores: DataFrame | None, k: int = 12, most: int = 30) -> DataFrame:
    """The first `most` hits by scores (id, score), larger first, then distance; the first k as they are if a score is missing.

    Without scores, or with k hits or fewer, nothing is reranked.
    """
    cands = top(hits, most)
    plain = Window.orderBy("distance", "ord")
    if scores is None:
        return cands.withColumn("n", F.row_number().over(plain)).where(F.col("n") <= k)
    rows = with_lookup(cands, scores.select("id", "score").withColumnRenamed("score", "rerank_score"), "id")
    every = Window.partitionBy(F.lit(1))
    usable = (F.count("rerank_score").over(every) == F.count("*").over(every)) & (F.count("*").over(every) > k)
    rows = rows.withColumn("usable", usable)
    n = F.row_number().over(Window.orderBy(F.when(F.col("usable"), -F.col("rerank_score")), "distance", "ord"))
    return rows.withColumn("n", n).where(F.col("n") <= k).drop("usable")


def rerank_lines(hits: DataFrame) -> DataFrame:
    """What a scorer is shown of each candidate: number from 0, speakers, topics, and 320 characters."""
    i = F.row_number().over(Window.orderBy("distance", "ord")) - 1
    who = F.when(F.size("speakers") > 0, F.concat(F.lit(" voices="), F.array_join("speakers", "/"))).otherwise("")
    what = F.when(F.size("topics") > 0, F.concat(F.lit(" topics="), F.array_join("topics", "/"))).otherwise("")
    return hits.withColumn("i", i).select("id", "i", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"), who, what, F.lit(' "'), collapsed(cut("content", 320)), F.lit('"')).alias("line"))


def citations(hits: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Numbered citations of reranked hits (with n): time, date, link, topics, speakers, quote and relevance."""
    rows = hits if dates is None else with_lookup(hits, dates.select("video_id", "date"), "video_id")
    date = F.lit(None).cast("date") if dates is None else F.col("date")
    return rows.select("n", "id", F.col("start_time").alias("time"), date.alias("date"), "video_id", "url", "topics", "speakers", cut("content", 400).alias("quote"), relevance("distance").alias("relevance"))


def context(cites: DataFrame, hits: DataFrame, chars: int = 600) -> DataFrame:
    """One row: the numbered segments as the text that a synthesiser is given."""
    rows = cites.join(hits.select("id", cut("content", chars).alias("segment")), "id")
    who = F.when(F.size("speakers") > 0, F.concat(F.lit(" · voices: "), F.array_join("speakers", ", "))).otherwise("")
    date = F.coalesce(F.col("date").cast("string"), F.lit("date-unknown"))
    text = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] episode-date: "), date, F.lit(" · timestamp: "), "time", F.lit(" · topics: "), F.array_join("topics", ", "), who, F.lit('\nSEGMENT: "'), "segment", F.lit('"'))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("context"))


def facts_text(facts: DataFrame) -> DataFrame:
    """One row: facts (ord, name, role, political_alignment, current_positions, style), which override what retrieval finds."""
    lines = F.array_join(F.transform("current_positions", lambda p: F.concat(F.lit("  - "), p)), "\n")
    text = F.concat(F.lit("• **"), "name", F.lit("** — "), "role", F.lit("\n  Political: "), "political_alignment", F.lit("\n  Current positions:\n"), lines, F.lit("\n  Voice: "), "style")
    return facts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("facts"))


def perspectives(hits: DataFrame, speakers: list[str], n: int = 5, chars: int = 500) -> DataFrame:
    """For each speaker the first n hits (id, ord, score, speakers, ...) that mention it or score more than 3, in one plan."""
    dims = hits.sparkSession.createDataFrame([(s,) for s in speakers], "speaker string")
    # a hit goes to each speaker of a dictionary of fixed size
    rows = hits.withColumn("speaker", F.explode(F.array(*[F.lit(s) for s in speakers])))
    rows = rows.where(F.array_contains("speakers", F.col("speaker")) | (F.col("score") > 3))
    order = Window.partitionBy("speaker").orderBy(F.desc("score"), "ord")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    segs = rows.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("rank", "id", cut("content", chars).alias("text"), "topics"))).alias("segments"))
    out = dims.join(segs, "speaker", "left")
    return out.withColumn("segment_count", F.coalesce(F.size("segments"), F.lit(0))).withColumn("confidence", confidence("segment_count"))


def consensus(views: DataFrame) -> DataFrame:
    """One row: the mean of confidences as 3, 2 and 1 (over 2 high, over 1 medium, else low) and all topics of the segments."""
    points = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    topics = F.array_distinct(F.flatten(F.flatten(F.collect_list(F.transform(F.coalesce("segments", F.array().cast("array<struct<rank:int,id:string,text:string,topics:array<string>>>")), lambda s: s["topics"])))))
    rows = views.agg(F.avg(points).alias("mean_confidence"), F.array_sort(topics).alias("common_topics"))
    return rows.withColumn("average_confidence", F.when(F.col("mean_confidence") > 2, "high").when(F.col("mean_confidence") > 1, "medium").otherwise("low"))
