"""Chapters of feed descriptions: extraction, browsing and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import CHAPTER, clean_topic, format_chapter, long_terms, parse_timestamp


def extract_chapters(episodes: DataFrame) -> DataFrame:
    """(ep_key, description) to (ep_key, pos, start_sec, start_time, topic); topics of 3 to 300 characters."""
    parts = [F.regexp_extract_all("description", F.lit(CHAPTER), F.lit(k)) for k in range(1, 5)]
    rows = episodes.select("ep_key", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "hmst", strict=True)])).alias("pos", "c"))
    rows = rows.select("ep_key", "pos", parse_timestamp("c.h", "c.m", "c.s").alias("start_sec"), clean_topic("c.t").alias("topic"))
    rows = rows.where(F.length("topic").between(3, 300))
    order = Window.partitionBy("ep_key").orderBy("pos")
    return rows.select("ep_key", (F.row_number().over(order) - 1).alias("pos"), "start_sec", format_chapter("start_sec").alias("start_time"), "topic")


def catalogue(episodes: DataFrame, chapters: DataFrame, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Episodes (ep_key, ord, title, date, audio_url) that have chapters, newest first with ids, and the chapters with theirs."""
    if since:
        episodes = episodes.where(F.col("date") >= F.lit(since).cast("date"))
    n = chapters.groupBy("ep_key").agg(F.count("*").alias("chapter_count"))
    kept = episodes.join(n, "ep_key")
    # days are numbered in one task, of which there are as many as the calendar has; episodes within their day
    days = kept.groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n"))
    days = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.col("before") + F.row_number().over(Window.partitionBy("date").orderBy("ord")) - 1
    kept = kept.join(days, F.col("date").eqNullSafe(F.col("day"))).withColumn("id", F.format_string("ep_%04d", place)).drop("day", "before")
    named = chapters.join(kept.select("ep_key", F.col("id").alias("episode_id"), F.col("title").alias("episode_title"), F.col("date").alias("episode_date"), "audio_url"), "ep_key")
    return kept, named.withColumn("id", F.concat("episode_id", F.format_string("_ch_%02d", "pos")))


def detail(kept: DataFrame, chapters: DataFrame, episode_id: str) -> DataFrame:
    """One episode with its chapters in order; no row if there is none of this id."""
    of = chapters.where(F.col("episode_id") == episode_id).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "start_time", "topic", "id"))).alias("chapters"))
    return kept.where(F.col("id") == episode_id).join(of, kept["id"] == of["episode_id"], "left").drop("episode_id")


def search(chapters: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Chapters by how many of the query's words of more than 2 characters are part of the topic; newest first among equals."""
    words = long_terms(query, 2)
    low = F.lower("topic")
    score = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return chapters.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("episode_date"), "id").limit(limit)


def recent(kept: DataFrame, weeks: int, as_of: Column) -> DataFrame:
    """Episodes of the last weeks, all for 0; as_of keeps its time of day."""
    return kept if weeks <= 0 else kept.where(F.col("date").cast("timestamp") >= as_of - F.make_interval(days=F.lit(7 * weeks)))


def listing(kept: DataFrame, weeks: int, as_of: Column, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(episodes up to the limit, their number before the limit)."""
    rows = recent(kept, weeks, as_of)
    return rows.orderBy("id").limit(limit).select("id", "title", "date", "chapter_count"), rows.agg(F.count("*").alias("episode_count"))


def freshness(kept: DataFrame) -> DataFrame:
    """One row: numbers of episodes and chapters, range of dates, and the latest episode."""
    latest = F.min_by(F.struct("title", "date"), "id")
    return kept.agg(F.count("*").alias("episode_count"), F.sum("chapter_count").alias("chapter_count"), F.min("date").alias("oldest"), F.max("date").alias("newest"), latest["title"].alias("latest_title"), latest["date"].alias("latest_date"))
