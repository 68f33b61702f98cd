"""Readers of captions, feeds, catalogues, dictionaries and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import rss_date
from tidemark.sources import schemas


#: Tasks a core that read a folder of files.
TASKS = 8


def captions(spark: SparkSession, folder: str, suffix: str = ".en.json3") -> DataFrame:
    """(video_id, events) of every caption file; the id is the file's name. Files that cannot be read are left out here and
    listed by bad_captions."""
    return readable(all_captions(spark, folder, suffix))


def bad_captions(spark: SparkSession, folder: str, suffix: str = ".en.json3") -> DataFrame:
    """(video_id, reason) of the caption files that captions leaves out, for a log."""
    return unreadable(all_captions(spark, folder, suffix))


def readable(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt_record is null and events is not null").drop("_corrupt_record")


def unreadable(rows: DataFrame) -> DataFrame:
    rows = rows.where("_corrupt_record is not null or events is null")
    return rows.select("video_id", F.when(F.col("_corrupt_record").isNotNull(), "not readable as JSON").otherwise("no events").alias("reason"))


def all_captions(spark: SparkSession, folder: str, suffix: str = ".en.json3") -> DataFrame:
    rows = spark.read.schema(schemas.EVENTS).option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    return few_tasks(rows.select(stem(suffix).alias("video_id"), "events", "_corrupt_record"))


def few_tasks(rows: DataFrame) -> DataFrame:
    """The rows of many small files, read by TASKS tasks a core at most: Spark deals them out by a few, whatever their size."""
    most = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows


def stem(suffix: str) -> Column:
    """The name of a row's file without its suffix. Spark gives names as in a URL."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def json_folder(spark: SparkSession, folder: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Rows of a folder of JSON files; Spark leaves out files whose names begin with an underscore, and bad files give null rows."""
    rows = few_tasks(spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(folder))
    return rows.where("coalesce(" + ", ".join(f"cast(`{c.split(' ')[0].strip('`')}` as string)" for c in schema_columns(schema)) + ") is not null")


def schema_columns(schema: str) -> list[str]:
    """The top-level columns of a DDL schema."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[last:i].strip())
            last = i + 1
    return out


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return json_folder(spark, folder, schemas.TRANSCRIPT)


def entry_batches(spark: SparkSession, folder: str, pattern: str = "entries_*.json", lines: bool = False) -> DataFrame:
    """Entries of files named entries_*.json, in the order of the files' names and of rows within; ord holds that order.

    A file is an array of entries, or with `lines`, as sinks.batches writes them, one entry a line.
    """
    rows = spark.read.schema(schemas.ENTRY).option("multiLine", not lines).option("pathGlobFilter", pattern).json(folder)
    return rows.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("k")).alias("ord"))


def json_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, value) of a JSON object; no row if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {kind[kind.index(',') + 1 : -1]}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content_index(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, schemas.CONTENT_INDEX).select("key", "value.*").select(F.col("key").alias("id"), F.col("c").alias("content"), F.col("v").alias("video_id"), F.col("t").alias("start_time"), F.col("s").alias("start_ms"), F.col("p").alias("topics"), F.col("m").alias("speakers"), F.col("u").alias("url"))


def idf(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, schemas.IDF).select(F.col("key").alias("term"), F.col("value").alias("idf"))


def episode_dates(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, schemas.DATES).select(F.col("key").alias("video_id"), F.col("value").cast("date").alias("date"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, schemas.FACTS).select(F.col("key"), "value.*")


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chaptered episodes; a missing file is an error."""
    return spark.read.schema(schemas.CHAPTERS).option("multiLine", True).json(path)


def chapter_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Chapters by id with what is known of their episode; no row if the file is missing."""
    rows = json_map(spark, path, schemas.LOOKUP).select(F.col("key").alias("id"), "value.*")
    return rows.select("id", "topic", F.col("episodeTitle").alias("episode_title"), F.col("episodeDate").cast("date").alias("episode_date"), F.col("audioUrl").alias("audio_url"), F.col("startTime").alias("start_time"), F.col("startSec").alias("start_sec"))


def freshness(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(schemas.FRESHNESS).option("multiLine", True).json(path) if exists(spark, path) else None


def profiles(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Profiles by file name; keys without a file are left out."""
    rows = spark.read.schema(schemas.PROFILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.select(stem(".json").alias("key"), "*")
    return rows if keys is None else rows.where(F.col("key").isin(keys))


def rss_items(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(title, date, description, audio_url, duration, place) of a feed's items that have a date, from `since` on.

    place is the item's: its file, where its part of the file begins, and a number that grows within it.
    """
    rows = spark.read.format("xml").option("rowTag", "item").schema(schemas.RSS).load(path)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    rows = rows.select("title", rss_date("pubDate").alias("date"), "description", F.col("enclosure._url").alias("audio_url"), F.col("itunes:duration").alias("duration"), place.alias("place")).where("date is not null")
    return rows if since is None else rows.where(F.col("date") >= F.lit(since).cast("date"))


def catalogue(spark: SparkSession, path: str, repair: bool = False) -> DataFrame:
    """(video_id, title) of a tab-separated list; titles may hold tabs, and lines without an id are left out.

    With `repair`, backslash-t pairs are read as tabs.
    """
    line = F.replace("value", F.lit("\\t"), F.lit("\t")) if repair else F.col("value")
    parts = F.split(line, "\t", 2)
    return spark.read.text(path).select(F.trim(F.get(parts, F.lit(0))).alias("video_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("title")).where("video_id <> ''")


def to_fetch(listed: DataFrame, present: DataFrame, limit: int | None = None) -> DataFrame:
    """Catalogue rows not there yet, in order, up to a limit of attempts."""
    rows = listed.join(present.select("video_id"), "video_id", "left_anti").orderBy("video_id")
    return rows if limit is None else rows.limit(limit)


def flat_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(place, vec) of flat little-endian float32 files; a file is one task's work, so large matrices are kept in several."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                m = np.frombuffer(raw.as_buffer(), "<f4")
                for a in range(0, len(m) // dims, 10_000):
                    part = m[a * dims : min(a + 10_000, len(m) // dims) * dims]
                    vecs = pa.ListArray.from_arrays(np.arange(0, len(part) + 1, dims, dtype=np.int32), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(vecs))), vecs], names=["place", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, "place long, vec array<float>")
