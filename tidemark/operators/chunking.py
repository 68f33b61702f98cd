"""Time-anchored chunks of ordered segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import deep_link, format_hms, tagged, trimmed, word_count

SHORT_MS, LONG_MS = 30_000, 120_000


def extract_segments(captions: DataFrame) -> DataFrame:
    """(video_id, events) to (video_id, seg_no, text, start_ms, end_ms): events without text go."""
    e = captions.select("video_id", F.posexplode("events").alias("pos", "e")).where("e.segs is not null")
    text = trimmed(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce("e.tStartMs", F.lit(0)).cast("long")
    e = e.select("video_id", "pos", text.alias("text"), start.alias("start_ms"), (start + F.coalesce("e.dDurationMs", F.lit(0))).cast("long").alias("end_ms")).where("text <> ''")
    order = Window.partitionBy("video_id").orderBy("pos")
    return e.select("video_id", (F.row_number().over(order) - 1).cast("long").alias("seg_no"), "text", "start_ms", "end_ms")


def anchored(items: Column, start: str, end: str, span: int) -> Column:
    """Ordered items cut greedily: a group opens at its first item's start and closes with the item that ends `span` later or more.

    Gives (first, last) places from 0 of each group, the open one at the end included. It is a fold, since where a group
    opens depends on where the one before it closed; only closed groups are kept in its state.
    """
    kind = "struct<first:int,last:int>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(None).cast("long").alias("anchor"), F.lit(0).alias("open"), F.array().cast(f"array<{kind}>").alias("groups"))

    def step(acc: Column, x: Column) -> Column:
        anchor = F.coalesce(acc["anchor"], x[start])
        closes = x[end] - anchor >= span
        group = F.struct(acc["open"].alias("first"), acc["i"].alias("last"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(~closes, anchor).alias("anchor"),
            F.when(closes, acc["i"] + 1).otherwise(acc["open"]).alias("open"),
            F.when(closes, F.concat(acc["groups"], F.array(group))).otherwise(acc["groups"]).alias("groups"),
        )

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["open"].alias("first"), (acc["i"] - 1).alias("last"))
        return F.when(acc["open"] < acc["i"], F.concat(acc["groups"], F.array(rest))).otherwise(acc["groups"])

    return F.aggregate(items, zero, step, finish)


def chunk(segments: DataFrame, span_ms: int) -> DataFrame:
    """(video_id, seg_no, text, start_ms, end_ms) to chunks of about `span_ms`, in segment order.

    One video's segments meet in one row, since its chunks follow from one another; videos are independent.
    """
    one = F.struct("seg_no", "text", "start_ms", "end_ms")
    rows = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("segs"))
    rows = rows.withColumn("groups", anchored(F.col("segs"), "start_ms", "end_ms", span_ms))
    rows = rows.select("video_id", "segs", F.posexplode_outer("groups").alias("chunk_index", "g")).where("g is not null")
    part = F.slice("segs", F.col("g.first") + 1, F.col("g.last") - F.col("g.first") + 1)
    rows = rows.select("video_id", "chunk_index", part.alias("part"))
    text = F.array_join(F.transform("part", lambda s: s["text"]), " ")
    start, end = F.get("part", F.lit(0))["start_ms"], F.get("part", F.size("part") - 1)["end_ms"]
    rows = rows.select("video_id", "chunk_index", F.size("part").alias("segments"), text.alias("text"), start.alias("start_ms"), end.alias("end_ms"))
    return rows.withColumn("word_count", word_count("text"))


def enrich(chunks: DataFrame, topics: dict[str, list[str]], speakers: dict[str, list[str]], suffix: str = "chunk") -> DataFrame:
    """Chunks with ids, times, topics, speakers and links."""
    return chunks.withColumns(
        {
            "id": F.concat(F.col("video_id").cast("string"), F.lit(f"_{suffix}_"), F.col("chunk_index").cast("string")),
            "start_time": format_hms("start_ms"),
            "end_time": format_hms("end_ms"),
            "topics": tagged("text", topics),
            "speakers": tagged("text", speakers),
            "url": deep_link("video_id", "start_ms"),
        }
    )


def transcript_totals(segments: DataFrame, chunks: DataFrame, long_chunks: DataFrame) -> DataFrame:
    """One row for each video: duration (the last segment's end), words, and numbers of chunks of both spans."""
    base = segments.groupBy("video_id").agg(F.max_by("end_ms", "seg_no").alias("duration_ms"))
    words = chunks.groupBy("video_id").agg(F.sum("word_count").alias("total_words"), F.count("*").alias("chunk_count"))
    more = long_chunks.groupBy("video_id").agg(F.count("*").alias("long_chunk_count"))
    return base.join(words, "video_id", "left").join(more, "video_id", "left").withColumn("duration", format_hms("duration_ms"))


def manifest(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count("*").alias("episode_count"), F.sum("chunk_count").alias("total_chunks"), F.sum("total_words").alias("total_words"))
