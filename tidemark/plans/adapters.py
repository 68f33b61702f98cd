"""The driver's tables as the entities of this engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import format_hms, tagged, word_count

#: Words that occur in the generated prose; the default dictionaries hardly do.
TEST_TOPICS = {"german": ["nicht", "und"], "romance": ["que", "les"], "legal": ["license"], "energy": ["oil"], "suffix": ["able", "ness", "less"]}
TEST_SPEAKERS = {"sch": ["sch"], "eux": ["eux"], "tion": ["tionha"]}


def as_of() -> Column:
    return F.lit("2024-06-30 00:00:00").cast("timestamp")


def files(spark: SparkSession, name: str) -> str:
    """A new folder for files that are made from the driver's tables: in spark.checkpoint.dir, or on one machine a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("content"),
        F.col("source").alias("video_id"),
        tagged("text", TEST_TOPICS).alias("topics"),
        tagged("text", TEST_SPEAKERS).alias("speakers"),
        word_count("text").cast("long").alias("word_count"),
        format_hms(F.col("doc_id") * 1000).alias("start_time"),
        F.concat(F.lit("https://example.org/"), "source").alias("url"),
    )


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date for each source but src19."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id")).distinct().where("video_id <> 'src19'")
    return sources.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.substring("video_id", 4, 9).cast("int") * 20))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of 60 ms a character, one after another."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_no"), "text", (F.length("text") * 60).cast("long").alias("dur"))
    before = Window.partitionBy("video_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("dur").over(before), F.lit(0)).cast("long")
    return c.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("dur")).select("video_id", "seg_no", "text", "start_ms", "end_ms")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings; the label is the speaker and names the video."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"), "label", F.array(F.col("label").cast("string")).alias("speakers"), F.concat(F.lit("src"), F.col("label").cast("string")).alias("video_id"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def query_text(spark: SparkSession, sf_dir: str, item: int = 2) -> str:
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") == item).select("text").first()[0]


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes, whose descriptions list the turns as chapters."""
    c = table(spark, sf_dir, "conversations")
    topic = F.trim(F.regexp_replace(F.substring(F.regexp_replace("text", r"[<(\[]", " "), 1, 40), r"\s+", " "))
    mark = F.format_string("(%d:%02d) ", F.col("turn") * 7, F.col("turn") * 11 % 60)
    one = F.struct("turn", F.concat(mark, topic, F.lit("<p>")).alias("part"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    return rows.select(
        F.col("conv_id").alias("ep_key"),
        F.col("conv_id").alias("ord"),
        F.concat(F.lit("Episode "), F.col("conv_id").cast("string")).alias("title"),
        F.date_add(F.lit("2024-03-01").cast("date"), (F.col("conv_id") % 90).cast("int")).alias("date"),
        F.concat(F.lit("https://example.org/a/"), F.col("conv_id").cast("string")).alias("audio_url"),
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("description"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as reports with citation markers; those of every tenth conversation have more claims than are checked."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n, m = (F.col("turn") + 1).cast("string"), (F.col("turn") + 2).cast("string")
    text = F.concat("text", F.lit(" First ["), n, F.lit("]. Then ["), m, F.lit("] and ["), n, F.lit("] end! Last ["), m, F.lit(", "), n, F.lit("] one."))
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit(" Claim "), i.cast("string"), F.lit(" ["), (F.col("turn") + 1 + i % 2).cast("string"), F.lit("]."))), "")
    text = F.when(F.col("conv_id") % 10 == 0, F.concat(text, more)).otherwise(text)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("report_id"), text.alias("report"), "turn")


def report_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    return r.select("report_id", F.explode(F.array((F.col("turn") + 1).cast("int"), (F.col("turn") + 2).cast("int"))).alias("n")).withColumn("quote", F.lit("quoted"))


def verdicts(paired: DataFrame) -> DataFrame:
    kind = (F.floor(F.col("report_id") / 100) + F.when(F.col("report_id") % 3 == 0, F.col("pid")).otherwise(0) + F.col("n")) % 4
    return paired.select("report_id", "pid", F.when(kind == 0, "YES").when(kind == 1, "PARTIAL").when(kind == 2, "NO").otherwise("UNKNOWN").alias("verdict"))
