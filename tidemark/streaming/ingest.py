"""Caption files as a stream: each file is a whole episode, so that chunks need no state across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import chunking
from tidemark.sources import schemas
from tidemark.sources.readers import stem


def captions(spark: SparkSession, folder: str, suffix: str = ".en.json3") -> DataFrame:
    rows = spark.readStream.schema(schemas.EVENTS).option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    return rows.where("_corrupt_record is null and events is not null").select(stem(suffix).alias("video_id"), "events")


def both_grains(events: DataFrame, topics: dict[str, list[str]], speakers: dict[str, list[str]]) -> DataFrame:
    """Enriched chunks of 30 and of 120 seconds in one table, told apart by `grain`."""
    segments = chunking.extract_segments(events)
    short = chunking.enrich(chunking.chunk(segments, chunking.SHORT_MS), topics, speakers, "chunk").withColumn("grain", F.lit("short"))
    return short.union(chunking.enrich(chunking.chunk(segments, chunking.LONG_MS), topics, speakers, "long").withColumn("grain", F.lit("long")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, topics: dict[str, list[str]], speakers: dict[str, list[str]]) -> StreamingQuery:
    """Chunks of the files that have come since the last run go to the table `out`; a batch run again replaces its rows."""

    def land(batch: DataFrame, k: int) -> None:
        rows = both_grains(batch, topics, speakers).withColumn("batch", F.lit(k))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "grain").parquet(out)

    return captions(spark, folder).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
