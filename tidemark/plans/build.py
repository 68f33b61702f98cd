"""The whole refresh: caption files and feeds to chunks, entries, profiles, frequencies, dates, chapters and manifests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.taxonomy import TOPICS
from tidemark.operators import chapters, chunking, knowledge
from tidemark.sources import readers, sinks
from tidemark.streaming.ingest import both_grains


Embed = Callable[[list[str]], list[list[float]]]


def build_all(spark: SparkSession, captions: str, feed: str | None, catalogue: str | None, out: str, speakers: dict[str, list[str]], topics: dict[str, list[str]] = TOPICS, since: str = "2024-04-01", embed: Embed | None = None, model: str = "") -> dict[str, DataFrame]:
    """Write every table under `out` and return those that were made. A missing feed or catalogue leaves its tables out,
    a missing embedder the vectors. `bad_captions` lists the caption files that could not be read."""
    # written first: every file is opened once
    sinks.table(readers.all_captions(spark, captions), f"{out}/captions")
    read = spark.read.parquet(f"{out}/captions")
    events = readers.readable(read)
    sinks.transcripts(both_grains(events, topics, speakers), f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    long, short = chunks.where("grain = 'long'"), chunks.where("grain = 'short'")
    made = {"chunks": chunks, "entries": knowledge.entries(long), "bad_captions": readers.unreadable(read)}
    spoken = knowledge.entries(short)
    made["profiles"] = knowledge.profiles(spoken, list(speakers))
    made["idf"] = knowledge.idf(made["entries"])
    made["topics"] = knowledge.topic_distribution(made["entries"])
    made["totals"] = chunking.transcript_totals(chunking.extract_segments(events), short, long)
    made["manifest"] = chunking.manifest(made["totals"])
    if feed:
        # written first: an item's place, which is its key and breaks ties, is made once
        sinks.table(readers.rss_items(spark, feed), f"{out}/feed_items")
        made["feed_items"] = items = spark.read.parquet(f"{out}/feed_items")
        key = F.concat_ws(":", "place.file", F.col("place.block").cast("string"), F.col("place.k").cast("string"))
        recent = items.where(F.col("date") >= F.lit(since).cast("date")).withColumn("ep_key", key).withColumnRenamed("place", "ord")
        kept, named = chapters.catalogue(recent, chapters.extract_chapters(recent))
        made |= {"episodes": kept.drop("description"), "chapters": named, "freshness": chapters.freshness(kept)}
        if catalogue:
            made["episode_dates"] = knowledge.best_title_matches(readers.catalogue(spark, catalogue), items.withColumnRenamed("place", "item_ord")).select("video_id", "date", "score")
    for name, df in made.items():
        if name not in ("chunks", "feed_items"):
            sinks.table(df, f"{out}/{name}")
            made[name] = spark.read.parquet(f"{out}/{name}")
    if embed is not None:
        sinks.vectors(made["entries"], embed, f"{out}/vectors", model)
        made["vectors"] = spark.read.parquet(f"{out}/vectors")
    return made


@dataclass
class Step:
    """A step of a job: what it runs, and whether the job goes on with a warning where it fails."""

    name: str
    run: Callable[[], object]
    needed: bool = True


def run_steps(steps: list[Step]) -> list[tuple[str, str, str]]:
    """(name, "ok" | "warned" | "failed" | "not run", reason) of each step, in order. A needed step that fails ends the job."""
    done, ended = [], False
    for step in steps:
        if ended:
            done.append((step.name, "not run", ""))
            continue
        try:
            step.run()
            done.append((step.name, "ok", ""))
        except Exception as e:
            done.append((step.name, "failed" if step.needed else "warned", f"{type(e).__name__}: {e}".splitlines()[0]))
            ended = step.needed
    return done


def weekly(spark: SparkSession, captions: str, feed: str, catalogue: str, out: str, speakers: dict[str, list[str]], fetch_feed: Callable[[], object], fetch_catalogue: Callable[[], object], fetch_captions: Callable[[], object], publish: Callable[[], object] | None = None, **options) -> list[tuple[str, str, str]]:
    """The weekly refresh. Fetching is given as functions: a list or captions that cannot be fetched leave the old ones, a
    feed is needed, and so is the build; what publishes the tables may fail."""
    steps = [
        Step("feed", fetch_feed),
        Step("catalogue", fetch_catalogue, needed=False),
        Step("captions", fetch_captions, needed=False),
        Step("build", lambda: build_all(spark, captions, feed, catalogue, out, speakers, **options)),
    ]
    return run_steps(steps + ([Step("publish", publish, needed=False)] if publish else []))
