"""Answers kept by query key: a table for many processes, a small store in memory for one, and replay of request logs."""

from __future__ import annotations

from collections import OrderedDict
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_MS = 72 * 3_600_000


class MemoryCache:
    """The last `size` answers. Reading keeps an answer from being the oldest but does not prolong it."""

    def __init__(self, size: int = 200, ttl_ms: int = TTL_MS):
        self.size, self.ttl_ms, self.rows = size, ttl_ms, OrderedDict()

    def get(self, key: str, now_ms: int):
        if key not in self.rows:
            return None
        value, expires = self.rows[key]
        if expires < now_ms:
            del self.rows[key]
            return None
        self.rows.move_to_end(key)
        return value

    def put(self, key: str, value, now_ms: int) -> None:
        if len(self.rows) >= self.size:  # also where the key is there already
            self.rows.popitem(last=False)
        self.rows[key] = (value, now_ms + self.ttl_ms)
        self.rows.move_to_end(key)


def usable(cache: DataFrame, tag: str, as_of: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """Stored answers (key15, payload, stored_at, tags) that carry the tag, are young enough and have a report."""
    age = F.unix_millis(as_of) - F.unix_millis("stored_at")
    report = F.get_json_object("payload", "$.report")
    return cache.where(F.array_contains("tags", tag) & (age <= ttl_ms) & report.isNotNull())


def valid(cache: DataFrame, key: str, tag: str, as_of: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """The newest usable answer for a key, or none."""
    return usable(cache.where(F.col("key15") == key), tag, as_of, ttl_ms).orderBy(F.desc("stored_at")).limit(1)


def lookup(requests: DataFrame, cache: DataFrame, tag: str, as_of: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """Requests (key15, ...) with the payload of the newest usable answer, null where there is none."""
    newest = usable(cache, tag, as_of, ttl_ms).groupBy("key15").agg(F.max_by("payload", F.struct("stored_at", "payload")).alias("payload"))
    return requests.join(newest, "key15", "left")


def store(spark: SparkSession, path: str, key: str, payload: str, stored_at: str, tags: list[str]) -> None:
    row = spark.createDataFrame([(key, payload, stored_at, tags)], "key15 string, payload string, stored_at string, tags array<string>")
    row.withColumn("stored_at", F.col("stored_at").cast("timestamp")).write.mode("append").parquet(path)


class TableCache:
    """The second tier: answers in a table that many processes append to, by key and tag, for `ttl_ms`."""

    def __init__(self, spark: SparkSession, path: str, tag: str = "answer", ttl_ms: int = TTL_MS):
        self.spark, self.path, self.tag, self.ttl_ms = spark, path, tag, ttl_ms

    def get(self, key: str, now_ms: int) -> str | None:
        """The newest answer's payload that is still valid; None where there is none, or no table yet."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        row = valid(self.spark.read.parquet(self.path), key, self.tag, F.timestamp_millis(F.lit(now_ms)), self.ttl_ms).first()
        return row and row["payload"]

    def put(self, key: str, payload: str, now_ms: int) -> None:
        at = datetime.fromtimestamp(now_ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        store(self.spark, self.path, key, payload, at, [self.tag])


def replay(requests: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Requests (key, at_ms) to (key, requests, hits): a miss stores an answer, which serves requests up to ttl later, inclusive.

    A key's requests are folded in order of time, as which of them miss follows from the misses before. Requests of one
    time are one step of the fold, so that a row holds a key's different times, not its requests.
    """
    times = requests.groupBy("key", "at_ms").agg(F.count("*").alias("n"))
    rows = times.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at_ms", "n"))).alias("at"), F.sum("n").alias("requests"))
    zero = F.struct(F.lit(None).cast("long").alias("stored"), F.lit(0).cast("long").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        t = x["at_ms"]
        hit = acc["stored"].isNotNull() & (t - acc["stored"] <= ttl_ms)
        return F.struct(F.when(hit, acc["stored"]).otherwise(t).alias("stored"), (acc["hits"] + x["n"] - (~hit).cast("long")).alias("hits"))

    return rows.select("key", "requests", F.aggregate("at", zero, step, lambda acc: acc["hits"]).alias("hits"))
