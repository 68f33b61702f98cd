"""Writers. Tables are Parquet; what other programs read is JSON too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Keys of a map that go to one file, about.
MAP_ROWS = 100_000
#: What a file is named whose row has no name, as Spark names folders.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def transcripts(chunks: DataFrame, path: str) -> None:
    """Chunks of both spans, in one table partitioned by `grain`."""
    chunks.write.mode("overwrite").partitionBy("grain").parquet(path)


def table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def batches(entries: DataFrame, path: str, rows: int = 500) -> None:
    """Files of at most so many rows, in the entries' order within each partition."""
    entries.sortWithinPartitions("ord").write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's lines as one JSON object: brackets around them, commas between them."""
    before = "{"
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([before + lines[0], *["," + x for x in lines[1:]]])], names=["value"])
            before = ","
    if before == ",":
        yield pa.RecordBatch.from_arrays([pa.array(["}"])], names=["value"])


def json_map(df: DataFrame, key: str, value: str, path: str, rows: int = MAP_ROWS) -> None:
    """A table as JSON objects, a file for each range of about `rows` keys, a line for each key in order. Null keys are left
    out; without any there is one empty object."""
    one = F.regexp_extract(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))), r"(?s)^\{(.*)\}$", 1)
    lines = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), one.alias("value"))
    n = lines.count()
    if not n:
        out = df.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1)
    else:
        out = lines.repartitionByRange(1 + n // rows, "key").sortWithinPartitions("key").select("value").mapInArrow(objects, "value string")
    out.write.mode("overwrite").text(path)


def named_files(df: DataFrame, name: str, value: str, path: str, suffix: str) -> None:
    """One file for each row, named by its key: what programs expect that find a thing by its file's name.

    In a local or mounted file system, tasks write the files under their names. In other stores Spark writes the contents,
    and the driver renames the files, of which there are as many as names.
    """
    rows = df.select(F.coalesce(F.col(name).cast("string"), F.lit(NO_NAME)).alias("__name"), F.col(value).alias("value")).repartition("__name")
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs.delete(root, True)
        fs.mkdirs(root)
        folder = root.toUri().getPath()
        rows.sortWithinPartitions("__name").mapInArrow(lambda batches: each_file(batches, folder, suffix), "files long").agg(F.sum("files")).collect()
        return
    rows.write.mode("overwrite").partitionBy("__name").text(path)
    for folder in fs.listStatus(root):
        if folder.isDirectory() and "=" in (own := folder.getPath().getName()):
            plain = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(own.split("=", 1)[1])
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(root, f"{plain}{suffix}"))
            fs.delete(folder.getPath(), True)


def each_file(batches: Iterator[pa.RecordBatch], folder: str, suffix: str) -> Iterator[pa.RecordBatch]:
    """Writes sorted rows (name, value) to a file for each name, a line for each row; gives the number of files. A file gets
    its name once it is whole, so that a task may run again, or twice at a time."""
    import os
    import uuid
    from itertools import groupby

    part, n = os.path.join(folder, f".{uuid.uuid4().hex}"), 0
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for name, same in groupby(rows, lambda row: row[0]):
        if "/" in name:
            raise ValueError(f"no name of a file: {name}")
        with open(part, "w", encoding="utf-8", newline="") as out:
            out.writelines(f"{text or ''}\n" for _, text in same)
        os.replace(part, os.path.join(folder, f"{name}{suffix}"))
        n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])


def binary_file(spark: SparkSession, content: bytes, path: str) -> None:
    """A small file of bytes, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(content)
    finally:
        out.close()


def unit_rows(vecs: list[list[float]]) -> np.ndarray:
    m = np.asarray(vecs, float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(norm > 0, norm, 1)).astype(np.float32)


def vectors(entries: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str, model: str, chars: int = 2000, batch: int = 100, tries: int = 3) -> None:
    """(id, ord, vec, model): texts cut to `chars` go to the embedder in batches, tried again up to `tries` times. Vectors
    are stored in unit length, zero vectors as they are."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for part in parts:
            for a in range(0, part.num_rows, batch):
                some = part.slice(a, batch)
                texts = some.column(1).to_pylist()
                for k in range(tries):
                    try:
                        vecs = embed(texts)
                        break
                    except Exception:
                        if k == tries - 1:
                            raise
                        time.sleep(k + 1)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(unit_rows(vecs)), pa.list_(pa.float32()))], names=["id", "vec"])

    kind = dict(entries.dtypes)["id"]
    made = entries.select("id", F.substring("content", 1, chars).alias("text")).mapInArrow(run, f"id {kind}, vec array<float>")
    made.join(entries.select("id", "ord"), "id").withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)
