"""What several operators share: the shared folder, written tables, hot-key joins and ranks."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word of a text: what lies between runs of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows that a lookup table may have to be broadcast; larger ones are joined by salted keys.
BROADCAST_ROWS = 100_000
#: Rows of a few numbers that go to one file at least, where a table's size is known.
ROWS_PER_FILE = 50_000
#: Bytes of an Arrow batch on its way to Python: what a worker holds at once, beside one row that may be longer.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, where it is unset, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.tidemark.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


class Scratches(threading.local):
    """For each scratch() that is open in this thread, the folders that go when it closes."""

    def __init__(self):
        self.open: list[list[str]] = []


_scratches = Scratches()


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end. Those written with keep, which the result still reads, are handed on
    to the scratch around this one, if there is one."""
    _scratches.open.append([])
    try:
        yield
    finally:
        for path in _scratches.open.pop():
            removed(spark, path)


def written(df: DataFrame, name: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """df as a table written to the shared folder and read again: it cuts lineage, and a lost executor loses nothing of it.

    `rows` is about how many rows of a few numbers df has at most: a small table is then written by few tasks, since every
    file costs time, memory and, in some stores, a process. Where rows are large or work is heavy, it is a multiple.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    going = _scratches.open[: -1 if keep else None]
    if going:
        going[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(f: Callable) -> Callable:
    """A function over Arrow batches whose worker gives memory back to the system when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def in_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with batches of BATCH_BYTES at most, a setting of the session that is left as it is once set lower."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    try:
        now = int(str(conf.get(key)).rstrip("b"))
    except ValueError:
        now = 0
    if not 0 < now <= BATCH_BYTES:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(bounded(f), schema)


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_bucket(n: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def sized(df: DataFrame, fits: bool) -> DataFrame:
    """A side of a join, marked for broadcast if it fits, else for a shuffle. Left to itself Spark would broadcast what it
    takes to be small by the bytes of compressed files, times one for an explode and for the lists of a group."""
    return F.broadcast(df) if fits else df.hint("merge")


def lookup(big: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 32, how: str = "inner", fits: bool | None = None) -> DataFrame:
    """Join a table of keys to a table in which a few keys may hold most rows. Null keys match each other.

    The small table is broadcast only if it was counted to have at most BROADCAST_ROWS rows, or as `fits` says where the
    caller knows more. Otherwise each of its rows is repeated once per salt, and `spread` deals the rows of a hot key over
    the salts; that join is shuffled, whatever Spark takes the repeated rows to be.
    """
    name, salt_s, salt_b = (free_name(x, big, small) for x in (f"__{key}", "__salt_s", "__salt_b"))
    small = small.withColumnRenamed(key, name)
    if fits is None:
        fits = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if fits:
        return big.join(sized(small, True), F.col(key).eqNullSafe(F.col(name)), how).drop(name)
    salted = small.withColumn(salt_s, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn(salt_b, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(sized(salted, False), F.col(key).eqNullSafe(F.col(name)) & (F.col(salt_b) == F.col(salt_s)), how).drop(name, salt_s, salt_b)


def row_key() -> Column:
    """A number for a row's id and text: rows alike in both share it, and rows without an id have one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def without(docs: DataFrame, gone: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that are not among gone (doc_id, key), at most `rows`, with all their columns.

    A row is known by its id and by the hash of id and text together, so that a hash alone takes no row along.
    """
    key = free_name("__row_key", docs)
    pair = F.struct(F.col("doc_id").cast("long").alias("id"), F.col("key").alias("key"))
    small = written(gone.select(pair.alias(key)).distinct(), "gone", rows)
    own = F.struct(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"))
    return lookup(docs.withColumn(key, own), small, key, F.col("doc_id"), salts=1, how="left_anti").drop(key)


#: Rows that a table of a few numbers may have to be broadcast: some tens of megabytes.
NARROW_ROWS = 500_000


def narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast if it has few rows; else it is shuffled.

    `rows` bounds their number where a count is known that does; without it a written table is counted.
    """
    if rows is None:
        rows = df.limit(NARROW_ROWS + 1).count()
    return F.broadcast(df) if rows <= NARROW_ROWS else df


def ranked(df: DataFrame, order: list[Column], name: str, parts: int = 32) -> DataFrame:
    """Number the rows from 0 in a global order without a window over all rows: range partitions, then counts per partition."""
    part = free_name("__part", df)
    dealt = written(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranked")
    counts = sorted((r[part], r["n"]) for r in dealt.groupBy(part).agg(F.count("*").alias("n")).collect())
    start, base = {}, 0
    for k, n in counts:
        start[k], base = base, base + n
    first = F.lit(0).cast("long")
    if start:
        first = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col(part)).cast("long")
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, first + within - 1).drop(part)
