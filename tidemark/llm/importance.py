"""Importance resampling towards a target distribution, over hashed runs of words.

One scan of a text keeps the running CRC states of the last RUNS starts: each new word, after a space, extends all of
them, and every state on the way is a feature, whose bucket is its remainder. Buckets are counted over all documents and
over the target; the logarithm of the smoothed ratio is a bucket's gain, a document's weight is the sum of its features'
gains, and Gumbel noise seeded by doc_id makes the highest scores a draw without replacement in proportion to the weights.

What travels between tasks is one row a bucket and task, and a few numbers a document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, in_arrow, lookup, ranked, row_key, scratch, written

#: Words of the longest feature, and the number of buckets.
RUNS, BUCKETS = 3, 10_000
#: Documents of fewer words are not drawn; of the others this percentage is.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: A word in bytes, A-Z lower-cased before: digits, letters, and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A text is scanned in pieces of about so many bytes, cut behind a word.
PIECE = 1 << 20
#: Rows of a few numbers in a range of the global order.
RANGE_ROWS = 1_000_000


class Ring:
    """The running CRC states of the runs of 1, 2, ... n words that end at the last word seen; fewer at a text's start."""

    def __init__(self, n: int):
        self.states: list[int] = []
        self.n = n

    def extend(self, words: list[bytes]) -> list[list[int]]:
        """Takes the next words; returns, for each length of run, the states of the runs that end in them."""
        if not words:
            return []
        spaced = [b" " + w for w in words]
        out = [list(map(crc32, words))]
        for k in range(1, self.n):
            starts = self.states[k - 1 : k] + out[-1][:-1]  # the runs of k words that end before each word
            out.append(list(map(crc32, spaced[len(spaced) - len(starts) :], starts)))
        self.states = [x[-1] for x in out if x]
        return out


def pieces(raw: bytes) -> Iterator[bytes]:
    """raw in lower case, in pieces that cut no word."""
    a = 0
    while a < len(raw):
        b = a + PIECE
        low = raw[a:b].lower()
        while b < len(raw) and WORD.match(low, len(low) - 1):  # on to the end of the word, in steps
            more = raw[b : b + PIECE].lower()
            end = m.end() if (m := WORD.match(more)) else 0
            low, b = low + more[:end], b + end
            if end < len(more) or not end:
                break
        yield low
        a = b


def features(raw: bytes, runs: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the buckets of its features, repeats included, shortest runs first by piece."""
    ring, n, out = Ring(runs), 0, []
    for piece in pieces(raw):
        words = WORD.findall(piece)
        n += len(words)
        out += [np.array(x, np.uint32) % np.uint32(buckets) for x in ring.extend(words)]
    return n, np.concatenate(out) if out else np.empty(0, np.uint32)


def kind_of(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def scanner(runs: int, buckets: int):
    """A function from (doc_id, key, text) to doc_id, key, the number of words, and the buckets as bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found = [], []
            for text in batch.column(2).cast(pa.large_binary()):
                n, b = features(text.as_py() or b"", runs, buckets)
                words.append(n)
                found.append(b.astype(kind_of(buckets)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.int64()), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["doc_id", "key", "n_words", "buckets"])

    return scan


def counter(buckets: int):
    """A function from rows whose last column is buckets to one row for each bucket of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(batch.num_columns - 1):
                sums += np.bincount(np.frombuffer(b.as_buffer() or b"", kind_of(buckets)), minlength=buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["bucket", "n"])

    return count


def weigher(gains: np.ndarray):
    """A function from (doc_id, key, n_words, buckets) to doc_id, key, n_words, n_features and the weight."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b.as_buffer() or b"", kind_of(len(gains))) for b in batch.column(3)]
            sizes = pa.array([len(b) for b in found], pa.int64())
            weights = pa.array([int(gains[b].sum()) for b in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, weights], names=["doc_id", "key", "n_words", "n_features", "weight"])

    return weigh


def scanned(rows: DataFrame, name: str, runs: int, buckets: int) -> DataFrame:
    """rows (doc_id, key, text), each text scanned once: the buckets are kept for counting and for weighing."""
    return written(in_arrow(rows, scanner(runs, buckets), "doc_id long, key long, n_words long, buckets binary"), name)


def counts(scans: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has: `buckets` rows come to the driver at most."""
    sums = in_arrow(scans.select("buckets"), counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floor of 1000 times the log of each bucket's smoothed share of the target over that of the source."""
    n = len(source)
    all_source, all_target = float(source.sum() + n), float(target.sum() + n)
    ratios = [float(t + 1) * all_source / (float(s + 1) * all_target) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def noise(doc_id):
    """Gumbel noise in thousandths from the hash of SEED and the id; rows without an id share that of `null`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """Every row of docs (doc_id, text, ...) weighed against target (text, ...), and the draw of `percent` of the longer ones.

    Returns doc_id, key (a hash of id and text), n_words, n_features, weight, score, rank (1 for the highest score of those
    of least_words words or more, down to the last drawn; else null). Equal scores go by smaller doc_id, null last. Null
    and empty texts have no words, no features and the weight 0; each of several rows alike is weighed and drawn by itself.
    Without a target every gain is that of an empty one; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with scratch(spark):
        text = F.col("text").cast("string").alias("text")
        source = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text), "feature-buckets", runs, buckets)
        wanted = scanned(target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), text), "target-buckets", runs, buckets)
        gains = gains_of(counts(source, buckets), counts(wanted, buckets))
        rows = in_arrow(source, weigher(gains), "doc_id long, key long, n_words long, n_features long, weight long")
        rows = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scores")
        n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("n_words") >= least_words).alias("long")).first()
        order = [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
        out = ranked(rows, order, "place", parts=32 + n["rows"] // RANGE_ROWS)
        drawn = F.when(F.col("place") < percent * n["long"] // 100, F.col("place") + 1)
        return written(out.withColumn("rank", drawn).drop("place"), "resampled", keep=True)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of docs with all their columns. Rows alike in id and text come together if one of them is drawn."""
    pair = lambda key: F.struct(F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    name = free_name("__row_key", docs)
    drawn = resample(docs, target, percent, least_words).where("rank is not null").select(pair(F.col("key")).alias(name)).distinct()
    return lookup(docs.withColumn(name, pair(row_key())), drawn, name, F.col("doc_id"), salts=1, how="left_semi").drop(name)
