"""Exact deduplication by Grace hashing.

First, each task groups the rows of a window of its input in an open-addressing table, so that of a hot group one row
per window travels. Then the contents are dealt by hash; a task whose share does not fit its table partitions the share
to spill files by further hash bits, again and again, until each bucket fits. Tables compare complete contents.

Spill files are a task's own, as Spark's spills are: anonymous, gone with the task, and written anew where a task is
run again. What one job hands to the next goes through a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, written

WINDOW_BYTES = 32 << 20
TABLE_BYTES = 64 << 20
FAN_OUT_BITS = 4
OUT_ROWS = 20_000
LARGE = (1 << 63) - 1

SPACE = b" \t\n\x0b\x0c\r"

LOCAL = "rid long, gid long, doc_id long, text_sha256 string, hash long, copies long, min_id long, min_rid long, content binary"
GROUPS = "g_gid long, keep_id long, keep_rid long, group_size long"


def normalised(raw: bytes) -> bytes:
    """Every run of ASCII white space as one space."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in SPACE else b"") + b" ".join(words) + (b" " if raw[-1] in SPACE else b"")


class Table:
    """Open addressing with linear probing; a slot has the number of a content, and equal means equal in every byte."""

    def __init__(self, bits: int = 10):
        self.slots, self.mask = np.zeros(1 << bits, np.int64).tolist(), (1 << bits) - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def add(self, h: int, content: bytes) -> int:
        at = h & self.mask
        while k := self.slots[at]:
            if self.hashes[k - 1] == h and self.contents[k - 1] == content:
                return k - 1
            at = (at + 1) & self.mask
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        self.slots[at] = len(self.hashes)
        if 2 * len(self.hashes) > self.mask:
            self.grow()
        return len(self.hashes) - 1

    def grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [0] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at]:
                at = (at + 1) & self.mask
            self.slots[at] = k + 1


def grouped(records: Iterator[tuple], budget: int = TABLE_BYTES, depth: int = 0) -> Iterator[list[tuple]]:
    """Records (hash, content, *rest) to lists of (group, *rest), one list for each bucket that fits the budget."""
    table, seen, files = Table(), [], None
    last = 64 // FAN_OUT_BITS - 2
    for h, content, *rest in records:
        if files is None:
            seen.append((table.add(h, content), *rest))
            if table.bytes > budget and depth < last:
                files = [tempfile.TemporaryFile() for _ in range(1 << FAN_OUT_BITS)]
                part = lambda h: (h >> (60 - FAN_OUT_BITS * depth)) & ((1 << FAN_OUT_BITS) - 1)
                for k, *r in seen:
                    pickle.dump((table.hashes[k], table.contents[k], *r), files[part(table.hashes[k])], -1)
                table, seen = Table(), []
        else:
            pickle.dump((h, content, *rest), files[part(h)], -1)
    if files is None:
        yield seen
        return
    for f in files:
        with f:
            f.seek(0)
            yield from grouped(read_back(f), budget, depth + 1)


def read_back(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their content hashed; the first of each content in a window carries it, with the window's count."""
    first = TaskContext.get().partitionId() << 40
    schema = pa.schema([("rid", pa.int64()), ("gid", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("hash", pa.int64()), ("copies", pa.int64()), ("min_id", pa.int64()), ("min_rid", pa.int64()), ("content", pa.binary())])
    n = 0

    def out(table: Table, rows: list, shas: list) -> pa.RecordBatch:
        best, count, lead = {}, {}, {}
        for rid, doc, k in rows:
            key = (LARGE if doc is None else doc, doc is None, rid)
            best[k] = min(best.get(k, key), key)
            count[k] = count.get(k, 0) + 1
            lead.setdefault(k, rid)
        cols = [[] for _ in range(9)]
        for rid, doc, k in rows:
            one = lead[k] == rid
            b = best[k]
            for c, v in zip(cols, (rid, lead[k], doc, shas[k], signed(table.hashes[k]) if one else None, count[k] if one else None, None if not one or b[1] else b[0], b[2] if one else None, table.contents[k] if one else None), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    table, rows, shas = Table(), [], []
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for i, doc in enumerate(ids):
            content = normalised(texts[i].as_py() or b"")
            digest = hashlib.sha256(content)
            k = table.add(int.from_bytes(digest.digest()[:8], "big"), content)
            if k == len(shas):
                shas.append(digest.hexdigest())
            rows.append((first + n, doc, k))
            n += 1
            if table.bytes > WINDOW_BYTES or len(rows) >= OUT_ROWS:
                yield out(table, rows, shas)
                table, rows, shas = Table(), [], []
    if rows:
        yield out(table, rows, shas)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def grace_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, content, gid, copies, min_id, min_rid) of one share to each gid's group."""

    def records() -> Iterator[tuple]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for h, *rest in zip(*cols, strict=True):
                yield (h & ((1 << 64) - 1), *rest)

    schema = pa.schema([("g_gid", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])
    for bucket in grouped(records()):
        best, size = {}, {}
        for k, _, copies, min_id, min_rid in bucket:
            key = (LARGE if min_id is None else min_id, min_id is None, min_rid)
            best[k] = min(best.get(k, key), key)
            size[k] = size.get(k, 0) + copies
        for at in range(0, len(bucket), OUT_ROWS):
            part = bucket[at : at + OUT_ROWS]
            cols = [[r[1] for r in part], [None if best[r[0]][1] else best[r[0]][0] for r in part], [best[r[0]][2] for r in part], [size[r[0]] for r in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)


def exact_dedup(docs: DataFrame, share_bytes: int = 64 << 20) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with the row that stays of those whose texts are equal but for white space.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null texts count as empty. The smallest doc_id stays, null
    ids last; of rows alike in id and text one stays. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = written(in_arrow(rows, local_groups, LOCAL), "dedup-local")
    total = local.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n")).first()["n"]
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // share_bytes + 1)
    leads = local.where("content is not null").select("hash", "content", "gid", "copies", "min_id", "min_rid")
    groups = in_arrow(leads.repartition(shares, "hash"), grace_groups, GROUPS)
    out = local.select("rid", "gid", "doc_id", "text_sha256").join(groups, F.col("gid") == F.col("g_gid"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
