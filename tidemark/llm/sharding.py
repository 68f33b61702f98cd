"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's key (its id and content) is a point of the ring; the next virtual node clockwise names its shard. Rows are
taken in ring order; where the shard is full, the row goes on clockwise to the next virtual node whose shard has room.
The capacities add up to the number of rows times the load factor, so that balance is guaranteed; only overflowing rows
leave the shard that plain consistent hashing gives them.

The ring is cut into a fixed number of cells. The plan counts rows by cell, lays the cells out on the shards (a table
of fixed size, whatever the input), and gives each row its place from its rank within its cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written

#: Rows repeated wholly are numbered together and set apart in steps of this many.
STEP = 10_000


def ring(shards: int, vnodes: int, bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node in ring order."""
    points = []
    for s in range(shards):
        for r in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{s}/{r}".encode(), digest_size=8).digest(), "big")
            points.append((h, s))
    return [(h >> (64 - bits), s) for h, s in sorted(points)]


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    """With a factor of 1, counts at most one apart; else that times the mean, rounded up."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    most = int(-(-rows * load_factor // shards))
    return [most] * shards


def lay_out(counts: dict[int, int], shards: int, vnodes: int, bits: int, load_factor: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) for every cell that has rows."""
    nodes = ring(shards, vnodes, bits)
    room, fill = capacities(sum(counts.values()), shards, load_factor), [0] * shards
    n = len(nodes)
    after = list(range(n))  # the next node clockwise that has room, as far as known

    def open_node(i: int) -> int:
        path = []
        for _ in range(n + 1):
            if room[nodes[i][1]] > fill[nodes[i][1]]:
                break
            path.append(i)
            i = after[i] if after[i] != i else (i + 1) % n
        for p in path:
            after[p] = i
        return i

    out, at = [], 0
    for cell in sorted(counts):
        while at < n and nodes[at][0] < cell:
            at += 1
        node, lo, left = at % n, 0, counts[cell]
        while left:
            node = open_node(node)
            s = nodes[node][1]
            k = min(left, room[s] - fill[s])
            out.append((cell, lo, lo + k, s, fill[s]))
            fill[s] += k
            lo += k
            left -= k
    return out


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 64, bits: int = 14, load_factor: float = 1.0) -> DataFrame:
    """Put every row of docs (doc_id, text, ...) into one of the shards.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard. The law is `rows`:
    with load_factor 1 the shards' counts differ by one at most. Null texts count as no bytes; null ids are keys like
    others; rows alike in id and text are numbered one after another; an empty table gives an empty result; other
    columns are ignored. The driver holds 2**bits counts and the ring, both fixed by parameters.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    point = F.xxhash64("doc_id", "size", "text_crc32")
    rows = written(rows.withColumn("point", point).withColumn("cell", F.shiftrightunsigned("point", 64 - bits).cast("int")), "ring-rows", docs.count())
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("copies").alias("n")).collect()}
    plan = spark.createDataFrame(lay_out(counts, shards, vnodes, bits, load_factor), "p_cell int, lo long, hi long, shard int, slot_0 long")
    order = Window.partitionBy("cell").orderBy("point", "doc_id", "size", "text_crc32")
    placed = rows.withColumn("rank", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    placed = placed.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(STEP).cast("long"))))
    last = F.least(F.col("copies") - 1, F.col("step") + STEP - 1)
    placed = placed.withColumn("rank", F.explode(F.sequence(F.col("rank") + F.col("step"), F.col("rank") + last)))
    # at most 2**bits + shards * vnodes rows, by the parameters
    placed = placed.join(F.broadcast(plan), (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot_0") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
