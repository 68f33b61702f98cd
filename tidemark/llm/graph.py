"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, scratch, written

STAR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


#: Links that one task hangs up in memory.
TASK_LINKS = 200_000


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as links from every node to the smallest that it reaches among them, TASK_LINKS at a time."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def out() -> Iterator[pa.RecordBatch]:
        ends = [(x, r) for x in list(up) if (r := root(x)) != x]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ends, strict=True)], schema=STAR)
        up.clear()

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= TASK_LINKS:
            yield from out()
            seen = 0
    yield from out()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, component): the smallest node reachable. Nodes without links are not returned.

    As many links as one task holds are hung up by it. More are hung up task by task; then each round hangs every node on
    its smallest neighbour, follows the pointer once more, and contracts the links; they shrink by half or better a round.
    Only the number of links left reaches the driver.
    """
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    n = ends.count()
    tasks = 1 + n // (TASK_LINKS // 2)
    if tasks == 1:
        found = in_arrow(ends.coalesce(1), stars, "u long, v long")
        found = found.union(found.select("v", "v").distinct()) if n else found
        return written(found.select(F.col("u").alias("node"), F.col("v").alias("component")), "components", 2 * n, keep=True)
    label, nodes = None, 2 * n
    with scratch(links.sparkSession):
        cur = written(in_arrow(ends.coalesce(tasks), stars, "u long, v long").distinct(), "links", n)
        while n := cur.count():
            both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v"))
            above = up.select(F.col("u").alias("v"), F.col("v").alias("top"))
            up = written(up.join(above, "v", "left").select("u", F.coalesce("top", "v").alias("v")), "parents", 2 * n)
            to = lambda name: up.select(F.col("u").alias(name), F.col("v").alias(f"{name}_up"))  # noqa: B023, E731
            if label is None:
                label = up.select(F.col("u").alias("node"), F.col("v").alias("component"))
            else:
                label = label.join(to("component"), "component", "left").select("node", F.coalesce("component_up", "component").alias("component"))
            cur = cur.join(to("u"), "u", "left").join(to("v"), "v", "left")
            cur = written(cur.select(F.coalesce("u_up", "u").alias("u"), F.coalesce("v_up", "v").alias("v")).where("u <> v").distinct(), "links", n)
        if label is None:
            label = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return written(label, "components", nodes, keep=True)
