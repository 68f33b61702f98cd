"""Joins with lookup tables whose size is checked first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes that a lookup table may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with new columns that are worked out once a row, whatever filters follow: the optimizer would put a column's
    expression into a filter on it and work it out there as well, but moves no filter before a generator."""
    one = F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, one).select(*kept, *[F.col(f"__once.{name}").alias(name) for name in columns])


def few_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches up to the one that goes past BROADCAST_BYTES."""
    size = 0
    for batch in batches:
        yield batch
        size += batch.nbytes
        if size > BROADCAST_BYTES:
            return


def with_lookup(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Broadcasts the small side if it has few rows and bytes; else a shuffled join, whose skew the adaptive planner splits.

    The rows are taken once, at most BROADCAST_ROWS + 1 of them, and no more once they are too many bytes: where that is
    all, they are the side that is broadcast.
    """
    rows = small.limit(BROADCAST_ROWS + 1).mapInArrow(few_bytes, small.schema).toArrow()
    if rows.num_rows <= BROADCAST_ROWS and rows.nbytes <= BROADCAST_BYTES:
        small = F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))
    return big.join(small, on, how)
