"""An index of vectors in cells around centroids. It is optional: exact search is the default, and the index's answers are
exact among the cells that a search looks into.

The centroids are fitted on a bounded sample; every vector is in the index, in the partition of its nearest centroid. How
many cells a search has to look into is measured on that sample when the index is built, and kept with the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.retrieval import cosine_search

#: Vectors that centroids are fitted on, rounds of fitting, and vectors that a cell is meant to hold.
SAMPLE, ROUNDS, CELL_VECTORS = 20_000, 10, 200
#: What share of the NEAREST nearest a search is to find, and on how many vectors of the sample that is measured.
RECALL, NEAREST, ASKED = 0.95, 10, 400
#: Rows that are worked on at once.
BLOCK_ROWS = 1024


def units(v: pa.Array, dims: int) -> np.ndarray:
    m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def fitted(m: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by cosine, from evenly spaced rows; a cell that loses all its rows keeps its centroid."""
    c = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)] if len(m) else m
    for _ in range(ROUNDS if len(m) else 0):
        near = (m @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def nearest_centroid(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[(m[a : a + BLOCK_ROWS] @ c.T).argmax(axis=1) for a in range(0, len(m), BLOCK_ROWS)]])


def probes_for(m: np.ndarray, c: np.ndarray) -> int:
    """The least number of nearest cells that hold RECALL of the nearest neighbours of some of the vectors among all of them."""
    if len(m) < 2:
        return 1
    asked = np.linspace(0, len(m) - 1, min(ASKED, len(m))).astype(int)
    cells, ranks = nearest_centroid(m, c), []
    for i in asked:
        near = np.argsort(-(m @ m[i]), kind="stable")[: NEAREST + 1]
        place = np.empty(len(c), int)
        place[np.argsort(-(c @ m[i]), kind="stable")] = np.arange(len(c))
        ranks.append(place[cells[near]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(int(np.ceil(RECALL * len(ranks))), len(ranks)) - 1]) + 1


def build(vectors: DataFrame, path: str, dims: int, cells: int | None = None, sample: int = SAMPLE) -> tuple[int, int]:
    """Write the index of (id, ord, vec, ...) and return how many vectors were accepted and how many rejected: null ones and
    those of other lengths are not in it."""
    spark = vectors.sparkSession
    fits = F.coalesce(F.size("vec") == dims, F.lit(False)) & F.col("vec").isNotNull()
    total, good = vectors.agg(F.count("*"), F.count_if(fits)).first()
    rows = vectors.where(fits)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    m = units(some, dims)
    c = fitted(m, cells or max(1, good // CELL_VECTORS))
    probes = probes_for(m, c)
    spark.createDataFrame([(k, [float(x) for x in v], probes) for k, v in enumerate(c)], "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @F.arrow_udf("int")
    def cell(v: pa.Array) -> pa.Array:
        return pa.array(nearest_centroid(units(v, dims), c).astype(np.int32))

    placed = rows.withColumn("cell", cell("vec")) if len(c) else rows.withColumn("cell", F.lit(0))
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    return good, total - good


def nearest_cells(spark: SparkSession, path: str, query: list[float], probes: int | None) -> list[int]:
    rows = spark.read.parquet(f"{path}/centroids").collect()  # as many as there are cells
    q = np.asarray(query, float)
    return [r["cell"] for r in sorted(rows, key=lambda r: -float(np.dot(r["centre"], q)))[: probes or max((r["probes"] for r in rows), default=1)]]


def search(spark: SparkSession, path: str, query: list[float], k: int = 30, probes: int | None = None, dates: DataFrame | None = None, as_of: Column | None = None, speaker: str | None = None) -> DataFrame:
    """Cosine search within the cells nearest to the query, as many as were measured to hold RECALL of the nearest: other
    cells' partitions are not read."""
    near = nearest_cells(spark, path, query, probes)
    rows = spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(near)).drop("cell")
    return cosine_search(rows, query, k, dates, as_of, speaker)


def search_many(vectors: DataFrame, path: str, queries: DataFrame, k: int, probes: int | None, dims: int) -> DataFrame:
    """The k nearest of each query (query_id, query) as (query_id, id, distance, rank). Queries are few and go to every task;
    cells that no query looks into are not read, and a cell's rows are scored against the queries that look into it alone."""
    spark = vectors.sparkSession
    asked = queries.select("query_id", "query").toArrow()
    ids = asked.column("query_id").to_numpy()
    q = units(asked.column("query").combine_chunks(), dims)
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    c = units(centroids.column("centre").combine_chunks(), dims)
    probes = probes or max(centroids.column("probes").to_pylist(), default=1)
    looks = np.zeros((len(q), len(c)), bool)
    np.put_along_axis(looks, np.argsort(-(q @ c.T), axis=1)[:, :probes], True, axis=1)
    read = [int(x) for x in np.flatnonzero(looks.any(axis=0))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, cells, own = units(batch.column(2), dims), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for cell in np.unique(cells):
                at, who = np.flatnonzero(cells == cell), np.flatnonzero(looks[:, cell])
                d = 1 - m[at] @ q[who].T
                best = np.argsort(d, axis=0, kind="stable")[:k]
                found = [np.repeat(ids[who], len(best)), own[at][best].T.ravel(), np.take_along_axis(d, best, axis=0).T.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "id", "distance"])

    rows = spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(read)).select("id", "cell", "vec")
    near = rows.mapInArrow(score, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", "id", "distance", "rank")
