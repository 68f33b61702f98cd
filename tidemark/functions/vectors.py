"""Vector functions: norms, dot products, and embeddings by hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import col

HASHED_DIMS = 512
#: Rows of a matrix that are worked on at once, and bytes of text.
BLOCK_ROWS, BLOCK_BYTES = 1024, 2 << 20


def l2_normalize(vec: Column | str) -> Column:
    """The unit vector; a zero vector stays."""
    v = F.transform(col(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def unit(query: list[float]) -> np.ndarray:
    q = np.asarray(query, float)
    return q / (np.linalg.norm(q) or 1.0)


def distances(v: pa.Array, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 - cosine of each vector to a unit vector, and which vectors have its length. Where all have, they are a view of
    the array's buffer; products are summed in double, block by block."""
    sizes = np.diff(v.offsets.to_numpy())
    good = (sizes == len(q)) & v.is_valid().to_numpy(zero_copy_only=False)
    m = (v if good.all() else v.filter(pa.array(good))).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q))
    out = np.full(len(v), np.nan)
    found = np.empty(len(m))
    for a in range(0, len(m), BLOCK_ROWS):
        x = m[a : a + BLOCK_ROWS].astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        found[a : a + BLOCK_ROWS] = 1 - (x @ q) / np.where(norm > 0, norm, 1)
    out[good] = found
    return out, good


def cosine_distance(vec: Column | str, query: list[float]) -> Column:
    """1 - cosine to a constant vector. Batches of vectors go through one matrix product; null and other lengths give null."""
    q = unit(query)

    @F.arrow_udf("double")
    def distance(v: pa.Array) -> pa.Array:
        d, good = distances(v, q)
        return pa.array(d, mask=~good)

    return distance(col(vec))


def nearest(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """rows (vec, weight, ...) to those that may be among the k nearest, without vec and weight, with raw_distance and
    distance (raw_distance over weight): the k nearest of each batch and what is as near. Others never leave the task."""
    q = unit(query)
    kept = [c for c in rows.columns if c not in ("vec", "weight")]
    schema = rows.select(*kept).schema.add("raw_distance", "double").add("distance", "double")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, good = distances(batch.column(batch.schema.get_field_index("vec")), q)
            far = np.where(good, raw / batch.column(batch.schema.get_field_index("weight")).to_numpy(), np.inf)
            limit = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
            at = np.flatnonzero(good & (far <= limit))
            some = batch.select(kept).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(raw[at]), pa.array(far[at])], names=[*kept, "raw_distance", "distance"])

    return rows.mapInArrow(best, schema)


def dot(a: Column, b: Column) -> Column:
    """In JVM terms, for two columns; sums in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column | str) -> Column:
    return 1 / (1 + col(distance))


def hash_bucket(word: Column, dims: int = HASHED_DIMS) -> Column:
    """The 31-polynomial hash of a word in 32-bit arithmetic, without sign, by dimensions."""
    wide = F.lit(1 << 31).cast("long")
    codes = F.transform(F.split(word, ""), lambda ch: F.ascii(ch).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: (a * 31 + x + wide).bitwiseAND(F.lit(0xFFFFFFFF)) - wide)
    return (F.abs(h) % dims).cast("int")


def hash_project(word: str, dims: int = HASHED_DIMS) -> int:
    h = 0
    for ch in word:
        h = (h * 31 + ord(ch) + (1 << 31) & 0xFFFFFFFF) - (1 << 31)
    return abs(h) % dims


def hashed_query(words: list[str], dims: int = HASHED_DIMS) -> dict[int, float]:
    out: dict[int, float] = {}
    for w in words:
        out[hash_project(w, dims)] = out.get(hash_project(w, dims), 0.0) + 1 / len(words)
    norm = sum(x * x for x in out.values()) ** 0.5
    return {k: x / norm for k, x in out.items()} if norm else {}


#: For each byte of a text: itself in lower case where it is an ASCII letter or digit, else 0; and ASCII white space.
PLAIN = np.zeros(256, np.uint8)
PLAIN[48:58], PLAIN[97:123], PLAIN[65:91] = range(48, 58), range(97, 123), range(97, 123)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_buckets(texts: pa.Array, dims: int = HASHED_DIMS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The words of tokens_plain, hashed: portions (first text, texts, text of each word, its bucket) of an Arrow array.

    The polynomial of each word is a sum over its letters times powers of 31, all in 32-bit arithmetic at once.
    """
    for sign, letter in (("\u212a", "k"), ("\u0130", "i")):  # what else is an ASCII letter in lower case
        texts = pc.replace_substring(texts, sign, letter)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = min(max(int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1, i + 1), len(texts))
        part, starts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        at = np.flatnonzero(PLAIN[part])
        # a letter begins a word where white space or a text's end lies between it and the letter before
        breaks = np.cumsum(SPACE[part])[at] if len(at) else at
        row = np.searchsorted(starts, at, "right") - 1
        opens = np.flatnonzero((np.diff(breaks, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        ends = np.append(opens[1:], len(at))[: len(opens)]
        sizes = ends - opens
        power = np.full(int(sizes.max(initial=0)) + 1, 31, np.uint32)
        power[:1] = 1
        power = np.multiply.accumulate(power, dtype=np.uint32)
        terms = PLAIN[part[at]].astype(np.uint32) * power[np.repeat(ends - 1, sizes) - np.arange(len(at))]
        h = np.add.reduceat(terms, opens, dtype=np.uint32) if len(opens) else np.empty(0, np.uint32)
        long = sizes > 2
        yield i, j - i, row[opens][long], (np.abs(h.view(np.int32).astype(np.int64)) % dims)[long]
        i = j


def hashed_cosine(text: Column | str, query: dict[int, float], dims: int = HASHED_DIMS) -> Column:
    """The cosine of a text's words (tokens_plain), hashed, to a unit vector of buckets; 0 where they share no bucket."""
    weights = np.zeros(dims)
    weights[list(query)] = list(query.values())

    @F.arrow_udf("double")
    def cosine(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for first, n, row, bucket in word_buckets(texts, dims):
            product = np.bincount(row, weights[bucket], n)
            pair, times = np.unique(row * dims + bucket, return_counts=True)
            square = np.bincount(pair // dims, (times * times).astype(float), n)
            out[first : first + n] = product / np.sqrt(np.where(square > 0, square, 1))
        return pa.array(out)

    return cosine.asNondeterministic()(col(text))  # lest a filter on it works it out a second time


def hashed_embedding(df: DataFrame, key: str, text: str, dims: int = HASHED_DIMS) -> DataFrame:
    """(key, bucket, weight): unit vectors of hashed words, in long form; texts without words have no rows."""
    schema = df.select(key).schema.add("bucket", "integer").add("weight", "double")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, bucket in word_buckets(batch.column(1), dims):
                pair, times = np.unique(row * dims + bucket, return_counts=True)
                of = pair // dims
                norm = np.sqrt(np.bincount(of, (times * times).astype(float), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + first)), pa.array((pair % dims).astype(np.int32)), pa.array(times / norm[of])], names=[key, "bucket", "weight"])

    return df.select(key, text).mapInArrow(embed, schema)
