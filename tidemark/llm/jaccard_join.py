"""Exact self-join of documents by the Jaccard similarity of their word 5-shingles, with set-relation skipping.

Equal sets form a class; only classes are joined. Every class enters index lists with the first tokens of its set, in an
order that puts what a count over all documents shows to be frequent last (prefix filter). Lists are sorted by set size.

Answers come in rounds. First every list compares its sets with a pivot only: the set that stands first in it by
position, which has the fewest elements of its own and so is nearest to the others. Links make components; within one no
further pair is looked at. Then the sets compared with one pivot get their answers from it: with both sets known by what
they lack of the pivot and what they have beside it, an overlap is a few bit operations, and no set is read again. What
is left are pairs of a list without a common pivot. Their blocks by size and position are skipped where a bound rules
them out, as are pairs that their overlaps with a pivot rule out. The rest is compared by parity marks, a sixteenth of
the sets' size, which bound the overlap from above, and where these leave it open, in full.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_bucket, in_arrow, narrow, scratch, without, written
from tidemark.llm.graph import components
from tidemark.llm.textsets import class_of, shingles, words_of

#: The similarity as a fraction in whole numbers.
NUM, DEN = 75, 100

#: Shingles are counted in 2**bits counters, from so many bits on to so many, about one for each eight shingles. More of
#: them tell frequent from usual shingles more finely; they never change a result.
SKETCH_BITS, SLICE_BITS = (18, 25), 16
#: Index entries that a task of the list stage is meant to hold, and those of one token beyond which they are dealt over several.
TASK_ENTRIES, LIST_ENTRIES = 600_000, 100_000
BLOCK = 64
#: Members of a list that one task compares with each other; longer lists are dealt over cells.
CELL = 500
#: Rows of a share of a long list or a large family: the least, over SHARES shares at most, and from then on the most.
LEAST_SHARE, SHARES, MOST_SHARE = 250, 40, 10_000
#: Sets are compared with a pivot in full from this many hundredths on, since they may be similar to its other sets.
NEAR = 50
#: Bytes of their differences from the pivot that the sets of a share of a family have.
SHARE_BYTES = 16 << 20
#: The mark that bounds a pair's overlap before sets are fetched has about so many bits for each element.
MARK_SHARE = 4
#: Bits of the filter on the rows whose sets are fetched.
FILTER_BITS = 24
LARGE = (1 << 63) - 1


def least_overlap(a, b):
    """The smallest overlap with which sets of a and b elements are similar."""
    return -(-NUM * (a + b) // (NUM + DEN))


def probe_length(n):
    return n - -(-NUM * n // DEN) + 1


def index_length(n):
    """Of two similar sets, the smaller meets the other's probe prefix within this many of its first elements."""
    return n - least_overlap(n, n) + 1


def mark_of(s: np.ndarray) -> bytes:
    """For each bit, whether an odd number of elements falls on it: two marks differ in no more bits than their sets in elements."""
    bits = max(256, 1 << (MARK_SHARE * len(s) - 1).bit_length()) if len(s) else 256
    return np.packbits(np.bincount((s >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two marks differ. The longer is folded to the length of the other, which keeps parities."""
    one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(one) < len(two):
        one, two = two, one
    return int(np.bitwise_count(np.bitwise_xor.reduce(one.reshape(-1, len(two)), axis=0) ^ two).sum())


def thinned(counts: np.ndarray) -> bytes:
    """A slice of counts, most of them 0: a bit for each that is not, then the low and the high bytes of those."""
    some = counts[counts > 0]
    return zlib.compress(np.packbits(counts > 0).tobytes() + (some & 255).astype(np.uint8).tobytes() + (some >> 8).astype(np.uint8).tobytes(), 1)


def filled(raw: bytes) -> np.ndarray:
    """The slice of counts that was thinned."""
    data = np.frombuffer(zlib.decompress(raw), np.uint8)
    there = np.unpackbits(data[: (1 << SLICE_BITS) // 8]).astype(bool)
    low, high = data[(1 << SLICE_BITS) // 8 :].reshape(2, -1).astype(np.uint16)
    out = np.zeros(1 << SLICE_BITS, np.uint16)
    out[there] = low | high << 8
    return out


def set_counter(bits: int):
    """A function from (doc_id, key, text) to (doc_id, key, n, class, mark), and at the end the task's counts by hash, in slices."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("mark", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low = np.zeros(1 << bits, np.uint16), np.uint64((1 << bits) - 1)
        for batch in batches:
            sizes, classes, marks = [], [], []
            for words in words_of(batch.column(2)):
                s = shingles(words)
                at = s & low
                counts[at] += counts[at] < 65535  # two shingles of a text in one counter count once; the order needs no more
                sizes.append(len(s))
                classes.append(class_of(s))
                marks.append(mark_of(s))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if counts.any():
            for k, part in enumerate(counts.reshape(-1, 1 << SLICE_BITS)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([thinned(part)], pa.binary())], schema=schema)

    return read_sets


def leveller(usual: float):
    """A function from slices of counts to how frequent their shingles are: 0 up to the usual count, then in powers of two."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = filled(raw) + total.get(k, np.uint64(0))
        for k, x in total.items():
            level = np.maximum(np.log2(np.maximum(x, 1) / usual), 0).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["slice", "levels"])

    return levels


def entry_writer(slices: dict[int, bytes], bits: int, buckets: int, hot: int):
    """A function from (text) to index entries, packed by list bucket and share: tokens, classes, sizes, positions.

    Tokens of level `hot` and beyond have their entries dealt over shares by class, twice as many with each level.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, empty = np.uint64((1 << bits) - 1), bytes(1 << SLICE_BITS)
        level = np.frombuffer(b"".join(zlib.decompress(slices[k]) if k in slices else empty for k in range(1 << (bits - SLICE_BITS))), np.int8)
        seen: set[int] = set()
        tokens, classes, sizes, places, shares, held = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            t, n = np.concatenate(tokens), [len(x) for x in tokens]
            c, s, p = np.repeat(np.array(classes, np.int64), n), np.repeat(np.array(sizes, np.uint32), n), np.concatenate(places)
            b = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32 | np.concatenate(shares)
            order = np.argsort(b, kind="stable")
            t, c, s, p, b = (t & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], c[order], s[order], p[order], b[order]
            at = np.append(np.flatnonzero(np.diff(b, prepend=b[:1] + 1)), len(b))
            rows = [b"".join((t[i:j].tobytes(), c[i:j].tobytes(), s[i:j].tobytes(), p[i:j].tobytes())) for i, j in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(b[at[:-1]]), pa.array(rows, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for words in words_of(batch.column(0)):
                s = shingles(words)
                n = len(s)
                if not n or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                rank = level[s & low]
                if rank.any():
                    order = np.argsort(rank, kind="stable")
                    s, rank = s[order], rank[order]
                k = probe_length(n)
                tokens.append(s[:k])
                places.append(np.arange(k, dtype=np.uint32))
                classes.append(c)
                sizes.append(n)
                above = rank[:k].astype(np.int64) - hot
                shares.append(np.where(above < 0, 0, 1 + (c & ((2 << np.maximum(above, 0)) - 1))))
                held += k
                if held >= 400_000:
                    yield out()
                    tokens, classes, sizes, places, shares, held = [], [], [], [], [], 0
        if held:
            yield out()

    return entries


def close(n1, p1, n2, p2):
    """The size and position bounds: can sets that share the tokens at these positions be similar?"""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (NUM * high <= DEN * low) & (most >= least_overlap(n1, n2))


def list_reader(buckets: int):
    """Packed entries of whole buckets to the lists' members (list, class, n, place, pivot, members, shared).

    `members` is how many the list has. Of a list that is dealt over shares, each share has pivots of its own, and no
    member is left out, as the others of its list are elsewhere.
    """
    schema = pa.schema([("list", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("pivot", pa.int64()), ("members", pa.int64()), ("shared", pa.bool_())])

    def members(bucket: int, rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        bucket, shared = bucket >> 32, bool(bucket & 0xFFFFFFFF)
        cols = [[], [], [], []]
        for raw in rows:
            k = len(raw) // 20
            for c, v in zip(cols, (np.frombuffer(raw, np.uint32, k), np.frombuffer(raw, np.int64, k, 4 * k), np.frombuffer(raw, np.uint32, k, 12 * k), np.frombuffer(raw, np.uint32, k, 16 * k)), strict=True):
                c.append(v)
        t, c, n, p = map(np.concatenate, cols)
        order = np.argsort(t, kind="stable")
        t = t[order]
        if not shared:
            same = t[1:] == t[:-1]
            twice = np.append(same, False) | np.append(False, same)
            order, t = order[twice], t[twice]
        if not len(t):
            return
        c, n, p = c[order], n[order].astype(np.int64), p[order].astype(np.int64)
        order = np.lexsort((c, p, n, t))
        t, c, n, p = t[order], c[order], n[order], p[order]
        new = np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]))
        t, c, n, p = t[new], c[new], n[new], p[new]
        at = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t))
        indexed = p < index_length(n)
        pivot = np.full(len(t), -1, np.int64)  # where the member's pivot stands
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if not shared and (j - i < 2 or not indexed[i:j].any()):
                continue
            start = i
            while i < j:
                end = i + int(np.searchsorted(n[i:j], DEN * n[i] // NUM, "right"))
                first = i + np.flatnonzero(p[i:end] == p[i:end].min())
                pivot[i:end] = first[np.argmin(c[first])]
                if end - i == 1 and not shared:  # alone in its range: it stays for the smaller sets of the range before, where a bound leaves one
                    k = start + np.flatnonzero(indexed[start:i])
                    if not close(n[k], p[k], n[i], p[i]).any():
                        pivot[i] = -1
                i = end
        stay = pivot >= 0
        count = np.repeat(np.diff(at), np.diff(at))
        if shared:
            count = np.maximum(count, CELL + 1)
        all_c = c
        t, c, n, p = t[stay], c[stay], n[stay], p[stay]
        lists = (np.int64(bucket) << 32) | t.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(c), pa.array(n), pa.array(p), pa.array(all_c[pivot[stay]]), pa.array(count[stay]), pa.array(np.full(len(t), shared))], schema=schema)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in groups(batches, 1):
            yield from members(bucket[0], [raw for x in parts for raw in x.column(1).to_pylist()])

    return lists


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Sorted batches to their groups by the first `width` columns: the key and the group's rows. Only one group is held at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(width)]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            this = tuple(x[a].item() for x in cols)
            if held and this != key:
                yield key, held
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def shares_for(rows: Column) -> Column:
    """Over how many shares so many rows are dealt: evenly over a few tasks first, as every row is copied to the others' shares."""
    return F.greatest(F.least(F.ceil(rows / LEAST_SHARE), F.lit(SHARES)), F.ceil(rows / MOST_SHARE)).cast("long")


def dealt(df: DataFrame, outside: Column, out_shares: Column, home_shares: Column, spread: Column) -> DataFrame:
    """df with `cell` and `side`, its rows repeated so that any two of which one is outside meet in one cell, on two sides or in a cell of one side.

    Rows outside are dealt over out_shares sides, the others over home_shares; a cell has the rows of two sides, or of one
    of the outer sides. Rows at home meet none of their own.
    """
    all_shares = out_shares + home_shares
    df = df.withColumn("side", F.when(outside, F.pmod(F.xxhash64(spread), out_shares)).otherwise(out_shares + F.pmod(F.xxhash64(spread), F.greatest(home_shares, F.lit(1)))))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(outside, all_shares).otherwise(out_shares) - 1)))
    return df.withColumn("cell", F.least("side", "other") * all_shares + F.greatest("side", "other")).drop("other")


def crossing_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of lists, sorted by list and cell, to the pairs that cross components and that no bound rules out."""
    for _, parts in groups(batches, 2):
        table = pa.Table.from_batches(parts)
        c, n, p, comp, side = (table.column(k).to_numpy() for k in ("class", "n", "place", "component", "side"))
        if len(c) < 2 or (comp == comp[0]).all():
            continue
        known, full = table.column("hi").is_valid().to_numpy(), table.column("full").fill_null(False).to_numpy()
        pivot, lo, hi = (table.column(k).fill_null(0).to_numpy() for k in ("pivot", "lo", "hi"))
        order = np.lexsort((c, p, n))
        c, n, p, comp, side, known, full, pivot, lo, hi = (x[order] for x in (c, n, p, comp, side, known, full, pivot, lo, hi))
        two = side.min() != side.max()
        indexed = p < index_length(n)
        for x in range(0, len(c), BLOCK):
            xs = np.arange(x, min(x + BLOCK, len(c)))
            xs = xs[indexed[xs]]
            if not len(xs):
                continue
            end = x + int(np.searchsorted(n[x:], DEN * n[xs[-1]] // NUM, "right"))  # beyond, every set is too large
            for y in range(x, end, BLOCK):
                ys = np.arange(y, min(y + BLOCK, end))
                gap = p[ys].min() - p[xs].max(), p[xs].min() - p[ys].max()
                slack = n[ys].max() - least_overlap(n[xs].min(), n[ys].min())
                if max(gap) > slack + 1:  # the block's positions lie too far apart
                    continue
                a, b = (m.ravel() for m in np.meshgrid(xs, ys, indexing="ij"))
                k = (a < b) & (comp[a] != comp[b])
                if two:
                    k &= side[a] != side[b]
                a, b = a[k], b[k]
                k = close(n[a], p[a], n[b], p[b])
                a, b = a[k], b[k]
                both = known[a] & known[b] & (pivot[a] == pivot[b])
                most = np.minimum(hi[b] + n[a] - lo[a], hi[a] + n[b] - lo[b])
                k = ~(both & (full[a] & full[b] | (most < least_overlap(n[a], n[b]))))
                a, b = a[k], b[k]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[a], c[b])), pa.array(np.maximum(c[a], c[b]))], names=["a", "b"])


def row_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the keys' low bits: which rows can be among them. Of fixed size, whatever the input."""
    at = F.pmod("key", F.lit(1 << FILTER_BITS))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(key, 64) AS int))) AS bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def set_reader(among: np.ndarray):
    """A function from (key, text) to (key, class, set), for the rows that pass the filter; a few others pass with them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            hit = (among[(key & ((1 << FILTER_BITS) - 1)) >> 6] >> (key & 63)) & 1 == 1
            batch = batch.filter(pa.array(hit))
            found = [shingles(w) for w in words_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "class", "set"])

    return sets


def bounder(num: int):
    """A function from (a, b, n_a, n_b, mark_a, mark_b) to (a, b, hi): no more elements than hi are shared.

    hi is null where the similarity may be num hundredths or more, so that the sets have to be read.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            differ = [apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            hi = (n + m - np.array(differ, np.int64)) // 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hi, mask=(DEN + num) * hi >= num * (n + m))], names=["a", "b", "hi"])

    return bounded


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) to (a, b, shared, linked, a_n, n, lacks, extra): which elements of a's b lacks, as bits, and what it has beside them."""
    for batch in batches:
        shared, linked, sizes, lacks, extra = [], [], [], [], []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            left, right = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            at = np.searchsorted(left, right)
            at[at == len(left)] = 0
            same = left[at] == right
            missing = np.ones(len(left), np.uint8)
            missing[at[same]] = 0
            k = int(same.sum())
            shared.append(k)
            sizes.append((len(left), len(right)))
            linked.append(DEN * k >= NUM * (len(left) + len(right) - k))
            lacks.append(np.packbits(missing).tobytes())
            extra.append(right[~same].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_()), pa.array([x[0] for x in sizes], pa.int64()), pa.array([x[1] for x in sizes], pa.int64()), pa.array(lacks, pa.binary()), pa.array(extra, pa.binary())], names=["a", "b", "shared", "linked", "a_n", "n", "lacks", "extra"])


def family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets by their difference from a pivot, sorted by pivot and cell, to links (a, b) of those outside the pivot's component."""
    for _, rows in groups(batches, 2):
        part = pa.Table.from_batches(rows)
        c, n, comp, home, size, side = (part.column(k).to_numpy() for k in ("b", "n", "component", "a_component", "a_n", "side"))
        outside = np.flatnonzero(comp != home)
        if not len(outside) or (comp == comp[0]).all():
            continue
        two = side.min() != side.max()
        raw = part.column("lacks").to_pylist()
        width = -(-len(raw[0]) // 8) * 8
        lacks = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint64).reshape(len(raw), -1)
        more = [np.frombuffer(x, np.uint64) for x in part.column("extra").to_pylist()]
        tokens, owner = np.concatenate(more), np.repeat(np.arange(len(more)), [len(x) for x in more])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for z in outside.tolist():
            shared = size[z] - np.bitwise_count(lacks | lacks[z]).sum(axis=1, dtype=np.int64)
            lo, hi = np.searchsorted(tokens, more[z]), np.searchsorted(tokens, more[z], "right")
            for i, j in zip(lo[hi > lo + 1].tolist(), hi[hi > lo + 1].tolist(), strict=True):
                shared[owner[i:j]] += 1
            hit = (shared >= least_overlap(n, n[z])) & (comp != comp[z])
            if two:
                hit &= side != side[z]
            found = np.flatnonzero(hit)
            if len(found):
                found = found[np.unique(comp[found], return_index=True)[1]]  # one link to each component will do
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c[z])), pa.array(c[found])], names=["a", "b"])


def compared(pairs: DataFrame, rows: DataFrame, read: DataFrame, leads: DataFrame, classes: int, num: int, name: str) -> DataFrame:
    """Pairs of classes (a, b) to (a, b, lo, hi, full, linked, a_n, n, lacks, extra): bounds of their overlap.

    The whole sets are compared (full, lo = hi) where their similarity may be num hundredths or more.
    """

    def of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        return leads.join(narrow(needed, classes), "class").select("class", "n", F.col("lead_key").alias("key"))

    with scratch(pairs.sparkSession):
        marks = written(read.where("slice is null").select("key", "mark").join(narrow(of(pairs), classes), "key").select("class", "n", "mark"), f"{name}-marks", 8 * classes)
        if marks.count() > marks.select("class").distinct().count():  # rows alike in id and text
            marks = written(marks.dropDuplicates(["class"]), f"{name}-marks")  # written, so that the joins' hot keys can be split
        one, two = (marks.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("mark").alias(f"mark_{x}")) for x in "ab")
        bounds = in_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "mark_a", "mark_b"), bounder(num), "a long, b long, hi long")
        count = pairs.count()
        bounds = written(bounds, f"{name}-bounds", 8 * count)
        open_pairs = bounds.where("hi is null").select("a", "b")
        wanted = written(of(open_pairs), f"{name}-wanted", classes)
        sets = in_arrow(rows.select("key", "text"), set_reader(row_filter(wanted)), "key long, class long, set binary")
        sets = written(sets.join(narrow(wanted.select("key"), classes), "key", "left_semi").drop("key"), f"{name}-sets")
        if sets.count() > sets.select("class").distinct().count():  # rows alike in id and text
            sets = written(sets.dropDuplicates(["class"]), f"{name}-sets")
        one, two = (sets.select(F.col("class").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        full = in_arrow(open_pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b"), overlaps, "a long, b long, shared long, linked boolean, a_n long, n long, lacks binary, extra binary")
        full = full.select("a", "b", F.col("shared").alias("lo"), F.col("shared").alias("hi"), F.lit(True).alias("full"), "linked", "a_n", "n", "lacks", "extra")
        none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
        ruled_out = bounds.where("hi is not null").select("a", "b", zero.alias("lo"), "hi", F.lit(False).alias("full"), F.lit(False).alias("linked"), zero.alias("a_n"), zero.alias("n"), none.alias("lacks"), none.alias("extra"))
        return written(ruled_out.union(full), f"{name}-overlaps", 8 * count, keep=True)


def placed(first: DataFrame, comp: DataFrame, count: int, classes: int) -> DataFrame:
    """Compared pairs (a, b) with the components of both."""
    pairs = first.select("a", "b", "lo", "hi", "full", (F.octet_length("lacks") + F.octet_length("extra")).cast("long").alias("bytes"))
    for x in "ab":
        pairs = pairs.join(narrow(comp.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")), classes), x, "left")
    return written(pairs.withColumns({f"{x}_component": F.coalesce(f"{x}_component", x) for x in "ab"}), "placed", count)


def from_pivots(first: DataFrame, pairs: DataFrame, shares: int, count: int) -> DataFrame:
    """Links of sets outside their pivot's component with others that were compared with the same pivot.

    A large family is dealt over cells, so that every set outside meets every other of the family in one of them.
    """
    pairs = pairs.where("full").withColumn("outside", F.col("b_component") != F.col("a_component"))
    cells = lambda of: F.greatest(shares_for(F.count_if(of)), F.ceil(F.sum(F.when(of, F.col("bytes"))) / SHARE_BYTES).cast("long"), F.lit(0))
    mixed = pairs.groupBy("a").agg(F.count_if("outside").alias("out"), F.count("*").alias("size"), cells(F.col("outside")).alias("out_shares"), cells(~F.col("outside")).alias("home_shares")).where("out > 0 and size > 1").drop("out", "size")
    families = pairs.join(narrow(mixed, count), "a").select("a", "b", F.col("b_component").alias("component"), "a_component", "outside", "out_shares", "home_shares")
    wide = first.where("full").select("a", "b", "a_n", "n", "lacks", "extra").join(families, ["a", "b"])
    wide = dealt(wide, F.col("outside"), F.col("out_shares"), F.col("home_shares"), F.col("b")).drop("out_shares", "home_shares", "outside")
    wide = wide.select("a", "cell", *[c for c in wide.columns if c not in ("a", "cell")])
    return in_arrow(wide.repartition(shares, "a", "cell").sortWithinPartitions("a", "cell"), family_links, "a long, b long").distinct()


def dealt_lists(left: DataFrame) -> DataFrame:
    """Members of long lists with cell and side. A list's largest component is at home: its members are not compared with
    each other. Lists of one component go."""
    counts = left.groupBy("list", "component").agg(F.count("*").alias("size"))
    homes = counts.groupBy("list").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("all")).where("all > most.size")
    homes = homes.select(F.col("list").alias("of_list"), F.col("most.component").alias("home"), shares_for(F.col("all") - F.col("most.size")).alias("out_shares"), shares_for(F.col("most.size")).alias("home_shares"))
    found = left.join(narrow(homes, left.count() // CELL), left["list"] == homes["of_list"])
    return dealt(found, F.col("component") != F.col("home"), F.col("out_shares"), F.col("home_shares"), F.col("class")).drop("of_list", "home", "out_shares", "home_shares")


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more links."""
    if links.isEmpty():
        return comp
    return components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def similarity_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, key, n, class) of every row, (class, lead_id, component) of the classes, and how many classes there are."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = min(max((size // 48).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    read = written(in_arrow(rows, set_counter(bits), "doc_id long, key long, n long, class long, mark binary, slice int, counts binary"), "sets", keep=True)
    sig = read.where("slice is null").select("doc_id", "key", "n", "class")
    total, count = sig.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mean = total / (1 << bits)
    usual = mean + 4 * mean**0.5 + 4
    slices = in_arrow(read.where("slice is not null").select("slice", "counts").repartition(parts, "slice"), leveller(usual), "slice int, levels binary")
    levels = {r["slice"]: bytes(r["levels"]) for r in slices.collect()}  # 2**bits small numbers at most, nearly all 0
    leads = written(sig.where("n > 0").groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LARGE)).alias("id"), "key")).alias("m"), F.max("n").alias("n")).select("class", "n", F.col("m.id").alias("lead_id"), F.col("m.key").alias("lead_key")), "leads", count)
    classes = leads.count()
    shares = max(parts, total // 4 // TASK_ENTRIES + 1)
    hot = max(1, math.ceil(math.log2(max(LIST_ENTRIES / usual, 1))))
    packed = in_arrow(rows.select("text"), entry_writer(levels, bits, 4 * shares, hot), "bucket long, entries binary")
    packed = packed.repartition(shares, "bucket").sortWithinPartitions("bucket")
    lists = written(in_arrow(packed, list_reader(4 * shares), "list long, class long, n long, place long, pivot long, members long, shared boolean"), "lists", max(total // 16, classes))
    # the pivots of a list's shares are compared with one of them by range of sizes, so that the shares' families become one
    heads = lists.where("shared and pivot = class").select("list", F.floor(F.log("n") / math.log(DEN / NUM)).alias("range"), "class", "place").distinct()
    main = heads.groupBy("list", "range").agg(F.min_by("class", F.struct("place", "class")).alias("a"))
    pairs = lists.where("pivot <> class").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
    pairs = pairs.union(heads.join(main, ["list", "range"]).where("a <> class").select("a", F.col("class").alias("b")))
    pairs = written(pairs.distinct(), "pairs", 4 * classes)
    count = pairs.count()
    first = compared(pairs, rows, read, leads, classes, NEAR, "pivot")
    comp = components(first.where("linked").select("a", "b"))
    near = placed(first, comp, count, classes)
    found = written(from_pivots(first, near, shares, count), "family-links", count)
    if not found.isEmpty():
        comp = joined(comp, found)
        near = placed(first, comp, count, classes)
    # a list of two has no pair but that of its pivot
    of = near.select(F.col("a").alias("pivot"), F.col("b").alias("class"), "lo", "hi", "full", F.col("b_component").alias("component"))
    # every set that is its own pivot, those too that stand alone in a range of sizes and were compared with none there
    pivots = lists.where("members > 2 and pivot = class").select("pivot", "class").distinct()
    pivots = pivots.join(narrow(comp, classes), pivots["class"] == comp["node"], "left").select("pivot", "class", F.coalesce("component", "class").alias("component"))
    of = written(of.unionByName(pivots, allowMissingColumns=True), "compared", count + classes)
    left = lists.where("members > 2").join(narrow(of, count + classes), ["pivot", "class"])
    own = F.col("pivot") == F.col("class")
    lo, hi = (F.when(own, F.col("n")).otherwise(F.col(x)).alias(x) for x in ("lo", "hi"))
    left = left.select("list", "class", "n", "place", "component", "pivot", lo, hi, F.when(own, True).otherwise(F.col("full")).alias("full"), "members")
    short = left.where(F.col("members") <= CELL).withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(0).cast("long")}).drop("members")
    left = short.unionByName(dealt_lists(written(left.where(F.col("members") > CELL).drop("members"), "long-lists", max(total // 16, classes))))
    left = left.select("list", "cell", *[c for c in left.columns if c not in ("list", "cell")])
    left = left.repartition(shares, hash_bucket(1 << 30, "list", "cell")).sortWithinPartitions("list", "cell")
    more = written(in_arrow(left, crossing_pairs, "a long, b long").distinct(), "crossing", count)
    if more.count():
        second = compared(more, rows, read, leads, classes, NUM, "crossing")
        comp = joined(comp, second.where("linked").select("a", "b"))
    return sig, leads.join(comp, leads["class"] == comp["node"], "left").select("class", "lead_id", F.coalesce("component", "class").alias("component")), classes


def ngram_jaccard_join(docs: DataFrame, with_key: bool = False) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with the size of its shingle set and its component of similar documents.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included). Texts without
    words and null texts are linked with nothing. Rows with a null id take part; they never name a component, and a
    component of none but such rows has the id null. Rows alike are one set. An empty table gives an empty result; other
    columns are ignored. Sets are of 64-bit hashes of shingles, and 64-bit hashes of sets name the classes: two different
    shingles agree with odds of 2**-64, and among r rows two different sets do with odds of about r**2 / 2**65.
    """
    with scratch(docs.sparkSession):
        sig, named, classes = similarity_classes(docs)
        least = named.groupBy("component").agg(F.min("lead_id").alias("component_id"))
        of = written(named.join(least, "component").select(F.col("class").alias("of_class"), F.when(F.col("component_id") < LARGE, F.col("component_id")).alias("component_id")), "component-ids", classes, keep=True)
    out = sig.join(of, F.when(F.col("n") > 0, F.col("class")) == F.col("of_class"), "left")
    key = ["key"] if with_key else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *key)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their component, with all their columns.

    Rows without an id stay if their component has no id at all; rows alike in id and text share their fate.
    """
    named = ngram_jaccard_join(docs.select("doc_id", "text"), with_key=True)
    return without(docs, named.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "key"))
