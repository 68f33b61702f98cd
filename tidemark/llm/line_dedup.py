"""Line deduplication by content-defined chunks of lines.

A hash rolls over the hashes of neighbouring lines; wherever its value allows, a text is cut, so that cuts move with the
content and a passage is cut alike wherever it stands. A chunk reaches from one cut line to the next, both included: two
lines at least. Of a chunk that stands in several places the first stays. Chunks that follow each other as they do in one
earlier place are a run; a run is extended line by line on both sides, its bytes are compared with that place, and it goes.

DataFrame functions only. Chunks travel as hashes; bytes travel only for runs, to the place that is said to hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BROADCAST_ROWS, lookup, sized, written

#: The rolling hash over two neighbouring lines: what the first one's is multiplied by, the modulus, and the share of
#: values (one of EVERY) that are no cut. Cuts are dense, so that passages of few lines hold a whole chunk.
BASE, PRIME, EVERY = 1_000_003, (1 << 32) - 5, 8
#: Bytes that the first places of repeated chunks may have to be broadcast, whose rows hold as many hashes as their
#: neighbours have lines.
BROADCAST_BYTES = 8 << 20
#: Runs whose lines may be broadcast to the texts: each is asked for twice at most, by about 200 bytes.
BROADCAST_RUNS = 20_000
#: Fewer lines never go.
LEAST_LINES = 2
#: Something but white space.
SOLID = r"[^\x20\x09-\x0D]"
LAST_ID = (1 << 63) - 1


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def cuts(rolls: str) -> Column:
    """The numbers (from 1) of the lines at which a text is cut: the first, the last, and where the rolling hash says so."""
    n = F.size(rolls)
    rolled = lambda i: (F.get(rolls, i - 1) * BASE + F.get(rolls, i)) % PRIME
    inner = F.when(n > 2, F.filter(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: rolled(i) % EVERY != 0)).otherwise(F.array().cast("array<int>"))
    return F.when(n > 1, F.concat(F.array(F.lit(1)), inner, F.array(n))).otherwise(F.array().cast("array<int>"))


def chunks(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with `chunks`: first and last line (from 1), hash, and the hashes of the lines of the chunk before
    (nearest first) and after. Chunks of blank lines alone are left out."""
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("all", lines(F.col("text")))
    rows = rows.withColumns(
        {
            "hashes": F.transform("all", lambda x: F.xxhash64(x)),
            "rolls": F.transform("all", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")),
        }
    )
    rows = rows.withColumn("cuts", cuts("rolls"))

    def chunk(first: Column, k: Column) -> Column:
        last, start, end = F.get("cuts", k + 1), F.get("cuts", k - 1), F.get("cuts", k + 2)
        before = F.when(k > 0, F.reverse(F.slice("hashes", F.greatest(start, F.lit(1)), first - start))).otherwise(none)
        after = F.when(end.isNotNull(), F.slice("hashes", last + 1, end - last)).otherwise(none)
        size = last - first + 1
        return F.struct(first.alias("first"), last.alias("last"), F.xxhash64(F.slice("hashes", first, size)).alias("hash"), F.exists(F.slice("all", first, size), lambda x: x.rlike(SOLID)).alias("solid"), before.alias("before"), after.alias("after"))

    inner = F.transform(F.slice("cuts", 1, F.greatest(F.size("cuts") - 1, F.lit(0))), chunk)
    return rows.withColumn("chunks", F.filter(inner, lambda c: c["solid"])).drop("all", "hashes", "rolls", "cuts")


def alike(a: str, b: str) -> Column:
    """How many elements two arrays have in common at their beginning."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(a, i) != F.get(b, i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), n))


def runs(found: DataFrame) -> DataFrame:
    """found (doc_id, key, first, last, keeper id, key and first line, lines alike before and after) to runs of chunks that
    follow each other in one keeper: first, last (of their chunks), begin, end (extended), shift to the keeper's lines,
    and whether they go, or stay as they are."""
    row = Window.partitionBy("key", "doc_id").orderBy("first")
    same = F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_key") == F.col("key")) & (F.col("k_first") == F.col("first"))
    found = found.withColumns({"shift": F.col("k_first") - F.col("first"), "kept": same})
    found = found.withColumns({"prev": F.lag(F.struct("last", "k_id", "k_key", "shift")).over(row), "next_first": F.lead("first").over(row)})
    beside = F.coalesce(F.col("prev.last") == F.col("first"), F.lit(False))
    goes_on = beside & F.col("prev.k_id").eqNullSafe(F.col("k_id")) & (F.col("prev.k_key") == F.col("k_key")) & (F.col("prev.shift") == F.col("shift"))
    # extended only over chunks that stand in no other place: others have runs of their own
    found = found.withColumns(
        {
            "opens": F.when(goes_on, 0).otherwise(1),
            "more_before": F.when(F.col("kept") | beside, 0).otherwise(F.col("more_before")),
            "more_after": F.when(F.col("kept") | F.coalesce(F.col("next_first") == F.col("last"), F.lit(False)), 0).otherwise(F.col("more_after")),
        }
    )
    found = found.withColumn("run", F.sum("opens").over(row))
    out = found.groupBy("key", "doc_id", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("more_before").alias("more_before"), F.sum("more_after").alias("more_after"),
        F.first("k_id").alias("k_id"), F.first("k_key").alias("k_key"), F.first("shift").alias("shift"), F.first("kept").alias("kept"),
    )
    out = out.withColumns({"begin": (F.col("first") - F.col("more_before")).cast("int"), "end": (F.col("last") + F.col("more_after")).cast("int")}).drop("run", "more_before", "more_after")
    out = out.withColumn("size", F.col("end") - F.col("begin") + 1)
    # lines of two runs are the longer one's, of equal ones the first one's; a run with one line of its own stays whole
    order = Window.partitionBy("key", "doc_id").orderBy("begin", "end")
    out = out.withColumns({"prev": F.lag(F.struct("end", "size")).over(order), "next": F.lead(F.struct("begin", "size")).over(order)})
    lost = F.when(F.col("prev.size") >= F.col("size"), F.greatest(F.col("prev.end") - F.col("begin") + 1, F.lit(0))).otherwise(0)
    lost += F.when(F.col("next.size") > F.col("size"), F.greatest(F.col("end") - F.col("next.begin") + 1, F.lit(0))).otherwise(0)
    own = F.col("size") - lost
    out = out.withColumns({"goes": ~F.col("kept") & (own >= LEAST_LINES), "stays": F.col("kept") | (own.between(1, LEAST_LINES - 1))})
    return out.drop("prev", "next", "size", "kept")


def fits(often: DataFrame) -> bool:
    """Whether first places are few and small enough for the driver and every executor to hold: about 100 bytes, and 8 a hash."""
    hashes = F.size("keeper.before") + F.size("keeper.after")
    n, size = often.agg(F.count("*"), F.coalesce(F.sum(100 + 8 * hashes), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, ...) without the runs of repeated chunks of lines that stand in an earlier place.

    Returns doc_id, n_lines, removed_chunks (blocks of neighbouring lines that went), removed_lines, clean_text. Places are
    ordered by doc_id (null last), then by a hash of the row, then by line. The lines of a chunk's first place stay, and so
    does a single line between such, so that whatever goes is two lines or more. Rows alike in id and text are one place
    and get the same result. Null texts count as empty; an empty text is one empty line. Runs whose hashes agree but whose
    bytes do not stay, and so do chunks of blank lines alone. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    # outer, lest the optimizer tests each array before it is exploded by working all of it out once more
    cut = chunks(rows).select("doc_id", "key", F.explode_outer("chunks").alias("chunk")).where("chunk is not null").select("doc_id", "key", "chunk.first", "chunk.last", "chunk.hash", "chunk.before", "chunk.after")
    cut = written(cut, "chunks")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "key", "first")
    often = cut.groupBy("hash").agg(F.min(F.struct(place.alias("place"), F.col("before"), F.col("after"))).alias("keeper"), F.max(place).alias("other"))
    often = written(often.where(F.col("keeper.place") != F.col("other")).drop("other"), "often")
    found = lookup(cut, often, "hash", F.col("key"), fits=fits(often)).withColumns({"k_before": F.col("keeper.before"), "k_after": F.col("keeper.after")})
    found = found.select(
        "doc_id", "key", "first", "last", F.nullif(F.col("keeper.place.id"), F.lit(LAST_ID)).alias("k_id"), F.col("keeper.place.key").alias("k_key"), F.col("keeper.place.first").alias("k_first"),
        alike("before", "k_before").alias("more_before"), alike("after", "k_after").alias("more_after"),
    )
    found = written(runs(found.dropDuplicates(["doc_id", "key", "first"])), "runs")
    few = found.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS

    def beside(asked: DataFrame) -> DataFrame:
        """rows with the structs that asked (doc_id, key, one) has for them. Unless they are few, joined by the same keys, so
        that the texts are dealt out once for both uses."""
        by_row = asked.groupBy(F.col("key").alias("__key"), F.col("doc_id").alias("__id")).agg(F.collect_list("one").alias("asked"))
        return rows.join(sized(by_row, few), (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__key", "__id")

    # the bytes of every run, there and in the place that keeps it; equal bytes meet in the map tasks first
    held = F.struct("k_id", "k_key", (F.col("begin") + F.col("shift")).alias("begin"), (F.col("end") + F.col("shift")).alias("end"))
    goers = found.where("goes").withColumn("held", held)
    there = goers.select("held").distinct().select(F.col("held.k_id").alias("doc_id"), F.col("held.k_key").alias("key"), F.struct("held.begin", "held.end", "held").alias("one"))
    asked = beside(goers.select("doc_id", "key", F.struct("begin", "end", "held").alias("one")).union(there)).where("asked is not null")
    piece = F.concat_ws("\n", F.slice(lines(F.col("text")), F.col("one.begin"), F.col("one.end") - F.col("one.begin") + 1))
    bytes_of = asked.select("text", F.explode_outer("asked").alias("one")).select(F.col("one.held").alias("held"), piece.alias("piece"))
    unequal = written(bytes_of.distinct().groupBy("held").agg(F.count("*").alias("n")).where("n > 1").select("held"), "unequal")
    goers = lookup(goers, unequal, "held", F.col("key"), how="left_anti")

    spans = goers.select("doc_id", "key", F.struct("begin", "end", F.lit(True).alias("goes")).alias("one"))
    spans = spans.union(found.where("stays").select("doc_id", "key", F.struct("first", "last", F.lit(False)).alias("one")))
    out = beside(spans).withColumn("asked", F.coalesce("asked", F.array().cast("array<struct<begin:int,end:int,goes:boolean>>")))
    of = lambda goes: F.flatten(F.transform(F.filter("asked", lambda x: x["goes"] == goes), lambda x: F.sequence(x["begin"], x["end"])))
    out = out.withColumn("dead", F.array_except(of(True), of(False)))
    neighbours = F.array_union(F.transform("dead", lambda i: i - 1), F.transform("dead", lambda i: i + 1))
    out = out.withColumn("dead", F.array_intersect("dead", neighbours)).withColumn("all", lines(F.col("text")))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("all")), F.col("dead")), lambda i: F.element_at("all", i))
    clean = F.when(F.size("dead") == 0, F.col("text")).otherwise(F.concat_ws("\n", left))
    blocks = F.array_except("dead", F.transform("dead", lambda i: i + 1))
    return out.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.size(blocks).cast("long").alias("removed_chunks"), F.size("dead").cast("long").alias("removed_lines"), clean.alias("clean_text"))
