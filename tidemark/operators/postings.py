"""An index of terms: searches that read the postings of a query's terms instead of all texts.

Entries are numbered in their order. A block is a range of BLOCK_DOCS numbers; a term has one row for each block in which
it stands, with the documents as distances from the block's beginning, their counts, and the largest count. So a common
term is spread over as many rows as there are blocks, and what a block can score at best is known without its documents.

Folders of an index: `entries` (numbered), `postings` by hash bucket of the term, `terms` by first character and in order,
so that a beginning is a range, and `grams` (three characters of a term) by hash bucket, for terms that contain something.
Searches give what the scans of `retrieval` give; a test and the queries hold them to that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import col, keyword_terms, long_terms, query_terms, spaced, strings
from tidemark.operators.retrieval import DECIMALS, PRIMARY_IDF, UNKNOWN_IDF, of_speaker, shortfall, top, with_recency

#: Documents of a block, as a power of two; hash buckets of terms and of grams; tasks that write a bucket's rows.
BLOCK_BITS, BUCKETS, GRAM_BUCKETS, SPREAD = 10, 32, 16, 4
GRAM = 3
#: Blocks that a ranked search reads first, those with the highest bounds; each further round reads twice as many.
FIRST_BLOCKS = 8
OTHER = "_"
#: The tables that lie in folders by a column, which hold no file where there is no row.
SCHEMAS = {
    "postings": "term string, block long, at array<int>, tf array<int>, docs int, best int, bucket int",
    "terms": "term string, df long, best int, head string",
    "grams": "term string, gram string, bucket int",
}


def alphanumeric(c: Column | str) -> Column:
    """Terms of TF-IDF: runs of ASCII letters and digits."""
    return F.array_remove(spaced(c), "")


def underscored(c: Column | str) -> Column:
    """Words whose beginnings keyword search looks at: of ASCII letters, digits and _."""
    return F.array_remove(F.split(F.lower(col(c)), "[^a-z0-9_]+"), "")


def pieces(c: Column | str) -> Column:
    """What stands between white space, in which substring search finds its words."""
    return F.array_remove(F.split(F.lower(col(c)), r"\s+"), "")


@dataclass
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def postings(self, terms: DataFrame | list[str]) -> DataFrame:
        """The rows of some terms: only their buckets are read. Terms in a table are joined, and prune as they run."""
        rows = self.table("postings")
        if isinstance(terms, list):
            buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket("term", BUCKETS)).collect()}) if terms else []
            return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return rows.join(terms.select("term", bucket("term", BUCKETS).alias("bucket")).distinct(), ["bucket", "term"], "left_semi")

    def documents(self) -> int:
        return self.table("entries").count()  # from the files' footers


def bucket(c: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def head(term: Column | str) -> Column:
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise(OTHER)


def build(entries: DataFrame, path: str, tokens: Callable[[str], Column] = alphanumeric) -> Index:
    """Write the index of entries (id, ord, content, ...) whose terms `tokens` makes of the text. Null texts have none."""
    spark = entries.sparkSession
    index = Index(spark, path)
    # numbers go up with ord: the range's number, then the place in it; written once, so that they hold
    dealt = entries.repartitionByRange(spark.sparkContext.defaultParallelism, "ord").sortWithinPartitions("ord")
    dealt.withColumn("n", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/entries")
    rows = index.table("entries").select("n", F.explode_outer(tokens("content")).alias("term")).where("term is not null")  # outer, lest tokens are made twice
    counts = rows.groupBy("term", "n").agg(F.count("*").cast("int").alias("tf"))
    start = F.shiftleft(F.col("block"), BLOCK_BITS)
    one = F.struct((F.col("n") - start).cast("int").alias("at"), "tf")
    blocks = counts.withColumn("block", F.shiftright("n", BLOCK_BITS)).groupBy("term", "block").agg(F.array_sort(F.collect_list(one)).alias("docs"), F.max("tf").alias("best"))
    blocks = blocks.select("term", "block", F.transform("docs", lambda d: d["at"]).alias("at"), F.transform("docs", lambda d: d["tf"]).alias("tf"), F.size("docs").alias("docs"), "best", bucket("term", BUCKETS).alias("bucket"))
    # a bucket's rows go to several tasks, as one term may have most of them
    dealt = blocks.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms = index.table("postings").groupBy("term").agg(F.sum("docs").alias("df"), F.max("best").alias("best"))
    terms.withColumn("head", head("term")).repartition("head").sortWithinPartitions("head", "term").write.mode("overwrite").partitionBy("head").parquet(f"{path}/terms")
    at = F.sequence(F.lit(1), F.length("term") - GRAM + 1)
    grams = index.table("terms").where(F.length("term") >= GRAM).select("term", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr("term", i, F.lit(GRAM))))).alias("gram"))
    grams = grams.withColumn("bucket", bucket("gram", GRAM_BUCKETS))
    grams.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    return index


def known(index: Index, terms: list[str]) -> dict[str, int]:
    """Documents that hold each term, where any does; only their folders and ranges are read."""
    if not terms:
        return {}
    heads = sorted({t[0] if t[:1].isascii() and t[:1].isalnum() else OTHER for t in terms})
    return {r["term"]: r["df"] for r in index.table("terms").where(F.col("head").isin(heads) & F.col("term").isin(terms)).select("term", "df").collect()}


def beginning(index: Index, prefix: str) -> DataFrame:
    """(term, df) of the terms that begin so: a range of one folder."""
    rows = index.table("terms")
    if not prefix:
        return rows.select("term", "df")
    first = prefix[0] if prefix[0].isascii() and prefix[0].isalnum() else OTHER
    return rows.where((F.col("head") == first) & (F.col("term") >= prefix) & F.col("term").startswith(prefix)).select("term", "df")


def containing(index: Index, text: str) -> DataFrame:
    """(term) of the terms that contain a text: they hold all of its grams, of which one bucket each is read."""
    if len(text) < GRAM:
        return index.table("terms").where(F.contains("term", F.lit(text))).select("term")
    grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    spark = index.spark
    buckets = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket("gram", GRAM_BUCKETS)).collect()})
    rows = index.table("grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams) & F.contains("term", F.lit(text)))
    return rows.select("term").distinct()


def exploded(postings: DataFrame) -> DataFrame:
    """(n, term, tf) of rows of postings."""
    one = F.explode(F.arrays_zip("at", "tf")).alias("one")
    return postings.select("term", "block", one).select((F.shiftleft(F.col("block"), BLOCK_BITS) + F.col("one.at")).alias("n"), "term", F.col("one.tf").alias("tf"))


@dataclass
class Ranked:
    """A ranked search's hits, and how much of what it had to look at it read."""

    hits: DataFrame
    blocks: int
    read: int


def contribution(tf: Column, weight: Column) -> Column:
    return F.when(tf > 0, (1 + F.ln(tf.cast("double"))) * weight).otherwise(0.0)


def tfidf_search(index: Index, query: str, k: int = 30, dates: DataFrame | None = None, as_of: Column | None = None, speaker: str | None = None) -> Ranked:
    """`retrieval.tfidf_search` from an index of alphanumeric terms, whose document frequencies are its IDF table.

    Blocks are read from the highest bound on: once k hits are known, blocks that cannot beat the last of them are left out.
    The distance that a bound allows holds for any date, as dates only add to it.
    """
    terms = query_terms(query)
    df, n = known(index, terms), index.documents()
    rows = index.table("entries")
    # as in the IDF table: terms of 3 to 29 characters that two documents hold
    weights = {t: log(n / df[t]) if df.get(t, 0) >= 2 and 2 < len(t) < 30 else UNKNOWN_IDF for t in terms}
    present = [t for t in terms if t in df]
    primary = [t for t in terms if weights[t] > PRIMARY_IDF]
    most = sum(3 * w for w in weights.values()) or 1.0
    factor = 1.5 if len(primary) > 1 else 1.0
    empty = with_recency(rows.limit(0).withColumns({"score": F.lit(0.0), "raw_distance": F.lit(0.0)}).drop("n"), dates, as_of)
    if not present:
        return Ranked(top(empty, k), 0, 0)
    postings = index.postings(present)
    weight = F.element_at(F.create_map(*[x for t in present for x in (F.lit(t), F.lit(weights[t]))]), F.col("term"))
    # what each block can score at best, without its documents: as many rows as blocks, in order of their bounds. A bound is
    # a decimal less, as it is summed in another order than scores are
    bounds = postings.groupBy("block").agg((F.sum(contribution(F.col("best"), weight)) * factor).alias("bound"))
    bounds = bounds.select("block", F.greatest(F.lit(0.0), shortfall("bound", most) - 10.0**-DECIMALS).alias("least"))
    blocks, gate = bounds.count(), None
    if primary:
        # documents with a rare term as a word, or as a part of one: blocks without any are not looked at
        inside = reduce(DataFrame.union, [containing(index, t) for t in primary]).distinct()
        gate = exploded(index.postings(inside)).select("n").distinct().persist()
        bounds = bounds.join(gate.select(F.shiftright("n", BLOCK_BITS).alias("block")).distinct(), "block", "left_semi")
    bounds = bounds.persist()
    # blocks in order of their bounds, equal ones in the documents' order: what is equal and behind the last hit loses
    place = F.struct("least", "block")
    at = lambda x: F.struct(F.lit(float(x[0])).alias("least"), F.lit(x[1]).cast("long").alias("block"))
    found, read, last, size = None, 0, None, FIRST_BLOCKS
    try:
        while True:
            left = bounds if last is None else bounds.where(place > at(last))
            ahead = left.orderBy("least", "block").limit(size).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).first()
            if not ahead["n"]:
                break
            if found is not None and found.num_rows == k and tuple(ahead["first"]) > (found.column("distance")[-1].as_py(), found.column("n")[-1].as_py() >> BLOCK_BITS):
                break
            last = tuple(ahead["last"])
            part = left.where(place <= at(last)).select("block")
            hits = scored(exploded(postings.join(part, "block", "left_semi")), present, weights, primary, most)
            if gate is not None:
                hits = hits.join(gate, "n", "left_semi")
            full = with_recency(of_speaker(rows.join(hits, "n"), speaker), dates, as_of)
            if found is not None:
                full = full.unionByName(index.spark.createDataFrame(found, full.schema))
            found, kind = top(full, k).toArrow(), full.schema  # k rows
            read, size = read + ahead["n"], 2 * size
        return Ranked(top(empty, k) if found is None else index.spark.createDataFrame(found, kind).drop("n"), blocks, read)
    finally:
        bounds.unpersist()
        if gate is not None:
            gate.unpersist()


def scored(postings: DataFrame, terms: list[str], weights: dict[str, float], primary: list[str], most: float) -> DataFrame:
    """(n, score, raw_distance) of documents from (n, term, tf), terms summed in the query's order."""
    of = postings.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"))
    counts = F.array(*[F.coalesce(F.element_at("tfs", F.lit(t)), F.lit(0)) for t in terms])
    parts = F.zip_with(counts, F.array(*[F.lit(weights[t]) for t in terms]), contribution)
    score = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    if len(primary) > 1:
        matched = F.size(F.filter(F.map_keys("tfs"), lambda t: F.array_contains(strings(primary), t)))
        score = score * (1 + F.lit(0.5) * matched / len(primary))
    rows = of.select("n", score.alias("score")).where("score > 0")
    return rows.withColumn("raw_distance", shortfall("score", most))


def keyword_search(index: Index, query: str, k: int = 20, topic: str | None = None, speaker: str | None = None) -> DataFrame:
    """`retrieval.keyword_search` from an index of underscored words: each term's words are a range of the dictionary."""
    rows, terms = index.table("entries"), keyword_terms(query)
    if not terms:
        return rows.limit(0).withColumn("score", F.lit(0.0)).drop("n")
    # a term that is given twice counts twice, and so does a word that begins with two terms
    words = reduce(DataFrame.union, [beginning(index, t).select("term") for t in terms]).groupBy("term").agg(F.count("*").alias("times"))
    found = exploded(index.postings(words)).join(words, "term")
    scores = found.groupBy("n").agg(F.sum(F.col("tf") * F.col("times")).cast("double").alias("score"))
    rows = rows.join(scores, "n").drop("n")
    score = F.col("score")
    if topic is not None:
        score = F.when(F.array_contains("topics", topic), score * 1.5).otherwise(score)
    if speaker is not None:
        score = F.when(F.array_contains("speakers", speaker), score * 2).otherwise(score)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "ord").limit(k)


def substring_search(index: Index, query: str, k: int = 30) -> DataFrame:
    """`retrieval.substring_search` from an index of pieces: what contains a word of the query goes through its grams."""
    rows, terms = index.table("entries"), long_terms(query, 3)
    if not terms:
        return rows.limit(0).withColumn("score", F.lit(0)).drop("n")
    each = [containing(index, t).withColumn("word", F.lit(i)) for i, t in enumerate(terms)]
    found = reduce(DataFrame.union, each)
    hits = exploded(index.postings(found)).join(found, "term").groupBy("n").agg(F.count_distinct("word").cast("int").alias("score"))
    return rows.join(hits, "n").drop("n").orderBy(F.desc("score"), "ord").limit(k)
