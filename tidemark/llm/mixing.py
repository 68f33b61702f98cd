"""Mixing sources to target weights: repetition rates by source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, free_name, lookup, ranked, written

WEIGHTS = (5, 2, 1)


#: Seeds that are tried for each source.
DRAWS = 32


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def draw(seed: int | Column, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    key = F.concat_ws(":", seed, *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): `share` of all sizes dealt by weight, none above `most` times its own.

    Sources in code-point order, null last, take the weights in turn. The level at which shares stop rising is found
    by rounds over the table of sources; the driver gets sums only.
    """
    order = [F.col("source").asc_nulls_last()]
    table = written(ranked(sizes, order, "k").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("k", F.lit(len(weights))) + 1).cast("int"))), "sources", 0)
    cap = F.col("source_size") * F.lit(float(most))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    goal = share * float(total["s"])
    level, held = (goal / total["w"] if total["w"] else 0.0), -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        r = table.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("c"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if r["n"] == held or not r["w"]:
            break
        held, level = r["n"], (goal - r["c"]) / r["w"]
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def rated(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of the mix under names that docs does not have, and those names."""
    new = {x: free_name(f"__{x}", docs) for x in ("size", "source_size", "target", "rate", "draw", "copies")}
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    # two aggregations over what one pass over the texts has counted; a lost part of it is counted again
    light = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), words.alias("size")).persist(StorageLevel.MEMORY_AND_DISK)
    table = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    table = written(table.withColumn("rate", rate), "mix-rates", 0)
    # what each draw would take of a source beyond whole copies; the draw that ends nearest to the target is the one
    part = lookup(light, table, "source", F.xxhash64("doc_id", "size"))
    extra = lambda k: draw(seed + k, F.col("doc_id"), F.col("size")) < F.col("rate") - F.floor("rate")
    sums = part.groupBy("source").agg(F.array(*[F.coalesce(F.sum(F.when(extra(k), F.col("size"))), F.lit(0)) for k in range(DRAWS)]).alias("sums"))
    best = sums.join(table.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    off = F.transform("sums", lambda x, k: F.struct(F.abs(F.floor("rate") * F.col("source_size") + x - F.col("target")).alias("off"), (k + F.lit(seed)).alias("draw")))
    best = written(best.select("source", *[F.col(x).alias(new[x]) for x in ("source_size", "target", "rate")], F.array_min(off)["draw"].alias(new["draw"])), "mix-draws", 0)
    light.unpersist()
    out = lookup(docs.withColumn(new["size"], words), best, "source", F.xxhash64("doc_id", new["size"]), how="left")
    rate = F.col(new["rate"])
    more = draw(F.col(new["draw"]), F.col("doc_id"), F.col(new["size"])) < rate - F.floor(rate)
    return out.withColumn(new["copies"], F.floor(rate).cast("int") + more.cast("int")), new


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Every row of docs with size (words), source_size, target and copies (how often the mix takes it).

    A source's rate is target over size. Each row is taken floor(rate) times, and once more if a number drawn from its
    id, size and a seed is below the fraction. Of DRAWS seeds from `seed` on, a source has the one with which its taken
    words come nearest to its target; one grouped aggregation tries them all. Null texts have size 0; null sources are one
    source, the last; rows alike draw alike; a source without words has the rate 0; an empty table stays empty. Other
    columns pass through, but for those named like the new ones, which are replaced.
    """
    out, new = rated(docs, weights, share, most, seed)
    names = ("size", "source_size", "target", "copies")
    return out.drop(*names).select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in names], *[F.col(new[x]).alias(x) for x in names])


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its own columns, whatever their names."""
    out, new = rated(docs, weights, share, most, seed)
    each = free_name("__each", out)
    many = out.where(F.col(new["copies"]) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(new["copies"]))))
    return many.select(*[F.col(quoted(c)) for c in docs.columns])
