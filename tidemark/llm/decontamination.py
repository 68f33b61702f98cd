"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of templates are
hash-joined, and the slots of a document's windows of an item must be consistent, all of them together.

A run of capitalised words, such as a name of several words, is one placeholder, so that places in a template do not
depend on the length of names; cardinal words are numbers. Both sides are read with names and without; in a text that has
no capitalised word, whatever is no word of the benchmark counts as a name. Everything runs in DataFrame functions. One
pass over the texts, for windows of all lengths, picks the runs that a filter of the benchmark's outlines lets through;
these few are joined by hash. A benchmark of more than BLOCK_WINDOWS windows is gone through block by block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import lookup, without, written

#: Tokens of a window. An item of fewer tokens is one window of all of them.
WINDOW = 8
#: A window of fewer tokens beside placeholders is too general for a template: it is joined by its tokens, values included.
LEAST_WORDS = 3
#: Benchmark windows that one pass over the texts looks for, and the most bits of their filter.
BLOCK_WINDOWS, FILTER_BITS = 1_000_000, 24

#: The units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros usd eur degree degrees mph kmh kph watt watts volt volts byte bytes kb mb gb tb"
).split()

#: The cardinal words that count as numbers.
CARDINALS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

NUMBER, NAME, UNIT, JOIN, BREAK = "\u0001", "\u0002", "\u0003", "\u0006", "\u0007"
MARKS = "\u0001\u0002\u0003\u0004\u0006\u0007"
#: Placeholders sort before this, words after.
FIRST_WORD = "\u0005"

#: Code points of scripts that are written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han); each of
#: their characters is a token.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"


def low(text: Column, openers: bool = True) -> Column:
    """A text in lower case with NAME before each capitalised word, the words of a run joined by JOIN. Without `openers`,
    words that begin a sentence (before which stands no word or comma) are none."""
    # patterns test a character before they look behind, and repeat no groups: Java's matcher recurses into those
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{MARKS}]", " ")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}[\p{L}'’]*)", NAME + "$1")
    if not openers:
        t = F.regexp_replace(t, rf"{NAME}(?<![\p{{L}}\p{{N}},;] {NAME})", "")
    t = F.lower(F.regexp_replace(t, rf"{NAME}(\p{{L}}+)\s+(?={NAME})", f"{NAME}$1{JOIN}"))
    return F.when(t.rlike(f"[{UNSPACED}]"), F.regexp_replace(t, f"([{UNSPACED}])", " $1 ")).otherwise(t)


def numbered(low: str) -> Column:
    """Numbers (runs of digits, inner points and commas) and the units right after them with their marks."""
    n = F.regexp_replace(low, r"(?=\d)(?<![\p{L}\p{N}])(\d[\d.,]*)", f" {NUMBER}$1 ")
    n = F.regexp_replace(n, rf"({NUMBER}[\d.,]+\s+){NAME}?({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    n = F.regexp_replace(n, r"[.,](?:(?<!\d[.,])|(?!\d))", " ")
    return F.when(F.col(low).rlike(r"\p{N}"), n).otherwise(F.col(low))


def split(text: Column) -> Column:
    n, w = (F.array_remove(F.split(text, rf"[^{x}{MARKS}]+"), "") for x in (r"\p{L}\p{N}.,", r"\p{L}"))
    return F.when(text.rlike(r"\p{N}"), n).otherwise(w)


def tokenised(df: DataFrame, known: Callable[[Column], Column] | None = None, openers: bool = True) -> DataFrame:
    """df with two readings of its column text: `names`, where a run of capitalised words is one name, and `words`, where
    all of them are words. Placeholders have the mark of their type in front.

    Where a text has no capitalised word and `known` is given, runs of words that are not known, up to a mark of
    punctuation, are its names.
    """
    df = df.withColumn("low", low(F.col("text"), openers))
    if known is not None:
        broken = F.regexp_replace("low", r"(?=[^\p{L}\p{N}\s'’-])(?:(?<!\d)[.,]|[.,](?!\d)|[^\p{L}\p{N}\s.,'’-])", f" {BREAK} ")
        df = df.withColumn("broken", F.when(~F.contains("low", F.lit(NAME)), broken))
        df = df.withColumn("broken", F.when(F.col("broken").isNotNull(), split(numbered("broken"))))
        named = F.transform("broken", lambda t: F.when((t < FIRST_WORD) | (t >= "0") & (t < ":") | (t == BREAK) | t.isin(CARDINALS) | known(t), t).otherwise(F.concat(F.lit(NAME), t)))
        runs = F.regexp_replace(F.array_join(named, " "), rf"{NAME}(\p{{L}}+)\s+(?={NAME})", f"{NAME}$1{JOIN}")
        df = df.withColumn("broken", F.array_remove(F.array_remove(F.split(runs, " "), BREAK), ""))
    df = df.withColumn("low", numbered("low"))
    names = split(F.col("low")) if known is None else F.coalesce("broken", split(F.col("low")))
    return df.withColumns({"names": names, "words": split(F.translate("low", JOIN + NAME, " "))}).drop("low", "broken", "text")


def bare(token: Column) -> Column:
    """A token without its mark."""
    return F.when(token < FIRST_WORD, F.substring(token, 2, 1 << 20)).otherwise(token)


def placeholder(token: Column) -> Column:
    return (token < FIRST_WORD) | token.isin(CARDINALS)


def template(token: Column) -> Column:
    return F.when(token < FIRST_WORD, F.substring(token, 1, 1)).when(token.isin(CARDINALS), NUMBER).otherwise(token)


def values(window: Column) -> Column:
    return F.filter(window, placeholder)


def by_template(window: Column) -> Column:
    """Has a window enough words for its template to be joined?"""
    return F.size(F.filter(window, lambda t: ~placeholder(t))) >= LEAST_WORDS


def form(window: Column) -> Column:
    """What two windows that are joined have in common: the template, or of windows with few words the tokens."""
    return F.when(by_template(window), F.transform(window, template)).otherwise(F.transform(window, bare))


def bits_for(n: int) -> int:
    """The binary logarithm of a set's bits: some 64 for each of n members, up to FILTER_BITS."""
    return min(max((64 * n).bit_length(), 12), FILTER_BITS)


def bits_of(df: DataFrame, hashes: str, bits: int) -> Column:
    """A constant array of 2**bits bits, those of a column's hashes set: 2**(FILTER_BITS - 6) numbers come to the driver at most."""
    at = F.pmod(hashes, F.lit(1 << bits))
    words = df.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({hashes}, 64) AS int)))").alias("bits"))
    found = {r["word"]: r["bits"] for r in words.collect()}
    return F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(1 << (bits - 6)))), ",").cast("array<bigint>")


def in_bits(there: Column, bits: int, hashed: Column) -> Column:
    word = F.get(there, F.shiftright(hashed.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))) != 0


def outline(first: Column, middle: Column, last: Column) -> Column:
    """Three of a run's token hashes as one, which is cheaper to make than a hash of the whole run."""
    return first.bitwiseXOR(F.shiftleft(middle, 1)).bitwiseXOR(F.shiftleft(last, 2))


def windows(df: DataFrame, readings: list[str], sizes: list[int], there: Column, bits: int) -> DataFrame:
    """df to one row for each run of so many tokens whose outline can be in a set of bits: its other columns, reading,
    place (from 0), cut (the run), hash.

    `readings` are columns of tokens, the first the longest. Runs of fewer than LEAST_WORDS tokens are whole texts. Places
    become rows first and are tested there, within generated code; a row points to its text's arrays, which are copied for
    the few that pass only.
    """
    others = [c for c in df.columns if c not in readings]
    for r, name in enumerate(readings):
        df = df.withColumn(f"hashed_{r}", F.transform(name, lambda t: F.xxhash64(template(t))))
    # outer, lest the optimizer tests each array before it is exploded by working it out once more
    rows = df.select("*", F.posexplode_outer("hashed_0").alias("place", "first"))
    place, cases = F.col("place"), []
    for r in range(len(readings)):
        for size in sizes:
            of = outline(*[F.get(f"hashed_{r}", place + k) for k in (0, size // 2, size - 1)])
            hit = in_bits(there, bits, of)
            if size < LEAST_WORDS:
                hit = hit & (F.size(f"hashed_{r}") == size)
            cases.append((hit, F.struct(F.lit(r).alias("reading"), F.slice(readings[r], place + 1, size).alias("cut"))))
    rows = rows.where(reduce(Column.__or__, [F.coalesce(hit, F.lit(False)) for hit, _ in cases]))
    rows = rows.select(*others, "place", F.explode_outer(F.array(*[F.when(hit, found) for hit, found in cases])).alias("found")).where("found is not null")
    return rows.select(*others, "place", "found.*").withColumn("hash", F.xxhash64(F.size("cut"), form(F.col("cut"))))


def readings_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, b_reading, tokens): an item as its documents may be read, and with words that begin its sentences as words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    whole, without = tokenised(items), tokenised(items, openers=False)
    words = whole.select("item_id", F.lit(0).alias("b_reading"), F.col("words").alias("tokens")).distinct()
    names = whole.select("item_id", F.lit(1).alias("b_reading"), F.col("names").alias("tokens")).union(without.select("item_id", F.lit(2), "names"))
    names = names.groupBy("item_id", "tokens").agg(F.min("b_reading").alias("b_reading")).select("item_id", "b_reading", "tokens")
    return words.union(names).where(F.size("tokens") > 0)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(size, b_hash, outline, item_id, b_reading, b_place, b_cut) of every window of every reading of an item."""
    size, place = F.col("size"), F.col("b_place")
    rows = items.withColumns({"size": F.least(F.size("tokens"), F.lit(WINDOW)), "hashed": F.transform("tokens", lambda t: F.xxhash64(template(t)))})
    rows = rows.withColumn("b_place", F.explode(F.sequence(F.lit(0), F.size("tokens") - size)))
    of = outline(*[F.get("hashed", place + k) for k in (F.lit(0), F.floor(size / 2).cast("int"), size - 1)])
    rows = rows.select("size", "item_id", "b_reading", "b_place", of.alias("outline"), F.slice("tokens", place + 1, size).alias("b_cut"))
    return rows.withColumn("b_hash", F.xxhash64(F.size("b_cut"), form(F.col("b_cut")))).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold a window of a benchmark item, perhaps with other numbers, names and units in its slots.

    A window counts if it has the item's own values, or if all windows that stand as they do in the item, one after
    another, go from the item's values to the document's one to one; places are those of the templates. Takes docs (doc_id,
    text, ...) and benchmark (item_id, text, ...). Returns for each document and item doc_id, key (a hash of id and text,
    for rows without an id), item_id, windows (of the item, in any reading, that count) and item_windows. Null and empty
    texts hold nothing; windows of fewer than LEAST_WORDS words count with their own values only; items of fewer than
    LEAST_WORDS tokens are found in documents that have no others; rows alike give one result; an empty table on either
    side gives an empty result.
    """
    spark = docs.sparkSession
    n = benchmark.count()
    items = written(readings_of(benchmark), "bench-readings", 10 * n)
    bench = written(benchmark_windows(items), "bench-windows", 100 * n)
    sizes = {r["size"]: r["n"] for r in bench.groupBy("size").agg(F.count("*").alias("n")).collect()}  # WINDOW rows at most
    if not sizes:
        return spark.createDataFrame([], "doc_id long, key long, item_id long, windows long, item_windows long")
    # the words of the benchmark's names readings: what else stands in a text without capitals may be a name
    words = items.where("b_reading > 0").select(F.explode("tokens").alias("word")).where(F.col("word") >= FIRST_WORD).distinct()
    known_bits = bits_for(words.count())
    known = bits_of(words.select(F.xxhash64("word").alias("hash")), "hash", known_bits)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = tokenised(docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text")), lambda t: in_bits(known, known_bits, F.xxhash64(t)))
    n = sum(sizes.values())
    blocks, hits = -(-n // BLOCK_WINDOWS), []
    bits = bits_for(-(-n // blocks))
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("b_hash", "b_place", "item_id"), F.lit(blocks)) == k)
        there = bits_of(part, "outline", bits)
        runs = windows(rows, ["words", "names"], sorted(sizes), there, bits).select("doc_id", "key", "reading", "place", "cut", "hash")
        hits.append(lookup(runs, part.select(F.col("b_hash").alias("hash"), "item_id", "b_reading", "b_place", "b_cut"), "hash", F.xxhash64("key", "place")))
    # as inequalities these are no join keys, so that they are worked out for joined windows only
    one, two = form(F.col("cut")), form(F.col("b_cut"))
    pairs = F.transform(F.arrays_zip(values(F.col("b_cut")).alias("b"), values(F.col("cut")).alias("d")), lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d")))
    hit = reduce(DataFrame.union, hits).where((one <= two) & (one >= two))
    hit = hit.select("doc_id", "key", "item_id", "reading", "b_reading", (F.col("place") - F.col("b_place")).alias("shift"), "b_place", (F.transform("cut", bare) == F.transform("b_cut", bare)).alias("own"), pairs.alias("pairs")).distinct()
    # windows of one reading of an item at one place of one reading of a document: as many as the item has
    every = F.array_distinct(F.flatten(F.collect_list("pairs")))
    alike = hit.groupBy("doc_id", "key", "item_id", "reading", "b_reading", "shift").agg(every.alias("pairs"), F.collect_set("b_place").alias("all"), F.collect_set(F.when(F.col("own"), F.col("b_place"))).alias("own"))
    one_to_one = (F.size(F.array_distinct("pairs.b")) == F.size("pairs")) & (F.size(F.array_distinct("pairs.d")) == F.size("pairs"))
    # where names are words, their slots cannot be checked: such windows count with their own values only
    slots = (F.col("reading") == 1) & (F.col("b_reading") > 0)
    # of an item's readings at about one place, that with the most windows speaks
    near = Window.partitionBy("doc_id", "key", "item_id").orderBy("shift").rangeBetween(-WINDOW, WINDOW)
    alike = alike.withColumn("most", F.max(F.when(slots, F.size("all"))).over(near))
    slots = slots & (F.size("all") == F.col("most")) & one_to_one
    held = alike.select("doc_id", "key", "item_id", "b_reading", F.explode(F.when(slots, F.col("all")).otherwise(F.col("own"))).alias("b_place"))
    total = bench.groupBy("item_id").agg(F.count_distinct("b_reading", "b_place").alias("item_windows"))
    out = held.groupBy("doc_id", "key", "item_id").agg(F.count_distinct("b_reading", "b_place").alias("windows"))
    return lookup(out, written(total, "bench-items", n), "item_id", F.col("key")).select("doc_id", "key", "item_id", "windows", "item_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""
    return without(docs, contaminated(docs, benchmark).select("doc_id", "key"))
