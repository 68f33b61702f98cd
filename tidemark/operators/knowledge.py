"""Document frequencies, topic counts, speaker profiles and title-to-date matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import cut, tokens_idf, tokens_title
from tidemark.operators.joins import once, with_lookup

#: Tokens and bytes of a feed's titles that may go to all tasks, and characters by which contained words are looked for.
FEED_TOKENS, FEED_BYTES, GRAM = 1_000_000, 16 << 20, 5
#: Titles that a task looks at together, numbers that it counts at once, and pieces of titles that it keeps, up to their length.
TITLES, COUNTS, KNOWN_PIECES, LONGEST_KNOWN = 1_000, 2_000_000, 200_000, 64


def entries(chunks: DataFrame) -> DataFrame:
    """Enriched long chunks as knowledge entries, in a fixed order."""
    order = F.struct("video_id", "chunk_index")
    return chunks.select("id", order.alias("ord"), F.col("text").alias("content"), "video_id", "start_time", "end_time", "start_ms", "topics", "speakers", "word_count", "url")


def idf(docs: DataFrame, text: str = "content", least: int = 2) -> DataFrame:
    """(term, df, idf): ln of documents by documents that hold the term, for terms in `least` documents or more."""
    n = docs.count()
    terms = docs.select(F.explode(tokens_idf(text)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least).withColumn("idf", F.ln(F.lit(float(max(n, 1))) / F.col("df")))


def term_extremes(table: DataFrame, n: int) -> DataFrame:
    """The rarest and the commonest terms, n of each."""
    rare = table.orderBy(F.desc("idf"), "term").limit(n).withColumn("end", F.lit("rare"))
    return rare.union(table.orderBy("idf", "term").limit(n).withColumn("end", F.lit("common")))


def topic_distribution(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("entries"))


def speaker_stats(docs: DataFrame, speakers: list[str]) -> DataFrame:
    """(speaker, total_mentions, episodes) for every speaker of the dictionary, those never mentioned with zeros."""
    seen = docs.select(F.explode("speakers").alias("speaker"), "video_id").groupBy("speaker").agg(F.count("*").alias("m"), F.count_distinct("video_id").alias("e"))
    dims = docs.sparkSession.createDataFrame([(s,) for s in speakers], "speaker string")
    return dims.join(seen, "speaker", "left").select("speaker", F.coalesce("m", F.lit(0)).cast("long").alias("total_mentions"), F.coalesce("e", F.lit(0)).cast("long").alias("episodes"))


def speaker_topics(docs: DataFrame) -> DataFrame:
    """(speaker, topic, n, first_ord): how often they stand in one document, and where that is first seen."""
    pairs = docs.select("ord", F.explode("speakers").alias("speaker"), "topics").select("ord", "speaker", F.posexplode("topics").alias("k", "topic"))
    return pairs.groupBy("speaker", "topic").agg(F.count("*").alias("n"), F.min(F.struct("ord", "k")).alias("first_ord"))


def top_topics(docs: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("speaker").orderBy(F.desc("n"), "first_ord")
    return speaker_topics(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("speaker", "rank", "topic", "n")


def sample_quotes(docs: DataFrame, n: int = 50, words: int = 20, chars: int = 300) -> DataFrame:
    """The first quotes of each speaker in corpus order, of texts of more than `words` words."""
    rows = docs.where(F.col("word_count") > words).select("ord", "video_id", cut("content", chars).alias("quote"), F.explode("speakers").alias("speaker"))
    order = Window.partitionBy("speaker").orderBy("ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("speaker", "rank", "video_id", "quote")


def profiles(docs: DataFrame, speakers: list[str], quotes: int = 50) -> DataFrame:
    """One row for each speaker: counts, topic counts as a map, top topics and quotes in order."""
    counts = speaker_topics(docs).groupBy("speaker").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("topic_counts"))
    top = top_topics(docs).groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("rank", "topic", "n"))).alias("top_topics"))
    said = sample_quotes(docs, quotes).groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("rank", "video_id", "quote"))).alias("sample_quotes"))
    return speaker_stats(docs, speakers).join(counts, "speaker", "left").join(top, "speaker", "left").join(said, "speaker", "left")


def title_tokens(titles: DataFrame, *kept: str) -> DataFrame:
    return titles.select(*kept, tokens_title("title").alias("tokens")).where(F.size("tokens") > 0)


def few_tokens(feed: DataFrame, tokens: str) -> bool:
    """Whether a feed's tokens are at most FEED_TOKENS, of FEED_BYTES."""
    size = feed.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.aggregate(tokens, F.lit(0), lambda n, t: n + F.octet_length(t))), F.lit(0)).alias("bytes")).first()
    return size["tokens"] <= FEED_TOKENS and size["bytes"] <= FEED_BYTES


def matched_in_tasks(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """The best of b (item_ord, tokens) for each of a (video_id, tokens). The lists of the items that hold each token go to
    all tasks, which count a title's lists."""
    items = b.select("item_ord", "tokens").orderBy("item_ord").toArrow()
    ords, tokens = items.column("item_ord").combine_chunks(), items.column("tokens").combine_chunks()
    sizes = np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    lists = np.split(np.repeat(np.arange(len(sizes)), sizes)[order], np.flatnonzero(np.diff(coded.indices.to_numpy()[order])) + 1)
    index = a.sparkSession.sparkContext.broadcast((dict(zip(coded.dictionary.to_pylist(), lists, strict=True)), sizes))
    schema = a.select("video_id").schema.add(b.schema["item_ord"]).add("score", "double")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = index.value
        for batch in batches:
            at, item, score = [], [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                found = [x for t in own if (x := held.get(t)) is not None]
                if found:
                    shared = np.bincount(np.concatenate(found), minlength=len(sizes))
                    near = shared / (len(own) + sizes - shared)
                    j = int(near.argmax())  # the first of equals
                    if near[j] >= least:
                        at.append(i)
                        item.append(j)
                        score.append(float(near[j]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ords.take(pa.array(item, pa.int64())), pa.array(score, pa.float64())], names=["video_id", "item_ord", "score"])

    return a.select("video_id", "tokens").mapInArrow(best, schema)


def matched_by_join(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """The same through one join of tokens: how often a pair meets is what it shares."""
    left = a.select("video_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    right = b.select("item_ord", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    sizes = (F.col("n") >= least * F.col("m") - 1e-9) & (F.col("m") >= least * F.col("n") - 1e-9)
    shared = left.join(right, "token").where(sizes).groupBy("video_id", "item_ord", "n", "m").agg(F.count("*").alias("shared"))
    scored = shared.select("video_id", "item_ord", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("video_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "item_ord")).alias("b"))
    return best.select("video_id", F.col("b.item_ord").alias("item_ord"), (-F.col("b.minus")).alias("score"))


def best_title_matches(catalogue: DataFrame, feed: DataFrame, least: float = 0.2) -> DataFrame:
    """catalogue (video_id, title) by feed (item_ord, title, date): the most similar feed title, the first of equals.

    A feed whose tokens were counted to be at most FEED_TOKENS, of FEED_BYTES, goes to all tasks; a larger one is joined.
    """
    a, b = title_tokens(catalogue, "video_id"), title_tokens(feed, "item_ord", "date")
    way = matched_in_tasks if few_tokens(b, "tokens") else matched_by_join
    return with_lookup(way(a, b, least), b.select("item_ord", "date"), "item_ord")


def spread(which: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the elements of the lists `which`, one list after another, where list i is size[i] elements from start[i] on."""
    n = size[which]
    return np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def contained_in_tasks(catalogue: DataFrame, words: DataFrame) -> DataFrame:
    """The first of words (item_ord, words) for each row of catalogue (video_id, low) that contains enough of them.

    Words go to all tasks. They have no white space in them, so that they are parts of a title's pieces between white space:
    each different piece is looked through once, and a title's items are counted.
    """
    items = words.orderBy("item_ord").toArrow()
    ords, lists = items.column("item_ord").combine_chunks(), items.column("words").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    item_of = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(code, kind="stable")]
    often = np.bincount(code, minlength=len(coded.dictionary))
    beginnings: dict[str, list] = {}
    for k, w in enumerate(coded.dictionary.to_pylist()):
        beginnings.setdefault(w[:GRAM], []).append((w, k))
    index = catalogue.sparkSession.sparkContext.broadcast((beginnings, item_of, np.cumsum(often) - often, often, sizes))
    schema = catalogue.select("video_id").schema.add(words.schema["item_ord"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beginnings, item_of, start, often, sizes = index.value
        known: dict[str, list[int]] = {}
        if not len(sizes):
            return

        def inside(piece: str) -> list[int]:
            found = known.get(piece)
            if found is None:
                found = sorted({k for i in range(len(piece) - GRAM + 1) for w, k in beginnings.get(piece[i : i + GRAM], ()) if piece.startswith(w, i)})
                if len(piece) <= LONGEST_KNOWN:
                    if len(known) >= KNOWN_PIECES:
                        known.clear()
                    known[piece] = found
            return found

        for whole in batches:
            for at in range(0, whole.num_rows, TITLES):
                batch = whole.slice(at, TITLES)
                pieces = batch.column(1).flatten().dictionary_encode()
                found = [inside(p) for p in pieces.dictionary.to_pylist()]
                n = np.array([len(x) for x in found], dtype=np.int64)
                held = np.array([k for x in found for k in x], dtype=np.int64)
                row, piece = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), pieces.indices.to_numpy()
                row, piece = row[n[piece] > 0], piece[n[piece] > 0]
                # each word once a title, in order of titles
                pair = np.unique(np.repeat(row, n[piece]) * len(often) + held[spread(piece, np.cumsum(n) - n, n)])
                row, word = pair // len(often), pair % len(often)
                meets = np.cumsum(np.bincount(row, often[word], batch.num_rows))  # whole numbers
                titles, item, low = [], [], 0
                while low < batch.num_rows:
                    # as many titles as meet items COUNTS times, and have COUNTS numbers of hits; one at least
                    high = int(np.searchsorted(meets, (meets[low - 1] if low else 0) + COUNTS, "right"))
                    high = max(low + 1, min(high, low + COUNTS // len(sizes), batch.num_rows))
                    of = slice(*np.searchsorted(row, (low, high)))
                    cell = np.repeat(row[of] - low, often[word[of]]) * len(sizes) + item_of[spread(word[of], start, often)]
                    hits = np.bincount(cell, minlength=(high - low) * len(sizes)).reshape(high - low, len(sizes))
                    enough = (hits >= 3) & (hits / sizes > 0.4)
                    some = np.flatnonzero(enough.any(axis=1))
                    titles.append(some + low)
                    item.append(enough[some].argmax(axis=1))  # the first
                    low = high
                if titles:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(titles))), ords.take(pa.array(np.concatenate(item)))], names=["video_id", "item_ord"])

    return catalogue.select("video_id", F.split("low", r"\s+").alias("pieces")).mapInArrow(first, schema)


def contained_by_join(low: DataFrame, words: DataFrame) -> DataFrame:
    """The same, every item for each row that contains enough of it.

    A word that is contained holds its first GRAM characters where it stands, so that titles meet by these: of an item's
    words, all but as many as may be missing. What meets is compared in full.
    """
    least = F.greatest(F.lit(3), (F.floor(F.size("words") * 0.4) + 1).cast("int"))
    # the longest words first: any `least` of the words hold one of these
    order = F.transform(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    probes = words.select("item_ord", F.explode(F.slice(order, 1, F.size("words") - least + 1)).alias("probe"))
    probes = probes.select("item_ord", F.substring("probe", 1, GRAM).alias("gram")).distinct()
    # from an array of characters, as a substring of a text is looked for from the text's beginning
    spelt = low.select("video_id", F.split("low", "").alias("chars"))
    at = F.sequence(F.lit(1), F.size("chars") - GRAM + 1)
    grams = spelt.select("video_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("chars", i, GRAM), "")))).alias("gram"))
    pairs = grams.join(probes, "gram").select("video_id", "item_ord").distinct()
    both = pairs.join(low, "video_id").join(words, "item_ord")
    hit = F.size(F.filter("words", lambda w: F.contains(F.col("low"), w)))
    return once(both, hits=hit).where((F.col("hits") >= 3) & (F.col("hits") / F.size("words") > 0.4)).select("video_id", "item_ord")


def contained_titles(catalogue: DataFrame, feed: DataFrame) -> DataFrame:
    """Another way to match titles: three words or more of over four letters contained, and over 0.4 of them; the first item wins.

    A feed whose words were counted to be at most FEED_TOKENS, of FEED_BYTES, goes to all tasks; a larger one is joined.
    """
    words = feed.where("item_ord is not null").select("item_ord", F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) > 4)).alias("words")).where(F.size("words") >= 3)
    low = catalogue.select("video_id", F.lower("title").alias("low")).where(F.length("low") >= GRAM)
    way = contained_in_tasks if few_tokens(words, "words") else contained_by_join
    return way(low, words).groupBy("video_id").agg(F.min("item_ord").alias("item_ord"))


def match_summary(catalogue: DataFrame, matches: DataFrame) -> DataFrame:
    n = F.count("*")
    rows = catalogue.select("video_id").join(matches, "video_id", "left")
    return rows.agg(F.count_if(F.col("score").isNotNull()).alias("matched"), (n - F.count_if(F.col("score").isNotNull())).alias("unmatched"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def kb_manifest(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("total_entries"), F.count_distinct("video_id").alias("videos"), F.sum("word_count").alias("words"))
