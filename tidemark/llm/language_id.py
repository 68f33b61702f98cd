"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from byte trigrams of its letters; the model is fitted on a bounded sample
of labelled texts. It is fused with what the page declares (how often declarations agree with texts is counted over all
rows), with the country suffix of its address, and with a prior for its host: the texts' posteriors summed by host,
smoothed towards those of its domain, and these towards those of all rows. A row's own share is taken out of its prior.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, lookup, without, written

#: Labelled texts that the model is fitted on, about, in equal shares by language; the only sample here.
TRAIN_TEXTS = 2000
#: A language's share of the texts is so many at least.
LEAST_SHARE = 100
BITS = 16
PIECE = 1 << 20
#: Neighbouring trigrams overlap; so much of a trigram's evidence is counted as new.
NEW = 1 / 3
#: Pseudo-counts of the smoothing by host, of declarations, and the trust in a country suffix.
HOST_ROWS, DECLARED_ROWS, SUFFIX_TRUST = 20.0, 10.0, 0.8
UNKNOWN = "und"

#: Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "uk": "en", "us": "en", "au": "en", "ie": "en"}

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
FOLD = np.where(LETTER, np.arange(256), 32).astype(np.uint32)
FOLD[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    #: A row for each bucket of trigrams, and one of zeros; the last column is that of unknown languages, alike for all.
    table: np.ndarray


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of each trigram; those without a letter in the middle go to the row of zeros."""
    d = FOLD[data]
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    h = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    h[~LETTER[data[1:-1]]] = 1 << BITS
    return h


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, buckets of its trigrams), in pieces of bounded size that cover whole texts."""
    texts = texts.cast(pa.large_binary())
    for i, t in enumerate(texts):
        raw = t.as_buffer() if t.is_valid else b""
        data = np.frombuffer(raw or b"", np.uint8)
        for a in range(0, max(len(data) - 2, 0), PIECE):
            yield i, buckets(data[a : a + PIECE + 2])


def counted(languages: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), 1 << BITS), np.uint32)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, b in pieces(batch.column(1)):
                sums[languages.index(langs[i])] += np.bincount(b, minlength=(1 << BITS) + 1)[:-1].astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], names=["counts"])

    return count


def fit(labelled: DataFrame, texts: int = TRAIN_TEXTS) -> Model:
    """A model from labelled (doc_id, text, lang): every language that any row has, whatever the input's size.

    Labels are counted over all rows. Of each language about the same number of texts is drawn, one to two times its share
    or all it has, by a hash of id and text, so that reruns agree.
    """
    rows = labelled.where("lang is not null and lang <> '' and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    share = max(texts // max(len(languages), 1), LEAST_SHARE)
    steps = labelled.sparkSession.createDataFrame([(x, max(1, counts[x] // share)) for x in languages], "lang string, step long")
    sample = rows.join(F.broadcast(steps), "lang").where(F.pmod("draw", "step") == 0).select("lang", "text")
    total = np.zeros((len(languages), 1 << BITS))
    for r in in_arrow(sample.repartition(8), counted(languages), "counts binary").collect() if languages else []:
        total += np.frombuffer(zlib.decompress(r["counts"]), np.uint32).reshape(total.shape)
    table = np.full(((1 << BITS) + 1, len(languages) + 1), -BITS * np.log(2), np.float32)
    table[:-1, :-1] = np.log((total + 0.1) / (total.sum(axis=1, keepdims=True) + 0.1 * (1 << BITS))).T
    table[-1] = 0
    return Model(languages, table)


def scorer(model: Model, keys: int):
    """A function from (keys..., declared, host, suffix, text) to the same without text but with log likelihoods and trigrams."""
    width = len(model.languages) + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, np.int64)
            for i, b in pieces(batch.column(keys + 3)):
                uses = np.bincount(b, minlength=(1 << BITS) + 1) if len(b) > 1 << BITS else None
                sums[i] += uses @ model.table if uses is not None else model.table[b].sum(axis=0, dtype=np.float64)
                n[i] += len(b) - int((b == 1 << BITS).sum())
            logs = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * width, pa.array((sums * NEW).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: keys + 3], logs, pa.array(n)], names=[*batch.schema.names[: keys + 3], "logs", "trigrams"])

    return score


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fuser(languages: list[str], overall: np.ndarray, agree: np.ndarray, keys: int):
    """A function that adds all evidence up and names the language."""
    width = len(languages) + 1
    place = {x: i for i, x in enumerate(languages)}

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            logs, by_host, by_domain = (col(x).flatten().to_numpy().reshape(n, width) for x in ("logs", "by_host", "by_domain"))
            seen = (col("trigrams").to_numpy() > 0)[:, None]
            own = softmax(logs) * seen
            everywhere = np.maximum(overall - own, 0) + 1
            everywhere /= everywhere.sum(axis=1, keepdims=True)
            domain = np.maximum(by_domain - own, 0) + HOST_ROWS * everywhere
            domain /= domain.sum(axis=1, keepdims=True)
            host = np.maximum(by_host - own, 0) + HOST_ROWS * domain
            total = logs + np.log(host / host.sum(axis=1, keepdims=True))
            for i, (declared, suffix) in enumerate(zip(col("declared").to_pylist(), col("suffix").to_pylist(), strict=True)):
                if declared is not None:
                    total[i] += agree[place.get(declared, width - 1)]
                k = place.get(SUFFIXES.get(suffix or ""))
                if k is not None:
                    total[i] += np.log((1 - SUFFIX_TRUST) / width)
                    total[i, k] += np.log(SUFFIX_TRUST + (1 - SUFFIX_TRUST) / width) - np.log((1 - SUFFIX_TRUST) / width)
            p = softmax(total)
            best = p.argmax(axis=1)
            names = [languages[k] if k < width - 1 else UNKNOWN for k in best]
            accepted = seen[:, 0] & (best < width - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array(names), pa.array(p[np.arange(n), best]), pa.array(accepted)], names=[*batch.schema.names[:keys], "language", "probability", "accepted"])

    return fuse


def total_of(name: str, width: int) -> Column:
    return F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(width)])


def identify(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """Rows (keys..., text, declared, host, suffix) to keys, language, probability and accepted.

    A row is accepted if its text has letters and a language of the model is likelier than none of them; a text without
    letters (null and empty ones too) gets the language that its other evidence makes likeliest, and is not accepted.
    Null declarations, hosts and suffixes say nothing, and rows without a host share one prior. Declarations are compared
    by what stands before a hyphen, in lower case. Rows alike get alike answers. A model without languages accepts none.
    Extra columns are left out, and an empty table gives an empty result.
    """
    if clash := set(keys) & {"declared", "host", "suffix", "logs", "trigrams", "soft", "by_host", "by_domain", "language", "probability", "accepted"}:
        raise ValueError(f"keys with names of this operator: {clash}")
    width, k = len(model.languages) + 1, len(keys)
    declared = F.lower(F.regexp_extract("declared", r"^\s*([A-Za-z]+)", 1))
    rows = rows.select(*keys, F.when(declared != "", declared).alias("declared"), F.coalesce("host", F.lit("")).alias("host"), "suffix", "text")
    types = dict(rows.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in keys)
    scored = in_arrow(rows, scorer(model, k), f"{head}, declared string, host string, suffix string, logs array<double>, trigrams long")
    most = F.array_max("logs")
    soft = F.transform("logs", lambda x: F.exp(x - most))
    total = F.aggregate("soft", F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumn("soft", soft).withColumn("soft", F.transform("soft", lambda x: F.when(F.col("trigrams") > 0, x / total).otherwise(0.0)))
    scored = written(scored.withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)), "language-scores")
    n = scored.count()
    hosts = written(scored.groupBy("domain", "host").agg(total_of("soft", width).alias("by_host")), "hosts", n)
    domains = written(hosts.groupBy("domain").agg(total_of("by_host", width).alias("by_domain")), "domains", n)
    overall = np.array(domains.agg(total_of("by_domain", width).alias("n")).first()["n"], float)
    overall = np.nan_to_num(overall)
    # how often rows of each language declare each language: as many numbers as pairs of languages
    pairs = scored.where("declared is not null and trigrams > 0").withColumn("said", F.when(F.col("declared").isin(model.languages), F.col("declared")))
    agree = np.full((width, width), DECLARED_ROWS / width)
    for r in pairs.groupBy("said").agg(total_of("soft", width).alias("n")).collect():
        agree[model.languages.index(r["said"]) if r["said"] else width - 1] += r["n"]
    agree = np.log(agree / agree.sum(axis=0, keepdims=True))
    priors = lookup(hosts, domains, "domain", F.col("host")).select("host", "by_host", "by_domain")
    joined = lookup(scored.drop("soft", "domain"), written(priors, "host-priors", n), "host", F.xxhash64(*keys))
    out = joined.select(*keys, "declared", "suffix", "logs", "trigrams", "by_host", "by_domain")
    return in_arrow(out, fuser(model.languages, overall, agree, k), f"{head}, language string, probability double, accepted boolean")


def of_documents(docs: DataFrame) -> DataFrame:
    """documents as rows for identify: the lang column is what they declare, the source is the host."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"), F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """pages as rows for identify: text without tags, scripts and comments, the html tag's lang, host and suffix of the URL."""
    text = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([^\"'\s>]*)", 1)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("text"), F.when(declared != "", declared).alias("declared"), F.when(host != "", host).alias("host"), F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is accepted, with all their columns."""
    judged = identify(of_documents(docs), ["doc_id", "key"], fit(docs))
    return without(docs, judged.where("not accepted").select("doc_id", "key"))
