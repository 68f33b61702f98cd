"""The answer path: caches, retrieval, rerank, citations, synthesis, validation, store. Models are functions passed in.

A search is run once; from then on its hits, 31 at most, are a table in memory.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import cache_key
from tidemark.operators import ann, citations, retrieval
from tidemark.operators.cache import MemoryCache, TableCache

NOTHING = "No relevant segments were found for this query."


@dataclass
class Knowledge:
    """Tables that answers are made from; vectors carry the entries' columns that hits need."""

    entries: DataFrame
    idf: DataFrame
    dates: DataFrame
    vectors: DataFrame | None = None
    #: The folder of an index of vectors (operators.ann), asked where the exact search has no hit or no vectors.
    index: str | None = None
    #: (ord, name, role, political_alignment, current_positions, style): what overrides anything that is retrieved.
    facts: DataFrame | None = None


@dataclass
class Models:
    """embed(text) -> vector; score(query, lines) -> scores; write(query, context, facts) -> report; judge(pairs) -> verdicts by pid."""

    embed: Callable[[str], list[float]] | None = None
    score: Callable[[str, list[str]], list[float]] | None = None
    write: Callable[[str, str, str], str] | None = None
    judge: Callable[[list[dict]], dict[int, str]] | None = None


@dataclass
class Answer:
    report: str
    citations: list[dict] = field(default_factory=list)
    search_mode: str = ""
    cache_hit: bool = False
    checked: int = 0
    unsupported: int = 0
    #: "memory" or "table" where the answer was there before.
    cache_source: str = ""
    #: Segments that the answer was made from, after reranking.
    segments_found: int = 0
    #: Entries that were there to be searched, and how long the answer took to make or to find.
    total_entries: int = 0
    latency_ms: int = 0

    def payload(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def of(cls, payload: str, source: str) -> Answer:
        return replace(cls(**json.loads(payload)), cache_hit=True, cache_source=source)


def key_of(df: DataFrame, query: str, version: str, speaker: str | None, mode: str | None) -> str:
    row = df.sparkSession.range(1).select(cache_key(F.lit(query), version, F.lit(speaker), F.lit(mode)).alias("k"))
    return row.first()["k"]


def retrieved(kb: Knowledge, models: Models, query: str, as_of: Column, speaker: str | None) -> tuple[str, DataFrame]:
    """The search's label and its hits, as a table in memory."""

    def leg(who: str | None, k: int) -> tuple[str, DataFrame]:
        tiers = []
        if kb.vectors is not None and models.embed is not None:
            tiers.append(("exact", lambda: retrieval.cosine_search(kb.vectors, models.embed(query), k, kb.dates, as_of, who)))
        if kb.index is not None and models.embed is not None:
            tiers.append(("ann", lambda: ann.search(kb.entries.sparkSession, kb.index, models.embed(query), k, None, kb.dates, as_of, who)))
        tiers.append(("tfidf", lambda: retrieval.tfidf_search(kb.entries, kb.idf, query, k, kb.dates, as_of, who)))
        return retrieval.first_tier(tiers)

    if speaker is None:
        return leg(None, 30)
    label, own = leg(speaker, 20)
    both = leg(None, 20)[1]
    order = retrieval.interleaved(retrieval.ranked(own), retrieval.ranked(both))
    hits = own.unionByName(both, allowMissingColumns=True).dropDuplicates(["id"]).join(order, "id").withColumn("ord", F.col("pos"))
    return label, retrieval.in_memory(hits)


def validated(answer: Answer, cites: DataFrame, judge: Callable[[list[dict]], dict[int, str]]) -> Answer:
    """The answer without the citations that the judge refuses, and with the verdicts of the others."""
    spark = cites.sparkSession
    reports = spark.createDataFrame([(0, answer.report)], "report_id long, report string")
    quotes = cites.select(F.lit(0).cast("long").alias("report_id"), F.col("n").cast("int").alias("n"), "quote")
    paired = retrieval.in_memory(citations.pairs(citations.claims(reports), quotes))
    given = judge([r.asDict() for r in paired.orderBy("pid").collect()])
    said = spark.createDataFrame([(0, int(k), v) for k, v in given.items()], "report_id long, pid int, verdict string")
    per = retrieval.in_memory(citations.citation_verdicts(paired, said))
    clean = citations.cleaned(reports, per).first()
    verdicts = {r["n"]: r["verdict"] for r in per.collect()}
    rows = [r | {"verdict": verdicts.get(r["n"], "UNCHECKED")} for r in answer.citations]
    return replace(answer, report=clean["report"], citations=rows, checked=clean["checked"], unsupported=clean["unsupported"])


def ask(kb: Knowledge, models: Models, query: str, as_of: Column, now_ms: int, cache: MemoryCache | None = None, speaker: str | None = None, mode: str | None = None, version: str = "v1", budget: int = 12, table: TableCache | None = None) -> Answer:
    """Answer a query. What reaches the driver is one answer: at most 31 hits, `budget` citations and the pairs of one report.

    The memory is looked up first, then the table; what is found there goes to memory. New answers go to both.
    """
    if not query or not query.strip():
        raise ValueError("a query is needed")
    began = time.monotonic()
    took = lambda: int(1000 * (time.monotonic() - began))
    key = key_of(kb.entries, query, version, speaker, mode)
    if cache is not None and (found := cache.get(key, now_ms)) is not None:
        return replace(found, cache_hit=True, cache_source="memory", latency_ms=took())
    if table is not None and (payload := table.get(key, now_ms)) is not None:
        answer = replace(Answer.of(payload, "table"), latency_ms=took())
        if cache is not None:
            cache.put(key, replace(answer, cache_hit=False, cache_source=""), now_ms)
        return answer
    label, hits = retrieved(kb, models, query, as_of, speaker)
    scores = None
    if models.score is not None:
        lines = retrieval.rerank_lines(retrieval.top(hits, 30)).orderBy("i").collect()
        given = models.score(query, [r["line"] for r in lines])
        if len(given) == len(lines) and lines:
            kind = dict(hits.dtypes)["id"]
            scores = kb.entries.sparkSession.createDataFrame([(r["id"], float(x)) for r, x in zip(lines, given, strict=True)], f"id {kind}, score double")
    hits = retrieval.in_memory(retrieval.rerank(hits, scores, budget))
    cites = retrieval.in_memory(retrieval.citations(hits, kb.dates))
    rows = [r.asDict(recursive=True) for r in cites.orderBy("n").collect()]
    if not rows:
        return Answer(NOTHING, search_mode=label, total_entries=kb.entries.count(), latency_ms=took())
    facts = (retrieval.facts_text(kb.facts).first()["facts"] or "") if kb.facts is not None else ""
    report = models.write(query, retrieval.context(cites, hits).first()["context"], facts) if models.write else ""
    answer = Answer(report, rows, label, segments_found=len(rows), total_entries=kb.entries.count())
    if models.judge is not None and report:
        answer = validated(answer, cites, models.judge)
    answer = replace(answer, latency_ms=took())
    if cache is not None:
        cache.put(key, answer, now_ms)
    if table is not None:
        table.put(key, answer.payload(), now_ms)
    return answer
