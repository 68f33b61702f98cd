"""Column functions on text, time and citations. None of them leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.taxonomy import KEYWORD_STOPWORDS, RETRIEVAL_STOPWORDS

Text = Column | str

#: Description markers such as "(1:02:03) Topic", up to the next paragraph or marker.
CHAPTER = r"\((\d{1,2}):(\d{2})(?::(\d{2}))?\)\s*([^<]+?)(?=</p>|<p>|\s*\(\d)"
MARKER = r"\[(\d+)\]"

# Zone names of RFC 822 by offset.
ZONES = {"GMT|UTC|UT|Z": "+0000", "EDT": "-0400", "EST|CDT": "-0500", "CST|MDT": "-0600", "MST|PDT": "-0700", "PST": "-0800"}


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def trimmed(c: Text) -> Column:
    """Without white space of any kind, byte-order marks included, at either end; trim() would take spaces only."""
    return F.regexp_replace(col(c), r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def collapsed(c: Text) -> Column:
    return F.regexp_replace(col(c), r"\s+", " ")


def word_count(c: Text) -> Column:
    """Pieces between runs of white space, empty ones at the ends included: an empty text has one."""
    return F.size(F.split(col(c), r"\s+"))


def format_hms(ms: Text) -> Column:
    """HH:MM:SS; hours are not bounded."""
    s = F.floor(col(ms) / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def format_chapter(seconds: Text) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = col(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def parse_timestamp(h: Text, m: Text, s: Text) -> Column:
    """Seconds of three parts, or of two where the third is missing: then they are minutes and seconds."""
    a, b, c = (F.when(col(x) != "", col(x)).try_cast("int") for x in (h, m, s))
    return F.when(c.isNull(), a * 60 + b).otherwise(a * 3600 + b * 60 + c)


def clean_topic(c: Text) -> Column:
    """Entities decoded, the ampersand first; tags dropped; white space collapsed."""
    t = col(c)
    for entity, plain in (("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return trimmed(collapsed(F.regexp_replace(t, "<[^>]+>", "")))


def tagged(c: Text, dictionary: dict[str, list[str]]) -> Column:
    """Keys of the dictionary, in its order, of which some word is part of the lower-cased text."""
    low = F.lower(col(c))
    hits = []
    for key, words in dictionary.items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w.lower()))
        hits.append(F.when(found, F.lit(key)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def deep_link(video: Text, ms: Text, base: str = "https://youtube.com/watch?v=") -> Column:
    return F.concat(F.lit(base), col(video).cast("string"), F.lit("&t="), F.floor(col(ms) / 1000).cast("string"), F.lit("s"))


def watch_id(url: Text) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"[?&]v=([^&#]+)", 1), F.lit(""))


def cut(c: Text, n: int) -> Column:
    return F.substring(col(c), 1, n)


def recency_weight(date: Text, as_of: Column) -> Column:
    """0.85 for unknown dates, 1 for the future, else 0.4 + 0.6 e^(-age / 180 days)."""
    age = (F.unix_millis(as_of) - F.unix_millis(col(date).cast("timestamp"))) / F.lit(86_400_000.0)
    return F.when(col(date).isNull(), 0.85).when(age < 0, 1.0).otherwise(0.4 + 0.6 * F.exp(-age / 180))


def spaced(c: Text) -> Column:
    """Runs of ASCII letters and digits of the text in lower case, with an empty one at an end that has other characters."""
    return F.split(F.lower(col(c)), "[^a-z0-9]+")


def tokens_idf(c: Text) -> Column:
    """Distinct tokens of 3 to 29 characters."""
    return F.array_distinct(F.filter(spaced(c), lambda t: (F.length(t) > 2) & (F.length(t) < 30)))


def tokens_query(c: Text, stop: Sequence[str] = RETRIEVAL_STOPWORDS) -> Column:
    """Distinct tokens of 3 characters or more that are no stopwords, in order."""
    return F.array_except(F.array_distinct(F.filter(spaced(c), lambda t: F.length(t) >= 3)), strings(stop))


def tokens_plain(c: Text) -> Column:
    """Tokens of more than 2 characters, with punctuation deleted and repeats kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s]", ""), r"\s+"), lambda t: F.length(t) > 2)


def tokens_keyword(c: Text, stop: Sequence[str] = KEYWORD_STOPWORDS) -> Column:
    return F.filter(tokens_plain(c), lambda t: ~F.array_contains(strings(stop), t))


def tokens_over(c: Text, n: int) -> Column:
    """Lower-cased pieces of more than n characters, punctuation and repeats kept."""
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda t: F.length(t) > n)


def tokens_title(c: Text) -> Column:
    return F.array_distinct(F.filter(F.split(trimmed(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s]", " "), r"\s+", " ")), " "), lambda t: F.length(t) > 3))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


# The query side of a search is one short string: its tokens are made where the plan is made.
def query_terms(query: str, stop: Sequence[str] = RETRIEVAL_STOPWORDS) -> list[str]:
    words = re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", query.lower(), flags=re.A))
    return [w for w in dict.fromkeys(words) if len(w) >= 3 and w not in stop]


def keyword_terms(query: str, stop: Sequence[str] = KEYWORD_STOPWORDS) -> list[str]:
    return [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", "", query.lower(), flags=re.A)) if len(w) > 2 and w not in stop]


def long_terms(query: str, n: int) -> list[str]:
    return [w for w in re.split(r"\s+", query.lower()) if len(w) > n]


def whole_words(c: Text, terms: Sequence[str]) -> Column:
    """Every place where one of the terms, of letters and digits, stands with no letter or digit next to it: one pass, whatever
    the number of terms."""
    return F.filter(spaced(c), lambda t: F.array_contains(strings(terms), t))


def prefix_count(c: Text, terms: Sequence[str]) -> Column:
    """How many words begin with a term, summed over the terms, repeated ones too; a word is of ASCII letters, digits and _.

    One pass, in which the first characters of a word decide whether it is held against the terms.
    """
    if not terms:
        return F.lit(0)
    n = min(map(len, terms))
    heads = strings(sorted({t[:n] for t in terms}))
    near = F.filter(F.split(F.lower(col(c)), "[^a-z0-9_]+"), lambda w: F.array_contains(heads, F.substring(w, 1, n)))
    each = lambda w: sum((F.startswith(w, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return F.aggregate(near, F.lit(0), lambda a, w: a + each(w))


def relevance(distance: Text) -> Column:
    return F.round(1 - col(distance), 3)


def normalize_query(c: Text) -> Column:
    return collapsed(F.lower(trimmed(c)))


def cache_key(query: Text, version: str, speaker: Column | None = None, mode: Column | None = None) -> Column:
    """15 hex digits of the hash of version, speaker, mode and normalised query."""
    none = F.lit("")
    parts = [F.lit(version), F.coalesce(none if speaker is None else speaker, none), F.coalesce(none if mode is None else mode, none), normalize_query(query)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15)


def rss_date(c: Text) -> Column:
    """The UTC date of an RFC 822 date, null where it cannot be read."""
    t = F.regexp_replace(trimmed(c), r"^[A-Za-z]{3},\s*", "")
    for names, offset in ZONES.items():
        t = F.regexp_replace(t, rf" (?:{names})$", f" {offset}")
    return F.to_date(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")))


def confidence(n: Text) -> Column:
    return F.when(col(n) >= 3, "high").when(col(n) >= 1, "medium").otherwise("low")


def sentences(report: Text) -> Column:
    """The sentences of the report's lines, in order."""
    parts = F.flatten(F.transform(F.split(col(report), r"\n+"), lambda line: F.split(line, r"(?<=[.!?])\s+")))
    return F.transform(parts, trimmed)


def markers(sentence: Column, lists: bool = False) -> Column:
    """Distinct citation numbers of a sentence; with `lists`, those of markers such as [4, 7] too."""
    if lists:
        inner = F.regexp_extract_all(sentence, F.lit(r"\[(\d+(?:,\s*\d+)*)\]"), F.lit(1))
        found = F.flatten(F.transform(inner, lambda x: F.split(x, r",\s*")))
    else:
        found = F.regexp_extract_all(sentence, F.lit(MARKER), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def strip_citations(report: Text, numbers: Column) -> Column:
    """The report without these citations, one after another; spaces left behind are tidied each time."""

    def one(text: Column, n: Column) -> Column:
        k = n.cast("string")
        text = F.regexp_replace(text, F.concat(F.lit(r"\s?\["), k, F.lit(r"\](?![\d])")), F.lit(""))
        text = F.regexp_replace(text, F.concat(F.lit(r"\["), k, F.lit(r",\s*(\d+)\]")), F.lit("[$1]"))
        text = F.regexp_replace(text, F.concat(F.lit(r"\[(\d+),\s*"), k, F.lit(r"\]")), F.lit("[$1]"))
        return F.regexp_replace(F.regexp_replace(text, "  +", " "), r"\s+([.,!?;])", "$1")

    return F.aggregate(numbers, col(report), one)


def model_json(reply: Text, schema: str) -> Column:
    """The JSON of a model's reply: code fences stripped, else from the first brace to the last; null if it cannot be read."""
    plain = trimmed(F.regexp_replace(col(reply), r"```(?:json)?", ""))
    inner = F.regexp_extract(col(reply), r"(?s)\{.*\}", 0)
    return F.from_json(F.when(plain.startswith("{"), plain).otherwise(inner), schema)


# The rewrites of Markdown, in the order that they are made in.
MARKDOWN = (
    (r"(?m)^### (.*$)", "<h3>$1</h3>"),
    (r"(?m)^## (.*$)", "<h2>$1</h2>"),
    (r"(?m)^# (.*$)", "<h1>$1</h1>"),
    (r"\*\*(.*?)\*\*", "<strong>$1</strong>"),
    (r"\*([^*\n]+)\*", "<em>$1</em>"),
    (r"(?m)^- (.*$)", "<li>$1</li>"),
    (r"((?:<li>.*</li>\n?)+)", "<ul>$1</ul>"),
    (r"(?m)^---$", "<hr />"),
    (r"\[([^\]]+)\]\((https?://[^)]+)\)", '<a href="$2" target="_blank" rel="noopener noreferrer">$1</a>'),
    (r"(https://youtube\.com/watch\?[^\s<]+)", '<a href="$1" target="_blank" rel="noopener noreferrer">youtube</a>'),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"\n\n", "</p><p>"),
)


def markdown_html(c: Text) -> Column:
    """Markdown as HTML."""
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), MARKDOWN, col(c))


def match_percent(relevance: Text) -> Column:
    """Shown as a percentage only where it is positive."""
    return F.when(col(relevance) > 0, F.concat(F.round(col(relevance) * 100).cast("int").cast("string"), F.lit("% match")))


def ellipsis(quote: Text, n: int = 395) -> Column:
    return F.when(F.length(col(quote)) >= n, F.concat(col(quote), F.lit("…"))).otherwise(col(quote))
