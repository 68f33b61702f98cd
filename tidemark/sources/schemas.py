"""Schemas of what is read and written."""

EVENTS = "events ARRAY<STRUCT<tStartMs: BIGINT, dDurationMs: BIGINT, segs: ARRAY<STRUCT<utf8: STRING>>>>, _corrupt_record STRING"
CHUNK = "id STRING, videoId STRING, chunkIndex INT, text STRING, startTime STRING, endTime STRING, startMs BIGINT, endMs BIGINT, topics ARRAY<STRING>, speakersMentioned ARRAY<STRING>, wordCount INT"
_CHUNKS = "ARRAY<STRUCT<" + ", ".join(f"{a}: {b}" for a, b in (x.split(" ") for x in CHUNK.split(", "))) + ">>"
TRANSCRIPT = f"videoId STRING, durationMs BIGINT, duration STRING, totalWords INT, topics ARRAY<STRING>, speakersMentioned ARRAY<STRING>, chunks {_CHUNKS}, longChunks {_CHUNKS}, chunkCount INT, longChunkCount INT"
ENTRY = "id STRING, content STRING, metadata STRUCT<videoId: STRING, startTime: STRING, endTime: STRING, duration: STRING, topics: ARRAY<STRING>, speakersMentioned: ARRAY<STRING>, wordCount: INT, youtubeUrl: STRING>"
CONTENT_INDEX = "MAP<STRING, STRUCT<c: STRING, v: STRING, t: STRING, s: BIGINT, p: ARRAY<STRING>, m: ARRAY<STRING>, u: STRING>>"
IDF = "MAP<STRING, DOUBLE>"
DATES = "MAP<STRING, STRING>"
FACTS = "MAP<STRING, STRUCT<name: STRING, role: STRING, political_alignment: STRING, current_positions: ARRAY<STRING>, style: STRING>>"
RSS = "title STRING, pubDate STRING, description STRING, enclosure STRUCT<_url: STRING>, `itunes:duration` STRING"
CHAPTERS = "id STRING, title STRING, date STRING, audioUrl STRING, chapterCount INT, chapters ARRAY<STRUCT<id: STRING, startSec: INT, startTime: STRING, topic: STRING>>"
LOOKUP = "MAP<STRING, STRUCT<topic: STRING, episodeTitle: STRING, episodeDate: STRING, audioUrl: STRING, startTime: STRING, startSec: INT>>"
FRESHNESS = "updatedAt STRING, episodeCount INT, chapterCount INT, dateRange STRUCT<oldest: STRING, newest: STRING>, latestEpisode STRUCT<title: STRING, date: STRING>"
PROFILE = "name STRING, tier STRING, role STRING, lensDescription STRING, expertise ARRAY<STRING>, biases ARRAY<STRING>, debateStyle STRING, topicCounts MAP<STRING, INT>, totalMentions INT, episodeAppearances INT, topTopics ARRAY<STRUCT<topic: STRING, count: INT>>"
QUESTION = "id STRING, category STRING, query STRING, speaker STRING, mode STRING"
GRADE = "id STRING, voice DOUBLE, grounding DOUBLE, citations DOUBLE, recency DOUBLE, usefulness DOUBLE, overall DOUBLE, verified_claims INT, unverified_claims INT, strengths ARRAY<STRING>, weaknesses ARRAY<STRING>, key_issue STRING"
