"""WARC archives of captures, and an index of them by external merging.

Writing: every capture is one record of gzip members; a file ends with the record that takes it past FILE_BYTES. Of
captures with equal payloads the one with the smallest id is a response, the others are revisits that refer to it. The
files go through Spark's own writer, so that they reach any store and appear when their task commits. That writer ends
each row with a separator: a byte 0, which is the last byte of a gzip member of less than 16 MiB and is left out before.

Indexing: each archive read back gives a run of index lines, sorted by URL key and time. Runs are dealt over ranges of
keys. In each range they come one after another, go to spill files of the task, and a loser tree merges them from there,
FAN_IN at a time and in as many passes as that takes. A task holds a block of lines of each of FAN_IN runs.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from itertools import chain, groupby, islice
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, lookup, written

LEAST_BYTES = 100
MEMBER_BYTES = 8 << 20
FILE_BYTES = 32 << 20
READ_STEP = 1 << 16
LINES_PER_RANGE = 500_000
#: Runs merged at once, lines of a run held at once, and lines of a range up to which no spill file is needed.
FAN_IN, BLOCK_LINES, HELD_LINES = 32, 512, 50_000

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-capture:"

LINE = pa.schema(
    [("url_key", pa.string()), ("captured", pa.int64()), ("run", pa.string()), ("line", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
LINE_DDL = "url_key string, captured long, run string, line long, offset long, length long, url string, id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """The host from its end, then path and query in lower case: captures of one site stand together."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = re.sub(r"^www\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def stamp(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(id_: int | None, url: str | None, seconds: int, digest: str, payload: bytes, refers: tuple | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    head = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<{NAME}{'' if id_ is None else id_}>"),
        ("WARC-Date", stamp(seconds)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    if refers:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{NAME}{refers[0]}>"), ("WARC-Refers-To-Date", stamp(refers[1]))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


MEMBERS = pa.schema([("member", pa.binary()), ("file", pa.int32()), ("place", pa.int64())])


def file_cutter(file_bytes: int):
    """A function from (id, url, seconds, digest, payload, first_id, first_seconds) to gzip members without their last byte,
    each with the number of its file in the task and its place there. All members of a record are in one file."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, filled, out, size = 0, 0, 0, [], 0
        for batch in batches:
            rest = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)]
            payloads = batch.column(4).cast(pa.binary())
            for i, (id_, url, seconds, digest, first, at) in enumerate(zip(*rest, strict=True)):
                raw = record(id_, url, seconds, digest, payloads[i].as_py() or b"", None if first is None else (first, at))
                for a in range(0, len(raw), MEMBER_BYTES):
                    out.append((member(raw[a : a + MEMBER_BYTES])[:-1], file, place))
                    place += 1
                    filled += len(out[-1][0])
                    size += len(out[-1][0])
                    if size > MEMBER_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MEMBERS, strict=True)], schema=MEMBERS)
                        out, size = [], 0
                if filled >= file_bytes:
                    file, filled = file + 1, 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MEMBERS, strict=True)], schema=MEMBERS)

    return records


def write(captures: DataFrame, path: str) -> None:
    """Write captures (id, url, seconds, payload) to a folder of archives.

    Null payloads are empty; captures of less than LEAST_BYTES are responses always. Null ids come last and are never
    referred to; a capture without a URL has no target. Captures alike in id and payload share their fate. An empty table
    gives no archive; other columns are ignored, whatever their names.
    """
    rows = captures.select(F.col("id").cast("long").alias("id"), "url", F.col("seconds").cast("long").alias("seconds"), F.coalesce(F.col("payload"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.xxhash64("id", "digest"))
    light = written(rows.where(F.octet_length("payload") >= LEAST_BYTES).select("key", "id", "digest", "seconds"), "captures")
    first = light.where("id is not null").groupBy("digest").agg(F.min(F.struct("id", "seconds")).alias("first"), F.count("*").alias("n"))
    later = lookup(light, written(first.where("n > 1 or n is null").select("digest", "first"), "firsts"), "digest", F.col("key"))
    later = later.where(~F.col("id").eqNullSafe(F.col("first.id"))).groupBy("key").agg(F.min("first").alias("first"))
    found = lookup(rows, written(later, "revisits"), "key", F.col("key"), how="left")
    out = found.select("id", "url", F.coalesce("seconds", F.lit(0)).alias("seconds"), "digest", "payload", F.col("first.id").alias("first_id"), F.col("first.seconds").alias("first_seconds"))
    members = in_arrow(out, file_cutter(FILE_BYTES), "member binary, file int, place long").sortWithinPartitions("file", "place")
    members.select(F.col("member").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


def members_of(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member."""
    at = 0
    while at < len(content):
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:
            step = content[end : end + READ_STEP]
            if not step:
                raise ValueError("an archive breaks off within a member")
            parts.append(z.decompress(step))
            end += len(step)
        end -= len(z.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def records_of(content: memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record, whose members are joined until its content is whole."""
    at, size, raw, fields, start, end = 0, 0, bytearray(), None, 0, 0
    for offset, length, part in members_of(content):
        if not raw:
            at, size = offset, 0
        raw += part
        size += length
        if fields is None:
            start = raw.find(b"\r\n\r\n") + 4
            if start < 4:
                continue
            fields = dict(line.split(": ", 1) for line in raw[: start - 4].decode().split("\r\n")[1:])
            end = start + int(fields["Content-Length"])
        if len(raw) >= end + 4:
            yield at, size, fields, bytes(raw[start:end])
            raw, fields = bytearray(), None
    if raw:
        raise ValueError("an archive breaks off within a record")


def index_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives (path, content) to one sorted run of index lines each. Payloads are digested anew and held to the header."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lines = []
            for offset, length, head, block in records_of(memoryview(content.as_buffer())):
                http, _, payload = block.partition(b"\r\n\r\n")
                n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path} at {offset}: the payload is not what its header says")
                number = lambda k, head=head: int(x) if (x := head.get(k, "<>")[1:-1].removeprefix(NAME)) else None
                seconds = int(datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                url = head.get("WARC-Target-URI")
                lines.append((url_key(url), seconds, path, offset, length, url, number("WARC-Record-ID"), n, digest, head["WARC-Type"], number("WARC-Refers-To")))
            lines.sort(key=lambda x: (x[0], x[1], x[3]))
            cols = list(zip(*[(*x[:3], i, *x[3:]) for i, x in enumerate(lines)], strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, LINE, strict=True)], schema=LINE)


class LoserTree:
    """Merges sorted runs: every inner node keeps the loser of its match, so that a step replays one path to the root."""

    def __init__(self, runs: list[Iterable], key: Callable):
        self.runs, self.key, k = [iter(r) for r in runs], key, max(len(runs), 1)
        self.heads = [self.pull(i) for i in range(len(runs))]
        self.size = 1 << (k - 1).bit_length()
        self.losers = [-1] * self.size
        winners = [i if i < len(runs) else -1 for i in range(self.size)]
        base = self.size
        while base > 1:
            base //= 2
            for n in range(base):
                a, b = winners[2 * n], winners[2 * n + 1]
                first = self.before(a, b)
                self.losers[base + n], winners[n] = (b, a) if first else (a, b)
        self.winner = winners[0]

    def pull(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def before(self, a: int, b: int) -> bool:
        if b < 0 or self.heads[b] is None:
            return True
        return a >= 0 and self.heads[a] is not None and self.heads[a][:2] < self.heads[b][:2]

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = w = self.winner
            self.heads[i] = self.pull(i)
            n = (i + self.size) // 2
            while n:
                if not self.before(w, self.losers[n]):
                    w, self.losers[n] = self.losers[n], w
                n //= 2
            self.winner = w


def batch_of(lines: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), LINE, strict=True)], schema=LINE)


def in_blocks(lines: Iterable[tuple], n: int) -> Iterator[pa.RecordBatch]:
    it = iter(lines)
    while block := list(islice(it, n)):
        yield batch_of(block)


def lines_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, BLOCK_LINES):
        yield from zip(*[c.to_pylist() for c in batch.slice(at, BLOCK_LINES).columns], strict=True)


class Spill:
    """A sorted run of index lines in an anonymous file of the task: written once, then read in blocks."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.file = tempfile.TemporaryFile()
        with pa.ipc.new_stream(self.file, LINE) as out:
            for batch in batches:
                batch = pa.RecordBatch.from_arrays(batch.columns, schema=LINE)
                for at in range(0, batch.num_rows, BLOCK_LINES):
                    out.write_batch(batch.slice(at, BLOCK_LINES))

    def __iter__(self) -> Iterator[tuple]:
        with self.file:
            self.file.seek(0)
            for batch in pa.ipc.open_stream(self.file):
                yield from lines_of(batch)


def merged(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    return iter(LoserTree(runs, lambda x: x[:2]))


def merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index lines of one range of keys, which come run by run, in the order of url_key, captured, run and line."""

    def by_run() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("run")
            run = batch.column(at).dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)

    def runs() -> Iterator[list[pa.RecordBatch] | Spill]:
        """A run after another: in memory while few lines are held, else as spill files."""
        held = 0
        at = LINE.get_field_index("run")
        for _, parts in groupby(by_run(), lambda x: x.column(at)[0].as_py()):
            first = []
            for part in parts:
                first.append(part)
                held += part.num_rows
                if held > HELD_LINES:
                    yield Spill(chain(first, parts))
                    break
            else:
                yield first

    def opened(run: list[pa.RecordBatch] | Spill) -> Iterable[tuple]:
        return run if isinstance(run, Spill) else chain.from_iterable(map(lines_of, run))

    # levels[k] has runs that were merged k times, in order; what stands on a higher level came before. Few files are open.
    levels: list[list] = [[]]
    for run in runs():
        levels[0].append(run)
        for k, level in enumerate(levels):
            if len(level) < FAN_IN:
                break
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(Spill(in_blocks(merged([opened(r) for r in level]), BLOCK_LINES)))
            level.clear()
    yield from in_blocks(merged([opened(r) for level in reversed(levels) for r in level]), 5_000)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a folder of archives: one row for each record, range after range in global order of key and time."""
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")
    runs = written(in_arrow(archives, index_lines, LINE_DDL), "index-runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // LINES_PER_RANGE + 1)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "run", "line").sortWithinPartitions("run", "line")
    return in_arrow(dealt, merged_runs, LINE_DDL)
