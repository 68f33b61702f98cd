"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks that a reader maps without copying.

A file holds whole documents one after another, cut into sequences of equal length; only its last sequence is padded.
Row i has input_ids (fixed-size list), attention_mask (fixed-size list of booleans), and the doc_ids and end offsets of
the documents that end in it. The schema's metadata has the file's place in the corpus, its numbers of documents and of
ids. Any row of a memory-mapped file is a slice of two buffers.

The files are written through Spark's own writer, so that they go to any store that Spark knows and appear only when
their task commits. That writer ends each record with a separator: it is the last byte of the format, left out before.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import in_arrow, new_path, ranked, removed, written
from tidemark.llm.textsets import FOLD, PLACES, PLAIN, SPACE, breaks, packed, scrambled

LENGTH = 2048
FILE_BYTES = 8 << 20
#: Beyond so many words a worker starts a new table of ids and keeps the last one beside it.
CACHE_WORDS = 250_000
STEP_BYTES = 2 << 20


def unicode_word(raw: bytes) -> bool:
    """Is the word of lower-case Latin letters that no normalisation changes?"""
    text = raw.decode()
    return text.isalpha() and text == text.lower() and max(text) < "\u0250"


#: ASCII marks but for the apostrophe, which may begin a piece together with letters.
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
MARK[39] = False


#: Lead bytes of the letters of two bytes that may be known to be letters, U+00C0 to U+017F.
LEADS = range(0xC3, 0xC6)


def plain_letters(normal) -> np.ndarray:
    """For each lead byte and second byte: does the tokenizer's normaliser make letters alone of that letter? Some become a
    letter and a combining mark, which a mark behind it would join."""
    codes = [bytes([lead, 0x80 + k]).decode() for lead in LEADS for k in range(64)]
    return np.array([c.isalpha() and normal.normalize_str(c).isalpha() for c in codes]).reshape(len(LEADS), 64)


def letter_ends(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Where a letter's last byte is known to be: ASCII, and the letters of two bytes that `letters` has."""
    out = PLAIN[data]
    tail = np.flatnonzero((data[1:] & 0xC0 == 0x80) & (data[:-1] >= LEADS[0]) & (data[:-1] <= LEADS[-1])) + 1
    out[tail] = letters[data[tail - 1] - LEADS[0], data[tail] & 63]
    return out


def word_spans(data: np.ndarray, cuts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in data, none across a cut; letters and marks next to each other are words apart."""
    inside = ~SPACE[data]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    mark, letter = MARK[data], PLAIN[data]
    stop = np.flatnonzero((mark[1:] & letter_ends(data, letters)[:-1]) | (letter[1:] & mark[:-1])) + 1
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[inner] = inside[inner]
    opens[stop] = True
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[inner - 1] = inside[inner - 1]
    ends[stop - 1] = True
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(ends) + 1 - starts


#: The parts of a tokenizer's file under which a text's ids are those of its words in a row. They ignore
#: the case of A-Z, drop white space, never join a letter with a mark but the apostrophe, and mark each piece's last token.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
END_MARK = "</w>"


def by_words(path: str) -> bool:
    """Does the tokenizer's file say that its ids can be worked out word by word? Else whole texts are encoded."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == END_MARK and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return plain and not said.get("truncation") and not said.get("padding") and all(said[k] == v for k, v in BY_WORDS.items())


class WordIds:
    """Ids of texts. Where `by_words` finds that sound, they are worked out once for each word; else for each whole text.

    Texts that hold one of the tokenizer's added tokens, in any case, are always encoded whole: such tokens are looked for
    in the text as it stands, before its case is folded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        self.added = sorted({FOLD[np.frombuffer(t.content.encode(), np.uint8)].tobytes() for t in added.values()})
        # what they begin with before their first letter: texts without it need no closer look
        self.heads = sorted({re.match(rb"[^a-z]*", t)[0] for t in self.added})
        self.by_words = by_words(path)
        size = max(self.tok.get_vocab_size(), max(added, default=0) + 1)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if not self.by_words:
            return
        self.letters = plain_letters(self.tok.normalizer)
        # for lower-case words of letters its normaliser and patterns change nothing
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.array([(self.tok.id_to_token(i) or END_MARK).endswith(END_MARK) for i in range(size)])
        self.last[list(added)] = True

    def one_by_one(self, words: list[bytes]) -> None:
        e = self.tok.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(1, len(words) + 1)) * self.dtype.itemsize
        raw, a = np.array(e.ids, self.dtype).tobytes(), 0
        for w, b in zip(words, ends.tolist(), strict=True):
            self.ids[w], a = raw[a:b], b

    def learn(self, words: list[bytes]) -> None:
        """Lower-case words of letters alone are one piece each and encoded in one go."""
        plain = [w for w in words if w.isalpha() or unicode_word(w)]
        if plain:
            found = np.array(self.plain.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.last[found]) + 1) * self.dtype.itemsize
            if len(ends) == len(plain):
                raw, a = found.tobytes(), 0
                for w, b in zip(plain, ends.tolist(), strict=True):
                    self.ids[w], a = raw[a:b], b
        if hard := [w for w in words if w not in self.ids]:
            self.one_by_one(hard)

    def ids_of(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that the cuts make of data, in a row, and where each text's begin.

        Words are told apart by hashes of their bytes, eight at a time; then every word is held against the first with its
        hash. Each different word is looked up once.
        """
        low = FOLD[data]
        starts, lengths = word_spans(data, cuts, self.letters)
        if not len(starts):
            return np.empty(0, self.dtype), np.zeros(len(cuts), np.int64)
        parts = packed(low, starts, lengths)
        hashes = scrambled(parts[0] * PLACES[0] + parts[1] * PLACES[1] + parts[2] * PLACES[2] + lengths.astype(np.uint64))
        for i in np.flatnonzero(lengths > 24).tolist():
            hashes[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
        which = pa.array(hashes).dictionary_encode().indices.to_numpy()  # numbered as they come
        first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        lead = first[which]
        same = (lengths == lengths[lead]).all() and (parts[0] == parts[0][lead]).all()
        for k in (1, 2):  # as long as each other, so that short words need no closer look
            more = np.flatnonzero(lengths > 8 * k)
            same = same and (parts[k][more] == parts[k][lead[more]]).all()
        if not same or any(low[starts[i] : starts[i] + lengths[i]].tobytes() != low[starts[lead[i]] : starts[lead[i]] + lengths[i]].tobytes() for i in np.flatnonzero(lengths > 24)):
            first = which = np.arange(len(starts))  # two words of one hash: look every word up
        del parts, hashes, lead
        raw = low.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), (starts[first] + lengths[first]).tolist(), strict=True)]
        if len(self.ids) > CACHE_WORDS:
            self.old, self.ids = self.ids, {}
        found = list(map(self.ids.get, words))
        if None in found:
            new = [w for w, x in zip(words, found, strict=True) if x is None]
            if self.old:
                self.ids.update((w, x) for w in new if (x := self.old.get(w)) is not None)
                new = [w for w in new if w not in self.ids]
            if new:
                self.learn(new)
            found = [self.ids[w] if x is None else x for w, x in zip(words, found, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        pool, offsets = np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes
        sizes, offsets = sizes[which], offsets[which]
        ends = np.cumsum(sizes)
        ids = pool[np.repeat((offsets - ends + sizes).astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)]
        return ids, np.append(0, ends)[np.searchsorted(starts, cuts)]

    def whole(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text by the tokenizer itself."""
        return np.array(self.tok.encode(data.tobytes().decode(), add_special_tokens=False).ids, self.dtype)

    def holds_added(self, data: np.ndarray) -> bool:
        raw = data.tobytes()
        if not any(h in raw for h in self.heads):
            return False
        low = FOLD[data].tobytes()
        return any(t in low for t in self.added)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow array, null as empty; whole texts, the long ones piece by piece."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = min(max(int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1, i + 1), len(texts))
            part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not self.by_words or self.holds_added(part):
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    one = part[a:b]
                    if not self.by_words or self.holds_added(one):
                        yield self.whole(one)
                    else:
                        at = breaks(one, STEP_BYTES)
                        yield np.concatenate([np.empty(0, self.dtype), *[self.ids_of(one[x:y], np.empty(0, np.int64))[0] for x, y in zip(at[:-1], at[1:], strict=True)]])
            elif j == i + 1 and len(part) > STEP_BYTES:
                at = breaks(part, STEP_BYTES)
                yield np.concatenate([self.ids_of(part[a:b], np.empty(0, np.int64))[0] for a, b in zip(at[:-1], at[1:], strict=True)])
            else:
                ids, begins = self.ids_of(part, cuts)
                for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    yield ids[a:b]
            i = j


def file_of(docs: list[tuple[int | None, np.ndarray]], place: tuple[int, int], length: int, dtype: np.dtype) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    n = len(ids)
    rows = -(-n // length)
    ends = np.cumsum([len(x) for _, x in docs]) - 1
    padded = np.zeros(rows * length, dtype)
    padded[:n] = ids
    mask = np.zeros(rows * length, bool)
    mask[:n] = True
    row_of = np.searchsorted(ends // length, np.arange(rows + 1)).astype(np.int32)
    table = pa.RecordBatch.from_arrays(
        [
            pa.FixedSizeListArray.from_arrays(pa.array(padded), length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
            pa.ListArray.from_arrays(row_of, pa.array([d for d, _ in docs], pa.int64())),
            pa.ListArray.from_arrays(row_of, pa.array((ends % length).astype(np.int32))),
        ],
        names=["input_ids", "attention_mask", "doc_ids", "doc_ends"],
    )
    table = table.replace_schema_metadata({"part": str(place[0]), "file": str(place[1]), "docs": str(len(docs)), "ids": str(n)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


_made: dict[str, WordIds] = {}


def file_writer(path: str, end_id: int, length: int, file_bytes: int):
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _made:  # a worker serves many tasks
            _made[path] = WordIds(path)
        words = _made[path]
        part, k = TaskContext.get().partitionId(), 0
        end = np.array([end_id], words.dtype)
        held, size = [], 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), strict=True):
                held.append((doc, np.append(ids, end)))
                size += ids.nbytes
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([file_of(held, (part, k), length, words.dtype)[:-1]], pa.binary())], names=["file"])
                    held, size, k = [], 0, k + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([file_of(held, (part, k), length, words.dtype)[:-1]], pa.binary())], names=["file"])

    return files


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int = LENGTH, file_bytes: int = FILE_BYTES, part_bytes: int = 64 << 20) -> None:
    """Encode docs (doc_id, text, ...) and write them to the folder in ascending doc_id order, null ids first.

    Null texts count as empty: such a document is its end id alone. Rows with one id follow each other in any order, and
    may lie in several files. The tokenizer's file must be readable at that path on every executor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // part_bytes + 1)
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    files = in_arrow(rows, file_writer(tokenizer, end_id, length, file_bytes), "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "1").option("maxRecordsPerFile", 1).text(path)


def documents_of(content: bytes) -> tuple[dict[str, int], list[int | None], list[np.ndarray]]:
    """A file's metadata, document ids, and ids of each document with its end id: views of the file's buffers."""
    table = pa.ipc.open_file(pa.BufferReader(content)).read_all()
    meta = {k.decode(): int(v) for k, v in table.schema.metadata.items()}
    col = lambda name: table.column(name).combine_chunks()
    ids = col("input_ids").flatten().to_numpy()
    assert int(col("attention_mask").flatten().true_count) == meta["ids"]
    ends = col("doc_ends")
    rows = np.repeat(np.arange(len(ends)), np.diff(ends.offsets.to_numpy()))
    stops = rows * col("input_ids").type.list_size + ends.values.to_numpy() + 1
    return meta, col("doc_ids").values.to_pylist(), np.split(ids[: meta["ids"]], stops[:-1]) if len(stops) else []


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            meta, docs, ids = documents_of(raw.as_buffer())
            n = np.array([len(x) for x in ids], np.int64)
            k = len(n)
            crc = [zlib.crc32(x.astype("<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array([meta["part"]] * k, pa.int32()), pa.array([meta["file"]] * k, pa.int32()), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "file", "doc_id", "within", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder of such files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    docs = written(in_arrow(files, read_files, "part int, file int, doc_id long, within long, n_tokens long, ids_crc32 long"), "token-docs")
    sums = docs.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    # one row for each file: the files before it, by ranges of files
    table = ranked(sums, [F.col("part"), F.col("file")], "k").withColumn("block", F.floor(F.col("k") / 1000))
    inner = F.sum("ids").over(Window.partitionBy("block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")
    blocks = table.groupBy("block").agg(F.sum("ids").alias("n"))
    outer = blocks.select("block", (F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("outer"))
    before = table.withColumn("inner", inner).join(outer, "block").select("part", "file", (F.col("inner") + F.col("outer")).alias("before"))
    return docs.join(before, ["part", "file"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """write, then read, over a new folder in the shared folder, which goes once it was read. An empty table gives no file
    and an empty result."""
    path = new_path(docs.sparkSession, "token-files")
    try:
        write(docs, path, tokenizer, end_id)
        return read(docs.sparkSession, path)
    finally:
        removed(docs.sparkSession, path)
