"""Alignment of two tokenizers over the same bytes, and how many documents link each pair of their ids.

Byte offsets at which tokens of both end cut them into groups; every pair of a group's tokens is a link. Pairs travel as
packed int64 keys: a task counts the documents that hold each by np.unique, the partial counts are sorted globally by
ranges of keys, and equal neighbours are summed in one run over each range. Each range is an Arrow file, a sorted count
shard, which the last pass maps into memory and searches with searchsorted.

Both tokenizers begin anew at a space behind a word (`by_words` asks their files whether that holds). So what stands
between two such places has its ids, groups and links once and for all, and each different word is aligned once a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, new_path, removed, scratch, written

#: Beyond so many words a worker forgets those it knows; longer words than this are not kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 200
#: Characters of text that are aligned at once, and of new words that a tokenizer gets at once.
STEP_CHARS, LEARN_CHARS = 1 << 20, 1 << 16
#: Keys that a task gathers before it makes them unique, and different keys after which it hands on what it has.
GATHER_KEYS, HOLD_KEYS = 1 << 21, 1 << 22
#: Groups with more links are counted by their different ids.
GROUP_LINKS = 1 << 16
#: Partial counts in a range of keys, so that a shard is some megabytes.
SHARD_ROWS = 1_000_000

#: White space to either tokenizer or to Python, and marks that older tables count as such.
BLANK = "\\s\u180e\u200b\ufeff"
#: A space at which a text is cut: something but white space before, anything behind.
CUT = re.compile(rf"(?<=[^{BLANK}]) (?=.)", re.S)
#: Texts in which not every space is such a place.
ODD = re.compile(rf"[{BLANK}] |^ | $")
BLANKS = frozenset(c for c in map(chr, range(1 << 16)) if re.match(f"[{BLANK}]", c))

#: The parts of a tokenizer's file under which a space behind a word begins a new piece.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}


def by_words(a_path: str, pieces: list[str]) -> bool:
    """Do both tokenizers begin anew at a space behind a word? The one by its file, the other as none of its pieces goes on
    into a space."""
    with open(a_path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and not said.get("normalizer") and said.get("pre_tokenizer") == BYTE_LEVEL and not any("\u2581" in p.lstrip("\u2581") for p in pieces)


def merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and the sums of their weights: equal keys stand in runs."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at starts and have these sizes, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Words and what their alignment gives. A word is what stands between two places where both tokenizers begin anew,
    without the space before it. Words of which either tokenizer changes the bytes have no alignment."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = byte_of_char()
        names = [self.a.id_to_token(i) or "" for i in range(max([self.a.get_vocab_size() - 1, *self.a.get_added_tokens_decoder()]) + 1)]
        # what is no byte-level character stands in no vocabulary entry; a special token's name is text
        self.a_bytes = [bytes(chars[c] for c in x) if all(c in chars for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", p)) else p.replace("\u2581", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        self.by_words = by_words(a_path, pieces)
        # an id and what follows it in the digest: more of its side, or the other side, or the next group
        number = [str(i).encode() for i in range(max(len(names), self.width))]
        self.shown = [n + b"," for n in number[: len(names)]] + [n + b"|" for n in number[: len(names)]] + [n + b"," for n in number[: self.width]] + [n + b";" for n in number[: self.width]]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.digests: list[bytes] = []
        #: Of each word: ids of a, ids of b, groups, links, where its keys begin, how many they are; -1 at first where it has no alignment.
        self.facts = np.empty((1 << 12, 6), np.int64)
        self.keys, self.weights, self.used = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), 0

    def add(self, words: list[str], facts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, weights: np.ndarray, digests: list[bytes]) -> None:
        """Words with their first four facts, and their keys and weights in a row, so many of each as sizes says."""
        k, n = len(self.digests), len(words)
        while k + n > len(self.facts):
            self.facts = np.resize(self.facts, (2 * len(self.facts), 6))
        while self.used + len(keys) > len(self.keys):
            self.keys, self.weights = np.resize(self.keys, 2 * len(self.keys)), np.resize(self.weights, 2 * len(self.weights))
        new = self.facts[k : k + n]
        new[:, :4], new[:, 4], new[:, 5] = facts, self.used + np.cumsum(sizes) - sizes, sizes
        self.keys[self.used : self.used + len(keys)] = keys
        self.weights[self.used : self.used + len(keys)] = weights
        self.used += len(keys)
        self.index.update(zip(words, range(k, k + n), strict=True))
        self.digests += digests

    def learn(self, words: list[str]) -> None:
        """Many words in one go, one after another; where that does not come out even, by halves down to single words."""
        text = " ".join(words)
        raw = (" " + text).encode()
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text), np.int64)
        even = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
        if even:
            a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            both = np.intersect1d(a_ends, b_ends, assume_unique=True)  # a group ends where tokens of both end
            ends = np.cumsum([1 + len(w) if w.isascii() else 1 + len(w.encode()) for w in words])
            last = np.searchsorted(both, ends)
            even = len(both) > 0 and last[-1] < len(both) and (both[last] == ends).all()
        if not even:
            if len(words) == 1:
                return self.add(words, np.array([[-1, 0, 0, 0]]), np.array([0]), np.empty(0, np.int64), np.empty(0, np.int64), [b""])
            self.learn(words[: len(words) // 2])
            return self.learn(words[len(words) // 2 :])
        a_cut, b_cut = np.append(0, np.searchsorted(a_ends, both, "right")), np.append(0, np.searchsorted(b_ends, both, "right"))
        n_a, n_b = np.diff(a_cut), np.diff(b_cut)
        links = n_a * n_b
        first = np.append(0, last[:-1] + 1)  # of each word's groups
        facts = np.stack([a_cut[last + 1] - a_cut[first], b_cut[last + 1] - b_cut[first], last + 1 - first, np.add.reduceat(links, first)], axis=1)
        shown = self.written_out(a, b, a_cut, b_cut)
        cuts = (a_cut + b_cut)[np.append(0, last + 1)].tolist()
        digests = [b"".join(shown[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if (links > GROUP_LINKS).any():
            for k, word in enumerate(words):
                keys, weights = self.counted(a, b, a_cut[first[k] : last[k] + 2], b_cut[first[k] : last[k] + 2])
                self.add([word], facts[k : k + 1], np.array([len(keys)]), keys, weights, digests[k : k + 1])
            return
        # the links of a group: each of its tokens of a with each of b
        group, nth = np.repeat(np.arange(len(links)), links), gathered(np.zeros(len(links), np.int64), links)
        keys = a[a_cut[:-1][group] + nth // n_b[group]] * self.width + b[b_cut[:-1][group] + nth % n_b[group]]
        self.add(words, facts, facts[:, 3], keys, np.ones(len(keys), np.int64), digests)

    def counted(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different keys of groups, and how often each is linked, from the different ids of each group."""
        keys, weights = [], []
        for x in range(len(a_cut) - 1):
            (p, m), (q, n) = (np.unique(ids[cut[x] : cut[x + 1]], return_counts=True) for ids, cut in ((a, a_cut), (b, b_cut)))
            keys.append((p[:, None] * self.width + q).ravel())
            weights.append((m[:, None] * n).ravel())
        return merged(np.concatenate(keys), np.concatenate(weights))

    def written_out(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> list[bytes]:
        """Every id with the mark behind it, group by group."""
        out = np.empty(len(a) + len(b), np.int64)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_cut[1:] - 1] = b_last[b_cut[1:] - 1] = True
        out[np.arange(len(a)) + np.repeat(b_cut[:-1], np.diff(a_cut))] = a + a_last * len(self.a_bytes)
        out[np.arange(len(b)) + np.repeat(a_cut[1:], np.diff(b_cut))] = b + 2 * len(self.a_bytes) + b_last * self.width
        return list(map(self.shown.__getitem__, out.tolist()))

    def know(self, words: set[str]) -> None:
        """Learns what is new among words, several together but for those that another may not follow."""
        new, size = [], 0
        for w in words:
            if w in self.index:
                continue
            if not self.by_words or not w or w[-1] in BLANKS or len(w) > LEARN_CHARS:
                self.learn([w])
                continue
            new.append(w)
            size += len(w)
            if size > LEARN_CHARS:
                self.learn(new)
                new, size = [], 0
        if new:
            self.learn(new)

    def words_of(self, text: str) -> list[str]:
        if not self.by_words:
            return [text]
        return CUT.split(text) if ODD.search(text) else text.split(" ")

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The words of a text in portions of about STEP_CHARS characters."""
        a = 0
        while a < len(text):
            m = CUT.search(text, a + STEP_CHARS) if self.by_words else None
            yield self.words_of(text[a : m.start()] if m else text[a:])
            a = m.end() if m else len(text)

    def steps(self, texts: list[str | None]) -> Iterator[list[tuple[list[str], bool]]]:
        """Portions (words, are they the last of their text) that are known together: several texts, or a part of a long one."""
        held, size = [], 0
        for text in texts:
            if text and len(text) > STEP_CHARS:
                if held:
                    yield held
                    held, size = [], 0
                before = None
                for words in self.pieces(text):
                    if before is not None:
                        yield [(before, False)]
                    before = words
                yield [(before, True)]
                continue
            held.append((self.words_of(text) if text else [], True))
            size += len(text or "")
            if size >= STEP_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def align(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """For each text: ids of a, ids of b, groups, links; the groups' digest; its different keys, sorted, and how often
        each is linked. Null and empty texts and those without an alignment have zeros and no digest."""
        state = None
        for step in self.steps(texts):
            if len(self.index) > CACHE_WORDS:
                self.forget()
            self.know(set().union(*(words for words, _ in step)))
            for words, last in step:
                if state is None:
                    state = (np.zeros(4, np.int64), hashlib.sha256(), [], [])
                    ok, begun = bool(words), False
                sums, sha, keys, weights = state
                numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                ok = ok and not (self.facts[numbers, 0] < 0).any()
                if ok and len(numbers):
                    if begun:
                        sha.update(b";")
                    sha.update(b";".join(map(self.digests.__getitem__, numbers.tolist())))
                    begun = True
                    each, times = np.unique(numbers, return_counts=True)
                    facts = self.facts[each]
                    sums += (facts[:, :4] * times[:, None]).sum(axis=0)
                    at = gathered(facts[:, 4], facts[:, 5])
                    k, w = merged(self.keys[at], self.weights[at] * np.repeat(times, facts[:, 5]))
                    keys.append(k)
                    weights.append(w)
                if last:
                    if ok and len(keys) > 1:
                        keys, weights = ([x] for x in merged(np.concatenate(keys), np.concatenate(weights)))
                    if ok:
                        yield tuple(sums.tolist()), sha.hexdigest(), keys[0], weights[0]
                    else:
                        yield (0, 0, 0, 0), "", np.empty(0, np.int64), np.empty(0, np.int64)
                    state = None
            for w in [w for words, _ in step for w in words if len(w) > CACHE_CHARS]:
                self.index.pop(w, None)


def valid(raw: bytes | None) -> str | None:
    try:
        return raw.decode() if raw else None
    except UnicodeDecodeError:
        return None


_made: dict[tuple[str, str], Aligner] = {}


def made(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _made:  # a worker serves many tasks
        _made[a_path, b_path] = Aligner(a_path, b_path)
    return _made[a_path, b_path]


ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def narrow_kind(most: int) -> np.dtype:
    return np.dtype("<u4" if most < 1 << 32 else "<i8")


def times_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(f"<u{len(raw) // n}") if n else np.uint8).astype(np.int64)


def as_times(w: np.ndarray) -> bytes:
    most = int(w.max()) if len(w) else 0
    return w.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u8").tobytes()


def encoder(a_path: str, b_path: str, kind: np.dtype):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = made(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, max(batch.num_rows, 1), 1000):  # what is handed on at once
                part = [valid(x.as_py()) for x in texts[at : at + 1000]]
                found = list(aligner.align(part))
                columns = [pa.array([x[0][k] for x in found], pa.int64()) for k in range(4)]
                columns += [pa.array([x[1] for x in found], pa.string()), pa.array([x[2].astype(kind).tobytes() for x in found], pa.binary()), pa.array([as_times(x[3]) for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 1000], *columns], names=[x.split()[0] for x in ENCODED.split(", ")])

    return encode


def counter(kind: np.dtype):
    """A function from rows of keys to (key, n): in how many of a task's rows each stands, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, new, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def taken():
            fresh, n = np.unique(np.concatenate(new), return_counts=True)
            return merged(np.concatenate([keys, fresh]), np.concatenate([sums, n]))

        def out():
            for a in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)]), pa.array(sums[a : a + (1 << 16)])], names=["key", "n"])

        for batch in batches:
            for x in batch.column(0):
                new.append(np.frombuffer(x.as_buffer() or b"", kind).astype(np.int64))
                size += len(new[-1])
                if size > GATHER_KEYS:
                    (keys, sums), new, size = taken(), [], 0
                    if len(keys) > HOLD_KEYS:
                        yield from out()
                        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        if new:
            keys, sums = taken()
        yield from out()

    return count


def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n) of one range to one file: equal keys stand in runs, whose counts are summed."""
    keys, sums = [], []
    for batch in batches:
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.flatnonzero(np.diff(k, prepend=-1))
        if len(first):
            k, n = k[first], np.add.reduceat(n, first)
            if keys and keys[-1][-1] == k[0]:  # a run goes on
                sums[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                sums.append(n.copy())
    if keys:
        table = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sums))], names=["key", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as w:
            w.write_batch(table)
        # the text writer ends a record with a separator: the last byte of the format
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()[:-1]], pa.binary())], names=["file"])


def columns_of(source: pa.Buffer | pa.NativeFile) -> tuple[np.ndarray, np.ndarray]:
    """A shard's keys and counts: views of its bytes."""
    batch = pa.ipc.open_file(source).get_batch(0)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def summary(width: int):
    """A function from shards (path, content) to (path, first key, ids of a, the highest count of each)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = columns_of(pa.BufferReader(raw.as_buffer()))
                ids = keys // width
                first = np.flatnonzero(np.diff(ids, prepend=-1))
                best = np.maximum.reduceat(n, first)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(keys[0])]), pa.array([ids[first]], pa.list_(pa.int64())), pa.array([best], pa.list_(pa.int64()))], names=["path", "first", "ids", "best"])

    return summarise


def mapped(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A shard mapped into memory. A store that cannot be mapped gives a copy, the task's own, that goes when it is closed."""
    if "://" not in path or path.startswith("file:"):
        return columns_of(pa.memory_map(re.sub("^file:(//)?", "", path)))
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with tempfile.NamedTemporaryFile() as own:
        with store.open_input_stream(name) as f:
            shutil.copyfileobj(f, own)
        own.flush()
        return columns_of(pa.memory_map(own.name))


class Shards:
    """Counts by key over shards in order, each mapped when first asked for."""

    def __init__(self, paths: list[str], firsts: np.ndarray):
        self.paths, self.firsts, self.open = paths, firsts, {}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which the shards have."""
        out, cuts = np.empty(len(keys), np.int64), np.append(np.searchsorted(keys, self.firsts), len(keys))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            if k not in self.open:
                self.open[k] = mapped(self.paths[k])
            have, n = self.open[k]
            out[cuts[k] : cuts[k + 1]] = n[np.searchsorted(have, keys[cuts[k] : cuts[k + 1]])]
        return out


def scorer(paths: list[str], firsts: np.ndarray, best: np.ndarray, width: int, kind: np.dtype):
    """A function from ENCODED to the same with n_best and count_sum in place of keys and times."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(paths, firsts)
        for batch in batches:
            held = [np.frombuffer(x.as_buffer() or b"", kind).astype(np.int64) for x in batch.column(6)]
            times = [times_of(x.as_py(), len(k)) for x, k in zip(batch.column(7), held, strict=True)]
            n_best, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            sizes = np.array([len(x) for x in held], np.int64)
            if sizes.sum():
                keys, which = np.unique(np.concatenate(held), return_inverse=True)
                n = shards.counts(keys)
                top = n == best[keys // width]
                t, doc = np.concatenate(times), np.repeat(np.arange(batch.num_rows), sizes)
                np.add.at(sums, doc, t * n[which])
                np.add.at(n_best, doc, t * top[which])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n_best), pa.array(sums), batch.column(5)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return score


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each row of docs (doc_id, text, ...) with its alignment and its different links (ENCODED)."""
    kind = narrow_kind(sizes_of(a_path, b_path)[0])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(in_arrow(rows, encoder(a_path, b_path, kind), ENCODED), "aligned")


def sizes_of(a_path: str, b_path: str) -> tuple[int, int, int]:
    """The number of possible keys, of ids of a and of ids of b."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    n_a = max([a.get_vocab_size() - 1, *a.get_added_tokens_decoder()]) + 1
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    return n_a * n_b, n_a, n_b


def write_shards(aligned: DataFrame, path: str, keys: int) -> None:
    """Counts of the pairs of ENCODED rows as sorted shards in a folder."""
    partial = written(in_arrow(aligned.select("keys"), counter(narrow_kind(keys)), "key long, n long"), "pair-counts")
    parts = 1 + partial.count() // SHARD_ROWS
    ranges = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    in_arrow(ranges, shard_of, "file binary").select(F.col("file").cast("string").alias("value")).write.option("lineSep", "1").text(path)


def shard_list(spark: SparkSession, path: str, n_a: int, n_b: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The shards in order, their first keys, and the highest count of each id of a: bounded by shards and vocabulary."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    found = sorted(in_arrow(files, summary(n_b), "path string, first long, ids array<long>, best array<long>").collect(), key=lambda r: r["first"])
    best = np.zeros(n_a, np.int64)
    for r in found:
        np.maximum.at(best, r["ids"], r["best"])
    return [r["path"] for r in found], np.array([r["first"] for r in found], np.int64), best


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every row of docs (doc_id, text, ...) aligned by a byte-level BPE file (a) and a piece model (b).

    Returns doc_id, n_a and n_b (ids), n_groups, n_links, n_best (links whose pair no other pair of their a id beats in
    documents), count_sum (documents that hold its pair, summed over links), groups_sha256. Null and empty texts, and texts
    that either tokenizer gives back changed, have zeros and an empty digest, and count for no pair; rows alike are
    documents of their own; an empty table gives an empty result; other columns are ignored. Both files must be readable
    at these paths on every executor. The shards go once the result is written.
    """
    spark = docs.sparkSession
    keys, n_a, n_b = sizes_of(a_path, b_path)
    path = new_path(spark, "pair-shards")
    with scratch(spark):
        try:
            aligned = encoded(docs, a_path, b_path)
            write_shards(aligned, path, keys)
            paths, firsts, best = shard_list(spark, path, n_a, n_b)
            schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
            return written(in_arrow(aligned, scorer(paths, firsts, best, n_b, narrow_kind(keys)), schema), "alignment", keep=True)
        finally:
            removed(spark, path)


def pairs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The pair table itself: a_id, b_id, documents."""
    spark = docs.sparkSession
    keys, _, n_b = sizes_of(a_path, b_path)
    with scratch(spark):
        aligned = encoded(docs, a_path, b_path)
        partial = in_arrow(aligned.select("keys"), counter(narrow_kind(keys)), "key long, n long")
        sums = partial.groupBy("key").agg(F.sum("n").alias("documents"))
        return written(sums.select(F.floor(F.col("key") / n_b).alias("a_id"), F.pmod("key", F.lit(n_b)).alias("b_id"), "documents"), "pairs", keep=True)
