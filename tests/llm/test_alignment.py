import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from tests.llm import data
from tidemark.llm import alignment as A
from tidemark.llm import queries

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", "the", "ing", "é", "İ", " ", "  ", "\n", "\t", "\u2581", "<s>", "<0x41>", "<|endoftext|>", "1", "12", "'s", "...", "日本", "\u00a0", "\u3000", "ﬁ", "\U0001f600", "\x1c", "\x85", "e\u0301", "\u180e", "Ｈ", "\r\n", "\x00", " \u0301", "\u200b"]


class Brute:
    """Whole texts by the libraries, groups and links by plain loops."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        self.chars = A.byte_of_char()

    def a_bytes(self, i):
        return bytes(self.chars[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def groups(self, text):
        if not text:
            return []
        x, y = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole, a, b = (" " + text).encode(), [self.a_bytes(i) for i in x], [self.b_bytes(i) for i in y]
        if b"".join(a) != whole or b"".join(b) != whole:
            return []
        out, i, j, p, q = [([], [])], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if p <= q and i < len(x):
                out[-1][0].append(x[i])
                p, i = p + len(a[i]), i + 1
            else:
                out[-1][1].append(y[j])
                q, j = q + len(b[j]), j + 1
            if p == q:
                out.append(([], []))
        return out[:-1]

    def rows(self, docs):
        found = [self.groups(t) for _, t in docs]
        links = [Counter((p, q) for x, y in g for p in x for q in y) for g in found]
        n = Counter(k for c in links for k in c)
        best = defaultdict(int)
        for (p, _), k in n.items():
            best[p] = max(best[p], k)
        out = []
        for (i, _), g, c in zip(docs, found, links, strict=True):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(m for k, m in c.items() if n[k] == best[k[0]]), sum(m * n[k] for k, m in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return out, n


@pytest.fixture(scope="module")
def whole():
    return Brute()


def test_byte_level_names():
    """The rule for names of bytes says what the library's own decoder does."""
    assert all(decoders.ByteLevel().decode([c]) == bytes([b]).decode("utf-8", "replace") for c, b in A.byte_of_char().items())
    assert sorted(A.byte_of_char().values()) == list(range(256))


@pytest.mark.parametrize("step", [5, 60, 1 << 20])
@pytest.mark.parametrize("most", [2, 1 << 16])
def test_words_align_like_whole_texts(monkeypatch, whole, step, most):
    monkeypatch.setattr(A, "STEP_CHARS", step)
    monkeypatch.setattr(A, "GROUP_LINKS", most)
    monkeypatch.setattr(A, "CACHE_WORDS", 500)
    aligner, rnd = A.Aligner(A_PATH, B_PATH), random.Random(step + most)
    assert aligner.by_words
    for _ in range(12):
        texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 25))) for _ in range(30)] + [None, "", " ", "  ", "a ", " a", "\n", "x" * 300]
        for text, (facts, digest, keys, times) in zip(texts, aligner.align(texts), strict=True):
            groups = whole.groups(text)
            links = Counter(p * aligner.width + q for x, y in groups for p in x for q in y)
            assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == links and (sorted(keys.tolist()) == keys.tolist())
            assert facts == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()))
            said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert digest == (hashlib.sha256(said.encode()).hexdigest() if groups else "")


def test_whole_texts_where_words_are_not_sound(monkeypatch, whole):
    monkeypatch.setattr(A, "by_words", lambda *_: False)
    aligner = A.Aligner(A_PATH, B_PATH)
    texts = ["The quick brown fox", " two  spaces\n", None, "", "\u2581"]
    assert [x[0][2] for x in aligner.align(texts)] == [len(whole.groups(t)) for t in texts]


def odd_rows():
    rnd = random.Random(6)
    out = [(r[0], r[1]) for r in data.rows()]
    out += [(500 + i, "".join(rnd.choice(BITS) for _ in range(40))) for i in range(60)]
    return [*out, (None, "the end"), (None, "the end")]


@pytest.mark.parametrize("small", [False, True])
def test_align_against_brute_force(spark, monkeypatch, whole, small):
    """Also with many shards, counts handed on early, and keys in 64 bits."""
    if small:
        monkeypatch.setattr(A, "SHARD_ROWS", 500)
        monkeypatch.setattr(A, "narrow_kind", lambda most: A.np.dtype("<i8"))
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want, n = whole.rows(rows)
    assert Counter(tuple(r[c] for c in names) for r in A.align(docs, A_PATH, B_PATH).collect()) == Counter(want)
    if small:
        assert {(r["a_id"], r["b_id"]): r["documents"] for r in A.pairs(docs, A_PATH, B_PATH).collect()} == n


def test_query_against_brute_force(spark, whole):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = whole.rows(rows)
    got = queries.op12_token_alignment(spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_counts_are_handed_on_early(monkeypatch):
    monkeypatch.setattr(A, "GATHER_KEYS", 3)
    monkeypatch.setattr(A, "HOLD_KEYS", 4)
    keys = [[1, 5, 9], [5], [2, 3, 4, 5, 6, 7], [], [1, 2]]
    batch = A.pa.RecordBatch.from_arrays([A.pa.array([A.np.array(k, "<u4").tobytes() for k in keys])], names=["keys"])
    out = Counter()
    for b in A.counter(A.np.dtype("<u4"))([batch]):
        for k, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            out[k] += n
    assert out == Counter(k for x in keys for k in x)


def test_runs_go_on_over_batches():
    batches = [A.pa.RecordBatch.from_arrays([A.pa.array(k, A.pa.int64()), A.pa.array([1] * len(k), A.pa.int64())], names=["key", "n"]) for k in ([0, 0, 1], [1, 1], [], [1, 2, 7], [7])]
    raw = next(A.shard_of(iter(batches))).column(0)[0].as_py() + b"1"
    keys, n = A.columns_of(A.pa.BufferReader(raw))
    assert (keys.tolist(), n.tolist()) == ([0, 1, 2, 7], [2, 4, 1, 2])


def test_empty_table_and_clashing_columns(spark):
    assert A.align(data.nothing(spark), A_PATH, B_PATH).count() == 0
    docs = data.docs(spark)
    more = docs.select("*", *[F.lit("own").alias(x) for x in ("n_a", "keys", "times", "n_best", "count_sum", "n", "path")])
    assert Counter(map(tuple, A.align(more, A_PATH, B_PATH).collect())) == Counter(map(tuple, A.align(docs, A_PATH, B_PATH).collect()))


def test_shards_go(spark):
    from pathlib import Path

    from tidemark.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "tidemark"
    before = set(folder.iterdir()) if folder.exists() else set()
    A.align(data.docs(spark), A_PATH, B_PATH).count()
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["alignment"]
