import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import data
from tidemark.llm import token_files as K
from tidemark.llm import warc as W

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_token_round_trip(spark, tmp_path):
    tok = tokenizers.Tokenizer.from_file(PATH)
    path = f"file://{tmp_path}/tokens"
    K.write(data.docs(spark), path, PATH, 2, length=64, file_bytes=20_000)
    got = [tuple(r) for r in K.read(spark, path).collect()]
    want = [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in data.rows()]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(((a, n, c) for a, _, n, c in got), key=repr) == sorted(((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want), key=repr)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):  # the documents follow each other without gaps, in order
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [d for d, _ in want]
    for f in (tmp_path / "tokens").glob("part-*"):  # whole Arrow files, mapped without copying
        with pa.memory_map(str(f)) as m:
            t = pa.ipc.open_file(m).read_all()
            before = pa.total_allocated_bytes()
            row = t.column("input_ids").chunk(0).flatten().slice(0, 64).to_numpy()
            assert len(row) == 64 and pa.total_allocated_bytes() == before
            assert t.schema.field("input_ids").type.list_size == 64


def test_no_documents(spark):
    assert K.round_trip(data.nothing(spark), PATH, 2).collect() == []


def test_words_equal_whole_texts(monkeypatch):
    w = K.WordIds(PATH)
    rnd = random.Random(3)
    odd = ["<|ENDOFTEXT|>", "x <|EndOfText|> y", "a<|STARTOFTEXT|>b", "one<|startoftext|>two <|end oftext|> <|endoftext|", "it's they'll x.y, ok. <|endoftext|> A.B.", "É́ İstanbul ΣΑΣ ΟΔΟΣ. ﬁne ½ ² 語言 a b c", "áb ́x", "# #x x# 12,5. don't", "ǅ Ɖ ß ẞ.", ""]
    texts = odd + [data.prose(rnd, 50) for _ in range(20)] + ["".join(rnd.choice("ab.,' \n\tÉé1#语") for _ in range(200)) for _ in range(200)] + ["".join(rnd.choice("astlv'$%.!( \n×÷éŁ\u0301…\u00a0ñ9-_") for _ in range(120)) for _ in range(1500)]
    want = [w.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in w.encode(pa.array(texts))] == want
    monkeypatch.setattr(K, "STEP_BYTES", 60)
    monkeypatch.setattr(K, "CACHE_WORDS", 50)
    assert [x.tolist() for x in w.encode(pa.array(["skip", *texts]).slice(1))] == want
    assert [x.tolist() for x in w.encode(pa.array([None, "a"]))][0] == []


def test_tokenizers_that_do_not_work_by_words(tmp_path):
    """A cased byte-level tokenizer, and the usual one without its folding: whole texts are encoded."""
    import json

    with open(PATH, encoding="utf-8") as f:
        cased = json.load(f)
    cased["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    rnd = random.Random(4)
    texts = ["Hello HELLO hello.", "", "tabs\tand  spaces", "<|endoftext|> <|ENDOFTEXT|>"] + ["".join(rnd.choice("abAB.,' \n#") for _ in range(100)) for _ in range(50)]
    for path in (public.path("byte_bpe_50k.json"), str(tmp_path / "cased.json")):
        w = K.WordIds(path)
        assert not w.by_words
        assert [x.tolist() for x in w.encode(pa.array(texts))] == [w.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert K.WordIds(PATH).by_words


def test_letters_beside_marks_are_encoded_as_in_whole_texts():
    """Every letter from U+00C0 to U+017F before and after every ASCII mark, alone and within words."""
    w = K.WordIds(PATH)
    letters = [c for c in map(chr, range(0xC0, 0x180)) if c.isalpha()]
    marks = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    texts = [t for a in letters for m in marks for t in (f"{a}{m}", f"{m}{a}", f"x{a}{m} y{m}{a}z")]
    texts += ["HABERİ, yeni", "(Prof. İ. Aksoy)", "İ.", "İ" * 30 + "!", "ı.İ-i̇,I"]
    assert w.by_words
    for text, ids in zip(texts, w.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == w.tok.encode(text, add_special_tokens=False).ids, text


def captures():
    rnd = random.Random(8)
    big = data.prose(rnd, 40)
    rows = [(i, f"http://{rnd.choice(('a', 'www.B', 'c.d'))}.example.org/{rnd.randrange(8)}?q={i % 3}#f", 1_700_000_000 + rnd.randrange(1000), rnd.choice((big, big + "é", "short", None, "", big * 3))) for i in range(60)]
    return rows + [(100, None, 5, big), (None, "not a url", None, big), (101, "http://x.org/\r\nInjected: 1", 7, "\r\n\r\nWARC/1.1\r\n" * 30), (102, "HTTP://user@X.org:80", 8, "x" * 300_000)]


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rows = captures()
    df = spark.createDataFrame(rows, "id long, url string, seconds long, payload string").repartition(3)
    monkeypatch.setattr(W, "FILE_BYTES", 3000)
    path = f"file://{tmp_path}/warc"
    W.write(df, path)
    got = W.index(spark, path).collect()
    first = {}
    for r in rows:
        p = (r[3] or "").encode()
        if len(p) >= 100 and r[0] is not None:
            first[p] = min(first.get(p, r[0]), r[0])
    want = []
    for id_, _, _, t in rows:
        p = (t or "").encode()
        lead = first.get(p)
        again = len(p) >= 100 and lead is not None and id_ != lead
        want.append((id_, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", lead if again else None))
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(want, key=repr)
    files = {"/".join(p.parts[-2:]): p.read_bytes() for p in (tmp_path / "warc").rglob("part-*")}
    assert len(files) > 3
    for r in got:  # every record can be read on its own, and every file as one gzip stream
        raw = files["/".join(r["run"].split("/")[-2:])][r["offset"] : r["offset"] + r["length"]]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
    for raw in files.values():
        gzip.decompress(raw)


def test_index_is_in_global_order(spark, tmp_path):
    df = spark.createDataFrame(captures(), "id long, url string, seconds long, payload string").repartition(5)
    W.write(df, f"file://{tmp_path}/w")
    lines = [(r["url_key"], r["captured"]) for r in W.index(spark, f"file://{tmp_path}/w").collect()]
    assert lines == sorted(lines)


def test_no_pages_and_columns_that_clash(spark, tmp_path):
    ddl = "id long, url string, seconds long, payload string, digest string, key long, first long, `file` string, member int, `__key` string, `__digest` int"
    rows = [(*r, "d", 1, 2, "f", 3, "k", 4) for r in captures()]
    for name, some in (("none", []), ("some", rows)):
        W.write(spark.createDataFrame(some, ddl), f"file://{tmp_path}/{name}")
        got = W.index(spark, f"file://{tmp_path}/{name}")
        assert got.count() == len(some)
    W.write(spark.createDataFrame(captures(), "id long, url string, seconds long, payload string"), f"file://{tmp_path}/plain")
    of = lambda name: sorted(map(repr, W.index(spark, f"file://{tmp_path}/{name}").select("id", "payload_digest", "record_type", "refers_to").collect()))
    assert of("some") == of("plain")


def test_large_payloads_stay_in_one_file(spark, tmp_path, monkeypatch):
    """Records of several members, each larger than a file is meant to be."""
    monkeypatch.setattr(W, "MEMBER_BYTES", 5000)
    monkeypatch.setattr(W, "FILE_BYTES", 2000)
    rnd = random.Random(3)
    rows = [(i, f"http://x.org/{i}", i, "".join(rnd.choices("abcdefgh ", k=20_000 * (1 + i % 3)))) for i in range(12)]
    W.write(spark.createDataFrame(rows, "id long, url string, seconds long, payload string").repartition(2), f"file://{tmp_path}/w")
    got = {r["id"]: r["payload_digest"] for r in W.index(spark, f"file://{tmp_path}/w").collect()}
    assert got == {r[0]: hashlib.sha256(r[3].encode()).hexdigest() for r in rows}
    assert len(list((tmp_path / "w").rglob("part-*"))) == 12


@pytest.mark.parametrize("runs", [0, 1, 3, 40])
def test_runs_are_merged_in_passes_from_spill_files(monkeypatch, runs):
    monkeypatch.setattr(W, "FAN_IN", 3)
    monkeypatch.setattr(W, "BLOCK_LINES", 4)
    monkeypatch.setattr(W, "HELD_LINES", 25)
    rnd = random.Random(runs)
    lines = []
    for k in range(runs):
        own = sorted((f"k{rnd.randrange(9)}", rnd.randrange(5)) for _ in range(rnd.randrange(1, 14)))
        lines += [(*x, f"run{k:03}", i, 0, 1, "u", k, 2, "d", "response", None) for i, x in enumerate(own)]
    table = pa.Table.from_batches([W.batch_of(lines)]) if lines else W.LINE.empty_table()
    got = [x for b in W.merged_runs(iter(table.to_batches(max_chunksize=7))) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert got == sorted(lines, key=lambda x: x[:4])


def test_large_records_are_several_members(monkeypatch):
    monkeypatch.setattr(W, "MEMBER_BYTES", 1000)
    payload = random.Random(1).randbytes(5000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["http://a.org/"]), pa.array([5]), pa.array([hashlib.sha256(payload).hexdigest()]), pa.array([payload], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=list("abcdefg"))
    raw = b"".join(m.as_py() + b"\0" for out in W.file_cutter(1 << 20)(iter([batch])) for m in out.column(0))
    (one,) = list(W.records_of(memoryview(raw)))
    assert one[3].endswith(payload) and (one[0], one[1]) == (0, len(raw))
    with pytest.raises(ValueError):
        list(W.records_of(memoryview(raw[:-20])))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randrange(20), i, j) for j in range(rnd.randrange(12))) for i in range(k)]
    runs = [[(a, i, j) for j, (a, _, _) in enumerate(r)] for i, r in enumerate(runs)]
    assert list(W.LoserTree(runs, lambda x: x[0])) == sorted(x for r in runs for x in r)


def test_url_key():
    assert W.url_key("https://www.A.Example.org:8080/Path?x=1#f") == "org,example,a)/path?x=1"
    assert W.url_key("http://a.org") == "org,a)/" and W.url_key(None) == ""
