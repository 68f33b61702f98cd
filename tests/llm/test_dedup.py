import hashlib
import random
import re
from collections import defaultdict

import pytest

from tests.llm import data
from tidemark.llm import exact_dedup as D


def norm(t):
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode())


def test_against_brute_force(spark):
    got = [tuple(r) for r in D.exact_dedup(data.docs(spark)).collect()]
    groups = defaultdict(list)
    for r in data.rows():
        groups[norm(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    key = lambda r: repr(r)
    assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=key) == sorted(want, key=key)
    assert sum(r[3] for r in got) == len(groups)
    assert all(r[0] == r[1] for r in got if r[3])


def test_nothing(spark):
    assert D.exact_dedup(data.nothing(spark)).collect() == []


def test_normalised():
    for t in ["", " ", "a", " a", "a ", " \t a \n b\x0b\x0c\r c  ", "  x  "]:
        assert D.normalised(t.encode()) == norm(t)


@pytest.mark.parametrize("budget", [1, 2000, 1 << 30])
def test_spill_files_change_nothing(budget):
    rnd = random.Random(1)
    contents = [bytes([rnd.randrange(5)]) * rnd.randrange(1, 40) for _ in range(2000)]
    h = lambda c: int.from_bytes(hashlib.sha256(c).digest()[:8], "big")
    found = defaultdict(set)
    for bucket in D.grouped(iter((h(c), c, i) for i, c in enumerate(contents)), budget):
        part = defaultdict(set)
        for k, i in bucket:
            part[k].add(i)
        for ids in part.values():
            found[contents[min(ids)]] |= ids
            assert len({contents[i] for i in ids}) == 1
    assert {frozenset(v) for v in found.values()} == {frozenset(i for i, x in enumerate(contents) if x == c) for c in contents}


def test_table_compares_contents():
    t = D.Table(2)
    assert [t.add(7, b"a"), t.add(7, b"b"), t.add(7, b"a"), t.add(11, b"c"), t.add(7, b"b")] == [0, 1, 0, 2, 1]
