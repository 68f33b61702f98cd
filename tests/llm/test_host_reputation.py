import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import host_reputation as H

PAGES = "page_id long, url string, html string, host string, path string, rule string, bad string"
RULES = "host string, path string, verdict string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def split(host):
    name = host.rsplit("@", 1)[-1] if "@" in host else host
    head, _, port = name.rpartition(":")
    name = head if head and (port == "" or port.isdigit()) else name
    name = name[:-1] if name.endswith(".") else name
    labels = name.split(".")
    k = 2 if len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in H.SECOND_LEVEL else 1
    if labels[-1].isdigit() or not labels[-1]:
        return name, name
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def variance(rows):
    """Weight of a prior from (parent, n, bad) of each group, by the nested analysis of variance over single outcomes."""
    rows = [r for r in rows if r[1]]
    parents = defaultdict(list)
    for p, n, k in rows:
        parents[p].append((n, k))
    total, groups = sum(r[1] for r in rows), len(rows)
    between = within = squares = 0.0
    for of in parents.values():
        n, k = sum(x for x, _ in of), sum(y for _, y in of)
        between += sum(x * (y / x - k / n) ** 2 for x, y in of)
        within += sum(y * (1 - y / x) ** 2 + (x - y) * (y / x) ** 2 for x, y in of)
        squares += sum(x * x for x, _ in of) / n
    up = len(parents)
    if groups <= up or total <= groups:
        return 10.0
    spread, noise, each = between / (groups - up), within / (total - groups), (total - squares) / (groups - up)
    if spread + (each - 1) * noise <= 0:
        return 10.0
    shared = (spread - noise) / (spread + (each - 1) * noise)
    return min(max(1 / shared - 1, 1.0), 1000.0) if shared > 1e-12 else 1000.0


def brute(pages, outcomes, rules, limit=0.5):
    by_page = defaultdict(list)
    for i, bad in outcomes:
        if i is not None and bad is not None:
            by_page[i].append(bad)
    hosts = defaultdict(lambda: [0, 0])
    for i, url in pages:
        own = by_page.get(i, [])
        host = hosts[parts(url)[0]]
        host[0] += len(own)
        host[1] += sum(own)
    level = {h: (*split(h), *nk) for h, nk in hosts.items()}
    domains, suffixes = defaultdict(lambda: [None, 0, 0]), defaultdict(lambda: [0, 0])
    for d, s, n, k in level.values():
        domains[d] = [s, domains[d][1] + n, domains[d][2] + k]
        suffixes[s] = [suffixes[s][0] + n, suffixes[s][1] + k]
    all_n, all_k = sum(n for n, _ in suffixes.values()), sum(k for _, k in suffixes.values())
    c_host = variance([(d, n, k) for d, _, n, k in level.values()])
    c_domain = variance([(s, n, k) for s, n, k in domains.values()])
    c_suffix = variance([("", n, k) for n, k in suffixes.values()])
    top = (all_k + 1) / (all_n + 2)
    of_suffix = {s: (k + c_suffix * top) / (n + c_suffix) for s, (n, k) in suffixes.items()}
    of_domain = {d: (k + c_domain * of_suffix[s]) / (n + c_domain) for d, (s, n, k) in domains.items()}
    out = []
    for i, url in pages:
        host, path = parts(url)
        d, _, n, k = level[host]
        a, b = k + c_host * of_domain[d], n - k + c_host * (1 - of_domain[d])
        mean = a / (a + b)
        bound = mean - 1.645 * math.sqrt(mean * (1 - mean) / (a + b + 1))
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fit)[3], max(fit)[2]) if fit else (None, "block" if bound > limit else "allow")
        out.append((i, host, path, rule, verdict, n, k, round(mean, 9), round(bound, 9)))
    return out


def odd_pages():
    urls = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/1?x#y", "https://example.net", "https://example.net/", "https://example.net/en", "https://example.net/en/", "x://a.b.example.com/de/x?q=/fr/", "x://org/fr/", "x://notorg/fr/", "x://a.org/fr/#z", "x://a.org/FR/", "a://u@h.co.uk:80/p", "a://h.co.uk/p", "a://b.h.co.uk./p", "a://10.0.0.1/x", "a://10.0.0.2/x", "a://É.example.org/fr/", "a://b://c/d", "x://" + "long." * 2000 + "com/" + "p" * 50_000, "x://a.net?q", "x://a.net#f", "a://x.y\nz.com/\nq"]
    rows = [(i, u) for i, u in enumerate(urls)]
    for k in range(40):  # hosts of a few domains, good and bad ones
        rows += [(100 + 10 * k + j, f"http://h{k}.d{k % 7}.{('com', 'org', 'net', 'de')[k % 4]}/{j}") for j in range(1 + k % 9)]
    return [*rows, rows[5], rows[5], (None, "http://h1.d1.org/x"), (None, None), (5, "http://other.org/en")]


def odd_outcomes():
    out = [(i, int(i % 7 == 3 or (100 <= i and (i // 10) % 4 == 1))) for i, _ in odd_pages() if i is not None and i % 3]
    return [*out, (5, 1), (5, 0), (None, 1), (8, None), (10**6, 1)]


def judged(spark, pages, outcomes, rules, **more):
    df = spark.createDataFrame([(i, u, "h", "own", "own", "own", "own") for i, u in pages], PAGES).repartition(3)
    out = H.judge(df, spark.createDataFrame(outcomes, "page_id long, bad long"), spark.createDataFrame(rules, RULES), **more)
    return [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["labelled"], r["bad"], round(r["bad_rate"], 9), round(r["bad_bound"], 9)) for r in out.collect()]


@pytest.mark.parametrize("salted", [False, True])
def test_judge_against_brute_force(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    rules = [*H.RULES, ("a.org", "/", "allow"), ("d3.net", "", "block")]
    got = judged(spark, odd_pages(), odd_outcomes(), rules)
    assert Counter(got) == Counter(brute(odd_pages(), odd_outcomes(), rules))
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_contract_rules(spark):
    urls = {"http://x.net/": "net/", "http://x.net": None, "http://example.net/en/a": "example.net/en/", "http://m.example.net/en": "net/", "http://www.example.com/de/": "example.com/de/", "http://a.org/fr/": "org/fr/", "http://morg/fr/": None, "http://EXAMPLE.net/EN/": "net/"}
    got = {r[0]: (r[3], r[4]) for r in judged(spark, list(enumerate(urls)), [], H.RULES)}
    assert [got[i][0] for i in range(len(urls))] == list(urls.values())
    assert [got[i][1] for i in range(4)] == ["block", "allow", "allow", "block"]


def test_a_few_bad_pages_on_a_small_host_are_not_enough(spark):
    pages = [(20 * h + j, f"http://d{h}.com/{j}") for h in range(40) for j in range(20)] + [(1000 + i, "http://small.com/x") for i in range(2)] + [(2000, "http://new.com/x")]
    outcomes = [(20 * h + j, int(j < (18 if h == 7 else h % 5))) for h in range(40) for j in range(20)] + [(1000, 1), (1001, 1)]
    assert {r[1] for r in judged(spark, pages, outcomes, H.RULES) if r[4] == "block"} == {"d7.com"}
    df = spark.createDataFrame(pages, "page_id long, url string")
    kept = H.kept(df, spark.createDataFrame(outcomes, "page_id long, bad long"), spark.createDataFrame(H.RULES, RULES))
    assert kept.count() == len(pages) - 20


def test_empty_tables(spark):
    assert judged(spark, [], odd_outcomes(), H.RULES) == []
    got = judged(spark, odd_pages(), [], [])
    assert Counter(got) == Counter(brute(odd_pages(), [], [])) and {r[4] for r in got} == {"allow"}


def test_outcomes(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 1), (5, None, None), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["page_id"]: r["bad"] for r in H.outcomes_of(labels).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 6: 0}


def test_suffixes(spark):
    want = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.de": ("a.de", "de"), "de": ("de", "de"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "": ("", ""), "u:p@a.b.org:8080": ("b.org", "org")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r["host"]: (r["d"], r["s"]) for r in df.select("host", H.domain_of(F.col("host")).alias("d"), H.suffix_of(F.col("host")).alias("s")).collect()} == want
