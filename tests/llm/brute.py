"""Plain versions of operators, row by row, that share no code with them."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = r"[^\x20\x09-\x0D]+"


def line_chunks(lines):
    """(first, last) of each chunk of lines, from 0: from one cut line to the next."""
    rolls = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    n = len(lines)
    cuts = [0, *[i for i in range(1, n - 1) if (rolls[i] * 1_000_003 + rolls[i + 1]) % 4294967291 % 8], n - 1] if n > 1 else []
    return list(zip(cuts, cuts[1:], strict=False))


def lines_left(docs):
    """(doc_id, text) in order to what is left of each text once the runs of chunks that stood before are gone."""
    solid = lambda x: re.search(r"[^\x20\x09-\x0D]", "".join(x))
    lines = [t.split("\n") for _, t in docs]
    cut = [line_chunks(x) for x in lines]
    places = defaultdict(list)
    for d, own in enumerate(lines):
        for f, e in cut[d]:
            if solid(own[f : e + 1]):
                places[tuple(own[f : e + 1])].append((d, f))
    out = {}
    for d, own in enumerate(lines):
        found = [(f, e, *places[tuple(own[f : e + 1])][0]) for f, e in cut[d] if len(places.get(tuple(own[f : e + 1]), [])) > 1]
        groups = []
        for x in found:
            last = groups[-1][-1] if groups else None
            if last and last[1] == x[0] and last[2] == x[2] and last[3] - last[0] == x[3] - x[0]:
                groups[-1].append(x)
            else:
                groups.append([x])
        there = {(f, e) for f, e, _, _ in found}
        spans = []
        for g in groups:
            f, e, k, kf = g[0][0], g[-1][1], g[0][2], g[0][3]
            begin, end, shift, kept = f, e, kf - f, (k, kf) == (d, f)
            before = next((c for c in cut[d] if c[1] == f), None)
            after = next((c for c in cut[d] if c[0] == e), None)
            k_before = next((c for c in cut[k] if c[1] == f + shift), None)
            k_after = next((c for c in cut[k] if c[0] == e + shift), None)
            if not kept and before and before not in there and k_before:
                while begin > before[0] and begin + shift > k_before[0] and own[begin - 1] == lines[k][begin - 1 + shift]:
                    begin -= 1
            if not kept and after and after not in there and k_after:
                while end < after[1] and end + shift < k_after[1] and own[end + 1] == lines[k][end + 1 + shift]:
                    end += 1
            spans.append((begin, end, f, e, kept))
        spans.sort(key=lambda x: x[:2])
        dead, stay = set(), set()
        for i, (begin, end, f, e, kept) in enumerate(spans):
            size = own_lines = end - begin + 1
            if i and spans[i - 1][1] - spans[i - 1][0] + 1 >= size:
                own_lines -= max(spans[i - 1][1] - begin + 1, 0)
            if i + 1 < len(spans) and spans[i + 1][1] - spans[i + 1][0] + 1 > size:
                own_lines -= max(end - spans[i + 1][0] + 1, 0)
            if kept or own_lines == 1:
                stay |= set(range(f, e + 1))
            elif own_lines >= 2:
                dead |= set(range(begin, end + 1))
        dead -= stay
        dead = {i for i in dead if i - 1 in dead or i + 1 in dead}
        out[docs[d][0]] = "\n".join(x for i, x in enumerate(own) if i not in dead)
    return out


def trigrams(text):
    """Bucket of each trigram with a letter in its middle: letters in lower case, all else as spaces."""
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    raw = [b + 32 if 65 <= b <= 90 else b if letter(b) else 32 for b in (text or "").encode()]
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(raw) - 2) if raw[i + 1] != 32]


def language_model(labelled):
    """[(text, lang)] of few rows, all of which are used, to logarithms by language and bucket."""
    counts = defaultdict(Counter)
    for text, lang in labelled:
        if lang and text is not None:
            counts[lang].update(trigrams(text))
    return {lang: (c, sum(c.values()) + 0.1 * (1 << 16)) for lang, c in counts.items()}


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def identified(model, rows, suffixes):
    """[(text, declared, host, suffix)] to (language, probability, accepted) of each, all evidence fused."""
    names = sorted(model)
    width = len(names) + 1
    logs, own, seen = [], [], []
    for text, _, _, _ in rows:
        t = Counter(trigrams(text))
        logs.append([sum(n * math.log((model[x][0][b] + 0.1) / model[x][1]) for b, n in t.items()) / 3 for x in names] + [-sum(t.values()) * 16 * math.log(2) / 3])
        seen.append(bool(t))
        own.append(softmax(logs[-1]) if t else [0.0] * width)
    add = lambda vs: [sum(v) for v in zip(*vs, [0.0] * width, strict=True)]
    host = [h or "" for _, _, h, _ in rows]
    domain = [".".join(h.split(".")[-2:]) for h in host]
    by = lambda keys: {k: add([o for o, x in zip(own, keys, strict=True) if x == k]) for k in set(keys)}
    by_host, by_domain, overall = by(host), by(domain), add(own)
    said = []
    for _, d, _, _ in rows:
        m = re.match(r"\s*([A-Za-z]+)", d or "")
        said.append(m[1].lower() if m else None)
    agree = [[10 / width] * width for _ in range(width)]
    for s, o, z in zip(said, own, seen, strict=True):
        if s is not None and z:
            k = names.index(s) if s in names else width - 1
            agree[k] = [a + b for a, b in zip(agree[k], o, strict=True)]
    total = add(agree)
    out = []
    for i, (_, _, _, suffix) in enumerate(rows):
        part = lambda x, i=i: [max(a - b, 0) for a, b in zip(x, own[i], strict=True)]
        norm = lambda x: [v / sum(x) for v in x]
        p = norm([v + 1 for v in part(overall)])
        p = norm([v + 20 * q for v, q in zip(part(by_domain[domain[i]]), p, strict=True)])
        p = norm([v + 20 * q for v, q in zip(part(by_host[host[i]]), p, strict=True)])
        x = [a + math.log(b) for a, b in zip(logs[i], p, strict=True)]
        if said[i] is not None:
            k = names.index(said[i]) if said[i] in names else width - 1
            x = [v + math.log(agree[k][j] / total[j]) for j, v in enumerate(x)]
        if suffixes.get(suffix or "") in names:
            k = names.index(suffixes[suffix])
            x = [v + math.log(0.2 / width + (0.8 if j == k else 0)) for j, v in enumerate(x)]
        p = softmax(x)
        best = p.index(max(p))
        out.append((names[best] if best < width - 1 else "und", p[best], seen[i] and best < width - 1))
    return out


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, goal, out = set(order), share * sum(sizes.values()), {}
    while left:
        rest = goal - sum(out.values())
        part = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        full = {s for s in left if part[s] > most * sizes[s]}
        if not full:
            out |= part
            break
        out |= {s: most * sizes[s] for s in full}
        left -= full
    return out


def mixed(docs, seed=7, draws=32):
    """[(doc_id, text, source)] to how often each is taken."""
    size = [len(re.findall(WORD, t or "")) for _, t, _ in docs]
    sums = Counter()
    for n, (_, _, s) in zip(size, docs, strict=True):
        sums[s] += n
    target = water(sums)
    rate = {s: target[s] / sums[s] if sums[s] else 0.0 for s in sums}
    number = lambda k, d, n: int(hashlib.md5(f"{k}:{'null' if d is None else d}:{n}".encode()).hexdigest()[:13], 16) / 2.0**52
    copies = lambda k, i: int(rate[docs[i][2]]) + (number(k, docs[i][0], size[i]) < rate[docs[i][2]] % 1)
    best = {}
    for s in sums:
        own = [i for i, d in enumerate(docs) if d[2] == s]
        best[s] = min(range(seed, seed + draws), key=lambda k: (abs(sum(size[i] * copies(k, i) for i in own) - target[s]), k))  # noqa: B023
    return [copies(best[d[2]], i) for i, d in enumerate(docs)]
