"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def repeats(docs, n, split, join):
    """(units, removed mask) by row: windows of n units that start in a document of smaller id too."""
    units = [(i, split(t or "")) for i, t in docs]
    least = {}
    for i, u in units:
        for k in range(len(u) - n + 1):
            w = join(u[k : k + n])
            least[w] = min(i, least.get(w, i))
    for i, u in units:
        gone = [False] * len(u)
        for k in range(len(u) - n + 1):
            if least[join(u[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        yield i, u, gone


def op10(docs):
    return sorted((i, len(u), sum(g), sha(" ".join(w for w, x in zip(u, g) if not x).encode())) for i, u, g in repeats(docs, 13, WORD.findall, tuple))


def op7(docs):
    out = []
    for i, u, g in repeats(docs, 50, lambda t: t.encode(), bytes):
        spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        out.append((i, len(u), sum(g), spans, sha(bytes(b for b, x in zip(u, g) if not x))))
    return sorted(out)


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def op2(docs):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    post = defaultdict(list)
    for i, s in sorted(sets.items()):
        for x in s:
            post[x].append(i)
    common = Counter()
    for ids in post.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


def op6(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = set()
        for k in range(len(w) - 2):
            if n[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return sorted(out)


WORD9 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def op9(docs, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD9.findall(lower(t or ""))
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                wins[tuple(w[k : k + window])].add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w = WORD9.findall(lower(t or ""))
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return sorted(out, key=str)


PHRASES = ("all rights reserved", "licensed under the", "released under the", "this work is licensed", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "enable javascript", "copyright (c)", "©", "redistribution and use in source", "permission is hereby granted")


def op6_lines(docs):
    """(doc_id, base_failed, lost_words, kept) by the rules on lines, one line at a time."""
    failed = {r[0]: r[-1] for r in op6(docs)}
    out = []
    for i, t in docs:
        seen, lost = set(), 0
        for line in (t or "").split("\n"):
            n = len(WORD.findall(line))
            if not n:
                continue
            low = lower(line)
            loud = sum(a in "!?" and b in "!?" for a, b in zip(line, line[1:]))
            marks = sum(line.count(c) for c in "|>»·•")
            bad = line in seen or sum(line.count(c) for c in "#*$%&|<>") > 0.3 * n or loud > 0.3 * n
            bad |= n <= 30 and any(p in low for p in PHRASES)
            bad |= n <= 30 and marks >= 2 and n <= 3 * (marks + 1)
            bad |= 100 * sum("://" in w or "www." in w for w in WORD.findall(low)) > 50 * n
            seen.add(line)
            lost += n * bad
        words = len(WORD.findall(t or ""))
        out.append((i, failed[i], lost, not failed[i] and 100 * lost <= 50 * words))
    return sorted(out)
