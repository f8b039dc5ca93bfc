"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

PLAIN = re.compile(rb"[^\x20\x09-\x0D]+")
LETTERS = re.compile(rb"[0-9a-z\x80-\xff]+")


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = PLAIN.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in reach(ids, links).items()}


def decontaminate(docs, items, window):
    patterns = defaultdict(set)
    for i, t in items:
        w = LETTERS.findall(lower(t))
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m and i is not None else 0):
            patterns[tuple(w[j : j + m])].add(i)
    out = []
    for i, t in docs:
        w = LETTERS.findall(lower(t))
        hit, found = set(), set()
        for m in {len(p) for p in patterns}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in patterns:
                    hit |= set(range(j, j + m))
                    found |= patterns[tuple(w[j : j + m])]
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), sha(names.encode()), bool(hit)))
    return out


def substrings(docs, window):
    words = [(float("inf") if i is None else i, PLAIN.findall((t or "").encode())) for i, t in docs]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, w), (doc, _) in zip(words, docs):
        gone = {x for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for x in range(j, j + window)}
        out.append((doc, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def suffixes(docs, length):
    raws, count = [(t or "").encode() for _, t in docs], defaultdict(int)
    for r in raws:
        for j in range(len(r) - length + 1):
            count[r[j : j + length]] += 1
    out = []
    for (i, _), r in zip(docs, raws):
        gone = np.zeros(len(r) + 2, bool)
        for j in range(len(r) - length + 1):
            if count[r[j : j + length]] > 1:
                gone[j + 1 : j + 1 + length] = True
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((i, len(r), int(gone.sum()), int((~gone[:-1] & gone[1:]).sum()), sha(kept)))
    return out


def tokens(docs, encode, end):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = encode(t or "") + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def vectors(rows, cosine):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, np.float64) / np.sqrt(np.square(np.array(v, np.float64)).sum())

    units = [(i, unit(v), label) for i, v, label in rows]
    count, links = defaultdict(int), []
    for x, (i, u, a) in enumerate(units):
        for y, (j, v, b) in enumerate(units):
            if x != y and u is not None and v is not None and a is not None and a == b and len(u) == len(v) and u @ v >= cosine:
                count[i] += 1
                links.append((i, j))
    return {i: (count[i], c, c == i) for i, c in reach([i for i, _, _ in rows], links).items()}


def base_licenses(docs, phrases):
    out = {}
    for i, t in docs:
        w = [x.decode() for x in LETTERS.findall(lower(t))]
        found = [(j, label) for label, p in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        at = [j for j, _ in found]
        out[i] = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))
    return out
