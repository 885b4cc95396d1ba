"""What each operator must return, computed the plain way."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def groups(ids, links):
    root = roots(len(ids), links)
    least = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def vectors(rows, cosine=0.98):
    """rows: (id, vector, label); returns (id, n_links, component, kept) of each."""
    blocks = defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        usable = v and label is not None and all(x is not None and np.isfinite(x) for x in v)
        if usable and any(v):
            blocks[label, len(v)].append(i)
    links = []
    for at in blocks.values():
        unit = np.array([rows[i][1] for i in at], float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= cosine, 1)), strict=True):
            links.append((at[a], at[b]))
    count = Counter(i for link in links for i in link)
    named = groups([r[0] for r in rows], links)
    return sorted(
        ((r[0], count[i], named[i], r[0] == named[i]) for i, r in enumerate(rows)), key=repr
    )


def repeats(docs, length):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((i, len(b), int(gone.sum()), spans, kept))
    return sorted(out, key=repr)


def shingles(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near(docs, percent):
    sets = [shingles(t) for _, t in docs]
    links = [
        (a, b) for a in range(len(docs)) for b in range(a)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    named = groups([i for i, _ in docs], links)
    return sorted(
        ((i, len(sets[k]), named[k], i == named[k]) for k, (i, _) in enumerate(docs)), key=repr
    )


def covered(docs, items, n):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= names
        out.append((i, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


def base_secrets(text):
    text, found = text or "", []
    assign = (
        r"(?i)(password|passwd|secret|token|api_?key)"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    for number, (kind, pattern, group, least) in enumerate((
        ("assign", assign, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32),
    )):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), number, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc(value) -> int:
    return zlib.crc32(str(value).encode())
