"""Plain versions of the corpus operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def shingles(t):
    w = WORD.findall(low(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(docs, percent=85):
    """{doc_id: smallest reachable id} for {doc_id: text}."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: find(d) for d in docs}, {d: len(s) for d, s in sets.items()}


def repeat_spans(rows, length=200, keep="none"):
    """Spans that go of each text of a list of (doc_id, text), in order."""
    texts = [(t or "").encode() for _, t in rows]
    seen, first = Counter(), {}
    for r, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] += 1
            first.setdefault(s, (r, i))
    out = []
    for r, b in enumerate(texts):
        spans = []
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if seen[s] > 1 and (keep == "none" or first[s] != (r, i)):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append((b, [tuple(s) for s in spans]))
    return out


def without(b, spans):
    at, kept = 0, b""
    for lo, hi in spans:
        kept += b[at:lo]
        at = hi
    return kept + b[at:]


def repeat_digest(b, spans):
    return len(b), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(without(b, spans)).hexdigest()


def contamination(docs, items, size=10):
    """Digest of each text of {key: text} against a list of (item_id, text)."""
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(low(t))
        if w:
            for k in range(max(1, len(w) - size + 1)):
                windows[tuple(w[k : k + size])].add(str(i))
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in docs.items():
        w, hit, ids = ITEM_WORD.findall(low(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    ids |= found
        out[d] = len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0
    return out
