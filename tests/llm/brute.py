"""Plain Python versions of what the operators compute."""

import hashlib
import re
from collections import defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def suffixes(docs, length):
    """docs: (id, text) pairs.  id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    at = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, t in texts:
        for p in range(len(t) - length + 1):
            at[t[p : p + length]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if at[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def windows(docs, w):
    """(id, n_words, n_removed, kept_sha256)."""
    first = {}
    for i, t in docs:
        ws = words(t)
        for p in range(len(ws) - w + 1):
            g = tuple(ws[p : p + w])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        ws = words(t)
        keep = [True] * len(ws)
        for p in range(len(ws) - w + 1):
            if first[tuple(ws[p : p + w])] < i:
                keep[p : p + w] = [False] * w
        kept = " ".join(x for x, k in zip(ws, keep, strict=True) if k)
        out.append((i, len(ws), len(ws) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_set(text, n):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def near(docs, n=5, percent=80):
    """(id, n_shingles, component)."""
    sets = [(i, shingle_set(t, n)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_item = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_item[x].append(k)
    seen = set()
    for ks in by_item.values():
        for x in range(len(ks)):
            for y in range(x + 1, len(ks)):
                if (ks[x], ks[y]) in seen:
                    continue
                seen.add((ks[x], ks[y]))
                (a, s), (b, t) = sets[ks[x]], sets[ks[y]]
                if 100 * len(s & t) >= percent * len(s | t):
                    a, b = find(a), find(b)
                    root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in sets]
