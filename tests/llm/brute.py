"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def near(docs, size, percent):
    """docs: list of (doc_id, text). doc_id -> (n_shingles, component)."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(size, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a]) * 100 < percent * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def suffixes(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = (t or "").encode()
        hit = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, h in zip(data, hit, strict=True) if not h)
        out[d] = (len(data), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return out


def windows(docs, items, window=10):
    """doc_id -> (n_words, n_hit, n_items, items_sha256)."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    known = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in known}
    out = {}
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (o := known.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= o
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def lines(docs, near_words=4):
    """doc_id -> removed line numbers."""

    def within_one(a, b):
        if a == b:
            return True
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    before, exact, out = {}, set(), {}
    for d, text in sorted(docs):
        gone = []
        for i, line in enumerate((text or "").split("\n")):
            w = tuple(line.split(" "))
            if not line.strip(" \t\x0b\f\r"):
                continue
            hit = w in exact
            if not hit and len(w) >= near_words:
                hit = any(within_one(w, o) for n in (len(w) - 1, len(w), len(w) + 1) for o in before.get(n, ()))
            if hit:
                gone.append(i)
            if w not in exact:
                exact.add(w)
                if len(w) >= near_words:
                    before.setdefault(len(w), []).append(w)
        out[d] = gone
    return out
