"""Plain versions of the operators for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def in_order(docs):
    """Documents by doc_id (null last), then text."""
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, (d[1] or "").encode()))


def repeated_bytes(docs, size):
    seen, out = set(), []
    for d, t in in_order(docs):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                cover[i : i + size] = b"\1" * size
            seen.add(w)
        out.append((d, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), sha(bytes(x for x, c in zip(b, cover) if not c))))
    return out


def repeated_words(docs, size):
    words = [(d, SPACE.findall((t or "").encode())) for d, t in docs]
    count = Counter(tuple(w[i : i + size]) for _, w in words for i in range(len(w) - size + 1))
    out = []
    for d, w in words:
        cover = [0] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                cover[i : i + size] = [1] * size
        out.append((d, len(w), sum(cover), sha(b" ".join(x for x, c in zip(w, cover) if not c))))
    return out


def contamination(docs, bench, size=13):
    windows = {}
    for i, t in bench:
        w = ALNUM.findall((t or "").translate(FOLD))
        m = min(size, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, items = [0] * len(w), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if found := windows.get(tuple(w[s : s + m])):
                    items |= found
                    hit[s : s + m] = [1] * m
        n = sum(hit)
        out.append((d, len(w), n, len(items), sha(",".join(sorted(items)).encode()), n > 0 and 20 * n >= len(w)))
    return out


def shingles(text, size):
    w = SPACE.findall((text or "").translate(FOLD).encode())
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_components(docs, size=4, percent=80):
    sets = [(d, shingles(t, size)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else root(d)) for d, s in sets]


def tokens(docs, path, end_id=2):
    from tokenizers import Tokenizer

    tool, start, out = Tokenizer.from_file(path), 0, []
    for d, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
