"""Plain single-process versions of the operators."""

import re
from collections import defaultdict


def low(text):
    return (text or "").encode().lower()


def shingles(text, k):
    w = low(text).split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent=80):
    """{row index: (set size, least doc_id of the component)} by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = (len(sets[i]), min(ids) if ids else None)
    return out


def line_key(line, least=20):
    key = line.strip(" \t\n\x0b\x0c\r").encode().lower()
    return key if len(key.decode()) >= least else None


def line_dedup(rows, min_docs=3):
    """Per row: (lines, dropped, text that stays)."""
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if line_key(line) is not None:
                holders[line_key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")

        def stays(line):
            h = holders.get(line_key(line)) if line_key(line) is not None else None
            if not h or len(h) < min_docs:
                return True
            ids = [x for x in h if x is not None]
            return d == (max(ids) if ids else None)
        stay = [x for x in lines if stays(x)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def words10(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))]


def contamination(rows, items, window=10):
    """Per row: (doc_id, words, hit words, item ids as text)."""
    seqs = defaultdict(set)
    for item, t in items:
        w = words10(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            seqs[tuple(w[i:i + n])].add("" if item is None else str(item))
    sizes = {len(s) for s in seqs}
    out = []
    for d, t in rows:
        w, hit, found = words10(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                s = tuple(w[i:i + n])
                if s in seqs:
                    hit.update(range(i, i + n))
                    found |= seqs[s]
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return out


def class_sort(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
