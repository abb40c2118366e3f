"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def shingles(text, size):
    w = words(text)
    if 0 < len(w) < size:
        return {tuple(w)}
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def components(sets, percent):
    """Smallest reachable id of each id."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def measures(text):
    plain = WORD.findall(text or "")
    windows = [tuple(plain[i:i + 5]) for i in range(len(plain) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(plain)
    return {"n_words": n, "word_chars": sum(map(len, plain)),
            "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": n < 10 or 100 * len(covered) > 20 * n}


def leaks(docs, items, percent=80):
    out = set()
    for item, body in items:
        needed = shingles(body, 5)
        for doc, text in docs:
            if needed and 100 * len(needed & shingles(text, 5)) >= percent * len(needed):
                out.add((doc, item))
    return out


def repeats(docs, size):
    """For each id, the character spans of windows of `size` words that an earlier id holds."""
    seen, out = {}, defaultdict(list)
    for doc, text in sorted(docs):
        hits = [(m.group().translate(str.maketrans(UPPER, LOWER)), m.start(), m.end())
                for m in WORD.finditer(text or "")]
        windows = [(tuple(x[0] for x in hits[i:i + size]), hits[i][1], hits[i + size - 1][2])
                   for i in range(len(hits) - size + 1)]
        out[doc] = [(a, b) for w, a, b in windows if seen.get(w, doc) != doc]
        for w, _, _ in windows:
            seen.setdefault(w, doc)
    return out
