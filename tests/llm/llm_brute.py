"""Brute-force versions."""

import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall((text or "").encode().lower() if (text or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if len(words) >= width:
        return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    return {tuple(words)} if words else set()


def brute_components(docs, width, percent=80):
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    meet = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            meet[x].add(i)
    pairs = {(a, b) for m in meet.values() for a in m for b in m if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}
