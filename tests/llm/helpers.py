"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_rows(docs, percent=80):
    """docs: (doc_id, text) rows; returns sorted (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in docs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    links = set()
    for i, s in enumerate(sets):
        if docs[i][0] is None:
            continue
        for j in {j for x in s for j in where[x] if j > i and docs[j][0] is not None}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.add((i, j))
    root = roots(range(len(docs)), links)
    least = {}
    for i, r in root.items():
        k = docs[i][0]
        if k is not None and sets[i]:
            least[r] = min(k, least.get(r, k))
    return sorted(((k, len(s), None if k is None else least[root[i]] if s else k)
                   for i, ((k, _), s) in enumerate(zip(docs, sets))), key=str)
