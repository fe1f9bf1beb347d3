"""Plain versions of the operators, over lists in memory."""

from __future__ import annotations

import re
from collections import defaultdict


def components(pairs):
    """node -> smallest node reachable."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def word_shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_classes(rows, words, numerator=80, denominator=100):
    """doc_id -> (shingles, component) by comparing all pairs."""
    sets = {i: word_shingles(t, words) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b])
    ]
    named = components(links)
    return {i: (len(sets[i]), named.get(i, i)) for i in ids}


def line_sets(text, size=8):
    """The `size` characters from each position on; a shorter line is one."""
    return frozenset(text[at : at + size] for at in range(max(len(text) - size, 0) + 1))


def line_classes(rows, threshold=0.8):
    """(doc_id, line_no) -> first line of its class, for lines that are not blank, by comparing all pairs."""
    places = defaultdict(list)
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            norm = re.sub(r"\s+", " ", line.lower()).strip(" ")
            if norm:
                places[norm].append((i, n))
    texts = sorted(places)
    sets = [line_sets(t) for t in texts]
    links = []
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    named = components(links)
    groups = defaultdict(list)
    for k, text in enumerate(texts):
        groups[named.get(k, k)] += places[text]
    return {p: min(g) for g in groups.values() for p in g}
