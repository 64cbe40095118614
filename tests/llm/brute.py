"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re

SMALL = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(ids, linked):
    """Smallest id of each component, comparing all pairs."""
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(ids)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
