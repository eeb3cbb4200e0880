"""Plain versions that several tests share."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(value, n):
    words = [w.encode().lower() for w in WORD.findall(value or "")]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain_components(rows, n):
    """doc_id -> smallest doc_id that links of similarity 0.8 reach."""
    sets = collections.defaultdict(list)
    for d, t in rows:
        sets[d].append(shingles(t, n))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    flat = [(d, s) for d, group in sets.items() for s in group if s]
    for i, (d, a) in enumerate(flat):
        for e, b in flat[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d in sets}


def plain_targets(sizes, weights):
    """Shares of all sizes by weight, none above three times its size, the excess reshared."""
    target, live, left = {}, set(sizes), sum(sizes.values())
    while live:
        whole = sum(weights[s] for s in live)
        over = {s for s in live if left * weights[s] / whole >= 3 * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / whole for s in live}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        live -= over
    return target
