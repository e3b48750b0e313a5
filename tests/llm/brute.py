"""Plain-Python versions of what the operators compute."""

import re
import string
from collections import defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1)))


def components(rows, num=3, den=4):
    """{row index: (set size, set of row indexes in its component)} by comparing all pairs of sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in where[g]:
                if j < i:
                    shared[j] += 1
        for j, c in shared.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(rows)):
        groups[find(i)].add(i)
    return {i: (len(sets[i]), groups[find(i)]) for i in range(len(rows))}
