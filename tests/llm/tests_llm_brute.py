"""Brute-force versions of stages, for the pipeline's tests."""

from test_decontaminate import brute as _decontaminate
from test_secrets import brute as _secrets


def brute_hit(text, item):
    return bool(_decontaminate(text, [(1, item)])[1])


def brute_secrets(text):
    return _secrets(text)[1]


def jaccard_components(rows, size=5, similarity=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            n = len(a & b)
            if a == b or n and n >= similarity * (len(a) + len(b) - n):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]
