"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict


def repeats(rows: list[tuple], min_words: int) -> set[tuple]:
    """{(id, start, n_words, first_id, first_start)} by comparing all windows of words; an equal window before in the same
    text comes before the first of all."""
    texts = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    first: dict[tuple, tuple] = {}
    out = set()
    for null, i, t in texts:
        i = None if null else i
        words = [w for w in t.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
        run, last = None, {}
        for p in range(len(words) - min_words + 1):
            w = tuple(words[p : p + min_words])
            src = (i, t, last[w]) if w in last else first.get(w)
            last[w] = p
            first.setdefault(w, (i, t, p))
            if run and src and src[:2] == run[1][:2] and src[2] - run[1][2] == p - run[0]:
                run[2] += 1
                continue
            if run:
                out.add((i, run[0], run[2] - 1 + min_words, run[1][0], run[1][2]))
            run = [p, src, 1] if src else None
        if run:
            out.add((i, run[0], run[2] - 1 + min_words, run[1][0], run[1][2]))
    return out


def alike(rows: list[tuple], least: float) -> list[tuple]:
    """Pairs of ids whose sets of lower-case word 3-grams have a Jaccard similarity of at least least; counts by shared 3-grams, none left out."""
    grams, by = {}, defaultdict(list)
    for i, t in rows:
        words = re.findall(r"\w+", t.lower())
        grams[i] = {tuple(words[p : p + 3]) for p in range(len(words) - 2)}
    out = []
    for i, mine in grams.items():
        shared: dict = defaultdict(int)
        for g in mine:
            for other in by[g]:
                shared[other] += 1
            by[g].append(i)
        out += [(o, i) for o, n in shared.items() if n >= least * (len(mine) + len(grams[o]) - n)]
    return out
