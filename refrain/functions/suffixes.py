"""Suffix order of a batch of byte texts, and what follows from it, in whole-array operations.

Texts are laid end to end and every class of equal substrings carries its text's number, so that nothing is ever
compared across texts. Ranks are refined by doubling the compared length, only where suffixes still tie; every level
is kept, which makes the longest common extension of two places a few look-ups whatever its length. Shorter suffixes
come first, bytes are unsigned.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sort key, and how many texts its remaining bits can number.
_FIRST = 6
MAX_TEXTS = 1 << 14


def batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of texts in them."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


class Suffixes:
    """order: places in suffix order, text by text. rank: its inverse. levels: classes of equal substrings by length."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        if len(offs) - 1 > MAX_TEXTS:
            raise ValueError(f"at most {MAX_TEXTS} texts in a batch")
        n = len(data)
        self.data, self.offs = data, offs
        self.text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        self.end = offs[1:][self.text]
        key = self.text.astype(np.int64)
        for k in range(_FIRST):
            symbol = np.zeros(n, np.int64)
            if k < n:
                symbol[: n - k] = data[k:].astype(np.int64) + 1
            symbol[np.arange(n) + k >= self.end] = 0
            key = key * 257 + symbol
        order = np.argsort(key, kind="stable")
        klass = self._classes(order, key[order])
        self.length, self.levels = [_FIRST], [klass]
        h = _FIRST
        # a class is the first rank of its members: members of one class lie next to each other in order
        while True:
            in_order = klass[order]
            tied = np.zeros(n, bool)
            same = in_order[1:] == in_order[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            at = np.flatnonzero(tied)
            if not len(at):
                break
            place = order[at]
            next_ = np.full(len(place), -1, np.int64)
            inside = place + h < self.end[place]
            next_[inside] = klass[place[inside] + h]
            sub = np.lexsort((next_, in_order[at]))
            order[at] = place[sub]
            group, second = in_order[at], next_[sub]
            new = np.ones(len(at), bool)
            new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
            klass = klass.copy()
            klass[order[at]] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
            h *= 2
            self.length.append(h)
            self.levels.append(klass)
        self.order = order
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)

    @staticmethod
    def _classes(order: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        klass = np.empty(len(order), np.int64)
        klass[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else 0
        return klass

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes from i on equal those from j on, within the text; 0 for places of different texts."""
        i, j = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        length = np.zeros(len(i), np.int64)
        same = i == j
        length[same] = self.end[i[same]] - i[same]
        limit = self.end[i]
        first = live = np.flatnonzero(~same & (self.text[i] == self.text[j]))
        # up to the longest level at which both are of one class: most pairs fail at the first
        top = np.full(len(i), -1)
        for k, (h, klass) in enumerate(zip(self.length, self.levels)):
            if not len(live):
                break
            a, b = i[live], j[live]
            equal = klass[a] == klass[b]
            live = live[equal]
            live = live[np.maximum(a[equal], b[equal]) + h <= limit[live]]
            top[live] = k
            length[live] = h
        live = first[top[first] >= 0]
        i[live] += length[live]
        j[live] += length[live]
        # and down again for the rest, which is shorter than that level
        for k in range(int(top.max(initial=0)) - 1, -1, -1):
            h, klass = self.length[k], self.levels[k]
            step = live[top[live] > k]
            a, b = i[step], j[step]
            fits = np.maximum(a, b) + h <= limit[step]
            step, a, b = step[fits], a[fits], b[fits]
            step = step[klass[a] == klass[b]]
            length[step] += h
            i[step] += h
            j[step] += h
        live = first[np.maximum(i[first], j[first]) < limit[first]]
        while len(live):  # fewer bytes are left than the first level has
            live = live[self.data[i[live]] == self.data[j[live]]]
            length[live] += 1
            i[live] += 1
            j[live] += 1
            live = live[np.maximum(i[live], j[live]) < limit[live]]
        return length

    def nearest(self, greater: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the nearest place before and after it in suffix order that lies earlier in the text (later, if
        greater); -1 where there is none."""
        # a barrier before each text's block, and one at the end
        value = np.full(len(self.data) + len(self.offs), -1, np.int64)
        slot = np.arange(len(self.data)) + self.text + 1
        value[slot] = (len(self.data) - 1 - self.order) if greater else self.order
        before = _smaller_before(value)
        after = len(value) - 1 - _smaller_before(value[::-1])[::-1]
        out = []
        for near in (before, after):
            found = value[near[slot]]
            if greater:
                found = np.where(found >= 0, len(self.data) - 1 - found, -1)
            result = np.empty(len(self.data), np.int64)
            result[self.order] = found
            out.append(result)
        return out[0], out[1]

    def longest_previous(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the length of the longest match that begins earlier, and where some such match begins (-1: none)."""
        before, after = self.nearest()
        here = np.arange(len(self.data))
        a, b = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
        for near, found in ((before, a), (after, b)):
            some = np.flatnonzero(near >= 0)
            found[some] = self.extension(some, near[some])
        length = np.maximum(a, b)
        return length, np.where(length == 0, -1, np.where(a >= b, before, after))

    def leftmost(self, source: np.ndarray, length: np.ndarray, longest: np.ndarray, previous: np.ndarray) -> np.ndarray:
        """The first places where the length bytes from each source on occur: following earlier matches that are as long."""
        source = source.copy()
        live = np.flatnonzero(source >= 0)
        while len(live):
            live = live[longest[source[live]] >= length[live]]
            source[live] = previous[source[live]]
        return source


def _smaller_before(value: np.ndarray) -> np.ndarray:
    """For each place of value the nearest one before it that holds a smaller number; value[0] is the least, and its own."""
    n = len(value)
    near = np.arange(-1, n - 1)
    near[0] = 0
    live = np.flatnonzero(value[near] >= value)
    live = live[live > 0]
    live = live[value[live] > value[0]]
    near[value == value[0]] = 0
    for _ in range(200):
        if not len(live):
            return near
        near[live] = near[near[live]]  # what lies between is larger still
        live = live[value[near[live]] >= value[live]]
    v, m = value.tolist(), near.tolist()
    for i in live.tolist():
        k = m[i]
        while v[k] >= v[i]:
            k = m[k]
        m[i] = k
    return np.array(m)
