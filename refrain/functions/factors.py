"""Lempel-Ziv 77 factors of a batch of byte texts, exact and approximate, and back.

A factor is (pos, src, len, literal): len 0 is a literal byte, otherwise len bytes are copied from src, which is
before pos; copies may overlap themselves. Positions count bytes within the text from 0. Exact factors are greedy,
each the longest match that begins earlier; of the possible sources the leftmost is given. An empty text has no
factors.
"""

from __future__ import annotations

import numpy as np

from .suffixes import Suffixes, batch

#: Lengths of k-mers that gaps are searched by, by the greatest guess of a match's length they are for.
PATTERNS = (
    (6.0, (2, 3, 4, 5, 6)), (8.0, (2, 3, 4, 6, 8)), (12.0, (2, 3, 4, 8, 12)), (16.0, (2, 4, 6, 9, 16)), (32.0, (2, 4, 6, 10, 20)),
    (64.0, (2, 4, 7, 12, 28)), (128.0, (2, 4, 8, 16, 36)), (256.0, (2, 5, 10, 20, 42)), (1024.0, (2, 6, 12, 24, 48)), (float("inf"), (2, 8, 16, 32, 64)),
)
PHRASES = ("lpf_naive", "lpf_opt", "lpf_lnf_naive", "lpf_lnf_opt")


def _chain(step: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places that are reached from the start of each text by going on step bytes at a time."""
    jump, out = step.tolist(), []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        while a < b:
            out.append(a)
            a += jump[a]
    return np.array(out, np.int64)


def exact(index: Suffixes, sections: int = 1, min_ref_len: int = 1) -> dict[str, np.ndarray]:
    """Greedy factors of all texts: text, phrase_no, pos, src, len, literal (src and literal -1 where they don't apply).

    With several sections factors end at section borders n * k // sections; sources may lie in any earlier place. A match
    shorter than min_ref_len becomes a literal."""
    longest, previous = index.longest_previous()
    length = longest.copy()
    if sections > 1:
        size = np.diff(index.offs)[index.text]
        at = np.arange(len(length)) - index.offs[index.text]
        k = (at * sections) // np.maximum(size, 1)
        border = size * (k + 1) // sections
        wrong = border <= at  # rounding put the place one section too early
        border[wrong] = (size * (k + 2) // sections)[wrong]
        length = np.minimum(length, border - at)
    length[length < min_ref_len] = 0
    pos = _chain(np.maximum(length, 1), index.offs)
    n = length[pos]
    source = index.leftmost(np.where(n > 0, previous[pos], -1), n, longest, previous)
    return _rows(index, pos, source, n)


def _rows(index: Suffixes, pos: np.ndarray, source: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    text = index.text[pos] if len(pos) else np.zeros(0, np.int64)
    base = index.offs[text]
    first = np.searchsorted(text, np.arange(len(index.offs) - 1))
    return {
        "text": text, "phrase_no": np.arange(len(pos)) - first[text] if len(pos) else text, "pos": pos - base,
        "src": np.where(n > 0, source - base, -1), "len": n, "literal": np.where(n > 0, -1, index.data[pos].astype(np.int64)),
    }


def decode(src: np.ndarray, length: np.ndarray, literal: np.ndarray) -> bytes:
    """The text of factors in order."""
    out = bytearray()
    for s, n, c in zip(src.tolist(), length.tolist(), literal.tolist()):
        if n == 0:
            out.append(c)
        elif not 0 <= s < len(out):
            raise ValueError(f"a factor at {len(out)} copies from {s}")
        elif s + n <= len(out):
            out += out[s : s + n]
        else:  # overlap: the source repeats with the distance as its period
            period = bytes(out[s:])
            out += (period * (n // len(period) + 1))[:n]
    return bytes(out)


def sync_set(text: np.ndarray, tau: int, runs: bool = True) -> np.ndarray:
    """Places of a string synchronizing set: i is in it when the least hash of the tau + 1 windows of tau bytes from i on
    is that of the first or the last, which depends on the bytes in [i, i + 2 tau) alone. Without runs, places whose
    3 tau - 1 bytes have a period of at most tau // 3 are left out."""
    n = len(text) - 2 * tau + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = polynomial(text, tau)
    least = np.lib.stride_tricks.sliding_window_view(h, tau + 1).min(1)
    inside = (least == h[:n]) | (least == h[tau : tau + n])
    if not runs:
        inside &= ~periodic(text, 3 * tau - 1, max(1, tau // 3))[:n]
    return np.flatnonzero(inside)


#: The fingerprints' modulus and base; a smaller modulus of its own serves the windows of sync_set.
MODULUS = (1 << 31) - 1
BASE = 911382323


def polynomial(text: np.ndarray, window: int) -> np.ndarray:
    """Polynomial fingerprint of every window, modulo 2^31 - 1."""
    n = len(text) - window + 1
    out = np.zeros(max(0, n), np.int64)
    for k in range(window if n > 0 else 0):
        out = (out * BASE + text[k : k + n]) % MODULUS
    return out


def periodic(text: np.ndarray, window: int, most: int) -> np.ndarray:
    """For each place, whether the window of bytes from it on (as far as the text goes) has a period of at most most."""
    out = np.zeros(len(text), bool)
    for p in range(1, most + 1):
        same = np.zeros(len(text) + 1, np.int64)
        same[1 : len(text) - p + 1] = text[p:] == text[:-p]
        same[len(text) - p + 1 :] = 1
        total = np.cumsum(same)
        stop = np.minimum(np.arange(len(text)) + window - p, len(text))
        size = np.maximum(stop - np.arange(len(text)), 0)
        out |= (total[np.maximum(stop, np.arange(len(text)))] - total[:-1] == size) & (np.arange(len(text)) + window <= len(text))
    return out


#: Bytes to the left that are compared for all samples at once.
_SHORT = 16


def _left_short(index: Suffixes, source: np.ndarray, sample: np.ndarray, start: int) -> np.ndarray:
    """How many bytes before each sample equal those before its source, _SHORT at most."""
    out = np.zeros(len(sample), np.int64)
    live = np.flatnonzero(source >= 0)
    for k in range(_SHORT):
        a, b = source[live] - 1 - k, sample[live] - 1 - k
        live = live[(np.minimum(a, b) >= start) & (index.data[np.maximum(a, 0)] == index.data[np.maximum(b, 0)])]
        out[live] += 1
        if not len(live):
            break
    return out


def _left(index: Suffixes, i: int, j: int, most: int) -> int:
    """How many bytes up to and with i equal those up to and with j, most at most; i is the earlier place."""
    data, base = index.data, int(index.offs[index.text[j]])
    most = max(0, min(most, i - base + 1))
    k = 0
    while k < most:
        step = min(256, most - k)
        a, b = data[i - k - step + 1 : i - k + 1], data[j - k - step + 1 : j - k + 1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return k + step - 1 - int(differ[-1])
        k += step
    return most


def phrases(index: Suffixes, text: int, tau: int, mode: str = "lpf_opt") -> list[tuple[int, int, int]]:
    """(beg, end, src) of one text's phrases, places in the batch: matches of sampled places with those sampled places
    that come nearest in suffix order and lie earlier, reaching to the right and (in the opt modes and for lpf_naive, as
    far as nothing is covered yet) to the left. The lnf modes add the same of the reversed text, mirrored."""
    if mode not in PHRASES:
        raise ValueError(f"unknown phrase mode {mode!r}")
    a, b = int(index.offs[text]), int(index.offs[text + 1])
    own = index.data[a:b]
    if mode.startswith("lpf_lnf"):
        found = _one_sided(index, text, sync_set(own, tau) + a, every=True, left=mode.endswith("opt"))
        turned = Suffixes(*batch([own[::-1].tobytes()]))
        mirrored = _one_sided(turned, 0, sync_set(own[::-1], tau), every=True, left=mode.endswith("opt"), later=True)
        found += [(b - end, b - beg, b - src - (end - beg)) for beg, end, src in mirrored]
        return select(found)
    return _one_sided(index, text, sync_set(own, tau) + a, every=mode == "lpf_naive", left=True)


def _one_sided(index: Suffixes, text: int, sample: np.ndarray, every: bool, left: bool, later: bool = False) -> list[tuple[int, int, int]]:
    s = len(sample)
    if not s:
        return []
    order = np.argsort(index.rank[sample])
    value = np.full(s + 2, -1, np.int64)
    value[1:-1] = (len(index.data) - sample[order]) if later else sample[order]
    from .suffixes import _smaller_before

    before, after = _smaller_before(value) - 1, s - _smaller_before(value[::-1])[::-1]
    rank = np.empty(s, np.int64)
    rank[order] = np.arange(s)
    near = [np.where((x[1:-1] >= 0) & (x[1:-1] < s), x[1:-1], -1)[rank] for x in (before, after)]
    reach = []
    for x in near:
        some = np.flatnonzero(x >= 0)
        length = np.zeros(s, np.int64)
        length[some] = index.extension(sample[some], sample[order[x[some]]])
        reach.append(length.tolist())
    source = [np.where(x >= 0, sample[order[np.maximum(x, 0)]], -1) for x in near]
    start = int(index.offs[text])
    short = [_left_short(index, x, sample, start).tolist() for x in source]
    source = [x.tolist() for x in source]
    out: list[tuple[int, int, int]] = []
    covered = start
    last: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
    for k, at in enumerate(sample.tolist()):
        if not every and k + 1 < s and int(sample[k + 1]) <= covered:
            continue
        best = None
        for side in (0, 1):
            src = source[side][k]
            if src < 0:
                continue
            end, shift = at + reach[side][k], abs(at - src)
            if later:
                if at < last[side][0] and shift == last[side][1]:
                    continue
            elif every and at < last[side][0] and shift == last[side][1]:
                continue  # the same match as from the sample before
            beg = at
            if left and min(src, at) > start:
                most = at - start if every or later else max(0, at - covered)
                back = min(short[side][k], most)
                if back == _SHORT:  # few reach so far; for those the rest is compared too
                    back += _left(index, min(src, at) - 1 - _SHORT, max(src, at) - 1 - _SHORT, most - _SHORT)
                beg, src = beg - back, src - back
            if not every and beg < covered:
                src, beg = src + covered - beg, covered
            if end - beg > 1:
                last[side] = (end, shift)
                if every:
                    out.append((beg, end, src))
                elif best is None or end - beg > best[1] - best[0]:
                    best = (beg, end, src)
        if best:
            out.append(best)
            covered = max(covered, best[1])
    return out if not every or later else select(out) if not left or every else out


def select(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Phrases that don't overlap and cover what all of them cover: of those that begin within what is covered, the one
    that reaches furthest comes next; the one before it is cut at its begin."""
    out: list[list[int]] = []
    rows = sorted(found, key=lambda p: (p[0], -p[1]))
    i, n = 0, len(rows)
    while i < n:
        covered = out[-1][1] if out else -1
        # all that begin at or before the end of what is covered; if none of them reaches further, the next one
        best = None
        while i < n and rows[i][0] <= covered:
            if rows[i][1] > covered and (best is None or rows[i][1] > best[1]):
                best = rows[i]
            i += 1
        if best is None:
            if i == n:
                break
            best = rows[i]
            i += 1
        beg, end, src = best
        if out and beg < out[-1][1]:
            out[-1][1] = beg
            if out[-1][1] <= out[-1][0]:
                out.pop()
        out.append([beg, end, src])
    return [(a, b, c) for a, b, c in out]


def gap_patterns(n: int, covered: int, phrases_: int, gaps: int) -> tuple[int, ...]:
    """Lengths of k-mers for the gaps between phrases, by the least of the mean gap, the mean phrase and what the share of
    gaps suggests."""
    share = (n - covered) / max(n, 1)
    guess = min((n - covered) / max(gaps, 1), covered / phrases_ if phrases_ else float("inf"), 8.0 * 128 ** (1 - share))
    return next(lengths for most, lengths in PATTERNS if guess <= most)


def approximate(index: Suffixes, tau: int = 32, mode: str = "lpf_opt", fill: str = "greedy") -> dict[str, np.ndarray]:
    """Factors from phrases, gaps between them filled by the last earlier place of the longest of five k-mers.

    fill "greedy": at a phrase the longer of it and such a match is taken; "greedy_naive": matches within gaps only."""
    if fill not in ("greedy", "greedy_naive"):
        raise ValueError(f"unknown way to fill gaps {fill!r}")
    many = len(index.offs) - 1
    chosen_of, patterns = [], []
    for text in range(many):
        a, b = int(index.offs[text]), int(index.offs[text + 1])
        chosen = phrases(index, text, tau, mode)
        covered = sum(e - s for s, e, _ in chosen)
        gaps = sum(x[1] < y[0] for x, y in zip([(a, a, 0), *chosen], [*chosen, (b, b, 0)]))
        chosen_of.append(chosen)
        patterns.append(gap_patterns(b - a, covered, len(chosen), gaps))
    earlier = np.full(len(index.data), -1, np.int64)
    shared = index.extension(index.order[1:], index.order[:-1])
    for k in sorted({k for p in patterns for k in p}, reverse=True):
        wanted = np.array([k in p for p in patterns])[index.text] & (earlier < 0)
        seen = last_seen(index, shared, k, wanted)
        earlier = np.where(wanted, seen, earlier)
    some = np.flatnonzero(earlier >= 0)
    extent = np.zeros(len(index.data), np.int64)
    extent[some] = index.extension(some, earlier[some])
    rows: list[tuple[int, int, int]] = []
    for text, chosen in enumerate(chosen_of):
        a, b = int(index.offs[text]), int(index.offs[text + 1])
        near, reach = earlier[a:b].tolist(), extent[a:b].tolist()
        i, k = a, 0
        while i < b:
            while k < len(chosen) and chosen[k][1] <= i:
                k += 1
            beg, end, src = chosen[k] if k < len(chosen) else (b, b, 0)
            n, source = reach[i - a], near[i - a]
            if i < beg:  # in a gap; a match may run on into the phrase, or over its end
                if beg < i + n <= end and fill == "greedy":
                    n = beg - i
                elif fill == "greedy_naive":
                    n = min(n, beg - i)
            else:
                own = end - i
                if fill == "greedy_naive" or own >= n:
                    n, source = own, src + i - beg
            rows.append((i, source if n else -1, n))
            i += max(n, 1)
    pos, source, n = np.array(rows, np.int64).reshape(-1, 3).T
    return _rows(index, pos, source, n)


def last_seen(index: Suffixes, shared: np.ndarray, k: int, wanted: np.ndarray) -> np.ndarray:
    """For each place the last earlier one of the k bytes from it on, -1 where there is none; shared is how much each
    suffix shares with the one before it in order. Places that aren't wanted may be left at -1, with all of their text."""
    same = shared >= k
    tied = np.zeros(len(index.order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    of_text = np.zeros(len(index.offs) - 1, bool)
    of_text[index.text[wanted]] = True
    at = np.flatnonzero(tied & of_text[index.text[index.order]])
    group = np.concatenate(([0], np.cumsum(~same)))[at] if len(at) else at
    place = index.order[at]
    turn = np.lexsort((place, group))
    group, place = group[turn], place[turn]
    out = np.full(len(index.data), -1, np.int64)
    again = group[1:] == group[:-1]
    out[place[1:][again]] = place[:-1][again]
    return out


def gapped(index: Suffixes, text: int, tau: int = 32, mode: str = "lpf_opt") -> list[tuple[str, int, int]]:
    """("gap", length, 0) and ("copy", source, length) in turn; gaps of no length are left out."""
    a, b = int(index.offs[text]), int(index.offs[text + 1])
    out, at = [], a
    for beg, end, src in phrases(index, text, tau, mode):
        if beg > at:
            out.append(("gap", beg - at, 0))
        out.append(("copy", src - a, end - beg))
        at = end
    if at < b:
        out.append(("gap", b - at, 0))
    return out
