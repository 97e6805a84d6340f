"""Kernels against brute force on seeded repetitive texts and on special ones."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from refrain.functions import codec as C
from refrain.functions import factors as K
from refrain.functions.suffixes import Suffixes, batch
from refrain.operators.positions import prefix_table
from texts import SPECIAL, common, greedy, repetitive


def batches(seed: int, many: int = 30, most: int = 200):
    rng = random.Random(seed)
    yield SPECIAL
    yield []
    for _ in range(many):
        yield [repetitive(rng, most) for _ in range(rng.randint(1, 5))]


def test_suffix_order_extensions_and_neighbours():
    rng = np.random.default_rng(1)
    for ts in batches(1, 15, 60):
        s = Suffixes(*batch(ts))
        for k, (t, b) in enumerate(zip(ts, s.offs[:-1].tolist())):
            order = sorted(range(len(t)), key=lambda i: t[i:])
            assert (s.order[b : b + len(t)] - b).tolist() == order
            for greater in (False, True):
                before, after = s.nearest(greater)
                for r, p in enumerate(order):
                    fits = lambda q: q > p if greater else q < p  # noqa: B023, E731
                    want = [next((q for q in side if fits(q)), None) for side in (order[:r][::-1], order[r + 1 :])]
                    got = [x[b + p] for x in (before, after)]
                    assert [g - b if g >= 0 else None for g in got] == want
        n = len(s.data)
        if n:
            i, j = rng.integers(n, size=(2, 80))
            for a, c, got in zip(i, j, s.extension(i, j)):
                rest = lambda p: s.data[p : s.end[p]].tobytes()  # noqa: B023, E731
                assert got == (common(rest(a), rest(c)) if s.text[a] == s.text[c] else 0)


def test_exact_factors_are_greedy_with_leftmost_sources():
    for ts in batches(2):
        index = Suffixes(*batch(ts))
        for least in (1, 2, 4):
            f = K.exact(index, min_ref_len=least)
            for k, t in enumerate(ts):
                mine = f["text"] == k
                assert list(zip(f["pos"][mine].tolist(), f["src"][mine].tolist(), f["len"][mine].tolist())) == greedy(t, least)
                assert K.decode(f["src"][mine], f["len"][mine], f["literal"][mine]) == t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80) | st.text(alphabet="ab", max_size=120).map(str.encode), max_size=4))
def test_exact_factors_of_any_texts(ts):
    f = K.exact(Suffixes(*batch(ts)))
    for k, t in enumerate(ts):
        mine = f["text"] == k
        assert list(zip(f["pos"][mine].tolist(), f["src"][mine].tolist(), f["len"][mine].tolist())) == greedy(t)


def test_sections_cut_factors_at_their_borders():
    for ts in batches(3, 15):
        index = Suffixes(*batch(ts))
        whole = np.bincount(K.exact(index)["text"], minlength=len(ts))
        for sections in (2, 5, 16):
            f = K.exact(index, sections)
            for k, t in enumerate(ts):
                mine = f["text"] == k
                assert K.decode(f["src"][mine], f["len"][mine], f["literal"][mine]) == t
                assert whole[k] <= mine.sum() <= whole[k] + sections
                assert {len(t) * j // sections for j in range(1, sections)} <= {0, *(f["pos"][mine] + np.maximum(f["len"][mine], 1)).tolist()}


@pytest.mark.parametrize("mode", K.PHRASES)
def test_phrases_and_approximate_factors(mode):
    for ts in batches(4, 12):
        index = Suffixes(*batch(ts))
        least = np.bincount(K.exact(index)["text"], minlength=len(ts))
        for tau in (2, 16):
            for k, t in enumerate(ts):
                last = 0
                for beg, end, src in ([int(x - index.offs[k]) for x in p] for p in K.phrases(index, k, tau, mode)):
                    assert last <= beg < end and 0 <= src < beg and all(t[src + q] == t[beg + q] for q in range(end - beg))
                    last = end
            for fill in ("greedy", "greedy_naive"):
                f = K.approximate(index, tau, mode, fill)
                for k, t in enumerate(ts):
                    mine = f["text"] == k
                    assert K.decode(f["src"][mine], f["len"][mine], f["literal"][mine]) == t and mine.sum() >= least[k]


def test_last_seen_kmers():
    for ts in batches(11, 15, 150):
        index = Suffixes(*batch(ts))
        shared = index.extension(index.order[1:], index.order[:-1])
        for k in (1, 2, 7, 20):
            got = K.last_seen(index, shared, k, np.ones(len(index.data), bool))
            for t, b in zip(ts, index.offs[:-1].tolist()):
                for i in range(len(t)):
                    want = t.rfind(t[i : i + k], 0, i + k - 1) if i + k <= len(t) else -1
                    assert got[b + i] == (b + want if want >= 0 else -1)


def test_selected_phrases_cover_what_all_of_them_cover():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(b, b + rng.randint(1, 12), rng.randrange(100)) for b in (rng.randrange(60) for _ in range(rng.randint(0, 20)))]
        chosen = K.select(rows)
        assert all(a[1] <= b[0] and a[0] < a[1] for a, b in zip(chosen, chosen[1:]))
        assert {x for b, e, _ in chosen for x in range(b, e)} == {x for b, e, _ in rows for x in range(b, e)}
        assert all(any(b == p[0] and e <= p[1] and s == p[2] for p in rows) for b, e, s in chosen)


def test_equal_contexts_are_sampled_alike():
    rng = random.Random(6)
    seen = 0
    for t in [repetitive(rng) for _ in range(60)] + SPECIAL:
        for tau in (2, 4, 8):
            inside = set(K.sync_set(np.frombuffer(t, np.uint8), tau).tolist())
            by: dict[bytes, set[bool]] = {}
            for i in range(len(t) - 2 * tau + 1):
                by.setdefault(t[i : i + 2 * tau], set()).add(i in inside)
            assert all(len(x) == 1 for x in by.values())
            # any tau + 1 places in a row hold a sample where 2 tau bytes follow
            assert all(any(i + k in inside for k in range(tau + 1)) for i in range(len(t) - 3 * tau + 1))
            seen += len(t) - len(by)
            assert set(K.sync_set(np.frombuffer(t, np.uint8), tau, runs=False).tolist()) <= inside
    assert seen > 1000


def test_periods():
    rng = random.Random(7)
    for t in [repetitive(rng, 120) for _ in range(40)]:
        for window, most in ((5, 1), (11, 3)):
            got = K.periodic(np.frombuffer(t, np.uint8), window, most)
            for i in range(len(t)):
                w = t[i : i + window]
                assert got[i] == (len(w) == window and any(w[p:] == w[:-p] for p in range(1, most + 1)))


def test_prefix_fingerprints():
    rng = random.Random(8)
    for t in [repetitive(rng) for _ in range(20)] + SPECIAL:
        want = [0]
        for c in t:
            want.append((want[-1] * K.BASE + c) % K.MODULUS)
        for block in (1, 7, 256):
            assert prefix_table(np.frombuffer(t, np.uint8), block).tolist() == want


def test_variable_bytes_and_elias_delta():
    numbers = [0, 1, 127, 128, 16_383, 16_384, 2**32 - 1, 2**40]
    for x in numbers:
        assert C.read_vbyte(C.vbyte(x)) == (x, len(C.vbyte(x)))
    assert C.vbyte(128) == b"\x80\x01"
    with pytest.raises(ValueError):
        C.vbyte(-1)
    out = C.Bits()
    for x in numbers[1:]:
        out.delta(x)
    assert sum(map(C.delta_bits, numbers)) == len("".join(out.parts))
    back = C.BitReader(out.bytes())
    assert [back.delta() for _ in numbers[1:]] == numbers[1:]


def test_code_lengths():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    assert C.code_lengths([]) == [] and C.code_lengths([0, 0]) == [0, 0] and C.code_lengths([0, 9]) == [0, 1]
    assert C.code_lengths([5, 1, 1, 2]) == [1, 3, 3, 2]
    rng = random.Random(9)
    for f in [fibonacci, [1] * 66, *[[rng.choice([0, 1, 2, 5, 1000]) for _ in range(66)] for _ in range(50)]]:
        bits = C.code_lengths(f)
        assert all((b > 0) == (n > 0) and b <= C.MAX_CODE for b, n in zip(bits, f))
        assert sum(2.0**-b for b in bits if b) <= 1
        assert all(bits[i] <= bits[j] for i in range(len(f)) for j in range(len(f)) if f[i] > f[j] > 0)
        codes = {format(c, f"0{b}b") for b, c in zip(bits, C.canonical(bits)) if b}
        assert len(codes) == sum(b > 0 for b in bits) and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_streams_records_and_gapped_files():
    rng = random.Random(10)
    many = bytes(rng.randrange(256) for _ in range(17_000))  # more than one block of factors
    for t in [repetitive(rng) for _ in range(30)] + SPECIAL + [many]:
        index = Suffixes(*batch([t]))
        f = K.exact(index)
        stream = C.write_factors(len(t), f["pos"], f["src"], f["len"], f["literal"])
        assert list(C.read_factors(stream)) == list(zip(*(f[c].tolist() for c in ("pos", "src", "len", "literal"))))
        assert len(stream) == 5 + -(-C.stream_bits(f["len"], f["pos"] - f["src"]) // 8)
        for wide in (False, True):
            data = C.write_records(f["src"], f["len"], f["literal"], wide)
            assert len(data) == len(f["pos"]) * (10 if wide else 8)
            assert all((a == f[c]).all() for a, c in zip(C.read_records(data, wide), ("src", "len", "literal")))
        for least in (0, 8, C.MIN_COPY):
            assert C.read_gapped(C.write_gapped(t, K.gapped(index, 0, 4), least)) == t
    with pytest.raises(ValueError):
        C.write_records(np.array([1 << 33]), np.array([1]), np.array([-1]))


def test_decode_refuses_sources_that_come_later():
    with pytest.raises(ValueError):
        K.decode(np.array([3]), np.array([2]), np.array([-1]))
