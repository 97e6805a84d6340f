"""Seeded texts that repeat themselves, and brute-force versions of what is computed about them."""

import random


def repetitive(rng: random.Random, most: int = 600) -> bytes:
    """New bytes, copies from before (overlapping ones too) and runs, over alphabets of different sizes."""
    out, alphabet, n = bytearray(), rng.choice([1, 2, 4, 256]), rng.choice([0, 1, 2, 3, 30, most // 3, most])
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4 or not out:
            out.append(rng.randrange(alphabet))
        elif kind < 0.8:
            at = rng.randrange(len(out))
            for k in range(rng.randint(1, 80)):
                out.append(out[at + k])
        else:
            out += bytes([rng.randrange(alphabet)]) * rng.randint(1, 30)
    return bytes(out[:n])


SPECIAL = [b"", b"a", b"\x00", b"\xff\x00\xff", b"a" * 200, b"ab" * 99, b"abc" * 50, bytes(range(256)), "é漢🙂é漢".encode(), b"\xc3\x28\xff", b"abababcabc", b"same text", b"same text"]


def greedy(text: bytes, least: int = 1) -> list[tuple[int, int, int]]:
    """(pos, src, len) of greedy factors with leftmost sources."""
    out, i = [], 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text.find(text[i : i + n + 1], 0, i + n) >= 0:
            n += 1
        n = n if n >= least else 0
        out.append((i, text.find(text[i : i + n], 0, i + n - 1) if n else -1, n))
        i += max(n, 1)
    return out


def common(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
