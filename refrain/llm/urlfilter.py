"""URL filters by a bit-parallel wildcard automaton.

A rule is a glob over the whole canonical URL: ``*`` is any run of characters,
``?`` any one, everything else itself. All rules are packed end to end into the
bits of a few 64-bit words: bit j of a rule says that its first j symbols have
been matched. One character advances every rule at once, for a block of URLs at
a time: D' = ((D & B[c]) << 1) | (D & S), with carries between words, where B[c]
marks the places whose next symbol accepts c and S those before a star.

Canonical form: lower case, without scheme, user, default port, fragment, utm
parameters and trailing slashes. Rows are handled one by one, without a shuffle.

Defined results: a null URL has a null canonical form, matches no rule and isn't
blocked; an empty one is matched by ``*`` alone. A URL is blocked when a block
rule matches and no allow rule does. Repeated rows get equal results, ids may be
null, very long URLs are read to their end, other columns are never looked at,
and an empty table gives an empty result. Rules whose names repeat or hold a
comma are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

#: (rule, action, glob)
RULES: tuple[tuple[str, str, str], ...] = tuple(
    [(f"spam-{i}", "block", f"*{w}*") for i, w in enumerate(("cheap-pills", "viagra", "cialis", "casino", "poker", "jackpot", "payday-loan", "forex-signals", "replica-watch", "xxx", "porn", "escort", "free-download", "keygen", "warez", "torrent"))]
    + [(f"file-{i}", "block", f"*.{w}") for i, w in enumerate(("exe", "zip", "rar", "iso", "dmg", "apk", "msi", "mp3", "mp4", "avi", "jpg", "jpeg", "png", "gif", "svg", "css", "js", "woff2"))]
    + [(f"path-{i}", "block", f"*/{w}*") for i, w in enumerate(("wp-admin", "wp-login", "cgi-bin/", "cart/", "checkout/", "login", "signin", "logout", "search?", "calendar/????-??", "feed/", "tag/", "trackback", "xmlrpc.php", "print/"))]
    + [(f"host-{i}", "block", f"{w}/*") for i, w in enumerate(("ads.*", "ad?.*", "track*.*.com", "*.doubleclick.example.*", "*.click-*.example.*", "m.*.spam.example.???", "blog.cheap-*"))]
    + [("short", "block", "*.example.???/??/?"), ("paged", "block", "*?page=????*"), ("deep", "block", "*/*/*/*/*/*/*/*/*")]
    + [("edu", "allow", "*.edu/*"), ("gov", "allow", "*.gov/*"), ("docs", "allow", "docs.*/*"), ("org-en", "allow", "*.example.org/en/*.html")]
)

#: (pattern, what for it with $n references), in order, on the lower-cased URL.
_CANON = (
    (r"#.*$", ""),
    (r"^[a-z][a-z0-9+.-]*://", ""),
    (r"^[^/?]*@", ""),
    (r"^([^/?:]*):(?:80|443)([/?]|$)", "$1$2"),
    (r"([?&])(?:utm_[a-z]+=[^&]*(?:&|$))+", "$1"),
    (r"[?&]+$", ""),
    (r"/+$", ""),
)


def canonical(url: Column) -> Column:
    out = F.lower(url)
    for pattern, by in _CANON:
        out = F.regexp_replace(out, pattern, by)
    return out


class Automaton:
    """All globs packed into words of 64 bits."""

    def __init__(self, globs: list[str]) -> None:
        symbols: list[list] = []  # for each bit: what the next symbol accepts (None: nothing, "?": all), and whether a star is there
        first, last = [], []
        for glob in globs:
            first.append(len(symbols))
            place: list = [None, False]
            for c in glob:
                if c == "*":
                    place[1] = True
                else:
                    place[0] = ("any",) if c == "?" else c
                    symbols.append(place)
                    place = [None, False]
            symbols.append(place)
            last.append(len(symbols) - 1)
        self.words = max(1, (len(symbols) + 63) // 64)
        literals = sorted({s[0] for s in symbols if isinstance(s[0], str)})
        self.codes = np.array([ord(c) for c in literals], np.uint32)
        # the last row is for characters that no rule names
        self.accepts = np.zeros((len(literals) + 1, self.words), np.uint64)
        self.stars, self.start, self.end = (np.zeros(self.words, np.uint64) for _ in range(3))
        bit = lambda j: (j >> 6, np.uint64(1) << np.uint64(j & 63))
        for j, (accepted, star) in enumerate(symbols):
            w, b = bit(j)
            if accepted == ("any",):
                self.accepts[:, w] |= b
            elif accepted is not None:
                self.accepts[literals.index(accepted), w] |= b
            if star:
                self.stars[w] |= b
        for j in first:
            w, b = bit(j)
            self.start[w] |= b
        self.last = np.array(last, np.int64)

    def run(self, texts: list[str]) -> np.ndarray:
        """For each text a row of booleans, one for each glob."""
        n = len(texts)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        begin, longest = begin[order], size[order]
        at = np.minimum(np.searchsorted(self.codes, flat), max(0, len(self.codes) - 1))
        kind = np.where(self.codes[at] == flat, at, len(self.codes)) if len(self.codes) else np.zeros(len(flat), np.int64)
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        active = np.searchsorted(-longest, -np.arange(int(size.max(initial=0))), "left")  # texts longer than each place
        for p, k in enumerate(active):
            d = state[:k]
            step = d & self.accepts[kind[begin[:k] + p]]
            moved = step << one
            moved[:, 1:] |= step[:, :-1] >> top
            state[:k] = moved | (d & self.stars)
        hit = (state[:, self.last >> 6] >> (self.last & 63).astype(np.uint64)) & one
        out = np.zeros((n, len(self.last)), bool)
        out[order] = hit.astype(bool)
        return out


def _matches(rules: tuple[tuple[str, str, str], ...]):
    rules = tuple(sorted(rules))
    if any("," in r[0] for r in rules) or len({r[0] for r in rules}) < len(rules):
        raise ValueError("rule names must differ and hold no comma")
    automaton = Automaton([r[2] for r in rules])
    names = np.array([r[0] for r in rules], object)
    allow = np.array([r[1] == "allow" for r in rules], bool)
    rows = max(1, min(2048, (1 << 20) // automaton.words))  # bounds the states held at once, however many rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                piece = batch.slice(a, rows)
                urls = piece.column(1).to_pylist()
                hit = automaton.run([u or "" for u in urls])
                hit[[u is None for u in urls]] = False
                blocked = hit[:, ~allow].any(1) & ~hit[:, allow].any(1)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(1).cast(pa.string()), pa.array([",".join(names[h]) for h in hit], pa.string()), pa.array(hit.sum(1).astype(np.int32)), pa.array(blocked),
                ], ["page_id", "canonical_url", "rules", "n_rules", "blocked"])

    return run


def match(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, canonical_url, rules, n_rules, blocked) for each row; rules are names in order, joined by commas."""
    schema = "page_id long, canonical_url string, rules string, n_rules int, blocked boolean"
    return pages.select(col(pages, id_col).cast("long").alias("page_id"), canonical(col(pages, url_col)).alias("url")).mapInArrow(_matches(rules), schema)


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """DuckDB SQL of match() over pages."""
    url = "lower(url)"
    for pattern, by in _CANON:
        flag = ", 'g'"
        url = f"regexp_replace({url}, '{pattern}', '{by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}'{flag})"
    values = ", ".join(f"('{r}', '{a}', '{g}')" for r, a, g in rules)
    return f"""
        with canon as (select row_number() over () as r, page_id, {url} as canonical_url from pages),
        hits as (select c.r, v.rule, v.action from canon c join (values {values}) v(rule, action, pat) on c.canonical_url glob v.pat)
        select any_value(c.page_id) as page_id, any_value(c.canonical_url) as canonical_url, coalesce(string_agg(h.rule, ',' order by h.rule), '') as rules,
            count(h.rule)::int as n_rules, coalesce(bool_or(h.action = 'block') and not bool_or(h.action = 'allow'), false) as blocked
        from canon c left join hits h on c.r = h.r group by c.r
    """
