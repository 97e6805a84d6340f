"""Command line for single files: factorize to a stream, compress with gaps, and back.

    python -m refrain.cli factorize [--mode exact|lpf_naive|lpf_opt|lpf_lnf_naive|lpf_lnf_opt] [--tau N] [-o OUT] FILE
    python -m refrain.cli decode [-o OUT] FILE.lz
    python -m refrain.cli compress [-e zstd|xz|bz2|gzip|none] [-N LEVEL] [--tau N] [-k] [-q] [-o OUT] FILE
    python -m refrain.cli decompress [-k] [-q] [-o OUT] FILE.gap.EXT

compress and decompress delete their input unless -k is given, and only once the output is written. Files are read
whole; corpora belong in tables and the operators.
"""

from __future__ import annotations

import argparse
import bz2
import gzip
import lzma
import sys
import time
from pathlib import Path

import numpy as np
import zstandard

from .functions import codec, factors
from .functions.suffixes import Suffixes

ENCODERS = {
    "zstd": (".zst", lambda d, n: zstandard.compress(d, n or 4), zstandard.decompress),
    "xz": (".xz", lambda d, n: lzma.compress(d, preset=n or 6), lzma.decompress),
    "bz2": (".bz2", lambda d, n: bz2.compress(d, n or 9), bz2.decompress),
    "gzip": (".gz", lambda d, n: gzip.compress(d, n or 6, mtime=0), gzip.decompress),
    "none": (".raw", lambda d, n: d, lambda d: d),
}


def _index(data: bytes) -> Suffixes:
    return Suffixes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


def size(n: float) -> str:
    """Bytes in the unit that fits."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1000 or unit == "GB":
            return f"{n:.4g} {unit}"
        n /= 1000
    raise AssertionError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="refrain", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["factorize", "decode", "compress", "decompress"])
    p.add_argument("file", type=Path)
    p.add_argument("-o", "--output", type=Path)
    p.add_argument("--mode", default="exact", choices=["exact", *factors.PHRASES])
    p.add_argument("--tau", type=int, default=32)
    p.add_argument("-e", "--encoder", default="zstd", choices=list(ENCODERS))
    p.add_argument("-N", "--level", type=int, default=0)
    p.add_argument("-k", "--keep", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(argv)
    if not a.file.is_file():
        p.error(f"there is no file {a.file}")
    data, began = a.file.read_bytes(), time.time()
    said = ""
    if a.command == "factorize":
        f = factors.exact(_index(data)) if a.mode == "exact" else factors.approximate(_index(data), a.tau, a.mode)
        out, to = codec.write_factors(len(data), f["pos"], f["src"], f["len"], f["literal"]), Path(f"{a.file}.lz")
        said = f", {len(f['pos'])} factors, {len(data) / max(1, len(f['pos'])):.2f} bytes each"
    elif a.command == "decode":
        f = np.array(list(codec.read_factors(data)), np.int64).reshape(-1, 4)
        out, to = factors.decode(f[:, 1], f[:, 2], f[:, 3]), a.file.with_suffix("") if a.file.suffix == ".lz" else Path(f"{a.file}.out")
    elif a.command == "compress":
        ext, encode, _ = ENCODERS[a.encoder]
        out, to = encode(codec.write_gapped(data, factors.gapped(_index(data), 0, a.tau)), a.level), Path(f"{a.file}.gap{ext}")
    else:
        way = next((d for ext, _, d in ENCODERS.values() if a.file.suffix == ext), None)
        if way is None:
            p.error(f"no encoder writes files that end in {a.file.suffix!r}")
        inner = a.file.with_suffix("")
        out, to = codec.read_gapped(way(data)), inner.with_suffix("") if inner.suffix == ".gap" else Path(f"{a.file}.out")
    to = a.output or to
    to.write_bytes(out)
    if a.command in ("compress", "decompress") and not a.keep and to.resolve() != a.file.resolve():
        a.file.unlink()
    if not a.quiet:
        print(f"{a.file}: {size(len(data))} to {size(len(out))} in {time.time() - began:.2f} s{said}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
