"""Words and rolling hashes of whole texts, vectorised over slices of an Arrow batch.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab,
form feed and carriage return (``[^\\x20\\x09-\\x0D]+``): just what ``bytes.split()``
cuts out of UTF-8, since no byte of a longer code point lies below 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Bytes of text that one slice holds at most (a longer single text makes its own slice).
SLICE_BYTES = 4 << 20

_MULT = 0x9E3779B97F4A7C15


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8 or None) of consecutive slices of bounded size."""
    raw = texts.cast(pa.large_binary())
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    start, size, held = 0, 0, []
    for i, x in enumerate(raw):
        b = x.as_py()
        if held and size + len(b or b"") > most:
            yield start, held
            start, size, held = i, 0, []
        held.append(b)
        size += len(b or b"")
    if held:
        yield start, held


def words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def flat_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and len(docs) + 1 offsets."""
    off = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=off[1:])
    flat = np.fromiter((h for d in docs for h in map(xxh3_64_intdigest, d)), np.uint64, int(off[-1]))
    return flat, off


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling(h: np.ndarray, k: int, seed: int = _MULT) -> np.ndarray:
    """Hash of the k consecutive values from each place on (len(h) - k + 1 of them), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out = power[: len(h)]
            else:
                m = np.uint64(pow(seed, width, 1 << 64))
                out = out[: len(h) - done - width + 1] * m + power[done : done + len(h) - done - width + 1]
            done += width
        rest >>= 1
        if rest:
            m = np.uint64(pow(seed, width, 1 << 64))
            power = power[: len(power) - width] * m + power[width:]
            width *= 2
    return mixed(out[:n])


def window_starts(off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat places at which a window of k words of one document starts, and the document of each."""
    n = np.maximum(off[1:] - off[:-1] - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) - first[doc] + off[:-1][doc], doc
