"""Words of Arrow text batches as numpy arrays: positions, hashes, shingles. Nothing here loops over words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 2 << 20
#: The same where every byte or word becomes several numbers of eight bytes.
SLICE = 1 << 19
#: Bytes of a word from which on it is digested alone.
LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Masks of the first n bytes of eight.
_FIRST = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, last row + 1, bytes, offsets`` of pieces of about ``size`` bytes; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + size, "right")) - 1)
        yield start, stop, data[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start]
        start = stop


def find_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run without ASCII white space, and the index of each document's first word (plus the total)."""
    solid = ~_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offs[:-1][offs[:-1] < len(data)]
    begin[edges] = solid[edges]
    edges = offs[1:][offs[1:] > 0] - 1
    end[edges] = solid[edges]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, min(2 * n, CHUNK + 1))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased: a polynomial by prefix sums, then mixed."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, long: int = LONG) -> np.ndarray:
    """64 bits of each word (or other stretch), A-Z lower-cased if ``lower``, by eight bytes at a time through a mixing permutation that starts from the length.

    Unlike the polynomial of :func:`hash_words` this has no algebraic structure, so no family of words collides by construction.
    Those over ``long`` bytes are digested one by one.
    """
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", low, 0, (1,))  # the eight bytes from each place
    size = ends - starts
    code = mix64(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019))
    live, at = np.flatnonzero(size <= long), starts
    while len(live):
        rest = ends[live] - at[live]
        code[live] = mix64(code[live] ^ (eight[at[live]] & _FIRST[np.minimum(rest, 8)]))
        live = live[rest > 8]
        at = at + 8
    for i in np.flatnonzero(size > long).tolist():
        code[i] = int.from_bytes(blake2b(low[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return code


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width`` consecutive words per document; a shorter document is one sequence; none if empty."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled = mix64(rolled + hashes[j : j + len(rolled)] + np.uint64(j + 1))
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for j, x in enumerate(hashes[a:b]):
                    h = mix64(h + x + np.uint64(j + 1 + 1000 * (b - a)))
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def byte_counts(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each document are in ``mask``."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offs[1:]] - sums[offs[:-1]]
