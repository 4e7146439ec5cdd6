"""Words of many texts as numpy arrays: boundaries, hashes, runs of words; no Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from muralis.llm.common import text_buffer

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so both have inverses modulo 2**64
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_EMPTY, _LINE = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below n (kept and grown by doubling)."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, _U)
            p[0] = 1
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * _U(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        _powers[base] = (out[0], out[1])
    return _powers[base]


def rolling(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs ``values[start:stop]``, alike for alike runs wherever they stand."""
    up, down = _power(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts.  ``comp`` holds them with one space after each;
    word i is ``comp[start[i]:stop[i]]`` with hash ``hash[i]``; text d has the words ``first[d]:first[d+1]``."""

    def __init__(self, texts: pa.Array):
        raw, at = text_buffer(pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), _EMPTY, _LINE))
        solid = ~_SPACE[raw]
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        comp, solid_c = raw[keep], solid[keep]
        comp = np.where(solid_c, comp, np.uint8(32))
        self.comp = comp
        self.stop = np.flatnonzero(~solid_c)
        self.start = np.append(0, self.stop[:-1] + 1) if len(self.stop) else self.stop
        ends = np.flatnonzero(keep & ~solid)  # in raw
        self.first = np.searchsorted(ends, at)
        self.n = len(self.stop)
        self.hash = rolling(_BYTE[comp], self.start, self.stop, _BASE)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all runs of ``length`` words inside one text, and their hashes."""
        at = self.run_starts(length)
        return at, rolling(self.hash, at, at + length, _STEP)

    def run_starts(self, length: int) -> np.ndarray:
        counts = np.maximum(np.diff(self.first) - length + 1, 0)
        return np.repeat(self.first[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())

    def slices(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """Words ``a[i]`` up to, not with, ``b[i]``, joined by one space each, as a binary array."""
        return gather(self.comp, self.start[a], self.stop[b - 1])


def gather(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    sizes = stop - start
    offs = np.append(0, np.cumsum(sizes))
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data[at])])
