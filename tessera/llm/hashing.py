"""Hashes of byte strings that numpy computes many at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: A prime field, and four points of it at which strings are evaluated as polynomials: 124 bits in all. Modulo a
#: prime, unlike a power of two, strings of n bytes collide at no more than n of the points.
FIELD = (1 << 31) - 1
POINTS = (1_198_754_321, 914_063_777, 1_741_330_883, 502_290_119)
#: Bytes whose powers are looked up at once; longer strings get a table of their own length.
CHUNK = 1 << 18
#: Bytes up to which the sums of unreduced terms, of 40 bits each, stay below 2 ** 64.
UNREDUCED = 1 << 23


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * MULTIPLIERS[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


@cache
def field_powers(point: int, n: int) -> np.ndarray:
    """Powers of a point of the field, by doubling."""
    p, size = np.ones(n, np.uint64), 1
    while size < n:
        more = min(size, n - size)
        p[size : size + more] = p[:more] * np.uint64(pow(point, size, FIELD)) % np.uint64(FIELD)
        size += more
    return p.astype(np.uint32)


def digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 62-bit digests of the bytes lo to hi (not included) of each string; lo ascends.

    Equal strings have equal digests; strings of n bytes that differ have the same with a chance of (n / 2**31)**4.
    """
    out = np.empty((4, len(lo)), np.uint64)
    at = 0
    while at < len(lo):
        start = int(lo[at])
        end = max(int(np.searchsorted(lo, start + CHUNK)), at + 1)
        stop = int(hi[at:end].max())
        part = data[start:stop].astype(np.uint64) + np.uint64(1)
        size = len(part)
        wide = max(2 * CHUNK, 1 << size.bit_length())
        a, b = lo[at:end] - start, hi[at:end] - start
        total = np.zeros(size + 1, np.uint64)
        for k, point in enumerate(POINTS):
            terms = part * field_powers(point, wide)[:size]
            if size > UNREDUCED:
                terms %= np.uint64(FIELD)
            np.cumsum(terms, out=total[1:])
            out[k, at:end] = (total[b] - total[a]) % np.uint64(FIELD) * field_powers(pow(point, -1, FIELD), wide)[a] % np.uint64(FIELD)
        at = end
    return (out[0] << np.uint64(31) | out[1]).view(np.int64), (out[2] << np.uint64(31) | out[3]).view(np.int64)
