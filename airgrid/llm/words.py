"""Words of whole texts as numpy arrays, without a Python step per word.

Words are runs of anything but ASCII white space (blank, tab to carriage return).  A word's name is a polynomial hash of its
bytes modulo the prime 2**61 - 1, mixed to 64 bits; the name of a run of words is one of their names.  Two families, each with
a point and byte values of its own, give two independent names.
"""

from __future__ import annotations

import numpy as np

# Constants of the published splitmix64 generator (fixed values), and odd numbers that tell the families apart.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PRIME = np.uint64((1 << 61) - 1)
BLOCK = 1 << 14
_29, _30, _31, _32, _61 = (np.uint64(k) for k in (29, 30, 31, 32, 61))
_LOW_29, _LOW_30, _LOW_31, _LOW_32 = (np.uint64((1 << k) - 1) for k in (29, 30, 31, 32))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def folded(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, for any 64-bit number."""
    out = x & PRIME
    out += x >> _61
    return np.minimum(out, out - PRIME)  # a difference below zero wraps around to a large number


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves that fit 64 bits: 2**62 is 2, and 2**61 is 1."""
    x, y = np.broadcast_arrays(x, y)
    out = np.empty(len(x), np.uint64)
    for at in range(0, len(x), BLOCK):  # a block stays in the cache
        a, b = x[at:at + BLOCK], y[at:at + BLOCK]
        a1, a0, b1, b0 = a >> _31, a & _LOW_31, b >> _31, b & _LOW_31
        middle = a1 * b0
        middle += a0 * b1
        product = a1 * b1
        product += product
        a0 *= b0
        product += a0
        product += middle >> _30
        middle &= _LOW_30
        middle <<= _31
        product += middle
        out[at:at + BLOCK] = folded(product)
    return out


def byte_values(family: int) -> np.ndarray:
    """A pseudo-random number below the prime for each byte."""
    with np.errstate(over="ignore"):
        return folded(mixed(np.arange(1, 257, dtype=np.uint64) * BASES[family] * np.uint64(0xA24BAED4963EE407)))


class Powers:
    """Powers of a family's point and of its inverse modulo the prime, grown as needed."""

    def __init__(self, family: int):
        self.point = int(folded(mixed(np.array([BASES[family]])))[0])
        self.inverse = pow(self.point, -1, int(PRIME))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            have = len(self.up)
            ups, downs = (np.array([pow(x, have, int(PRIME))], np.uint64) for x in (self.point, self.inverse))
            self.up = np.concatenate([self.up, times(self.up, ups)])
            self.down = np.concatenate([self.down, times(self.down, downs)])
        return self.up, self.down


class Sums:
    """Prefix sums of a sequence of numbers below the prime, from which any run of it gets its name.

    The sums are kept in two parts, of the low 32 bits and of the rest, so that they never overflow.
    """

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        up, self.down = powers.upto(n + 1)
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        for at in range(0, n, BLOCK):
            terms = times(folded(values[at:at + BLOCK]), up[at:min(n, at + BLOCK)])
            for part, sums in ((terms & _LOW_32, self.low), (terms >> _32, self.high)):
                here = sums[at + 1:at + 1 + len(part)]
                np.cumsum(part, out=here)
                here += sums[at]

    def names(self, begins: np.ndarray, ends: np.ndarray | int) -> np.ndarray:
        """Names of the runs [begin, end)."""
        out = np.empty(len(begins), np.uint64)
        for at in range(0, len(begins), BLOCK):
            b, e = begins[at:at + BLOCK], ends[at:at + BLOCK]
            high = self.high[e] - self.high[b]
            total = folded((self.low[e] - self.low[b]) + (high >> _29))
            high &= _LOW_29
            high <<= _32
            total += high
            with np.errstate(over="ignore"):
                out[at:at + BLOCK] = mixed(times(folded(total), self.down[b]) + (e - b).astype(np.uint64))
        return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of each word of a text's UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    if inside[-1]:
        edge = np.concatenate([edge, [len(data)]])
    return edge[0::2], edge[1::2]


class Words:
    """The words of several texts in one go.

    ``names`` are the words' names, ``begins`` and ``ends`` their bytes in ``data``, ``first[k]`` the first word of text k
    (``first[-1]`` the number of words).
    """

    def __init__(self, texts: list[bytes], family: int = 0, space: np.ndarray = SPACE, powers: Powers | None = None):
        self.powers = powers or Powers(family)
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.begins, self.ends = word_bounds(self.data, space)
        self.first = np.searchsorted(self.begins, np.append(self.starts, len(self.data) + 1))
        self.names = Sums(byte_values(family)[self.data], self.powers).names(self.begins, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), np.diff(self.first))

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and names of all runs of ``length`` words of one text."""
        n = len(self.names) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = self.text_of_word()
        begins = np.flatnonzero(text[:n] == text[length - 1:])
        return begins, Sums(self.names, self.powers).names(begins, begins + length)
