"""SetSketch registers of word shingles, in numpy; what runs inside the tasks of near-dedup.

A register is the truncated, exponentially spaced minimum of exponential variates of a set's
elements: with u the least of uniform hashes, floor(1 - log_b(-ln(1 - u) / a)), held to 0..q+1.
The registers of a union are the maxima of the registers, element by element. Two sets' registers
are equal, or one is greater, with chances that depend only on their Jaccard similarity and their
sizes, which gives a likelihood.
"""

import functools
import re

import numpy as np
import xxhash

#: Fixed parameters of the sketch: base, rate, highest register less one, registers, rows a band.
B, A, Q, M, ROWS = 1.001, 20.0, 2**16 - 2, 160, 5
BANDS = M // ROWS
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile("[A-Z]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.cache
def multipliers() -> np.ndarray:
    """Two columns of odd 32-bit factors and of offsets, fixed by rule."""
    return np.stack([mix(np.arange(1, M + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1), mix(np.arange(M + 1, 2 * M + 1, dtype=np.uint64)).astype(np.uint32)])


class Shingler:
    """Sets of 64-bit shingle hashes; remembers hashes of words, and forgets them all when they are too many."""

    def __init__(self, size: int, most: int = 400_000):
        self.size, self.most, self.seen = size, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles; with fewer words than size, all of them as one; without words, none."""
        text = text or ""
        ws = WORD.findall(text.lower() if text.isascii() else UPPER.sub(lambda m: m[0].lower(), text))
        if not ws:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(ws).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))
        n = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                out = mix(out * _P + h[k : len(h) - n + 1 + k])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def registers(shingles: np.ndarray) -> np.ndarray:
    """M registers of a non-empty set."""
    factor, offset = multipliers()
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        part = h[at : at + 2048]
        np.minimum(least, (part[None, :] * factor[:, None] + offset[:, None]).min(axis=1), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / A) / np.log(B)), 0, Q + 1).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the number of the band is part of it."""
    rows = regs.reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mix(key * _P + rows[:, k])
    return key.view(np.int64)


def joint_estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarities of rows of registers x and y of sets of nx and ny elements.

    With u = n / (nx + ny), a register of x is greater with chance p(ux - uy j), lesser with chance
    p(uy - ux j), equal otherwise, p(t) = -log_b(1 - t (b - 1) / b). The likelihood is searched on a grid.
    """
    up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - up - down
    total = (nx + ny).astype(np.float64)
    ux, uy = nx / total, ny / total
    grid = np.linspace(0, 1, 101)[None, :] * (np.minimum(nx, ny) / np.maximum(nx, ny))[:, None]
    p = lambda t: -np.log1p(-np.clip(t, 0, 1) * (B - 1) / B) / np.log(B)
    tiny = 1e-12
    more, less = p(ux[:, None] - uy[:, None] * grid), p(uy[:, None] - ux[:, None] * grid)
    ll = up[:, None] * np.log(more + tiny) + down[:, None] * np.log(less + tiny) + same[:, None] * np.log(np.maximum(1 - more - less, tiny))
    return grid[np.arange(len(grid)), ll.argmax(axis=1)]
