"""The packing of a histogram of lengths; its size depends on the capacity alone, so it runs on the driver.

The configuration program has a variable for each multiset of lengths that fits a sequence, and
asks that each length be covered as often as it occurs, with the fewest sequences. Multiplicative
weights keep a price for each length, higher the less it is covered; knapsack dynamic programming
over the prices finds the best fill of every capacity, and with it for each length the best
configuration that holds it. Every length takes part.

By duality, prices under which no configuration is worth more than 1 bound the number of sequences
from below. The program's solution is rounded in several ways: down, and then with one more of those
configurations whose fraction is large enough, the largest first, while their pieces last. What is left over is
placed best fit, longest first, and the way with the fewest sequences is taken; of equal ones that in
which the program gives the most. One of the ways rounds all of the program away, so that no more
sequences come out than best fit alone needs.

The result is runs: (length, n, first sequence, offset) puts n pieces of that length at that offset
of n sequences in a row.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Passes of a round, each over the lengths that the ones before left open.
PASSES = 4
#: Fractions from which a configuration is taken once more; above 1 it is only rounded down.
LEAST_FRACTIONS = (1.1, 0.0)
#: Room that a configuration may leave, in the several ways.
MOST_WASTE = (1, 0)


def best_fills(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each capacity and a length that it ends with (0: none).

    value[l] is the price of length l, under 0 for lengths that may not be used.
    """
    lengths = np.nonzero(value > 0)[0]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        usable = lengths[: np.searchsorted(lengths, c, side="right")]
        best[c] = best[c - 1]
        if len(usable):
            got = value[usable] + best[c - usable]
            k = len(got) - 1 - (got[::-1] >= got.max() - 1e-12).argmax()  # of equals the longest: short ones fill later gaps
            if got[k] > best[c] + 1e-12:
                best[c], last[c] = got[k], usable[k]
    return best, last


def _traced(last: np.ndarray, capacity: int) -> list[int]:
    out, c = [], capacity
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return out


def configurations(counts: np.ndarray, capacity: int, rounds: int, eta: float = 0.5) -> tuple[list[tuple[list[int], float]], float]:
    """(lengths, times): a fractional solution of the program over lengths below the capacity; and the best dual bound."""
    kinds = np.nonzero(counts[:capacity])[0]
    bound = float((kinds * counts[kinds]).sum() / capacity)
    need = counts[kinds].astype(float)
    where = {int(x): i for i, x in enumerate(kinds)}
    price = (kinds / capacity) ** 1.01
    covered = np.zeros(len(kinds))
    found: dict[tuple[int, ...], float] = {}
    for r in range(rounds):
        open_share = need / rounds + np.maximum(need * r / rounds - covered, 0)
        for again in range(PASSES):
            # The best fills of lengths that are still open in this round; in the first pass all are, which gives a dual bound.
            some = open_share > 1e-6
            if not some.any():
                break
            value = np.full(capacity + 1, -1.0)
            value[kinds[some]] = price[some]
            best, last = best_fills(value, capacity)
            if not again and some.all():
                bound = max(bound, float(need @ price / best[capacity]))
            gain = np.where(some, price + best[capacity - kinds], -1)
            for i in np.lexsort((-kinds, -gain)):
                if open_share[i] <= 1e-6:
                    continue
                config = sorted([int(kinds[i]), *_traced(last, capacity - int(kinds[i]))], reverse=True)
                many = Counter(config)
                times = min(open_share[where[x]] / n for x, n in many.items())
                if times <= 1e-6:
                    continue
                found[tuple(config)] = found.get(tuple(config), 0.0) + times
                for x, n in many.items():
                    open_share[where[x]] -= times * n
                    covered[where[x]] += times * n
        behind = 1 - covered / np.maximum(need * (r + 1) / rounds, 1e-9)
        price = price * np.exp(eta * np.clip(behind, -1, 1))
        price = price / (price / kinds).max() / capacity
    return sorted(((list(c), t) for c, t in found.items()), key=lambda x: (-sum(x[0]), -x[1], x[0])), bound


class Packing:
    """Runs, and the sequences that have room left, of a histogram that is being packed."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.rest = capacity, counts.astype(np.int64).copy()
        self.runs: list[tuple[int, int, int, int]] = []
        self.sequences = 0
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, n)

    def add(self, config: list[int], times: int) -> int:
        """New sequences with that configuration, as many as the pieces left make at most; how many."""
        kinds, each = np.unique(config, return_counts=True)
        n = int(min(times, (self.rest[kinds] // each).min()))
        if n > 0:
            at = 0
            for x in config:
                self.runs.append((x, n, self.sequences, at))
                at += x
            self.rest[kinds] -= n * each
            self.free[self.capacity - at].append((self.sequences, n))
            self.sequences += n
        return max(n, 0)

    def best_fit(self) -> None:
        """Places what is left, longest first, where the least room is left."""
        for x in range(self.capacity, 0, -1):
            left, room = int(self.rest[x]), x
            self.rest[x] = 0
            while left:
                while room <= self.capacity and not self.free[room]:
                    room += 1
                if room > self.capacity:
                    self._open(x, left)
                    break
                first, n = self.free[room].pop()
                take = min(n, left)
                self.runs.append((x, take, first, self.capacity - room))
                self.free[room - x].append((first, take))
                if n > take:
                    self.free[room].append((first + take, n - take))
                left -= take
                room = max(x, room - x)  # what it left may be the best fit for the next

    def _open(self, x: int, left: int) -> None:
        """New sequences, each filled with as many of the length as fit."""
        per = self.capacity // x
        n, odd = divmod(left, per)
        for many, each, first in ((n, per, self.sequences), (1 if odd else 0, odd, self.sequences + n)):
            if many:
                for k in range(each):
                    self.runs.append((x, many, first, k * x))
                self.free[self.capacity - each * x].append((first, many))
                self.sequences += many


@dataclass
class Plan:
    """runs; the number of sequences; how many of them the program gave; and a bound that none can be under."""

    runs: np.ndarray
    sequences: int
    from_program: int
    bound: int


def solve(counts: np.ndarray, capacity: int, rounds: int = 8) -> Plan:
    """The packing of counts[l] pieces of each length l."""
    found, bound = configurations(counts, capacity, rounds) if counts[1:capacity].any() else ([], 0.0)
    best: tuple[Packing, int] | None = None
    for waste in (capacity, *MOST_WASTE, -1):  # the last: best fit alone
        some = [(config, times) for config, times in found if capacity - sum(config) <= waste]
        by_fraction = sorted(some, key=lambda x: (-(x[1] % 1), -sum(x[0]), x[0]))
        for least in LEAST_FRACTIONS if some else (2.0,):
            p = Packing(counts, capacity)
            p.add([capacity], int(counts[capacity]))
            given = sum(p.add(config, int(times + 1e-9)) for config, times in some)
            given += sum(p.add(config, 1) for config, times in by_fraction if times % 1 >= max(least, 1e-3))
            p.best_fit()
            if best is None or (p.sequences, -given) < (best[0].sequences, -best[1]):
                best = p, given
    p, given = best
    whole = int(counts[capacity])
    return Plan(np.array(p.runs, np.int64).reshape(-1, 4), p.sequences, given, whole + int(np.ceil(bound - 1e-6)))


def plan(counts: np.ndarray, capacity: int, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Runs (length, n, first sequence, offset), and the number of sequences; counts[l] pieces have length l."""
    p = solve(counts, capacity, rounds)
    return p.runs, p.sequences
