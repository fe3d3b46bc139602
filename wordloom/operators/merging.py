"""Greedy merges over pieces that fit the driver's memory.

The symbols of all pieces lie in one flat array, one number a symbol.  A token of
several symbols is kept at its first position, its length at its first and last
position, so that both neighbours are found without links.  A merge looks at the
places of the rarer symbol of its pair and reports how pair counts changed.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterable

import numpy as np

CHUNK = 1_000_000
_SHIFT = 32  # a pair of symbol numbers as one integer
_GAP = -1    # before, between and after the pieces


class FlatPieces:
    """Pieces as flat arrays, and the counts of their pairs."""

    def __init__(self, pieces: Iterable[tuple[list[str], int]], likelihood: bool = False, min_frequency: int = 1):
        self.likelihood, self.least = likelihood, min_frequency
        self.number: dict[str, int] = {}
        flat, starts, weights = array("i", [_GAP]), array("i"), array("q")
        longest = 1
        for symbols, n in pieces:
            starts.append(len(flat))
            weights.append(n)
            flat.extend([self.number.setdefault(s, len(self.number)) for s in symbols])
            flat.append(_GAP)
            longest = max(longest, len(symbols))
        self.names = list(self.number)
        self.sym = np.frombuffer(flat, np.int32)
        self.starts, self.weights = np.frombuffer(starts, np.int32), np.frombuffer(weights, np.int64)
        self.size = np.ones(len(self.sym), np.uint16 if longest < 2**16 else np.int32)
        self.places: dict[int, np.ndarray] = {}  # of symbols asked for so far
        self.pairs: dict[int, int] = {}
        self.single: list[int] = [0] * len(self.names)
        self.near: dict[int, set[int]] = {}  # symbol -> its pairs, for likelihoods
        self.heap: list[tuple[float, str, str]] = []
        self.hot = 0.0  # pairs below this value are left out of the heap for now
        self._count()

    def _weight(self, at: np.ndarray) -> np.ndarray:
        return self.weights[np.searchsorted(self.starts, at, "right") - 1]

    def _count(self) -> None:
        for lo in range(0, len(self.sym) - 1, CHUNK):
            at = np.arange(lo, min(lo + CHUNK, len(self.sym) - 1))
            at = at[self.sym[at] != _GAP]
            n = self._weight(at)
            if self.likelihood:
                for k, c in enumerate(np.bincount(self.sym[at], n, len(self.names)).tolist()):
                    self.single[k] += int(c)
            both = self.sym[at + 1] != _GAP
            self._add(*_summed(self._keys(at[both], at[both] + 1), n[both]))

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (self.sym[left].astype(np.int64) << _SHIFT) | self.sym[right]

    def _add(self, keys: np.ndarray, changes: np.ndarray) -> list[int]:
        """Changes the counts; the pairs that are left."""
        out = []
        for key, change in zip(keys.tolist(), changes.tolist()):
            n = self.pairs.get(key, 0) + change
            if n:
                self.pairs[key] = n
                out.append(key)
            else:
                self.pairs.pop(key, None)
            if self.likelihood:
                for s in (key >> _SHIFT, key & (2**_SHIFT - 1)):
                    (self.near.setdefault(s, set()).add if n else self.near.setdefault(s, set()).discard)(key)
        return out

    def value(self, key: int) -> float:
        n = self.pairs.get(key, 0)
        if n < self.least:
            return 0.0
        return n / (float(self.single[key >> _SHIFT]) * float(self.single[key & (2**_SHIFT - 1)])) if self.likelihood else n

    def _push(self, keys: Iterable[int]) -> None:
        for key in keys:
            if (v := self.value(key)) > 0 and v >= self.hot:
                heapq.heappush(self.heap, (-v, self.names[key >> _SHIFT], self.names[key & (2**_SHIFT - 1)]))

    def _best(self) -> tuple[str, str] | None:
        """The best pair, ties by its symbols.  The heap holds all pairs of at least ``hot``."""
        while True:
            while self.heap:
                v, left, right = heapq.heappop(self.heap)
                if self.value(self.number[left] << _SHIFT | self.number[right]) == -v:
                    return left, right
            values = np.fromiter((self.value(k) for k in self.pairs), float, len(self.pairs))
            values = values[values > 0]
            if not len(values):
                return None
            # a part of the pairs at a time, but all those of one value
            k = min(len(values), 50_000)
            self.hot = float(np.partition(values, len(values) - k)[len(values) - k])
            self._push(list(self.pairs))

    def _places(self, symbol: int) -> np.ndarray:
        """Where the symbol stands now."""
        at = self.places.get(symbol)
        at = np.flatnonzero(self.sym == symbol).astype(np.int32) if at is None else at[self.sym[at] == symbol]
        self.places[symbol] = at
        return at

    def _before(self, at: np.ndarray) -> np.ndarray:
        return at - self.size[at - 1]

    def _after(self, at: np.ndarray) -> np.ndarray:
        return at + self.size[at]

    def _around(self, at: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and signed weights of the pairs that start at the sorted places ``at``."""
        right = self._after(at)
        both = (self.sym[at] != _GAP) & (self.sym[right] != _GAP)
        return self._keys(at[both], right[both]), sign * self._weight(at[both])

    def _merge(self, left: str, right: str, merged: str) -> None:
        a, b = self.number[left], self.number[right]
        one, two = self._places(a), self._places(b)
        if len(one) <= len(two):
            first = one[self.sym[self._after(one)] == b]
        else:
            first = self._before(two)
            first = first[self.sym[first] == a]
        if a == b:  # in a row of equal symbols every other one begins a merge, from the left
            follows = np.zeros(len(first), bool)
            follows[1:] = self._after(first)[:-1] == first[1:]
            run = np.arange(len(first)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(first))))
            first = first[run % 2 == 0]
        second = self._after(first)
        old = self._around(_distinct(np.concatenate([self._before(first), first, second])), -1)
        m = self.number.setdefault(merged, len(self.names))
        if m == len(self.names):
            self.names.append(merged)
            self.single.append(0)
            self.places[m] = np.empty(0, np.int32)
        length = self.size[first] + self.size[second]
        self.sym[first], self.sym[second] = m, -2
        self.size[first] = length
        self.size[first + length - 1] = length
        self.places[m] = np.sort(np.concatenate([self.places[m], first.astype(np.int32)])) if len(self.places[m]) else first.astype(np.int32)
        new = self._around(_distinct(np.concatenate([self._before(first), first])), 1)
        changed = self._add(*_summed(*map(np.concatenate, zip(old, new))))
        if self.likelihood:
            n = int(self._weight(first).sum())
            self.single[a] -= n
            self.single[b] -= n
            self.single[m] += n
            changed = {*changed, *self.near.get(a, ()), *self.near.get(b, ()), *self.near.get(m, ())}
        self._push(changed)

    def train(self, room: int, merge: Callable[[str, str], str]) -> list[tuple[int, str, str, str]]:
        """rank, left, right, merged of the greedy merges that make ``room`` symbols."""
        merges, seen = [], set()
        while room > len(seen) and (best := self._best()):
            merged = merge(*best)
            merges.append((len(merges), *best, merged))
            seen.add(merged)
            self._merge(*best, merged)
        return merges


def _distinct(at: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; np.unique costs several times as much on short arrays."""
    at.sort()
    keep = np.empty(len(at), bool)
    keep[:1] = True
    np.not_equal(at[1:], at[:-1], out=keep[1:])
    return at[keep]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys whose sum is not zero."""
    if not len(keys):
        return keys, n
    order = keys.argsort()
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.add.reduceat(n[order], first)
    return keys[first][total != 0], total[total != 0]


class SideBySide:
    """Pieces cut by merges, many at once: at each turn every piece merges its best pair, the leftmost place first."""

    LONGEST = 64  # symbols of a piece that is cut together with others
    _NEVER = 2**31 - 1
    _MADE = 0x110000  # numbers of made symbols; below, a code point or a byte

    def __init__(self, ranks: dict[tuple[str, str], int], known: set[str], unknown: str, in_bytes: bool):
        self.in_bytes, self.known, self.unknown, self.names = in_bytes, known, unknown, []
        number: dict[str, int] = {}

        def of(name: str) -> int:
            if len(name) == 1 + in_bytes:
                return int(name, 16) if in_bytes else ord(name)
            if name not in number:
                number[name] = self._MADE + len(self.names)
                self.names.append(name)
            return number[name]

        rows = sorted((of(a) << _SHIFT | of(b), of(a + b), rank) for (a, b), rank in ranks.items())
        self.keys, self.made, self.rank = (np.array([r[k] for r in rows], np.int64) for k in range(3))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and what it becomes."""
        if not len(self.keys):
            return np.full(len(left), self._NEVER), left
        keys = left << _SHIFT | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], self._NEVER), self.made[at]

    def _name(self, symbol: int) -> str:
        if symbol >= self._MADE:
            name = self.names[symbol - self._MADE]
        else:
            name = f"{symbol:02X}" if self.in_bytes else chr(symbol)
        return name if name in self.known else self.unknown

    def cut(self, pieces: list[str], alone: Callable[[str], list[str]]) -> list[list[str]]:
        """Tokens of each piece; ``alone`` cuts the very long ones."""
        forms = [p.encode("utf-8") for p in pieces] if self.in_bytes else pieces
        out: list = [[] if not f else alone(p) if len(f) > self.LONGEST else None for p, f in zip(pieces, forms)]
        which = [k for k, tokens in enumerate(out) if tokens is None]
        if not which:
            return out
        if self.in_bytes:
            work = np.frombuffer(b"".join(forms[k] for k in which), np.uint8).astype(np.int64)
        else:
            work = np.frombuffer("".join(forms[k] for k in which).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        counts, of = np.array([len(forms[k]) for k in which], np.int64), np.arange(len(which))
        ends = np.cumsum(counts)
        rank, made = np.full(len(work), self._NEVER), np.zeros(len(work), np.int64)
        inner = np.ones(len(work), bool)
        inner[ends - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner], made[inner] = self._ranks(work[inner], work[inner + 1])
        done_work, done_of = [], []
        while len(of):
            begin = np.cumsum(counts) - counts
            first = np.minimum.reduceat(rank << _SHIFT | np.arange(len(work)), begin)
            goes_on = (first >> _SHIFT) < self._NEVER
            stay = np.repeat(goes_on, counts)
            done_work.append(work[~stay])
            done_of.append(np.repeat(of[~goes_on], counts[~goes_on]))
            places = first[goes_on] & (2**_SHIFT - 1)
            work[places] = made[places]
            stay[places + 1] = False
            places = (np.cumsum(stay) - 1)[places]
            work, rank, made, of, counts = work[stay], rank[stay], made[stay], of[goes_on], counts[goes_on] - 1
            begin = np.cumsum(counts) - counts
            rank[places] = self._NEVER
            at = np.concatenate([places[places > begin] - 1, places[places < begin + counts - 1]])
            rank[at], made[at] = self._ranks(work[at], work[at + 1])
        work, of = np.concatenate(done_work), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        symbols, index = np.unique(work[order], return_inverse=True)
        names = [self._name(s) for s in symbols.tolist()]
        tokens, at = [names[k] for k in index.tolist()], 0
        for k, n in zip(which, np.bincount(of, minlength=len(which)).tolist()):
            out[k] = tokens[at: at + n]
            at += n
        return out


def replayer(merges: list[tuple[int, str, str, str]]):
    """Function from the symbols of a piece to its tokens after ``merges``.  A pair may be
    merged at several ranks: one that appears late waits for the next of them."""
    ranks: dict[tuple[str, str], list[int]] = {}
    for rank, left, right, _ in merges:
        ranks.setdefault((left, right), []).append(rank)
    made = [m for *_, m in merges]

    def replay(parts: list[str]) -> list[str]:
        from bisect import bisect

        parts = list(parts)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i, j, now):
            pair = (parts[i], parts[j])
            later = ranks.get(pair, ())
            if (k := bisect(later, now)) < len(later):
                heapq.heappush(heap, (later[k], i, pair))

        for i in range(n - 1):
            offer(i, i + 1, -1)
        while heap:
            rank, i, (left, right) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = made[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    offer(x, y, rank)
        return [p for p in parts if p is not None]

    return replay
