"""Greedy merges over pieces that stay distributed.

The driver never sees the pieces.  It holds the most frequent pairs (at most HOT) and
works in rounds.  A round takes the first pairs of the greedy order as candidates; one
job cuts the regions around them out of all pieces, each with a few symbols of context,
and adds up equal regions.  On these few rows the driver finds the next merges and the
exact change of every pair count, as long as

* the best pair stands before the first pair that was no candidate (its count can only
  have fallen since), and
* all its places lie inside their regions: nothing unknown comes next to a new symbol.

A round makes at least one merge.  If its regions are too many, it is tried again with
fewer candidates and less context; without context it makes exactly one merge, and the
changed counts come from a job.  Pieces are rewritten after a few rounds; in between
the merges made since are applied again while reading.

Where possible a stage takes the place of many rounds.  A pair less frequent than some
least count stays so, and so does every later pair that spans one of its places; so the
pieces may be cut there as long as the best pair is at least so frequent.  What is left
are segments, of which far fewer are different; the driver merges them in the greedy
order down to the least count.  The count is the lowest one, of a few, whose segments are
not too many; a sample of them by hash tells that beforehand, and they are measured
before they are sent.  An old symbol made again in another way ends a stage.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.operators.merging import FlatPieces
from wordloom.session import scratch_dir, spread

HOT = 300_000          # pairs that the driver holds
REGIONS = 150_000      # regions that a round may send to it
CANDIDATES = 4_096     # of a round, at most
CONTEXT = 4            # symbols kept on each side of a candidate, at most
REWRITE = 6            # rounds between two versions of the pieces
LIKELY = 20_000        # candidates of a round by likelihood, at most
WHOLE = 2**30          # context that no piece exceeds
SEGMENTS = 4_000_000   # symbols of all segments that a stage may send to the driver
LEVELS = (16, 64, 256, 1_024, 4_096, 16_384)  # of the first pairs, from which a stage's least count is chosen
SAMPLED = 64           # one of so many segments is counted beforehand
UNKNOWN = -2           # beyond a region inside a piece, as it is sent
EDGE = 2**31 - 1       # the same while merging
_SHIFT = 32


# --- symbols of pieces as flat arrays --------------------------------------------------------
def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all pieces in one array, and where each piece begins (and the last ends)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0]: ends[-1]].astype(np.int32), ends - ends[0]


class Merger:
    """Applies merges in order.  All pieces of a batch go side by side: each takes its
    earliest merge until none is left.  A pair that a later merge makes appear again waits
    for its next turn, so a list is cut where a pair comes twice."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part, seen = [], set()
        for left, right, made in merges:
            key = left << _SHIFT | right
            if key in seen:
                self._close(part)
                part, seen = [], set()
            seen.add(key)
            part.append((key, made))
        self._close(part)

    def _close(self, part: list[tuple[int, int]]) -> None:
        if part:
            keys, made = np.array([k for k, _ in part], np.int64), np.array([m for _, m in part], np.int32)
            order = np.argsort(keys)
            self.parts.append((keys[order], order.astype(np.int64), made))

    def apply(self, sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for keys, ranks, made in self.parts:
            sym, ends = _apply(sym, ends, keys, ranks, made)
        return sym, ends


def _keys(sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pair that starts at each symbol; -1 at the last of a piece."""
    out = np.full(len(sym), -1, np.int64)
    out[:-1] = (sym[:-1].astype(np.int64) << _SHIFT) | sym[1:]
    last = ends[1:][ends[1:] > ends[:-1]] - 1
    out[last] = -1
    return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key is one of the sorted ``wanted``, and which."""
    at = np.searchsorted(wanted, keys)
    at[at == len(wanted)] = 0
    places = np.flatnonzero(wanted[at] == keys) if len(wanted) else np.empty(0, np.int64)
    return places, at[places]


def _apply(sym: np.ndarray, ends: np.ndarray, wanted: np.ndarray, rank_of: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places, _ = _found(_keys(sym, ends), wanted)
    if not len(places):
        return sym, ends
    touched = np.zeros(len(sizes), bool)
    touched[owner[places]] = True
    pick = touched[owner]
    work, of = sym[pick], owner[pick]  # symbols of pieces that change, and their piece
    clock = np.full(len(sizes), -1, np.int64)
    done_sym, done_of = [sym[~pick]], [owner[~pick]]
    while len(work):
        key = np.full(len(work), -1, np.int64)
        key[:-1] = np.where(of[1:] == of[:-1], (work[:-1].astype(np.int64) << _SHIFT) | work[1:], -1)
        places, which = _found(key, wanted)
        rank = rank_of[which]
        ahead = rank > clock[of[places]]
        places, rank = places[ahead], rank[ahead]
        begin = np.flatnonzero(np.append(True, of[places][1:] != of[places][:-1])) if len(places) else places
        if len(places):
            now = rank == np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(places))))
            places, rank = places[now], rank[now]
        # in a row of equal symbols every other one begins a merge, from the left
        follows = np.zeros(len(places), bool)
        follows[1:] = places[1:] == places[:-1] + 1
        run = np.arange(len(places)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
        places, rank = places[run % 2 == 0], rank[run % 2 == 0]
        clock[of[places]] = rank
        work[places] = made[rank]
        left = np.ones(len(work), bool)
        left[places + 1] = False
        active = np.zeros(len(sizes), bool)
        active[of[places]] = True
        work, of = work[left], of[left]
        goes_on = active[of]
        done_sym.append(work[~goes_on])
        done_of.append(of[~goes_on])
        work, of = work[goes_on], of[goes_on]
    sym, owner = np.concatenate(done_sym), np.concatenate(done_of)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(sizes))
    return sym[order], np.concatenate([[0], np.cumsum(counts)])


def _lists(sym: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sym, pa.int32()))


# --- jobs over the pieces ----------------------------------------------------------------------
def numbered(words: DataFrame, symbols: Callable[[str], list[str]], number: dict[str, int]) -> DataFrame:
    """piece, frequency, ids (numbers of the piece's symbols)."""
    shared = words.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        ids = shared.value
        for batch in batches:
            lists = [[ids[s] for s in symbols(p)] for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["piece", "frequency", "ids"])

    return words.select("piece", "frequency", "symbols").mapInArrow(run, "piece string, frequency bigint, ids array<int>")


def merged(pieces: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """The pieces after ``merges``."""
    if not merges:
        return pieces

    def run(batches):
        merger = Merger(merges)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(*merger.apply(*_flat(batch.column(2))))], ["piece", "frequency", "ids"])

    return pieces.select("piece", "frequency", "ids").mapInArrow(run, "piece string, frequency bigint, ids array<int>")


def named(pieces: DataFrame, names: list[str]) -> DataFrame:
    """piece, frequency, tokens (the symbols by name)."""
    shared = pieces.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        words = pa.array(shared.value, pa.string())
        for batch in batches:
            sym, ends = _flat(batch.column(2))
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(sym)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], ["piece", "frequency", "tokens"])

    return pieces.select("piece", "frequency", "ids").mapInArrow(run, "piece string, frequency bigint, tokens array<string>")


def _counts(pieces: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """left, right, count over all pieces; each batch adds up its own first."""

    def run(batches):
        merger = Merger(merges)
        for batch in batches:
            sym, ends = merger.apply(*_flat(batch.column(1)))
            weight = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            keys = _keys(sym, ends)
            keys, weight = keys[keys >= 0], weight[keys >= 0]
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            sums = np.add.reduceat(weight[order], first) if len(first) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[first] >> _SHIFT), pa.array(keys[first] & (2**_SHIFT - 1)), pa.array(sums)], ["left", "right", "n"])

    pairs = pieces.select("frequency", "ids").mapInArrow(run, "left bigint, right bigint, n bigint")
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("count"))


def _regions(pieces: DataFrame, merges: list[tuple[int, int, int]], candidates: list[int], context: int) -> DataFrame:
    """region (symbols as bytes), count: what stands around the candidates, equal regions added up."""
    wanted = np.array(sorted(candidates), np.int64)

    def run(batches):
        merger = Merger(merges)
        for batch in batches:
            sym, ends = merger.apply(*_flat(batch.column(1)))
            frequency = batch.column(0).to_numpy()
            places, _ = _found(_keys(sym, ends), wanted)
            if not len(places):
                continue
            owner = np.searchsorted(ends, places, "right") - 1
            lo, hi = np.maximum(places - context, ends[owner]), np.minimum(places + 2 + context, ends[owner + 1])
            # regions that overlap, or touch inside a piece, are one
            fresh = np.ones(len(places), bool)
            fresh[1:] = (lo[1:] > hi[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(fresh)
            stop = np.append(begin[1:], len(places)) - 1
            sums: Counter = Counter()
            marker = np.array([UNKNOWN], np.int32).tobytes()
            for a, b, cut_left, cut_right, n in zip(
                lo[begin].tolist(), hi[stop].tolist(), (lo[begin] > ends[owner[begin]]).tolist(), (hi[stop] < ends[owner[stop] + 1]).tolist(), frequency[owner[begin]].tolist()
            ):
                sums[(marker if cut_left else b"") + sym[a:b].tobytes() + (marker if cut_right else b"")] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["region", "n"])

    rows = pieces.select("frequency", "ids").mapInArrow(run, "region binary, n bigint")
    return rows.groupBy("region").agg(F.sum("n").alias("count"))


class _Cut:
    """Finds the segments of pieces between pairs less frequent than a least count."""

    def __init__(self, counts: dict[int, int]):
        self.keys = np.array(sorted(counts), np.int64)
        self.counts = np.array([counts[k] for k in self.keys.tolist()], np.int64)

    def frequencies(self, sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Count of the pair that starts at each symbol; 0 if it is not among the given ones."""
        out = np.zeros(len(sym), np.int64)
        places, which = _found(_keys(sym, ends), self.keys)
        out[places] = self.counts[which]
        return out

    @staticmethod
    def segments(frequencies: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each segment begins and ends."""
        inside = np.concatenate([[False], frequencies >= least, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        return turns[::2], turns[1::2] + 1


def _sizes(pieces: DataFrame, counts: dict[int, int], levels: list[int]) -> dict[int, int]:
    """Symbols of the different segments for each least count, estimated from a sample of the segments by hash."""
    shared = pieces.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        cut = _Cut(shared.value)
        for batch in batches:
            sym, ends = _flat(batch.column(0))
            if not len(sym):
                continue
            frequencies = cut.frequencies(sym, ends)
            # a segment's hash: the sum of its symbols' hashes, each by its place times a power of an odd number
            with np.errstate(over="ignore"):
                mixed = (sym.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                powers = np.cumprod(np.full(len(sym), 0xD6E8FEB86659FD93, np.uint64))
                back = np.cumprod(np.full(len(sym), pow(0xD6E8FEB86659FD93, -1, 2**64), np.uint64))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers)])
                for level in levels:
                    begin, stop = cut.segments(frequencies, level)
                    value = (sums[stop] - sums[begin]) * back[begin]
                    value ^= value >> np.uint64(32)
                    value *= np.uint64(0x9E3779B97F4A7C15)
                    pick = (value >> np.uint64(32)) % np.uint64(SAMPLED) == 0
                    found, first = np.unique(value[pick], return_index=True)
                    size = (stop - begin)[pick][first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), level)), pa.array(found.view(np.int64)), pa.array(size.astype(np.int64))], ["level", "hash", "size"])

    rows = pieces.select("ids").mapInArrow(run, "level bigint, hash bigint, size bigint").groupBy("level", "hash").agg(F.max("size").alias("size"))
    found = {r[0]: r[1] for r in rows.groupBy("level").agg(F.sum("size")).collect()}
    return {level: SAMPLED * found.get(level, 0) for level in levels}


def _segments(pieces: DataFrame, counts: dict[int, int], least: int) -> DataFrame:
    """region (symbols as bytes), count: the segments, equal ones added up."""
    shared = pieces.sparkSession.sparkContext.broadcast({k: n for k, n in counts.items() if n >= least})

    def run(batches):
        cut = _Cut(shared.value)
        for batch in batches:
            sym, ends = _flat(batch.column(1))
            if not len(sym):
                continue
            begin, stop = cut.segments(cut.frequencies(sym, ends), least)
            weight = batch.column(0).to_numpy()[np.searchsorted(ends, begin, "right") - 1]
            data, sums = sym.tobytes(), Counter()
            for a, b, n in zip((begin * 4).tolist(), (stop * 4).tolist(), weight.tolist()):
                sums[data[a:b]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["region", "n"])

    rows = pieces.select("frequency", "ids").mapInArrow(run, "region binary, n bigint")
    return rows.groupBy("region").agg(F.sum("n").alias("count"))


# --- the rounds ------------------------------------------------------------------------------
class _Regions(FlatPieces):
    """The regions of a round as pieces; the symbols keep their numbers."""

    def __init__(self, regions: list[bytes], counts: list[int], names: list[str], number: dict[str, int], least: int):
        self.likelihood, self.least, self.hot = False, least, 0.0
        self.names, self.number, self.old = names, number, len(names)
        gap = np.array([-1], np.int32).tobytes()
        self.sym = np.frombuffer(gap + gap.join(regions) + gap, np.int32).copy()
        self.sym[self.sym == UNKNOWN] = EDGE
        sizes = np.array([len(r) // 4 for r in regions], np.int64)
        self.starts = (np.cumsum(sizes + 1) - sizes).astype(np.int32)
        self.weights = np.array(counts, np.int64)
        self.size = np.ones(len(self.sym), np.int32)
        self.places, self.pairs, self.near, self.heap = {}, {}, {}, []
        self._count()

    def value(self, key: int) -> float:
        return super().value(key) if self.known(key) else 0.0

    @staticmethod
    def known(key: int) -> bool:
        return EDGE not in (key >> _SHIFT, key & (2**_SHIFT - 1))

    def best(self) -> int | None:
        pair = self._best()
        return pair and (self.number[pair[0]] << _SHIFT | self.number[pair[1]])

    def reaches_out(self, key: int) -> bool:
        """Something unknown is next to a place of the pair."""
        first = self._places(key >> _SHIFT)
        first = first[self.sym[self._after(first)] == key & (2**_SHIFT - 1)]
        second = self._after(first)
        return bool((self.sym[self._before(first)] == EDGE).any() or (self.sym[self._after(second)] == EDGE).any())

    def merge(self, key: int, symbol: int) -> None:
        if symbol >= self.old:
            self.places.setdefault(symbol, np.empty(0, np.int32))  # a new symbol stands nowhere yet
        self._places(symbol)
        self._merge(self.names[key >> _SHIFT], self.names[key & (2**_SHIFT - 1)], self.names[symbol])


class _HotPairs:
    """The first pairs of the greedy order and what stands behind them."""

    def __init__(self, names: list[str], most: int):
        self.names, self.most = names, most
        self.count: dict[int, int] = {}
        self.bound: tuple | None = None  # the first pair that is not held, as it stood when the pairs were counted
        self.fresh: set[int] = set()     # symbols made since

    def key(self, pair: int) -> tuple:
        return (-self.count[pair], self.names[pair >> _SHIFT], self.names[pair & (2**_SHIFT - 1)])

    def read(self, counts: DataFrame, least: int) -> None:
        """Keep the first pairs of at least ``least``."""
        spark = counts.sparkSession
        named = spark.createDataFrame(pa.table({"id": pa.array(range(len(self.names)), pa.int64()), "name": pa.array(self.names, pa.string())}))
        left = named.select(F.col("id").alias("left"), F.col("name").alias("l"))
        right = named.select(F.col("id").alias("right"), F.col("name").alias("r"))
        order = (F.col("count").desc(), F.col("l"), F.col("r"))
        rows = counts.where(F.col("count") >= least).join(left, "left").join(right, "right").orderBy(*order).limit(self.most + 1).toArrow()
        pairs = sorted(((-n, self.names[a], self.names[b], a << _SHIFT | b) for a, b, n in zip(*(rows.column(c).to_pylist() for c in ("left", "right", "count")))))
        self.fresh = set()
        self.bound = pairs[self.most][:3] if len(pairs) > self.most else None
        self.count = {pair: -n for n, _, _, pair in pairs[: self.most]}

    def change(self, changes: dict[int, int]) -> None:
        for pair, n in changes.items():
            known = self.count.get(pair)
            if known is None and self.bound is not None and not (pair >> _SHIFT in self.fresh or pair & (2**_SHIFT - 1) in self.fresh):
                continue  # an old pair that is not held
            n += known or 0
            if n > 0:
                self.count[pair] = n
            else:
                self.count.pop(pair, None)


def _levels(table: _HotPairs, least: int, room: int) -> list[int]:
    """Least counts to choose from, the lowest first: at most half as frequent as the pair that is last if
    the order stays as it is, and those of the first pairs."""
    order = sorted(table.count.values(), reverse=True)
    bound = 1 - table.bound[0] if table.bound is not None else 1  # pairs that are not held stay below
    lowest = max(least, bound, order[min(room, len(order)) - 1] // 2 if order else 1)
    return sorted({lowest, *(order[k] for k in LEVELS if k < len(order) and order[k] > lowest)})


def _stage_rows(pieces: DataFrame, counts: dict[int, int], levels: list[int], most: int) -> tuple[int, pa.Table] | None:
    """The lowest of the least counts whose segments have at most ``most`` symbols, and these."""
    spark = pieces.sparkSession
    counts = {k: n for k, n in counts.items() if n >= levels[0]}
    if not counts:
        return None
    sizes = _sizes(pieces, counts, levels)
    for level in (n for n in levels if sizes[n] <= most):
        path = scratch_dir(spark, "subword-segments")
        _segments(pieces, counts, level).write.parquet(path)
        rows = spark.read.schema("region binary, count bigint").parquet(path)
        if (rows.agg(F.sum(F.length("region") / 4)).first()[0] or 0) <= most:
            return level, rows.toArrow()
    return None


def train(pieces: DataFrame, names: list[str], room: int, merge: Callable[[str, str], str], min_frequency: int = 1,
          hot: int = HOT, regions: int = REGIONS, segments: int = SEGMENTS) -> tuple[DataFrame, list[tuple[int, str, str, str]]]:
    """The pieces after the merges, and the greedy merges (rank, left, right, merged) that make
    ``room`` symbols.  ``names`` are the symbols of the numbers in ``pieces`` and grow."""
    spark = pieces.sparkSession
    number = {s: k for k, s in enumerate(names)}
    made: list[tuple[int, int, int]] = []
    since: list[tuple[int, int, int]] = []  # merges that the stored pieces do not have yet
    stored, rounds = pieces, 0
    table = _HotPairs(names, hot)
    least = max(1, min_frequency)

    def rewrite() -> None:
        nonlocal stored, since
        path = scratch_dir(spark, "subword-pieces")
        merged(stored, since).write.parquet(path)
        stored, since = spark.read.schema("piece string, frequency bigint, ids array<int>").parquet(path), []

    def made_by(pair: int) -> int:
        name = merge(names[pair >> _SHIFT], names[pair & (2**_SHIFT - 1)])
        if name not in number:
            number[name] = len(names)
            names.append(name)
        return number[name]

    def take(pair: int) -> int:
        symbol = made_by(pair)
        step = (pair >> _SHIFT, pair & (2**_SHIFT - 1), symbol)
        made.append(step)
        since.append(step)
        table.fresh.add(symbol)
        seen.add(symbol)
        return symbol

    seen: set[int] = set()
    stored = spread(stored)
    table.read(_counts(stored, []), least)
    many, context = 16, 1
    fresh = True  # the stored pieces have all merges, and the table was just read
    while room > len(seen):
        if fresh and (levels := _levels(table, least, room - len(seen))) and (stage := _stage_rows(stored, table.count, levels, segments)):
            floor, rows = stage
            before, old = len(made), len(names)
            _play_down(_Regions(rows.column(0).to_pylist(), rows.column(1).to_pylist(), names, number, floor), room, take, seen, old)
            if len(made) > before:
                if room > len(seen):
                    rewrite()
                    table.read(_counts(stored, []), least)
                continue
        fresh = False
        first = heapq.nsmallest(many + 1, table.count, key=table.key)
        if not first or table.bound is not None and table.key(first[0]) >= table.bound:
            if table.bound is None:
                break
            table.read(_counts(stored, since), least)  # the pairs held are used up
            continue
        if table.count[first[0]] < least:
            break
        limits = [table.key(p) for p in first[many:]] + [b for b in [table.bound] if b is not None]
        limit = min(limits, default=None)
        candidates = [p for p in first[:many] if limit is None or table.key(p) < limit]
        rows = _regions(stored, since, candidates, context).limit(regions + 1).toArrow()
        if rows.num_rows > regions:
            if many == 1 and context <= 1:  # one merge, its changes from a job
                take(first[0])
                table.read(_counts(stored, since), least)
            many, context = max(1, many // 4), max(1, context - 1)
            continue
        before, old = len(made), len(names)
        held = set(table.fresh)
        changes = _play(_Regions(rows.column(0).to_pylist(), rows.column(1).to_pylist(), names, number, least), room, limit, take, seen, old)
        table.change(changes)
        if table.bound is not None and made[-1][2] < old and made[-1][2] not in held:
            table.read(_counts(stored, since), least)  # an older symbol was made again: pairs that are not held got more frequent
        # more candidates while there is room and they get used
        if rows.num_rows < regions // 3:
            if len(made) - before >= many // 2 or many < 64:
                many = min(CANDIDATES, many * 2)
            else:
                context = min(CONTEXT, context + 1)
        rounds += 1
        if rounds % REWRITE == 0:
            rewrite()
            table.read(_counts(stored, []), least)
            fresh = True
    rewrite()
    return stored, [(k, names[a], names[b], names[m]) for k, (a, b, m) in enumerate(made)]


def _play_down(flat: _Regions, room: int, take: Callable[[int], int], seen: set[int], old: int) -> None:
    """Merges on the segments of a stage, until no pair is frequent enough or a symbol is made in a second way."""
    done: set[int] = set()
    while len(seen) < room and (best := flat.best()) is not None:
        symbol = take(best)
        if symbol < old or symbol in done:
            break  # its pairs may be where pieces were cut
        done.add(symbol)
        flat.merge(best, symbol)


def _play(flat: _Regions, room: int, limit: tuple | None, take: Callable[[int], int], seen: set[int], old: int) -> dict[int, int]:
    """Merges on the regions of a round; returns how the counts of pairs changed."""
    start, names, first = dict(flat.pairs), flat.names, True
    while len(seen) < room and (best := flat.best()) is not None:
        key = (-flat.pairs[best], names[best >> _SHIFT], names[best & (2**_SHIFT - 1)])
        if limit is not None and key >= limit or not first and flat.reaches_out(best):
            break
        symbol, first = take(best), False
        flat.merge(best, symbol)
        if symbol < old:
            break  # pairs of an older symbol, also such that were no candidates, got more frequent
    changed = {p: flat.pairs.get(p, 0) - start.get(p, 0) for p in {*start, *flat.pairs}}
    return {p: n for p, n in changed.items() if n and flat.known(p)}


# --- by likelihood ---------------------------------------------------------------------------
class _Likelihoods(FlatPieces):
    """Counts of all pairs and symbols, and the pieces of a round, which hold all places of some pairs."""

    def __init__(self, names: list[str], number: dict[str, int], least: int):
        self.likelihood, self.least, self.hot = True, least, 0.0
        self.names, self.number = names, number
        self.pairs, self.single, self.near, self.heap = {}, [], {}, []

    def read(self, pieces: DataFrame, merges: list[tuple[int, int, int]]) -> None:
        """All counts, from a job: bounded by the vocabulary, not by the corpus."""
        self.pairs, self.near, self.heap, self.hot = {}, {}, [], 0.0
        self.single = [0] * len(self.names)
        singles = _singles(pieces, merges).toArrow()
        for symbol, n in zip(singles.column(0).to_pylist(), singles.column(1).to_pylist()):
            self.single[symbol] = n
        rows = _counts(pieces, merges).toArrow()
        left, right = (rows.column(c).to_numpy().astype(np.int64) for c in ("left", "right"))
        self._add(left << _SHIFT | right, rows.column("count").to_numpy())

    def hold(self, regions: list[bytes], counts: list[int]) -> None:
        gap = np.array([-1], np.int32).tobytes()
        self.sym = np.frombuffer(gap + gap.join(regions) + gap, np.int32).copy()
        sizes = np.array([len(r) // 4 for r in regions], np.int64)
        self.starts = (np.cumsum(sizes + 1) - sizes).astype(np.int32)
        self.weights = np.array(counts, np.int64)
        self.size = np.ones(len(self.sym), np.int32)
        self.places = {}

    def best(self) -> int | None:
        """The best pair; it stays in the heap."""
        if (pair := self._best()) is None:
            return None
        key = self.number[pair[0]] << _SHIFT | self.number[pair[1]]
        heapq.heappush(self.heap, (-self.value(key), *pair))
        return key

    def first(self, places: int) -> list[int]:
        """The first pairs of the order, which together have at most so many places; at least one."""
        out, total = [], 0
        while len(out) < LIKELY and (pair := self._best()) is not None:
            key = self.number[pair[0]] << _SHIFT | self.number[pair[1]]
            out.append(key)
            total += self.pairs[key]
            if total > places:
                break
        taken = out[:-1] if total > places and len(out) > 1 else out
        for key in out:
            heapq.heappush(self.heap, (-self.value(key), self.names[key >> _SHIFT], self.names[key & (2**_SHIFT - 1)]))
        return taken


def _singles(pieces: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """symbol, count over all pieces."""

    def run(batches):
        merger = Merger(merges)
        for batch in batches:
            sym, ends = merger.apply(*_flat(batch.column(1)))
            weight = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            found, which = np.unique(sym, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, which, weight)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(sums)], ["symbol", "n"])

    rows = pieces.select("frequency", "ids").mapInArrow(run, "symbol bigint, n bigint")
    return rows.groupBy("symbol").agg(F.sum("n").alias("count"))


def train_likelihood(pieces: DataFrame, names: list[str], room: int, merge: Callable[[str, str], str], min_frequency: int = 1,
                     regions: int = REGIONS, rewrite_every: int = REWRITE) -> tuple[DataFrame, list[tuple[int, str, str, str]]]:
    """As ``train``, but the best pair is the one with the largest count over the product of both symbols' counts.

    The driver holds the counts of all pairs and symbols.  A round brings all pieces that
    hold one of the first pairs, whole; so the merges of these pairs, and of pairs with a
    symbol made in the round, change every count exactly.  It ends where another pair is best.
    """
    spark = pieces.sparkSession
    number = {s: k for k, s in enumerate(names)}
    made: list[tuple[int, int, int]] = []
    since: list[tuple[int, int, int]] = []  # merges that the stored pieces do not have yet
    seen: set[int] = set()
    stored, rounds = spread(pieces), 0
    table = _Likelihoods(names, number, max(1, min_frequency))
    table.read(stored, [])

    def take(key: int) -> tuple[str, str, str]:
        a, b = key >> _SHIFT, key & (2**_SHIFT - 1)
        return names[a], names[b], merge(names[a], names[b])

    def note(key: int, symbol: int) -> None:
        step = (key >> _SHIFT, key & (2**_SHIFT - 1), symbol)
        made.append(step)
        since.append(step)
        seen.add(symbol)

    places = regions  # of the candidates in the corpus; a piece may have many
    while room > len(seen) and (candidates := table.first(places)):
        rows = _regions(stored, since, candidates, WHOLE).limit(regions + 1).toArrow()
        if rows.num_rows > regions and len(candidates) > 1:
            places = max(1, places // 8)
            continue
        if rows.num_rows < regions // 8 and len(candidates) < LIKELY:
            places *= 4
        if rows.num_rows > regions:  # of one pair: its changes from a job
            _, _, name = take(candidates[0])
            if name not in number:
                number[name] = len(names)
                names.append(name)
            note(candidates[0], number[name])
            table.read(stored, since)
            continue
        table.hold(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        here, old = set(candidates), len(names)
        while len(seen) < room and (key := table.best()) is not None and (key in here or max(key >> _SHIFT, key & (2**_SHIFT - 1)) >= old):
            left, right, name = take(key)
            table._merge(left, right, name)
            note(key, number[name])
        rounds += 1
        if rounds % rewrite_every == 0:
            path = scratch_dir(spark, "subword-pieces")
            merged(stored, since).write.parquet(path)
            stored, since = spark.read.schema("piece string, frequency bigint, ids array<int>").parquet(path), []
    return merged(stored, since), [(k, names[a], names[b], names[m]) for k, (a, b, m) in enumerate(made)]
