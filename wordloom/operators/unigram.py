"""Unigram subword vocabularies: seeds, expectation-maximisation, pruning, best cut.

A piece is a lattice of all its cuts into tokens; a cut's probability is the product of
its tokens' probabilities.  Expected counts come from forward-backward sums over each
distinct piece, in parallel; only one row per token goes to the driver.  Between
rounds the tokens go whose removal costs the least likelihood.

The pieces of a batch go side by side through the same sums as a piece alone would
(``Lattice``); only very long pieces go alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wordloom.session import checkpointed, spread

LONGEST = 16      # characters of a token
SEEDS = 4         # seeds for each entry of the final vocabulary
STEPS = 2         # expectation-maximisation steps between two prunings
SHRINK = 0.75     # share of the tokens that a pruning keeps
LEAST = 0.5       # expected count below which a token goes
UNSEEN = 10.0     # an unknown character costs this much more than the rarest token
SIDE_BY_SIDE = 64  # characters of a piece that goes through a lattice together with others
_NONE = -math.inf
_CHAR = 21        # bits of a code point
_STOP = -1        # after a piece


def _arcs(piece: str, scores: dict[str, float], unknown: float):
    """For each end position the (start, token, score) of the tokens that end there; a
    character that no token covers alone is an unknown one."""
    n = len(piece)
    out = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            score = scores.get(piece[i:j])
            if score is not None:
                out[j].append((i, piece[i:j], score))
            elif j == i + 1:
                out[j].append((i, None, unknown))
    return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == _NONE else a + math.log1p(math.exp(b - a))


def expected(piece: str, scores: dict[str, float], unknown: float) -> tuple[float, dict[str, float]]:
    """Logarithm of the piece's probability, and the expected number of each token."""
    arcs, n = _arcs(piece, scores, unknown), len(piece)
    ahead, behind = [_NONE] * (n + 1), [_NONE] * (n + 1)
    ahead[0], behind[n] = 0.0, 0.0
    for j in range(1, n + 1):
        for i, _, s in arcs[j]:
            ahead[j] = _add(ahead[j], ahead[i] + s)
    for j in range(n, 0, -1):
        for i, _, s in arcs[j]:
            behind[i] = _add(behind[i], behind[j] + s)
    total, counts = ahead[n], {}
    for j in range(1, n + 1):
        for i, token, s in arcs[j]:
            if token is not None:
                counts[token] = counts.get(token, 0.0) + math.exp(ahead[i] + s + behind[j] - total)
    return total, counts


def best_cut(piece: str, scores: dict[str, float], unknown: float, without: str | None = None) -> tuple[float, list[str | None]]:
    """The most likely cut; of equal ones the one whose last tokens are longer.  ``without``
    is a token that may not be used.  None stands for an unknown character."""
    arcs, n = _arcs(piece, scores, unknown), len(piece)
    best, back = [0.0] + [_NONE] * n, [None] * (n + 1)
    for j in range(1, n + 1):
        for i, token, s in arcs[j]:
            if (token is None or token != without) and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, token)
    if n and back[n] is None:
        return _NONE, []
    out, j = [], n
    while j:
        i, token = back[j]
        out.append(token)
        j = i
    return best[n], out[::-1]


def penalty(scores: dict[str, float]) -> float:
    return min(scores.values(), default=0.0) - UNSEEN


# --- pieces side by side ---------------------------------------------------------------------
def _codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all pieces in one array, each piece followed by a stop; where each piece begins; lengths."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(pieces), _STOP, np.int64)
    inside = np.ones(len(out), bool)
    inside[begin + sizes] = False
    out[inside] = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, begin, sizes


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each size, one after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``_add``, to the last bit: these functions are the C library's, as those of ``math`` are."""
    high, low = np.maximum(a, b), np.minimum(a, b)
    return high + pc.log1p(pc.exp(pa.array(low - high))).to_numpy()


class Trie:
    """Strings by their prefixes: sorted (node, character) edges, and the number of the string that ends at a node."""

    def __init__(self, strings: list[str]):
        codes, begin, sizes = _codes(strings)
        node, nodes = np.zeros(len(sizes), np.int64), 1
        edges, to, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        left = np.flatnonzero(sizes > 0)
        depth = 0
        while len(left):
            found, at = np.unique(node[left] << _CHAR | codes[begin[left] + depth], return_inverse=True)
            edges.append(found)
            to.append(np.arange(nodes, nodes + len(found)))
            node[left] = to[-1][at]
            nodes += len(found)
            depth += 1
            left = left[sizes[left] > depth]
        order = np.argsort(edges := np.concatenate(edges), kind="stable")
        self.edges, self.to = edges[order], np.concatenate(to)[order]
        self.string = np.full(nodes, -1, np.int64)
        self.string[node] = np.arange(len(strings))

    def step(self, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have an edge with their character, and where it leads."""
        if not len(self.edges):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key = node << _CHAR | code  # -1 at a stop
        at = np.searchsorted(self.edges, key)
        at[at == len(self.edges)] = 0
        found = np.flatnonzero(self.edges[at] == key)
        return found, self.to[at[found]]


class Lattice:
    """The lattices of many pieces at once.  For each end and each length of a token, the longest first,
    one step goes over all pieces; so each piece has its sums in the order of ``_arcs``."""

    def __init__(self, scores: dict[str, float]):
        self.tokens = [t for t in scores if 0 < len(t) <= LONGEST]
        self.scores = scores
        self.unknown = penalty(scores)
        self.values = np.array([scores[t] for t in self.tokens] + [self.unknown], np.float64)  # the last for unknown characters
        self.trie = Trie(self.tokens)

    def arcs(self, pieces: list[str], whole: bool = True) -> "_Arcs":
        return _Arcs(self, pieces, whole)

    def expected(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logarithm of each piece's probability; and piece, token and expected number."""
        arcs = self.arcs(pieces)
        ahead, behind = arcs.states(0), arcs.states(arcs.sizes)
        for _, to, start, score in arcs.steps():
            ahead[to] = _added(ahead[to], ahead[start] + score)
        for _, to, start, score in arcs.steps(backwards=True):
            behind[start] = _added(behind[start], behind[to] + score)
        total = ahead[arcs.begin + arcs.sizes]
        # a token's numbers in one piece are added up in the order of its places
        key = arcs.piece * np.int64(len(self.values)) + arcs.token
        order = np.argsort(key, kind="stable")
        order = order[arcs.token[order] < len(self.tokens)]
        key, to, piece = key[order], arcs.to[order], arcs.piece[order]
        n = pc.exp(pa.array(ahead[to - arcs.size[order]] + arcs.score[order] + behind[to] - total[piece])).to_numpy()
        fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = np.flatnonzero(fresh)
        sums = np.bincount(np.cumsum(fresh) - 1, n, len(first)) if len(first) else n
        return total, piece[first], key[first] % len(self.values), sums

    def best(self, pieces: list[str], whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each piece's best cut, the number of its tokens, and the tokens of all.  Number
        len(tokens) is an unknown character.  Without ``whole`` a piece may not be one token."""
        arcs = self.arcs(pieces, whole)
        best, back = arcs.states(0), np.full(len(arcs.codes), -1, np.int64)
        for k, to, start, score in arcs.steps():
            found = best[start] + score
            more = found > best[to]
            best[to[more]], back[to[more]] = found[more], k[more]
        at, left = arcs.begin + arcs.sizes, np.flatnonzero(arcs.sizes > 0)
        counts, out, of = np.zeros(len(pieces), np.int64), [], []
        while len(left):
            k = back[at[left]]
            out.append(arcs.token[k])
            of.append(left)
            counts[left] += 1
            at[left] -= arcs.size[k]
            left = left[at[left] > arcs.begin[left]]
        if out:  # found from the end
            out, of = np.concatenate(out[::-1]), np.concatenate(of[::-1])
            out = out[np.argsort(of, kind="stable")]
        return best[arcs.begin + arcs.sizes], counts, np.array(out, np.int64)

    def cut(self, pieces: list[str]) -> list[list[str | None]]:
        """The most likely cut of each piece."""
        out: list = [None] * len(pieces)
        short = [k for k, p in enumerate(pieces) if len(p) <= SIDE_BY_SIDE]
        names = [*self.tokens, None]
        _, counts, tokens = self.best([pieces[k] for k in short])
        at, tokens = 0, tokens.tolist()
        for k, n in zip(short, counts.tolist()):
            out[k] = [names[t] for t in tokens[at: at + n]]
            at += n
        return [best_cut(p, self.scores, self.unknown)[1] if o is None else o for p, o in zip(pieces, out)]


class _Arcs:
    """All arcs of some pieces: where they end, characters, token, score and piece; by place of the end, longest first."""

    def __init__(self, lattice: Lattice, pieces: list[str], whole: bool):
        self.codes, self.begin, self.sizes = _codes(pieces)
        at = np.flatnonzero(self.codes != _STOP)
        owner = np.repeat(np.arange(len(pieces)), self.sizes)
        node, start, none = np.zeros(len(at), np.int64), at, len(lattice.tokens)
        to, size, token, piece = [], [], [], []
        for length in range(1, LONGEST + 1):
            found, leads = lattice.trie.step(node, self.codes[at + length - 1])
            if length == 1:  # every character is an arc
                tokens = np.full(len(at), none, np.int64)
                tokens[found] = np.where(lattice.trie.string[leads] >= 0, lattice.trie.string[leads], none)
                to.append(at + 1)
                size.append(np.ones(len(at), np.int64))
                token.append(tokens)
                piece.append(owner)
            at, owner, node = at[found], owner[found], leads
            if not len(at):
                break
            if length > 1:
                is_token = lattice.trie.string[node] >= 0
                if not whole:
                    is_token &= self.sizes[owner] != length
                to.append(at[is_token] + length)
                size.append(np.full(int(is_token.sum()), length, np.int64))
                token.append(lattice.trie.string[node[is_token]])
                piece.append(owner[is_token])
        to, size, token, piece = (np.concatenate(x) for x in (to, size, token, piece))
        group = (to - self.begin[piece]) * LONGEST + (LONGEST - size)
        order = np.argsort(group.astype(np.uint16) if not len(group) or group.max() < 2**16 else group, kind="stable")
        self.to, self.size, self.token, self.piece = to[order], size[order], token[order], piece[order]
        self.score, group = lattice.values[self.token], group[order]
        self.turns = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)]).tolist() + [len(group)]

    def states(self, at: np.ndarray | int) -> np.ndarray:
        """One number for each place of each piece: 0 at the given one, else nothing yet."""
        out = np.full(len(self.codes), _NONE)
        out[self.begin + at] = 0.0
        return out

    def steps(self, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of the arcs with one end and length, where they end and begin, scores."""
        spans = list(zip(self.turns, self.turns[1:]))
        for a, b in reversed(spans) if backwards else spans:
            to = self.to[a:b]
            yield np.arange(a, b), to, to - self.size[a:b], self.score[a:b]


# --- seeds -----------------------------------------------------------------------------------
def _grams(pieces: DataFrame, parts: list[str], longest: int) -> DataFrame:
    """length, key, n: the substrings of up to ``longest`` characters that are longer than the ``parts``
    (all of one length, at least half as long) and have every substring of that length among them.  The key is
    the number of the first part and that of the last; without parts, up to three code points."""
    size = len(parts[0]) if parts else 0
    shared = pieces.sparkSession.sparkContext.broadcast(Trie(parts))

    def run(batches):
        trie = shared.value
        for batch in batches:
            codes, _, sizes = _codes(batch.column(0).to_pylist())
            inside = np.flatnonzero(codes != _STOP)
            weights = np.zeros(len(codes), np.int64)
            weights[inside] = np.repeat(batch.column(1).to_numpy(), sizes)
            at, node = inside, np.zeros(len(inside), np.int64)
            for depth in range(size):
                found, node = trie.step(node, codes[at + depth])
                at = at[found]
            number = np.full(len(codes) + longest, -1, np.int64)  # of the part, or the character, that starts here
            number[at] = trie.string[node] if size else codes[at]
            key = number[at] if not size else at
            for length in range(size + 1, longest + 1):
                if size or length > 1:
                    goes_on = number[at + length - max(size, 1)] >= 0
                    at, key = at[goes_on], key[goes_on]
                last = number[at + length - max(size, 1)]
                if size:
                    key = number[at] << 32 | last
                elif length > 1:
                    key = key << _CHAR | last
                keys, which = np.unique(key, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, which, weights[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), pa.array(sums)], ["length", "key", "n"])

    rows = pieces.select("piece", "frequency").mapInArrow(run, "length int, key bigint, n bigint")
    return rows.groupBy("length", "key").agg(F.sum("n").alias("n"))


def _gram(parts: list[str], length: int, key: int) -> str:
    if parts:
        first, last = parts[key >> 32], parts[key & (2**32 - 1)]
        return first + last[2 * len(last) - length:]
    return "".join(chr(key >> _CHAR * k & (2**_CHAR - 1)) for k in range(length - 1, -1, -1))


def seeds(pieces: DataFrame, most: int) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(token, count): all characters, and the ``most`` longer substrings found twice or more
    that cover most text; ties by the token.

    Substrings are counted by length, the short ones first.  One is not more frequent than its parts, and
    none of the first ``most`` covers less than the last of those known so far; so only parts that are
    frequent enough for LONGEST characters are made longer, and only their counts go to the driver."""
    single, found, parts, longest = [], [], [], min(3, LONGEST)  # found: covered characters, token, count of the longer ones
    while True:
        counts = checkpointed(_grams(pieces, parts, longest))
        covered = (F.col("n") * F.col("length")).alias("covered")
        first = counts.where((F.col("length") > 1) & (F.col("n") > 1)).select(covered).orderBy(F.col("covered").desc()).limit(max(0, most)).toArrow()
        best = sorted([*first.column(0).to_pylist(), *(-f[0] for f in found)], reverse=True)
        least = max(2, -(-best[most - 1] // LONGEST)) if len(best) >= most > 0 else 2
        rows = counts.where((F.col("length") == 1) | (F.col("n") >= least)).toArrow()
        made = [(_gram(parts, length, key), n) for length, key, n in zip(*(c.to_pylist() for c in rows.columns))]
        single = single or sorted((t, n) for t, n in made if len(t) == 1)
        found = heapq.nsmallest(max(0, most), [*found, *((-n * len(t), t, n) for t, n in made if len(t) > 1)])
        parts = [t for t, n in made if len(t) == longest and n >= least]
        if longest == LONGEST or not parts or most <= 0:
            return single, [(t, n) for _, t, n in found]
        longest = min(2 * longest, LONGEST)


# --- sums over all pieces --------------------------------------------------------------------
def _over_pieces(pieces: DataFrame, scores: dict[str, float], work: Callable) -> dict[str | None, float]:
    """Sums of (token, value) that ``work`` gives for pieces, each times its frequency; at most a row a token.
    The token None collects what is not a token's."""
    shared = pieces.sparkSession.sparkContext.broadcast(Lattice(scores))

    def run(batches):
        lattice = shared.value
        names = lattice.tokens
        number = {}
        sums, seen, rest = np.zeros(len(names)), np.zeros(len(names), bool), 0.0
        for batch in batches:
            texts, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if not texts:
                continue
            short = np.array([len(p) <= SIDE_BY_SIDE for p in texts], bool)
            groups = [texts] if short.all() else _alternating(texts, short)
            done = 0
            for group in groups:
                weight = counts[done: done + len(group)]
                done += len(group)
                if len(group[0]) <= SIDE_BY_SIDE:
                    owner, token, value, other = work(lattice, group)
                    np.add.at(sums, token, weight[owner] * value)
                    seen[token] = True
                    for n, v in zip(weight.tolist(), other.tolist()):
                        rest += n * v
                    continue
                number = number or {t: k for k, t in enumerate(names)}
                for token, value in work.alone(group[0], lattice.scores, lattice.unknown):
                    if token is None:
                        rest += int(weight[0]) * value
                    else:
                        sums[number[token]] += int(weight[0]) * value
                        seen[number[token]] = True
        which = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*which.tolist(), -1], pa.int32()), pa.array([*sums[which].tolist(), rest], pa.float64())], ["token", "value"])

    rows = pieces.select("piece", "frequency").mapInArrow(run, "token int, value double").groupBy("token").agg(F.sum("value")).toArrow()
    names = [t for t in scores if 0 < len(t) <= LONGEST]
    return {None if k < 0 else names[k]: v for k, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())}


def _alternating(texts: list[str], short: np.ndarray) -> Iterator[list[str]]:
    """The texts in order: runs of short ones, and each long one alone."""
    run: list[str] = []
    for text, fits in zip(texts, short.tolist()):
        if fits:
            run.append(text)
            continue
        if run:
            yield run
        yield [text]
        run = []
    if run:
        yield run


def _expectations(lattice: Lattice, pieces: list[str]):
    total, piece, token, value = lattice.expected(pieces)
    return piece, token, value, total


def _expectations_alone(piece, scores, unknown):
    total, counts = expected(piece, scores, unknown)
    yield None, total
    yield from counts.items()


def _best_tokens(lattice: Lattice, pieces: list[str]):
    _, counts, token = lattice.best(pieces)
    owner = np.repeat(np.arange(len(pieces)), counts)
    known = token < len(lattice.tokens)
    return owner[known], token[known], np.ones(int(known.sum())), np.zeros(len(pieces))


def _best_tokens_alone(piece, scores, unknown):
    for token in best_cut(piece, scores, unknown)[1]:
        if token is not None:
            yield token, 1


_expectations.alone, _best_tokens.alone = _expectations_alone, _best_tokens_alone


def maximise(pieces: DataFrame, scores: dict[str, float]) -> tuple[dict[str, float], float]:
    """Scores after one step of expectation-maximisation, and the log-likelihood before it.
    Longer tokens that are hardly expected go; characters stay."""
    counts = _over_pieces(pieces, scores, _expectations)
    likelihood = counts.pop(None, 0.0)
    kept = {t: max(counts.get(t, 0.0), LEAST) for t in scores if len(t) == 1 or counts.get(t, 0.0) >= LEAST}
    total = math.log(sum(kept.values())) if kept else 0.0
    return {t: math.log(n) - total for t, n in kept.items()}, likelihood


def pruned(pieces: DataFrame, scores: dict[str, float], size: int) -> dict[str, float]:
    """At most ``size`` tokens: characters, and the longer ones whose loss is the largest."""
    spark = pieces.sparkSession
    uses = _over_pieces(pieces, scores, _best_tokens)
    shared = spark.sparkContext.broadcast(Lattice(scores))

    def run(batches):
        lattice = shared.value
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            gain = np.array([lattice.scores[t] for t in tokens]) - lattice.best(tokens, whole=False)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain, pa.float64())], ["token", "gain"])

    longer = [t for t in scores if len(t) > 1]
    table = spark.createDataFrame(pa.table({"token": pa.array(longer, pa.string())})).repartition(spark.sparkContext.defaultParallelism)
    loss = {r[0]: uses.get(r[0], 0.0) * r[1] for r in table.mapInArrow(run, "token string, gain double").collect()}  # one row a token
    room = max(0, size - (len(scores) - len(longer)))
    kept = set(heapq.nsmallest(room, longer, key=lambda t: (-loss[t], t)))
    return {t: s for t, s in scores.items() if len(t) == 1 or t in kept}


def train(pieces: DataFrame, size: int) -> dict[str, float]:
    """token -> logarithm of its probability, ``size`` tokens if the pieces have so many.

    ``pieces`` has piece and frequency.  All characters are tokens, also if they are more than ``size``.
    """
    pieces = spread(pieces.select("piece", "frequency"))
    single, longer = seeds(pieces, SEEDS * size)
    total = sum(n for _, n in single) + sum(n for _, n in longer)
    scores = {t: math.log(n / total) for t, n in single + longer}
    while True:
        for _ in range(STEPS):
            scores, _ = maximise(pieces, scores)
        if len(scores) <= max(size, len(single)):
            return scores
        scores = pruned(pieces, scores, max(size, int(len(scores) * SHRINK)))
