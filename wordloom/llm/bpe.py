"""BPE encoding and decoding: speculate and verify.

Distinct words are cut greedily into the longest vocabulary entries, all words
of a batch at once.  A cut is the merge result exactly if each token comes out of
merging its own text and no pair of adjacent tokens would have merged otherwise,
which array operations test for all pairs; only words that fail are merged.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import set_columns, table
from wordloom.llm.registry import query

CACHE_PIECES = 400_000   # pieces that a worker remembers, besides those used shortly before: some 200 MB
CHUNK_CHARS = 1_000_000  # text handled at once
_SPACE = regex.compile(r"\S+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
SHORT = 48   # symbols of a word up to which words are merged side by side
ROWS = 8192  # such words at a time


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Finds code points that Python's tables do not know; newer tables may."""
    known = [unicodedata.category(chr(c)) != "Cn" for c in range(sys.maxunicode + 1)]
    starts = [c for c in range(len(known)) if not known[c] and (c == 0 or known[c - 1])]
    ends = [c for c in range(len(known)) if not known[c] and (c + 1 == len(known) or known[c + 1])]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]")


@lru_cache(maxsize=2)
def _library_parts(pattern: str):
    """Normaliser and splitter of the tokenizer library."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    return normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


class _Code:
    """A piece's ids as int32 bytes and its tokens joined by a blank; empty until encoded."""

    __slots__ = ("ids", "names")

    def __init__(self):
        self.ids = self.names = None


class _Known(dict):
    """piece -> _Code.  A piece that is not known gets its place at once, to be filled later;
    what ``older`` knows is taken over when it is used."""

    def __init__(self, older: dict[str, _Code] | None = None):
        super().__init__()
        self.older = dict(older or {})
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> _Code:
        code = self.older.get(piece)
        if code is None:
            code = _Code()
            self.fresh.append(piece)
        self[piece] = code
        return code

    def taken(self) -> list[str]:
        """The pieces to fill, once."""
        out, self.fresh = self.fresh, []
        return out


class Speculative:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.added).items()}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._build([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self._reset()

    # --- tables: symbols 0-255 are bytes, 256-511 bytes that end a word; merges follow in order
    def _build(self, merges: list[tuple[str, str]]) -> None:
        chars = _byte_chars()
        names = [chars[b] for b in range(256)] + [chars[b] + self.suffix for b in range(256)]
        number = {t: k for k, t in enumerate(names)}
        left, right, spelled = list(range(512)), list(range(512)), [(k,) for k in range(512)]
        for a, b in merges:
            x, y = number[a], number[b]
            number[a + b] = len(names)
            names.append(a + b)
            left.append(x)
            right.append(y)
            spelled.append(spelled[x] + spelled[y])
        self.size = len(names)
        self.left, self.right = np.array(left), np.array(right)
        keys = self.left[512:] * self.size + self.right[512:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_tokens = keys[order], order + 512
        self.pairs = dict(zip(keys.tolist(), range(512, self.size)))
        self.ids = np.array([self.vocab[t] for t in names], np.int32)
        self.id_bytes = [i.tobytes() for i in self.ids]
        self.texts = names
        nodes, edges, accept = 1, {}, [-1]
        for token, symbols in enumerate(spelled):
            at = 0
            for s in symbols:
                key = at * 512 + s
                to = edges.get(key)
                if to is None:
                    to = edges[key] = nodes
                    nodes += 1
                    accept.append(-1)
                at = to
            accept[at] = token
        self.accept = np.array(accept)
        self.edge_keys = np.array(sorted(edges))
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()])
        # a token is reachable if its halves are and nothing merges across them before it
        ok = np.ones(self.size, bool)
        every = np.arange(512, self.size)
        ok[512:] = self.compatible(self.left[512:], self.right[512:], every)
        for t in every.tolist():  # halves come before the whole
            ok[t] &= ok[left[t]] and ok[right[t]]
        self.reachable = ok

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a pair merges to, or a number above all."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_tokens[at], self.size)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair: would merging leave the boundary between them alone?

        Takes both tokens apart along the boundary, the later-made one first; what
        stands at the boundary at each time must not merge before that time ends.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), self.size) if limit is None else limit.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            clash = self._pair(x, y) < limit[live]
            good[live[clash]] = False
            live = live[~clash]
            x, y = a[live], b[live]
            cut_a = (x > y) & (x >= 512) | (y < 512) & (x >= 512)
            cut_b = ~cut_a & (y >= 512)
            limit[live[cut_a]], a[live[cut_a]] = x[cut_a], self.right[x[cut_a]]
            limit[live[cut_b]], b[live[cut_b]] = y[cut_b] + 1, self.left[y[cut_b]]
            live = live[cut_a | cut_b]
        return good

    # --- words to tokens
    def _longest(self, symbols: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token, and its length, from each position; ``room``: symbols left in the word."""
        n = len(symbols)
        token, length = symbols.copy(), np.ones(n, np.int64)
        where, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(where):
            fits = room[where] > depth
            where, node = where[fits], node[fits]
            keys = node * 512 + symbols[where + depth]
            at = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            step = self.edge_keys[at] == keys
            where, node = where[step], self.edge_to[at[step]]
            depth += 1
            hit = self.accept[node] >= 0
            token[where[hit]], length[where[hit]] = self.accept[node[hit]], depth
        return token, length

    def exact(self, symbols: list[int]) -> list[int]:
        """Merge in order of rank, then place: a heap over a linked list, n log n."""
        n = len(symbols)
        tok, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n:
                made = self.pairs.get(tok[i] * self.size + tok[j])
                if made is not None:
                    heapq.heappush(heap, (made, i, tok[i], tok[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            made, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != x or j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return [t for t in tok if t >= 0]

    def exact_all(self, words: list[np.ndarray]) -> list[list[int]]:
        """Exact merging of many words: short ones as rows of a matrix, a merge per row and round."""
        out: list[list[int]] = [[] for _ in words]
        short = sorted((len(w), k) for k, w in enumerate(words) if len(w) <= SHORT)
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.exact(w.tolist())
        for at in range(0, len(short), ROWS):
            ids = [k for _, k in short[at : at + ROWS]]
            sizes = np.array([len(words[k]) for k in ids])
            width = int(sizes.max()) + 1  # the last column stays unused
            tok = np.full((len(ids), width), -1)
            tok[np.arange(width) < sizes[:, None]] = np.concatenate([words[k] for k in ids])
            made = np.where((tok[:, :-1] >= 0) & (tok[:, 1:] >= 0), self._pair(tok[:, :-1], tok[:, 1:]), self.size)
            rows, columns = np.arange(len(ids)), np.arange(width)
            done = np.full((len(ids), width), -1)
            while len(rows):
                first = made.argmin(axis=1)
                low = made[np.arange(len(rows)), first]
                ends = low == self.size
                if ends.any():
                    done[rows[ends]] = np.pad(tok[ends], ((0, 0), (0, width - tok.shape[1])), constant_values=-1)
                    rows, tok, made, first, low = rows[~ends], tok[~ends], made[~ends], first[~ends], low[~ends]
                    if not len(rows):
                        break
                w = tok.shape[1]
                line = np.arange(len(rows))
                tok[line, first] = low
                # the merged symbol's right half goes; the pairs beside it are looked up again
                keep = columns[: w - 1] + (columns[: w - 1] > first[:, None])
                tok = np.take_along_axis(tok, keep, axis=1)
                if w == 2:
                    done[rows, :1] = tok
                    break
                made = np.take_along_axis(made, columns[: w - 2] + (columns[: w - 2] > first[:, None]), axis=1)
                for beside in (first - 1, first):
                    ok = (beside >= 0) & (beside < w - 2)
                    r, b = line[ok], beside[ok]
                    x, y = tok[r, b], tok[r, b + 1]
                    made[r, b] = np.where((x >= 0) & (y >= 0), self._pair(x, y), self.size)
            for k, line in zip(ids, done.tolist()):
                out[k] = [t for t in line if t >= 0]
        return out

    def coded(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Ids (int32 bytes) and tokens joined by a blank of each word; a word is never empty."""
        flat, stop, exact = self._tokens(words)
        ids, names = self.ids[flat].tobytes(), list(map(self.texts.__getitem__, flat.tolist()))
        bounds = [0, *stop.tolist()]
        out = [(ids[4 * a : 4 * b], " ".join(names[a:b])) for a, b in zip(bounds, bounds[1:])]
        for k, tok in exact.items():
            out[k] = b"".join([self.id_bytes[t] for t in tok]), " ".join([self.texts[t] for t in tok])
        return out

    def tokens(self, words: list[str]) -> list[list[int]]:
        """Tokens (numbers of this class) of each word."""
        flat, stop, exact = self._tokens(words)
        return [exact.get(k, cut.tolist()) for k, cut in enumerate(np.split(flat, stop[:-1]))]

    def _tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Greedy tokens of all words, where each word's end, and the tokens of those that failed."""
        raw = [w.encode() for w in words]
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        symbols[ends - 1] += 256
        room = np.repeat(ends, sizes) - np.arange(len(symbols))
        token, length = self._longest(symbols, room)
        jump, at, starts = length.tolist(), 0, []
        while at < len(jump):  # a token never crosses the end of its word
            starts.append(at)
            at += jump[at]
        flat, starts = token[starts], np.array(starts)
        stop = np.searchsorted(starts, ends)
        owner = np.repeat(np.arange(len(words)), np.diff(stop, prepend=0))
        fails = np.zeros(len(words), bool)
        fails[owner[~self.reachable[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            fails[owner[inner[~self.compatible(keys // self.size, keys % self.size)[back]]]] = True
        bad = np.flatnonzero(fails).tolist()
        self.failed += len(bad)
        return flat, stop, dict(zip(bad, self.exact_all([symbols[ends[k] - sizes[k] : ends[k]] for k in bad])))

    # --- texts
    def _reset(self) -> None:
        self.failed = 0
        self.known = _Known()

    def pieces(self, text: str) -> list[str]:
        """Normalised text cut at white space, which no token spans.  Added tokens, which are
        found before normalisation, are pieces that begin with a blank."""
        out = []
        for part in self.specials.split(text) if self.specials and "<|" in text else (text,):
            if part in self.added:
                out.append(" " + part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
            if any(c in part for c in _SEPARATORS):  # blanks to Python, not to Unicode
                out += _SPACE.findall(part)
            else:
                out += part.split()
        return out

    def _words(self, piece: str) -> list[str]:
        """The words of a piece; the commonest forms need no pattern."""
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        if not piece.isascii() and _unassigned().search(piece):
            return self._newer_words(piece)
        return self.split.findall(piece)

    def _newer_words(self, piece: str) -> list[str]:
        """The words of a piece with code points newer than Python's tables: its letters,
        case and composition come from the tokenizer library's own tables."""
        normalizer, splitter = _library_parts(self.split.pattern)
        norm = normalizer.normalize_str(piece)
        return [norm[a:b] for _, (a, b) in splitter.pre_tokenize_str(norm)]

    def _learn(self, fresh: list[str]) -> None:
        """Encode pieces not seen lately, all at once.  A word that is a known piece needs nothing."""
        known = self.known
        split = [(known[p], self._words(p)) for p in fresh if p[0] != " "]
        words = list({w for _, ws in split for w in ws if (c := known.get(w)) is None or c.ids is None})
        new = dict(zip(words, self.coded(words) if words else ()))
        old = {w: (known[w].ids, known[w].names) for _, ws in split for w in ws if w not in new}
        new |= old
        for code, ws in split:
            if len(ws) == 1:
                code.ids, code.names = new[ws[0]]
            else:
                parts = [new[w] for w in ws]
                code.ids, code.names = b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts])
        for piece in fresh:
            if piece[0] == " ":
                known[piece].ids, known[piece].names = np.int32(self.added[piece[1:]]).tobytes(), piece[1:]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text and the decoded texts (tokens joined by a blank)."""
        if len(self.known) > CACHE_PIECES:  # what was not used lately is forgotten
            self.known = _Known(self.known)
        look = self.known.__getitem__
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and looking through all known pieces takes long
        try:
            codes = [list(map(look, self.pieces(t))) for t in texts]
            self._learn(self.known.taken())
        except BaseException:
            self.known = _Known()  # places that stayed empty
            raise
        finally:
            if collecting:
                gc.enable()
        ids = [np.frombuffer(b"".join([c.ids for c in cs]), np.int32) for cs in codes]
        return ids, [" ".join([c.names for c in cs]) for cs in codes]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Speculative:
    """One vocabulary per worker process."""
    return Speculative(path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most CHUNK_CHARS together, or one longer text."""
    at = 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at])
        while end < len(texts) and chars + len(texts[end]) <= CHUNK_CHARS:
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Sets ``ids`` (array<int>) and ``decoded`` on every row; other columns stay, also
    repeated rows.  A null text counts as empty.  A task holds the results of
    CHUNK_CHARS characters at a time."""
    kept = set_columns(docs, {"ids": F.lit(None).cast("array<int>"), "decoded": F.lit(None).cast("string")})
    others = kept.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at, end in _slices(texts):
                ids, decoded = bpe.encode(texts[at:end])
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], lists, pa.array(decoded, pa.string())], [*others, "ids", "decoded"])

    return docs.mapInArrow(run, kept.schema)


def decode(ids: Column, path: str) -> Column:
    """Tokens joined by a blank; ids outside the vocabulary are left out, null stays null."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        bpe = vocabulary(path)
        return pa.array([None if x is None else bpe.decode(x) for x in lists.to_pylist()], pa.string())

    return run(ids)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_bpe_codec")
def op1_bpe_codec(spark, sf):
    return digests(encode_documents(table(spark, sf, "documents", "doc_id", "text"), default_path()))
