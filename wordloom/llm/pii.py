"""Personal data: patterns, and a skip-chain conditional random field.

Nodes are the tokens of a text that hold a digit or an @.  Neighbouring nodes
share a chain potential; equal tokens and tokens of one shape, however far
apart, share a skip potential (each with the next one like it, so a text has a
linear number of edges).  Loopy message passing makes labels agree.  The weights
are fitted on counts over all documents, with the patterns' spans as labels.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import table, written
from wordloom.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is "none"
TOLERANCE = 1e-4         # a text's messages are passed until none changes by more
ROUNDS = 2000            # a text whose messages keep swinging is left there
SURE = 0.9               # posterior from which an unmatched token becomes a span
EPOCHS, RATE, RIDGE = 300, 0.5, 1e-3
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_DIGIT_RUN, _LETTER_RUN = re.compile("[0-9]+"), re.compile(r"[^\W\d_]+")
_EDGE = ".,;:!?()[]{}<>\"'|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start.  Each pattern is matched in linear time: an
    address is looked for around each @, numbers only at the start of a run of digits."""
    out, at, lo = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > lo and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            lo = m.end()
        at = text.find("@", max(lo, at + 1))
    if not _DIGIT_RUN.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- tokens -------------------------------------------------------------------------------
def _features(core: str, before: str) -> int:
    """Bits of what a token looks like; none of them tests a pattern of ``base_spans`` in full."""
    n = sum(map(len, _DIGIT_RUN.findall(core)))
    bucket = next(k for k, most in enumerate((0, 1, 2, 4, 7, 11, 15, 19, 10**9)) if n <= most)
    letters = bool(_LETTER_RUN.search(core))
    dots = core.count(".")
    tests = ("@" in core, dots == 0, dots == 3, dots not in (0, 3), core.startswith("+"), letters, "-" in core, "(" in core,
             n * 2 >= len(core), core.count("@") == 1 and 0 < core.find("@") < len(core) - 1, before.startswith("+"), before[-1:].isdigit())
    return 1 | 1 << (bucket + 1) | sum(1 << (k + 10) for k, yes in enumerate(tests) if yes)


N_FEATURES = 22


def _shape(core: str) -> str:
    return _LETTER_RUN.sub("a", _DIGIT_RUN.sub(lambda m: "9" * min(3, len(m[0])) + str(len(m[0]) // 4), core))


def tokens_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(start, end, features, label, place, same, like): ``place`` counts all white-space
    breaks before a token, so that nodes of neighbouring places are neighbours."""
    out, place, counted, before = [], 0, 0, ""
    ordered = sorted((a, b, k) for k, a, b in spans)
    s = 0
    for m in _TOKEN.finditer(text):
        core = m[0].strip(_EDGE)
        if not core:
            continue
        start = m.start() + m[0].find(core)
        end = start + len(core)
        if counted < m.start():
            gap = text[counted : m.start()]
            step = len(gap.split()) + (1 if counted else 0)
            place += step
        while s < len(ordered) and ordered[s][1] <= start:
            s += 1
        label = 0
        for a, b, k in ordered[s : s + 4]:
            if a < end and start < b:
                label = k + 1
                break
        out.append((start, end, _features(core, before if counted and gap.strip() == "" else ""), label, place,
                    xxhash.xxh3_64_intdigest(core.lower()) >> 1, xxhash.xxh3_64_intdigest(_shape(core)) >> 1))
        counted, before = m.end(), core
    return out


_NAMES = ("start", "end", "features", "label", "place", "same", "like")
_TOKENS = "array<struct<" + ",".join(f"{n}:bigint" for n in _NAMES) + ">>"
_SPANS = "array<struct<k:int,start:bigint,end:bigint>>"


def analysed(text):
    """struct(base, tokens) of each text."""

    @F.arrow_udf(f"struct<base:{_SPANS},tokens:{_TOKENS}>")
    def run(texts: pa.Array) -> pa.Array:
        base, tokens, b_at, t_at = [], [], [0], [0]
        for t in texts:
            text = t.as_py() or ""
            if "@" in text or _DIGIT_RUN.search(text):
                spans = base_spans(text)
                base += spans
                tokens += tokens_of(text, spans)
            b_at.append(len(base))
            t_at.append(len(tokens))
        b = np.array(base, np.int64).reshape(-1, 3)
        k = np.array(tokens, np.int64).reshape(-1, len(_NAMES))
        spans = pa.StructArray.from_arrays([pa.array(b[:, 0].astype(np.int32)), pa.array(b[:, 1]), pa.array(b[:, 2])], ["k", "start", "end"])
        nodes = pa.StructArray.from_arrays([pa.array(k[:, j]) for j in range(len(_NAMES))], list(_NAMES))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(b_at, pa.int32()), spans), pa.ListArray.from_arrays(pa.array(t_at, pa.int32()), nodes)], ["base", "tokens"])

    return run(text)


def _nodes(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each token, and the tokens' fields, of a list column."""
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    return rows, {n: flat.field(n).to_numpy(zero_copy_only=False) for n in _NAMES}


def edges(rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j), chain edges and skip edges: neighbours, and a token with the next
    equal one and the next of its shape in the same text."""
    at = np.arange(len(rows))
    near = np.flatnonzero((rows[1:] == rows[:-1]) & (t["place"][1:] - t["place"][:-1] == 1))
    chain = np.stack([at[near], at[near] + 1])
    skips = []
    for key in ("same", "like"):
        order = np.lexsort((at, t[key], rows))
        follows = (rows[order][1:] == rows[order][:-1]) & (t[key][order][1:] == t[key][order][:-1])
        skips.append(np.stack([order[:-1][follows], order[1:][follows]]))
    skip = np.unique(np.concatenate(skips, axis=1), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
    return chain, skip


def _count(batches):
    """(what, a, b, n) of a partition: features with labels, and labels along edges."""
    total: dict[tuple[str, int, int], int] = {}
    for batch in batches:
        rows, t = _nodes(batch.column("tokens_"))
        chain, skip = edges(rows, t)
        for what, a, b in (("token", t["features"], t["label"]), ("chain", t["label"][chain[0]], t["label"][chain[1]]), ("skip", t["label"][skip[0]], t["label"][skip[1]])):
            keys, n = np.unique(np.stack([a, b]), axis=1, return_counts=True)
            for (x, y), c in zip(keys.T.tolist(), n.tolist()):
                total[what, x, y] = total.get((what, x, y), 0) + c
    if total:
        what, a, b = zip(*total)
        yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(total.values()), pa.int64())], ["what", "a", "b", "n"])


class Weights:
    """Node weights by maximum entropy, edge potentials from label pairs (both smoothed)."""

    def __init__(self, counts: list[tuple[str, int, int, int]]):
        token = [(a, b, n) for what, a, b, n in counts if what == "token"]
        x = np.array([[a >> f & 1 for f in range(N_FEATURES)] for a, _, _ in token], float).reshape(-1, N_FEATURES)
        y = np.array([b for _, b, _ in token], int)
        n = np.array([c for _, _, c in token], float)
        share = n / max(n.sum(), 1.0)
        self.w = np.zeros((N_FEATURES, LABELS))
        for _ in range(EPOCHS if len(y) else 0):
            p = _softmax(x @ self.w)
            p[np.arange(len(y)), y] -= 1
            self.w -= RATE * (x.T @ (p * share[:, None]) + RIDGE * self.w)
        self.chain, self.skip = self._pairs(counts, "chain"), self._pairs(counts, "skip")

    @staticmethod
    def _pairs(counts, kind: str) -> np.ndarray:
        """Log of how much more often two labels meet than by chance."""
        m = np.full((LABELS, LABELS), 0.1) + np.eye(LABELS)
        for what, a, b, n in counts:
            if what == kind:
                m[a, b] += n / 2
                m[b, a] += n / 2
        p = m / m.sum()
        own = p.sum(axis=0)
        return np.clip(np.log(p / np.outer(own, own)), -3, 3)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sums(node: np.ndarray, target: np.ndarray, message: np.ndarray) -> np.ndarray:
    return node + np.stack([np.bincount(target, message[:, y], len(node)) for y in range(LABELS)], axis=1)


def posteriors(
    weights: Weights, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, rows: np.ndarray | None = None,
    tolerance: float = TOLERANCE, rounds: int = ROUNDS,
) -> np.ndarray:
    """Label posteriors of all tokens: all messages are renewed at once, half old, half new.

    ``rows``: the text of each token.  A text is done when none of its messages changes by more
    than ``tolerance``, however far they had to go; the others go on.  Messages on loops may
    swing for ever: such a text keeps those of the last of ``rounds``.
    """
    x = (features[:, None] >> np.arange(N_FEATURES) & 1).astype(float)
    node = np.log(_softmax(x @ weights.w) + 1e-12)
    ends = np.concatenate([chain, skip], axis=1).astype(int)
    n = ends.shape[1]
    source, target = np.concatenate([ends[0], ends[1]]), np.concatenate([ends[1], ends[0]])
    back = np.concatenate([np.arange(n) + n, np.arange(n)])
    is_skip = np.tile(np.arange(n) >= chain.shape[1], 2)
    text = (np.zeros(len(node), int) if rows is None else np.asarray(rows))[source]
    final, live = np.zeros((2 * n, LABELS)), np.arange(2 * n)
    message = final.copy()
    for step in range(rounds):
        if not len(live):
            break
        out = _sums(node, target, message)[source] - message[back]
        new = np.empty_like(message)
        for kind, pot in ((False, weights.chain), (True, weights.skip)):
            z = out[is_skip == kind][:, :, None] + pot[None]
            top = z.max(axis=1, keepdims=True)
            new[is_skip == kind] = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - message).max(axis=1) > tolerance
        message = (message + new) / 2
        if step % 4 == 3 or not moved.any():  # texts that are done leave, with all their edges
            on = np.isin(text, np.unique(text[moved]))
            final[live[~on]] = message[~on]
            place = np.cumsum(on) - 1
            source, target, is_skip, text, live, message = (a[on] for a in (source, target, is_skip, text, live, message))
            back = place[back[on]]
    final[live] = message
    return _softmax(_sums(node, np.concatenate([ends[1], ends[0]]), final))


def _consistent(weights: Weights, sure: float):
    """Spans that the field adds: unmatched tokens it is sure of, neighbours of one label as one."""

    @F.arrow_udf(_SPANS)
    def run(lists: pa.Array) -> pa.Array:
        rows, t = _nodes(lists)
        chain, skip = edges(rows, t)
        p = posteriors(weights, t["features"], chain, skip, rows) if len(rows) else np.zeros((0, LABELS))
        best = p.argmax(axis=1) if len(rows) else np.zeros(0, int)
        new = (best > 0) & (t["label"] == 0) & (p.max(axis=1, initial=0) >= sure)
        counts, spans = np.zeros(len(lists), np.int64), []
        last = None
        for i in np.flatnonzero(new).tolist():
            if last is not None and last == i - 1 and rows[i] == rows[last] and best[i] == best[last] and t["place"][i] - t["place"][last] == 1:
                spans[-1][2] = int(t["end"][i])
            else:
                spans.append([int(best[i]) - 1, int(t["start"][i]), int(t["end"][i])])
                counts[rows[i]] += 1
            last = i
        s = np.array(spans, np.int64).reshape(-1, 3)
        flat = pa.StructArray.from_arrays([pa.array(s[:, 0].astype(np.int32)), pa.array(s[:, 1]), pa.array(s[:, 2])], ["k", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), flat)

    return run(F.col("tokens_"))


def find_personal_data(docs: DataFrame, sure: float = SURE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns, unless named), and ``base`` (pattern spans) and ``added``
    (spans of the random field): arrays of (k, start, end) with k an index of KINDS,
    in code points.

    The kept columns are written once beside the spans.  Null or empty texts have
    no spans; rows stay, also repeated ones; a column named base or added is
    replaced.  Without any pattern span nothing is added: there is nothing to learn from.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base", "added")]
    rest = [F.struct(*[docs[f"`{c}`"] for c in names]).alias("rest_")] if names else []  # any names
    found = docs.select(*rest, analysed(docs["text"]).alias("found_"))
    found = written(found.select(*found.columns[:-1], F.col("found_.base").alias("base"), F.col("found_.tokens").alias("tokens_")), "pii-tokens")
    counts = found.where("size(tokens_) > 0").select("tokens_").mapInArrow(_count, "what string, a bigint, b bigint, n bigint")
    # one row for each combination of features and label, a number that does not grow with the documents
    rows = counts.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).orderBy("what", "a", "b").collect()
    out = found.withColumn("added", _consistent(Weights([tuple(r) for r in rows]), sure))
    return out.select(*[F.col("rest_").getField(c).alias(c) for c in names], "base", "added")


def redact(text, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


@query("op5_personal_data")
def op5_personal_data(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    found = find_personal_data(docs, keep=["doc_id"])
    kinds = F.array(*map(F.lit, KINDS))

    def joined(spans, prefix: str = ""):
        return F.transform(spans, lambda x: F.concat(F.lit(prefix), F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))))

    def count(k: int):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    base = joined(F.col("base"))
    more = joined(F.array_sort("added"), "field_")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))
