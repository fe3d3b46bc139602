"""SimHash near-duplicates: fingerprints, a trie self-join, and classes.

Distinct fingerprints are dealt out by bits that two of them must share: if at
most two of 64 bits differ, one of three segments is equal.  Sets larger than
``BUCKET`` are dealt out again by segments of the remaining bits, so their size
has a bound whatever the data.  Each set is a binary trie, read from sorted
fingerprints, which is joined with itself: node pairs descend together, add up
the differing bits and end where these exceed the budget.  A set reports each
member's link to the first of its class, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import set_columns, table, written
from wordloom.llm.graph import components
from wordloom.llm.registry import query

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 2
BUCKET = 4096


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text; 0 if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """Fingerprint as a signed 64-bit integer with the same bits."""

    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), size) for t in texts], np.uint64).view(np.int64))

    return fp(text)


# --- the trie join of one table of sets ------------------------------------------------
def trie_pairs(groups: np.ndarray, values: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within a group whose values differ in at most ``budget`` bits.

    ``groups`` and ``values`` (uint64) are sorted together and hold no value twice in a group.  A
    node is a range of sorted values with equal leading bits; it splits at the
    first value with the next bit set.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(groups)] if len(groups) else starts
    a0, a1 = starts, ends
    b0, b1, d = a0.copy(), a1.copy(), np.zeros(len(a0), np.int8)
    done_i, done_j = [], []
    for level in range(BITS - 1, -1, -1):
        alone = (a0 == b0) & (a1 - a0 < 2)  # a leaf with itself
        a0, a1, b0, b1, d = (x[~alone] for x in (a0, a1, b0, b1, d))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)  # two leaves: the rest of the path at once
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            rest = (values[i] ^ values[j]) & np.uint64((1 << (level + 1)) - 1)
            near = np.bitwise_count(rest).astype(np.int64) + d[leaf] <= budget
            done_i.append(i[near])
            done_j.append(j[near])
            a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            break
        ones = np.r_[0, np.cumsum((values >> np.uint64(level)) & np.uint64(1)).astype(np.int64)]
        am = a1 - (ones[a1] - ones[a0])
        bm = b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, d, np.ones(len(d), bool)), (am, a1, bm, b1, d, np.ones(len(d), bool)),
                 (a0, am, bm, b1, d + 1, d < budget), (am, a1, b0, bm, d + 1, (d < budget) & ~same)]
        kept = [(p[0][ok], p[1][ok], p[2][ok], p[3][ok], p[4][ok]) for p in parts for ok in [p[5] & (p[1] > p[0]) & (p[3] > p[2])]]
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*kept))
    apart = a0 != b0  # leaf pairs that parted at the last bit
    done_i.append(a0[apart])
    done_j.append(b0[apart])
    i = np.concatenate(done_i)
    j = np.concatenate(done_j)
    return np.minimum(i, j), np.maximum(i, j)


def first_of_class(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item connected with it."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) rows of a partition, sorted by key and fp, to links (fp, first of its class)."""

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        values = fps.view(np.uint64)
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        i, j = trie_pairs(keys, values)
        label = first_of_class(len(keys), i, j)
        moved = np.flatnonzero(label != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))], ["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.r_[keys, batch.column("key").to_numpy(zero_copy_only=False)]
        fps = np.r_[fps, batch.column("fp").to_numpy(zero_copy_only=False)]
        if len(keys) and keys[0] != keys[-1]:  # the last set may go on in the next batch
            cut = int(np.searchsorted(keys, keys[-1]))
            yield solve(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield solve(keys, fps)


def _segments(free: list[int], parts: int) -> list[list[int]]:
    size = -(-len(free) // parts)
    return [free[k : k + size] for k in range(0, len(free), size)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def near_links(fps: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within ``budget``
    differing bits: not all pairs, but the same classes."""
    todo = fps.select("fp", F.lit(0).cast("bigint").alias("mask"))
    free = {0: list(range(BITS))}  # mask of the bits known to be equal -> the other bits
    found = None
    while free:
        cases, deeper = [], {}
        for mask, bits in free.items():
            for part in _segments(bits, budget + 1):
                new = _mask([b for b in range(BITS) if b not in bits] + part)
                cases.append((mask, new))
                deeper[new] = [b for b in bits if b not in part]
        choices = F.array(*[F.struct(F.lit(m).alias("old"), F.lit(n).alias("new")) for m, n in cases])
        keyed = todo.select("fp", F.explode(F.filter(choices, lambda c: c["old"] == F.col("mask"))).alias("c")).select(
            "fp", F.col("c.new").alias("mask"), F.col("fp").bitwiseAND(F.col("c.new")).alias("part"))
        sizes = written(keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
        sized = written(keyed.join(sizes, ["mask", "part"]), "simhash-sets")
        last = all(len(bits) <= int(np.log2(bucket)) for bits in deeper.values())
        here = sized if last else sized.where(F.col("n") <= bucket)
        sets = here.select(F.xxhash64("mask", "part").alias("key"), "fp").distinct()
        n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        links = sets.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a bigint, b bigint")
        found = links if found is None else found.unionByName(links)
        todo = sized.where(F.col("n") > bucket).select("fp", "mask")
        if last or todo.isEmpty():
            break
        free = deeper
    return found


def _classes(docs: DataFrame, size: int, budget: int) -> DataFrame:
    prints = written(docs.select("doc_id", row_key(docs).alias("row"), fingerprint(docs["text"], size).alias("fp")), "simhash-fp")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    classes = components(near_links(fps, budget), "a", "b")
    rooted = fps.join(classes, fps["fp"] == classes["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-root")
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-classes")
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "row", "fp", "component_id")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def near_duplicates(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    Documents whose fingerprints differ in at most ``budget`` bits are linked;
    ``component_id`` is the smallest doc_id reachable.  Null, empty and blank
    texts have fingerprint 0 and are linked like any other; fewer words than a
    shingle are one shingle.  Rows of one doc_id are linked through their texts
    only.  A null doc_id takes part but is never a component_id, unless all are null.
    """
    return _classes(docs, size, budget).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """Of each class the document with the smallest doc_id, all its columns; a
    repeated row stays repeated, and rows without a doc_id stay only if their class has none."""
    gone = written(_classes(docs, size, budget).where("not (doc_id <=> component_id)").select("doc_id", "row").distinct(), "simhash-gone")
    # no broadcast: what goes grows with the documents
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["doc_id"]) & (row_key(docs) == gone["row"]), "left_anti")


@query("op7_simhash_dedup")
def op7_simhash_dedup(spark, sf):
    out = near_duplicates(table(spark, sf, "documents", "doc_id", "text"))
    return set_columns(out.select("doc_id", "fp", "component_id"), {"fingerprint": F.lpad(F.lower(F.hex("fp")), 16, "0")}).select(
        "doc_id", "fingerprint", "component_id")
