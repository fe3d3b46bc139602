"""Prefix trie of conversations: shared openings, counted once.

A conversation is cut into blocks of BLOCK turns.  A block hangs below the node
that the turns before it spell, so the blocks below one node are a small trie of
their own.  Blocks are sorted by (that node, their turns' digests); within a slice
of the sorted rows a union-find takes the edges between neighbours in descending
depth of their common prefix, and every merge makes a branching node.  Nodes that
a neighbouring slice or partition shares, or that hold deeper blocks, are left
open: what each slice knows of them adds up, and one aggregation merges them.
"""

from __future__ import annotations

import hashlib
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import table, written
from wordloom.llm.registry import query
from wordloom.operators.joins import lookup_join
from wordloom.operators.ordering import ordered_layout, running_by_group

BLOCK = 128      # turns of a block; a block's sort key has 16 bytes a turn
SLICE = 20_000   # sorted blocks that a forest is built over at a time
DIGEST = 16
GROUP = ("p0", "p1", "p2", "p3")   # what identifies the turns before a block
AFTER = ("q0", "q1", "q2", "q3")   # the same for the turns up to its end
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- turns ---------------------------------------------------------------------------------
def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), key (a digest of role and text), chars (code points of the text).

    Turns are ordered by ``turn``, null first, then role, then the digest of the
    text.  Null roles and texts count as empty; rows without a conv_id belong to no
    conversation and are left out.  A conversation with very many turns is spread
    over partitions by the range layout, also if its rows are all equal.
    """
    c = {k: conversations[f"`{v}`"] for k, v in (("conv", conv), ("turn", turn), ("role", role), ("text", text))}
    said, who = F.coalesce(c["text"], F.lit("")), F.coalesce(c["role"], F.lit(""))
    rows = conversations.where(c["conv"].isNotNull()).select(
        c["conv"].cast("bigint").alias("conv_id"), c["turn"].alias("turn"), who.alias("role"), F.md5(F.encode(said, "UTF-8")).alias("digest"),
        F.length(said).cast("bigint").alias("chars"), F.rand(17).alias("tie"))
    placed = running_by_group(rows, ["conv_id"], ["turn", "role", "digest", "tie"], {}, position="pos")
    key = F.unhex(F.md5(F.encode(F.concat_ws(":", F.length("role"), "role", "digest"), "UTF-8")))
    return placed.select("conv_id", "pos", key.alias("key"), "chars")


# --- blocks --------------------------------------------------------------------------------
def _marks() -> list[Column]:
    """Four 32-bit hashes of a turn and its place; their sums identify a sequence of turns."""
    a, b = F.xxhash64("pos", "key"), F.xxhash64("key", F.lit("place"), "pos")
    low = F.lit(2**32 - 1)
    return [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]


def _blocks(turns: DataFrame, convs: DataFrame, block: int, step: int) -> DataFrame:
    """One row a block: conv_id, chunk, seq (digests in order), chars, GROUP, AFTER, goes_on
    (a later block exists), later (characters that later blocks share) and leaf (1 if the
    last of them ends a leaf).  A conversation without turns is one empty block."""
    rows = turns.select("conv_id", "pos", "key", "chars").unionByName(convs.select("conv_id"), allowMissingColumns=True)
    chunk = F.coalesce(F.floor(F.col("pos") / block), F.lit(0)).cast("bigint")
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "chars"))
    sums = [F.coalesce(F.sum(F.when(F.col("pos").isNotNull(), m)), F.lit(0)).alias(q) for m, q in zip(_marks(), AFTER)]
    # at most ``block`` turns a group
    blocks = rows.groupBy("conv_id", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(turn)).alias("t"), *sums)
    blocks = written(blocks.select(
        "conv_id", "chunk", F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["key"])), "")).alias("seq"),
        F.col("t.chars").alias("chars"), *AFTER), "trie-blocks")
    none = [F.lit(0).cast("bigint").alias(p) for p in GROUP]
    if blocks.where("chunk > 0").isEmpty():
        return blocks.select("*", *none, F.lit(False).alias("goes_on"), F.lit(0).cast("bigint").alias("later"), F.lit(0).cast("bigint").alias("leaf"))
    starts = blocks.where("chunk > 0").select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.lit(True).alias("goes_on"))
    blocks = written(blocks.join(starts, ["conv_id", "chunk"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False))), "trie-blocks")
    # the sums up to a block's end are those before the next block
    full = blocks.where("goes_on").select("conv_id", "chunk", *[F.col(q).alias(f"one_{q}") for q in AFTER])
    ran = running_by_group(full, ["conv_id"], ["chunk"], {p: ("sum", F.col(f"one_{q}")) for p, q in zip(GROUP, AFTER)})
    ran = ran.select("conv_id", (F.col("chunk") + 1).alias("chunk"), *GROUP)
    placed = blocks.join(ran, ["conv_id", "chunk"], "left").fillna(0, list(GROUP))
    placed = placed.withColumns({q: F.col(q) + F.col(p) for p, q in zip(GROUP, AFTER)})
    placed = written(placed.withColumns({"later": F.lit(0).cast("bigint"), "leaf": F.lit(0).cast("bigint")}), "trie-blocks")
    # what the blocks below share, summed from a conversation's end
    below = _over_slices(_layout(placed.where("chunk > 0")), _shares, block, step, "conv_id bigint, chunk bigint, shared bigint, ends_leaf bigint")
    back = running_by_group(below.withColumn("back", -F.col("chunk")), ["conv_id"], ["back"],
                            {"later": ("sum", F.col("shared")), "leaf": ("sum", F.col("ends_leaf"))})
    back = back.select("conv_id", (F.col("chunk") - 1).alias("chunk"), "later", "leaf")
    return placed.drop("later", "leaf").join(back, ["conv_id", "chunk"], "left").fillna(0, ["later", "leaf"])


def _layout(blocks: DataFrame) -> DataFrame:
    """Blocks below one node together, sorted by their turns; of equal ones those that end here first."""
    return ordered_layout(blocks, [*GROUP, "seq", "goes_on", "conv_id"])


# --- slices of sorted blocks ---------------------------------------------------------------
class _Rows:
    """A slice as columns; ``before`` and ``after`` are the blocks next to it, or None."""

    def __init__(self, batch: pa.RecordBatch, before, after, block: int):
        def column(name: str):
            return batch.column(batch.schema.get_field_index(name))

        self.block = block
        self.group = np.stack([column(p).to_numpy(zero_copy_only=False) for p in GROUP], 1)
        self.end = np.stack([column(q).to_numpy(zero_copy_only=False) for q in AFTER], 1)
        self.seq = column("seq").to_pylist()
        self.conv = column("conv_id").to_numpy(zero_copy_only=False)
        self.chunk = column("chunk").to_numpy(zero_copy_only=False)
        self.goes_on = np.array(column("goes_on").to_pylist(), bool)
        self.later = column("later").to_numpy(zero_copy_only=False)
        self.below = column("leaf").to_numpy(zero_copy_only=False)
        self.n = np.array([len(s) // DIGEST for s in self.seq], np.int64)
        chars = column("chars")
        flat = chars.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # characters of the first k turns of row i: self.upto[self.at[i] + k]
        self.at = np.concatenate([[0], np.cumsum(self.n + 1)[:-1]]).astype(np.int64)
        steps = np.zeros(int((self.n + 1).sum()), np.int64)
        inner = np.ones(len(steps), bool)
        inner[self.at] = False
        steps[inner] = flat
        total = np.cumsum(steps)
        self.upto = total - np.repeat(total[self.at], self.n + 1)
        # common turns with the row before; -1 below another node
        keys = [tuple(g) for g in self.group.tolist()]
        rows = [before, *zip(keys, self.seq), after]
        self.shared = np.array([_common(a, b) for a, b in zip(rows, rows[1:])], np.int64)

    def __len__(self) -> int:
        return len(self.seq)

    def ends_leaf(self) -> np.ndarray:
        """1 for the last row of a leaf."""
        return ((self.shared[1:] < self.n) & ~self.goes_on).astype(np.int64)

    def shared_chars(self) -> np.ndarray:
        """Characters of the turns that a row shares with the row before."""
        return self.upto[self.at + np.maximum(self.shared[:-1], 0)]


def _common(a, b) -> int:
    """Turns that two neighbours begin with, -1 if they hang below different nodes."""
    if a is None or b is None or a[0] != b[0]:
        return -1
    x, y = a[1], b[1]
    if x == y:
        return len(x) // DIGEST
    return len(os.path.commonprefix([x, y])) // DIGEST


def _over_slices(laid: DataFrame, work, block: int, step: int, schema: str) -> DataFrame:
    """``work`` over slices of ``step`` sorted blocks, each with the blocks next to it.

    Only the first and last block of each partition are read on the driver.
    """
    edge = F.struct(*GROUP, "seq")
    ends = laid.groupBy("_part").agg(F.min_by(edge, "_local").alias("first"), F.max_by(edge, "_local").alias("last"))
    around, previous = {}, None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a partition
        first, last = ((tuple(e[p] for p in GROUP), bytes(e["seq"])) for e in (r["first"], r["last"]))
        around[r["_part"]] = [None if previous is None else around[previous][2], None, last]
        if previous is not None:
            around[previous][1] = first
        previous = r["_part"]

    def run(batches):
        held, before, part = None, None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                row = (tuple(piece.column(piece.schema.get_field_index(p))[0].as_py() for p in GROUP), piece.column(piece.schema.get_field_index("seq"))[0].as_py())
                if held is None:
                    part = piece.column(piece.schema.get_field_index("_part"))[0].as_py()
                    before = around[part][0]
                else:
                    rows = _Rows(held, before, row, block)
                    yield from work(rows)
                    before = (tuple(rows.group[-1].tolist()), rows.seq[-1])
                held = piece
        if held is not None:
            yield from work(_Rows(held, before, around[part][1], block))

    return laid.mapInArrow(run, schema)


def _shares(rows: _Rows):
    """conv_id, chunk, characters shared with the row before, and whether a leaf ends here."""
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows.conv), pa.array(rows.chunk), pa.array(rows.shared_chars()), pa.array(rows.ends_leaf())],
        ["conv_id", "chunk", "shared", "ends_leaf"])


class _Forest:
    """Union-find over a slice.  A record stands for a node at depth ``top`` and the
    unary chain above it, down to but without depth ``low``."""

    def __init__(self, rows: _Rows):
        n, self.rows = len(rows), rows
        shares = rows.shared_chars().tolist()
        self.first, self.last = list(range(n)), list(range(n))
        self.top, self.low, self.over = rows.n.tolist(), [-2] * n, [-1] * n
        self.least, self.count = rows.conv.tolist(), [1] * n
        self.ends, self.deeper = (~rows.goes_on).astype(int).tolist(), rows.goes_on.astype(int).tolist()
        self.leaves, self.later = (rows.ends_leaf() + rows.below).tolist(), rows.later.tolist()
        self.share, self.children = [0] * n, [0] * n
        self.ahead = int(rows.shared[0])   # turns shared with the block before the slice
        self.past = int(rows.shared[n])    # and with the one after it
        up, current = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        inner = rows.shared[1:n]
        order = np.argsort(-inner, kind="stable")
        for i in order.tolist():
            depth = int(inner[i])
            if depth < 0:
                break  # other nodes' blocks begin here
            a, b = find(i), find(i + 1)
            one = self._node_at(current[a], depth)
            two = current[b]
            if self.top[two] > depth:
                self.over[two], self.low[two] = one, depth
                self.children[one] += 1
            else:  # an equal row, which ends at the same node
                self.ends[one] += self.ends[two]
                self.low[two] = self.top[two]
            self.last[one] = self.last[two]
            self.least[one] = min(self.least[one], self.least[two])
            for column in (self.count, self.deeper, self.leaves, self.later):
                column[one] += column[two]
            self.share[one] += self.share[two] + shares[i + 1]
            up[b] = a
            current[a] = one
        for i in range(n):
            if up[i] == i:
                self.low[self._node_at(current[i], 0)] = -1

    def _node_at(self, record: int, depth: int) -> int:
        """The record itself if its node has that depth, or a new one above it."""
        if self.top[record] == depth:
            return record
        new = len(self.top)
        for column in (self.first, self.last, self.least, self.count, self.deeper, self.leaves, self.later, self.share):
            column.append(column[record])
        self.top.append(depth)
        self.low.append(-2)
        self.over.append(-1)
        self.ends.append(0)
        # a child that began in an earlier slice is counted there
        self.children.append(0 if self.first[record] == 0 and self.ahead > depth else 1)
        self.over[record], self.low[record] = new, depth
        return new


_NODES = ("id binary, parent_id binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
          "n_leaves bigint, saved_tokens bigint, ends_sha256 string, ends string, ends_from bigint")


def _nodes(rows: _Rows):
    """Nodes of a slice.  Open ones have an id, and what this slice knows of them; the
    others are whole.  A parent that is open is named by its id."""
    f = _Forest(rows)
    first, last, top, low, over, least, count, ends, deeper, leaves, later, share, children = (
        np.array(c, np.int64) for c in (f.first, f.last, f.top, f.low, f.over, f.least, f.count, f.ends, f.deeper, f.leaves, f.later, f.share, f.children))
    record = np.repeat(np.arange(len(top)), np.maximum(top - low, 0))
    start = np.cumsum(np.maximum(top - low, 0)) - np.maximum(top - low, 0)
    depth = low[record] + 1 + np.arange(len(record)) - start[record]
    at_top = depth == top[record]
    r = first[record]

    def is_open(rec: np.ndarray, d: np.ndarray) -> np.ndarray:
        reaches_back = (first[rec] == 0) & (d <= f.ahead)
        reaches_on = (last[rec] == len(rows) - 1) & (d <= f.past)
        return reaches_back | reaches_on | (d == 0) | ((d == rows.block) & (deeper[rec] > 0))

    opened = is_open(record, depth)
    begun = (r == 0) & (depth <= f.ahead)  # its first member lies in an earlier slice
    kids = np.where(at_top, children[record], np.where((r == 0) & (depth + 1 <= f.ahead), 0, 1))
    others = count[record] - 1 + begun
    earlier = rows.upto[rows.at[r] + np.maximum(depth - 1, 0)]
    reach = int(rows.upto[rows.at[0] + max(f.ahead, 0)])
    saved = share[record] + begun * reach - others * earlier + later[record]
    inside = depth > low[record] + 1
    parent = np.where(inside, record, over[record])
    has_parent = depth > 0
    parent_open = has_parent & is_open(np.where(has_parent, parent, record), depth - 1)
    parent_conv = least[np.where(has_parent, parent, record)]
    chunk = rows.chunk[r]
    real = (depth > 0) | (chunk == 0)  # below a block the node itself belongs to the block before
    n_ends = np.where(at_top & real, ends[record], 0)

    def name(row: int, d: int) -> bytes:
        if d == rows.block:
            return struct.pack(">4q", *rows.end[row].tolist())
        return struct.pack(">4q", *rows.group[row].tolist()) + rows.seq[row][: d * DIGEST]

    spots, depths = r.tolist(), depth.tolist()
    ids = [name(i, d) if o else None for i, d, o in zip(spots, depths, opened.tolist())]
    parents = [name(i, d - 1) if o else None for i, d, o in zip(spots, depths, parent_open.tolist())]
    digests, pieces, froms = [], [], []
    for i, n, o in zip(spots, n_ends.tolist(), opened.tolist()):
        listed = ",".join(map(str, rows.conv[i:i + n].tolist())) if n else None
        digests.append(None if o else hashlib.sha256(listed.encode()).hexdigest() if n else NO_ENDS)
        pieces.append(listed if o else None)
        froms.append(int(rows.conv[i]) if o and n else None)

    def known(values: np.ndarray) -> pa.Array:
        return pa.array(np.where(real, values, 0), pa.int64())

    out = pa.RecordBatch.from_arrays([
        pa.array(ids, pa.binary()), pa.array(parents, pa.binary()), pa.array(least[record], pa.int64(), mask=~real),
        pa.array(chunk * rows.block + depth, pa.int64()), pa.array(parent_conv, pa.int64(), mask=~(has_parent & ~parent_open)), known(count[record]),
        pa.array(kids, pa.int64()), known(leaves[record]), known(saved), pa.array(digests, pa.string()), pa.array(pieces, pa.string()), pa.array(froms, pa.int64()),
    ], [c.split()[0] for c in _NODES.split(", ")])
    for lo in range(0, out.num_rows, SLICE):
        yield out.slice(lo, SLICE)


# --- the trie ------------------------------------------------------------------------------
def _digests(pieces: DataFrame) -> DataFrame:
    """id, ends_sha256: pieces of a node's list are hashed one after the other, in bounded memory."""

    def run(batches):
        current, state, fresh = None, None, True
        done_ids, done = [], []
        for batch in batches:
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != current:
                    if state is not None:
                        done_ids.append(current)
                        done.append(state.hexdigest())
                    current, state, fresh = key, hashlib.sha256(), True
                state.update((piece if fresh else "," + piece).encode())
                fresh = False
            yield pa.RecordBatch.from_arrays([pa.array(done_ids, pa.binary()), pa.array(done, pa.string())], ["id", "sha"])
            done_ids, done = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["id", "sha"])

    lists = pieces.repartition("id").sortWithinPartitions("id", "ends_from").select("id", "ends")
    return lists.mapInArrow(run, "id binary, sha string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, step: int = SLICE) -> DataFrame:
    """Every distinct prefix of the conversations as a row.

    ``turns`` has conv_id, pos (0, 1, ... within a conversation), key, chars;
    ``convs`` the conv_id of each conversation, once, also of those without turns.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (characters of turns that need not be processed again)
    and ends_sha256 (members that end there), as ``op11_prefix_trie`` states them.
    Without conversations there is no node, not even the root.  Equal turns are told
    by 128-bit digests.  A very long conversation is many blocks of ``block`` turns, a
    node with very many members many slices of ``step`` blocks; the rows do not depend on either.
    """
    laid = _layout(_blocks(turns, convs, block, step))
    nodes = written(_over_slices(laid, _nodes, block, step, _NODES), "trie-nodes")
    parts = nodes.where("id is not null")
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = parts.groupBy("id").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"),
        F.min(F.when(F.col("conv_id").isNotNull(), F.col("parent_id"))).alias("parent_id"), *[F.sum(c).alias(c) for c in counts])
    opened = merged.join(_digests(parts.where("ends is not null")), "id", "left")
    opened = written(opened.withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha"), "trie-open")
    # an open node's children that began in later slices are counted there; open children of one
    # parent in several slices begin in one only, so the sums need no repair
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = nodes.where("id is null").select(*columns, "parent_id").unionByName(opened.select(*columns, "parent_id"))
    names = opened.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("_parent"))
    out = lookup_join(rows, names, ["parent_id"], spread_by=["conv_id", "depth"])
    return out.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select(*columns)


def conversation_trie(conversations: DataFrame, block: int = BLOCK, step: int = SLICE) -> DataFrame:
    """``prefix_trie`` of a table with conv_id, turn, role and text; other columns do not matter.

    Ties, nulls and repeated rows are put in order as ``ordered_turns`` states; an empty table gives no row.
    """
    turns = written(ordered_turns(conversations), "trie-turns")
    return prefix_trie(turns, conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).where("conv_id is not null").distinct(), block, step)


# --- the query -----------------------------------------------------------------------------
HEAD = 5  # the largest remainder of the contract's h


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation begins with the first h turns of conversation c - c % 100, and
    goes on with its own turns after its first h; h = crc32(c) % 6."""
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (HEAD + 1)
    heads = turns.where(F.col("pos") < HEAD).where(F.col("conv_id") % 100 == 0)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "chars"))).alias("head"))
    named = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.cast("int").alias("h"))
    joined = written(named.join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce(F.size("head"), F.lit(0)))), "trie-heads")
    opening = joined.where("m > 0").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("m"))).alias("t")).select("conv_id", "t.*")
    short = joined.where("m < h").select("conv_id", (F.col("h") - F.col("m")).cast("bigint").alias("gap"))
    own = lookup_join(turns.where(F.col("pos") >= h), short, ["conv_id"], spread_by=["pos"])
    own = own.select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "key", "chars")
    return opening.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "key", "chars").unionByName(own)


_CRC = """(4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(CAST(xor(a, b) AS BIGINT), list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
    lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)))"""
_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
lists AS (SELECT c, list({{'r': role, 't': text}} ORDER BY p) AS l FROM own GROUP BY c),
seqs AS (SELECT v.c, list_concat(coalesce(b.l[1:v.h], []), o.l[v.h + 1:]) AS s FROM convs v JOIN lists o ON o.c = v.c LEFT JOIN lists b ON b.c = v.base),
path AS (SELECT c, s, len(s) AS n, unnest(range(len(s) + 1)) AS d FROM seqs),
member AS (SELECT c, d, n, CAST(s[1:d] AS VARCHAR) || ':' || d AS id, CASE WHEN d > 0 THEN CAST(s[1:d - 1] AS VARCHAR) || ':' || (d - 1) END AS up,
  CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS chars FROM path),
node AS (SELECT id, d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM member GROUP BY id, d),
kids AS (SELECT up AS id, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY up),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (id)),
below AS (SELECT a.id, f.id AS under, f.k, f.n, f.chars FROM full_node f JOIN member m ON m.c = f.c AND m.d = f.d
  JOIN member a ON a.c = m.c AND a.d <= m.d),
total AS (SELECT id, count(*) FILTER (WHERE k = 0) AS leaves, sum((n - 1) * chars) AS saved FROM below GROUP BY id)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN total USING (id) LEFT JOIN node p ON p.id = f.up
"""


@query("op11_prefix_trie", _SQL)
def op11_prefix_trie(spark, sf):
    turns = written(ordered_turns(table(spark, sf, "conversations", "conv_id", "turn", "role", "text")), "trie-turns")
    convs = turns.select("conv_id").distinct()
    return prefix_trie(rebuilt(turns, convs), convs)
