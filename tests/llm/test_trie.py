import hashlib
import random
import zlib

from wordloom.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sequences(rows):
    """conv_id -> turns in order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            text, role = text or "", role or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in out.items()}


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    rows = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        rows.add((min(m), len(p), up, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows, len(members)


def check(found, seqs):
    want, n = brute(seqs)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == n and set(got) == want


def made(rng, convs, longest, words):
    rows = []
    for c in range(convs):
        n = rng.choice((0, 1, 2, 3, longest, rng.randrange(longest + 1)))
        rows += [(c * 3 - 20, t, rng.choice(("user", "assistant")), rng.choice(words)) for t in range(n)]
    return rows


def test_equal_to_brute_force_over_blocks_and_slices(spark):
    rng = random.Random(4)
    for block, step in ((3, 4), (2, 50), (128, 5), (128, 20_000)):
        rows = made(rng, 40, 9, ("a", "bb", "é" * 5))
        same = [(1000 + k, t, "user", "again " * t) for k in range(60) for t in range(7)]  # a large group of copies
        longer = [(2000 + k, t, "user", "again " * t) for k in range(3) for t in range(7 + 2 * k)]
        rows += same + longer
        rng.shuffle(rows)
        check(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), block, step), sequences(rows))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, 0, "", None), (1, 0, "", ""), (1, 0, "b", "x"), (1, 0, "a", "y"), (2, 5, None, ""), (2, None, "", ""), (None, 1, "user", "lost"), (3, 1, "user", "z" * 200_000)]
    rows += [(4, 0, "user", "same")] * 5
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA + ", pos int, key string").withColumnRenamed("key", "P0")
    check(trie.conversation_trie(df, 2, 2), sequences(rows))


def test_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_very_long_conversation_twice(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (5, 9) for t in range(300)] + [(7, t, "user", str(t % 7)) for t in range(120)]
    check(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), 16, 6), sequences(rows))


def test_rebuilt_conversations(spark):
    rng = random.Random(8)
    rows = []
    for c in (0, 1, 2, 5, 7, 33, 99, 100, 104, 150, 205, 207, 299, 301, 400, 401, 402, 499, 1234567890123):
        rows += [(c, t, "user", f"{c if rng.random() < 0.7 else 0} {t}") for t in range(rng.choice((1, 2, 3, 9)))]
    own = sequences(rows)
    want = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + s[h:]
    assert any(not s for s in want.values())
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    convs = turns.select("conv_id").distinct()
    check(trie.prefix_trie(trie.rebuilt(turns, convs), convs, 4, 3), want)
