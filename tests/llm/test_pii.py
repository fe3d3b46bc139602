import re

import numpy as np

from wordloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def texts():
    rng = np.random.default_rng(5)
    out = ["", "plain", "a@b.c@d.e a@@b.c @x.y a@b", "a@b-c..d x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.002.003.0255", "4111 1111-1111 1111 4111  1111",
           "+1 (377) 555-0271 +1((((( +12345678+12345678 ++49 89 123456.", "é🙂 a.b%c+d@e-f.gh 4111111111111111", "7" * 5000, "a" * 5000 + "@", "1 " * 3000]
    alphabet = list("ab@.+- ()0123456789\né")
    return out + ["".join(rng.choice(alphabet, 200)) for _ in range(300)]


def test_base_spans_match_the_patterns():
    for t in texts():
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("x" * 300_000 + "@" + "9" * 300_000) == []


def test_messages_match_enumeration():
    """On a tree, message passing gives the exact posteriors."""
    rng = np.random.default_rng(1)
    w = pii.Weights([])
    w.w = rng.normal(size=w.w.shape)
    w.chain, w.skip = (lambda a: a + a.T)(rng.normal(size=w.chain.shape)), (lambda a: a + a.T)(rng.normal(size=w.skip.shape))
    features = np.array([3, 5, 9, 17])
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[1], [3]])
    got = pii.posteriors(w, features, chain, skip, tolerance=1e-9)
    x = (features[:, None] >> np.arange(pii.N_FEATURES) & 1).astype(float)
    node = np.log(pii._softmax(x @ w.w))
    want = np.zeros((4, pii.LABELS))
    for ys in np.ndindex(*[pii.LABELS] * 4):
        p = np.exp(sum(node[i, y] for i, y in enumerate(ys)) + w.chain[ys[0], ys[1]] + w.chain[ys[1], ys[2]] + w.skip[ys[1], ys[3]])
        for i, y in enumerate(ys):
            want[i, y] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def _field():
    w = pii.Weights([])
    w.w = np.zeros_like(w.w)
    w.w[1, 2] = 6.0  # feature 1 is clear evidence for a label, feature 2 says nothing
    w.skip = np.clip(np.eye(pii.LABELS) * 6 - 3, -3, 3)
    return w


def test_evidence_reaches_far_occurrences():
    """30 equal tokens in a row, one of them clear: the far end gets the exact share."""
    w = _field()
    n = 30
    features = np.array([2] + [4] * (n - 1))
    skip = np.stack([np.arange(n - 1), np.arange(1, n)])
    got = pii.posteriors(w, features, np.zeros((2, 0), int), skip)
    p = pii._softmax(np.array([w.w[1], w.w[2]]))
    at, pass_on = p[0], np.exp(w.skip)
    for k in range(1, n):  # exact sums along the row; the other tokens are even
        at = at @ pass_on
        at = at / at.sum()
        if k < n - 1:
            at = at * p[1]
    assert np.allclose(got[-1], at, atol=1e-3)
    assert got[-1, 2] > 0.5


def test_texts_do_not_wait_or_change_each_other():
    rng = np.random.default_rng(4)
    w = pii.Weights([])
    w.w = rng.normal(size=w.w.shape)
    w.skip = w.skip + 0.5 * np.eye(pii.LABELS)
    parts, features, chain, skip, rows = [], [], [], [], []
    for text, n in enumerate((1, 3, 40, 2, 0, 12)):
        f = rng.integers(1, 1 << 10, n)
        c, s = np.stack([np.arange(n - 1), np.arange(1, n)]) if n > 1 else np.zeros((2, 0), int), np.zeros((2, 0), int)
        if n > 4:
            s = np.array([[0, 1], [n - 1, n - 2]])
        parts.append(pii.posteriors(w, f, c, s))
        at = sum(map(len, features))
        features.append(f), chain.append(c + at), skip.append(s + at), rows.append(np.full(n, text))
    got = pii.posteriors(w, *[np.concatenate(features)], np.concatenate(chain, axis=1), np.concatenate(skip, axis=1), np.concatenate(rows))
    assert np.allclose(got, np.concatenate(parts), atol=1e-3)


def test_a_like_token_is_added(spark):
    rng = np.random.default_rng(2)

    def card():
        d = "".join(map(str, rng.integers(0, 10, 15)))
        return next(d + str(k) for k in range(10) if luhn(d + str(k)))

    rows = [(i, f"pay {card()} now or {card()} then {card()} and {card()}") for i in range(60)] + [(100 + i, f"in {1900 + i} we sold {i} of them") for i in range(200)]
    good = card()
    bad = good[:-1] + str((int(good[-1]) + 5) % 10)
    rows += [(1000, f"pay {good} and {card()} then {bad} with {card()} or {card()}"), (1001, None), (1002, ""), (1002, ""), (None, "x@y.zz")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, text string, base string")
    out = pii.find_personal_data(docs)
    assert out.columns == ["doc_id", "text", "base", "added"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    text = dict(rows)[1000]
    assert [text[x["start"] : x["end"]] for x in got[1000]["added"]] == [bad]
    assert not any(r["added"] for i, r in got.items() if i and 100 <= i < 400)
    assert [tuple(x) for x in got[None]["base"]] == [(0, 0, 6)] and got[1001]["base"] == []
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    assert pii.redact("a x@y.zz b", [(0, 2, 8)]) == "a [EMAIL] b"
