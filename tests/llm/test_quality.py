import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wordloom.llm import quality as ql


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    rep = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
    lines = t.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_statistics():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x\nx\n x\n\n\nx", "é🙂 # * $$", "a\x1cb \x85 c"]
    texts += ["".join(rng.choices(["a", "b", " ", "\n", "#", "é"], k=120)) for _ in range(200)]
    for t in texts:
        assert ql.text_stats(t) == brute(t), t
    assert ql.text_stats("ab " * 20_000)[4] == 20_000


def corpus():
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do"]
    rows = []
    for k in range(600):
        rows.append((k, " ".join(rng.choices(words, k=rng.randint(20, 200))), ("en", "de")[k % 2], "big" if k % 3 else f"small{k % 30}", "e"))
    for k in range(600, 630):
        rows.append((k, "&&& ".join(rng.choices(words, k=80)), "en", "big", "e"))
    rows += [(700, None, "en", "big", "e"), (701, "", None, None, "e"), (702, "one two", "en", "big", "e"), (703, " ".join(rng.choices(words, k=50)), None, None, "e")]
    return rows + [rows[0], (None, rows[1][1], "en", "big", "e")]


def test_outliers_go_and_clean_texts_stay(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, KEPT string").repartition(5)
    out = ql.judge(docs).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in out}
    failed = {r["doc_id"] for r in out if r["base_failed"]}
    assert failed == {d for d, t, *_ in rows for n, _, _, _, rep in [brute(t)] if n < 10 or 100 * rep > 20 * n}
    clean = [d for d, *_ in rows if (d is None or d < 600 or d == 703) and d not in failed]
    assert all(kept[d] for d in clean)
    assert not any(kept[d] for d in range(600, 630))
    left = ql.keep(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(r["kept"] for r in out)
    assert ql.judge(docs.limit(0)).count() == 0 == ql.keep(docs.limit(0)).count()
    assert left.where(F.col("doc_id") == 0).count() == 2


def brute_distances(rows):
    """(key, statistics) rows to squared distances: the same estimate on whole arrays."""
    keys = [k for k, _ in rows]
    x = np.zeros((len(rows), 4))
    for at, (_, (n, chars, symbols, dup, repeat)) in enumerate(rows):
        words = max(n, 1)
        x[at] = np.log((chars + 1) / words) * 4, *[np.arcsinh(v / words * 20) for v in (symbols, dup, repeat)]
    fit = np.array([not (n < 10 or 100 * rep > 20 * n) for _, (n, _, _, _, rep) in rows])
    groups = {k: np.array([a == k for a in keys]) & fit for k in set(keys)}
    groups = {k: g for k, g in groups.items() if g.any()}

    def quantile(values, share):
        return np.sort(values)[int(np.ceil(share * len(values))) - 1]

    def estimate(inside):
        picked = np.logical_or.reduce(list(inside.values()))
        m0, c0 = x[picked].mean(0), np.cov(x[picked].T, bias=True)
        out = {}
        for k, g in inside.items():
            w, both = g.sum(), g.sum() + ql.PRIOR
            mean = (x[g].sum(0) + ql.PRIOR * m0) / both
            second = (x[g].T @ x[g] + ql.PRIOR * (c0 + np.outer(m0, m0))) / both
            full = second - np.outer(mean, mean) + ql.FLOOR * np.eye(4)
            out[k] = (np.linalg.slogdet(full)[1], mean, np.linalg.inv(full))
        return out

    def squared(k, est):
        d = x - est[k][1]
        return np.einsum("ni,ij,nj->n", d, est[k][2], d)

    orders, last = [np.zeros(len(rows)) for _ in range(2)], None
    for scaled, d2 in enumerate(orders):
        for k, g in groups.items():
            off = x[g] - [quantile(c, 0.5) for c in x[g].T]
            scale = [quantile(np.abs(c), 0.5) ** 2 + ql.FLOOR for c in off.T] if scaled else 1.0
            d2[g] = (off**2 / scale).sum(1)
    for _ in range(ql.STEPS):
        ends = [estimate({k: g & (d2 <= quantile(d2[g], ql.SUPPORT)) for k, g in groups.items()}) for d2 in orders]
        if last and max(b[k][0] - e[k][0] for b, e in zip(last, ends) for k in e) <= ql.TOLERANCE:
            break
        last = ends
        for est, d2 in zip(ends, orders):
            for k, g in groups.items():
                d2[g] = squared(k, est)[g]
    best = {k: min((e[k] for e in ends), key=lambda t: t[0]) for k in groups}
    return [squared(k, best)[at] if k in best else None for at, k in enumerate(keys)], fit


def test_estimate_and_verdict_match_brute_force(spark):
    rng = random.Random(4)
    words = [a + b for a in ("lo", "rem", "ip", "sum") for b in ("dol", "or", "sit", "amet", "x")]
    rows, labels = [], []
    for k in range(300):
        junk = rng.choice([0, 0, 0, 0, 1, 3]) if k % 7 == 0 else 0
        line = " ".join(rng.choices(words, k=rng.randint(3, 60))) + " #&" * (junk * 10)
        text = "\n".join([line] * rng.choice([1, 1, 1, 2]) + [" ".join(rng.choices(words, k=rng.randint(8, 60)))])
        rows.append((k, text, ("en", "de", None)[k % 3], ("a", "b")[k % 2]))
        if k % 2:
            labels.append((k, 0 if junk else 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (9999, 0)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in ql.judge(docs, labels=marks).collect()}
    want, fit = brute_distances([((lang, source), brute(t)) for _, t, lang, source in rows])
    for (k, *_), d in zip(rows, want):
        assert (got[k]["d2"] is None) == (d is None) and (d is None or abs(got[k]["d2"] - d) < 1e-6 * (1 + d)), k

    # the cutoff: no other threshold costs less on the labelled texts
    quality = dict(labels)
    known = [(want[k], quality[k]) for k in quality if fit[k]]
    cut = min(d for (k, *_), d in zip(rows, want) if fit[k] and not got[k]["kept"])
    assert all(got[k]["kept"] == bool(fit[k] and want[k] < cut) for k, *_ in rows)

    def cost(t):
        return sum(ql.CLEAN if q else 0 for d, q in known if d >= t) + sum(1 for d, q in known if d < t and not q)

    assert cost(cut) == min(cost(d) for d, _ in known + [(np.inf, 1)]) < cost(np.inf)


def test_cutoff(spark):
    d = np.array([1.0, 2, 3, 100, 400, 400, 50])
    good = np.array([True, True, True, True, False, False, False])
    assert ql.best_cutoff(d, good) == 200.0  # one bad text stays, no good one goes
    assert ql.best_cutoff(d, good, clean=0.5) == (3 * 50) ** 0.5
    assert ql.best_cutoff(d, np.ones(7, bool)) is None and ql.best_cutoff(d, ~np.ones(7, bool)) is None
    assert ql.best_cutoff(np.array([1.0, 1.0]), np.array([True, False])) is None
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(d)] + [(None, 3.0), (9, None)], "doc_id bigint, d2 double")
    labels = spark.createDataFrame([(k, int(q)) for k, q in enumerate(good)] + [(0, None), (4, 1)], "doc_id bigint, quality int")
    assert ql.fit_cutoff(rows, labels) == 200.0 == ql.fit_cutoff(rows, labels.unionByName(labels))
    assert ql.fit_cutoff(rows, labels.limit(0)) == ql.fence(rows) > 400
    assert ql.fence(rows.limit(0)) == np.inf


def test_cutoff_of_all_labels(spark):
    """More labels than any bounded sample would hold: the rule on all of them."""
    rng = np.random.default_rng(3)
    d = rng.lognormal(3, 1, 40_000)
    good = d * rng.lognormal(0, 0.5, len(d)) < 60
    table = pa.table({"doc_id": np.arange(len(d)), "d2": d, "quality": good.astype(np.int32)})
    rows = spark.createDataFrame(table)
    assert abs(ql.fit_cutoff(rows.select("doc_id", "d2"), rows.select("doc_id", "quality")) / ql.best_cutoff(d, good) - 1) < 1e-12
