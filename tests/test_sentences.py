import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators import sentences as se


def corpus():
    rng = random.Random(6)
    nouns = "river mountain teacher window garden letter doctor captain story market bridge winter summer paper silver".split()
    verbs = "sees finds opens follows leaves paints crosses".split()
    out = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            subject = rng.choice(["The", "A", "This"]) + " " + rng.choice(nouns)
            tail = rng.choice(nouns)
            kind = rng.randrange(6)
            if kind == 0:
                parts.append(f"{rng.choice(['Dr.', 'Prof.', 'Mr.'])} {rng.choice(['Miller', 'Stone', 'Weber'])} {rng.choice(verbs)} the {tail}.")
            elif kind == 1:
                parts.append(f"{subject} {rng.choice(verbs)} it, e.g. the {tail}.")
            elif kind == 2:
                parts.append(f"{subject} {rng.choice(verbs)} the {tail} of J. Weber{rng.choice('.!?')}")
            else:
                parts.append(f"{subject} {rng.choice(verbs)} the {tail}{rng.choice('...!?')}")
        out.append(parts)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, " ".join(p)) for k, p in enumerate(corpus())] + [(1000, None), (1001, ""), (1002, " \n ")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def tokens(text):
    out = [re.sub(r"^[^\w.]+|[^\w.]+$", "", w) for w in (text or "").split()]
    return [w for w in out if w]


def test_counts_and_scores_equal_brute_force(texts):
    words = [w for p in corpus() for w in tokens(" ".join(p))]
    n, dots = Counter(), Counter()
    for w in words:
        n[w.rstrip(".").lower()] += 1
        dots[w.rstrip(".").lower()] += w.endswith(".")
    share = sum(dots.values()) / len(words)
    got = {r["type"]: r for r in se.boundary_types(se.token_rows(texts)).collect()}
    assert {t: (r["n"], r["n_period"]) for t, r in got.items()} == {t: (n[t], dots[t]) for t in n}
    for t in n:
        if dots[t]:
            a, b, size = dots[t], n[t] - dots[t], len(t.replace(".", ""))
            ll = 2 * (a * math.log(0.99) + b * math.log(0.01) - a * math.log(share) - b * math.log(1 - share))
            want = ll * math.exp(-size) * (len(t) - size + 1) * size ** -b
            assert math.isclose(got[t]["score"], want, rel_tol=1e-9, abs_tol=1e-12)


def test_planted_abbreviations_are_found_and_not_cut(spark, texts):
    model = se.learn_boundaries(texts)
    assert {"dr", "prof", "mr", "e.g"} <= model.abbreviations
    assert not model.abbreviations & {"river", "garden", "paper", "the"}
    assert {"the", "this"} & model.starters
    rows = se.trained_sentences(texts, model).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["part_no"])):
        got.setdefault(r["doc_id"], []).append(r["part"])
    assert got == dict(enumerate(corpus()))


def test_a_boundary_may_follow_an_abbreviation(spark, texts):
    model = se.learn_boundaries(texts)
    cut = lambda t: se.cut_sentences(t, model)
    assert cut("He met the Dr. The river rose.") == ["He met the Dr.", "The river rose."]
    assert cut("Dr. Miller came. “Go!” he said... and left 3.5 m behind") == ["Dr. Miller came.", "“Go!”", "he said... and left 3.5 m behind"]
    assert cut("") == [] and cut("no end") == ["no end"]
    assert len(cut("word. " * 50_000)) == 50_000


def test_bounded_sets_and_empty_table(spark, texts):
    assert len(se.learn_boundaries(texts, most=2).abbreviations) == 2
    empty = se.learn_boundaries(texts.limit(0))
    assert not empty.abbreviations and not empty.starters
    assert [r["part"] for r in se.trained_sentences(texts.where("doc_id > 999"), empty).collect()] == []
    df = spark.createDataFrame([("One. Two",)], "text string").withColumn("part_x", F.lit(1))
    assert [r["part"] for r in se.trained_sentences(df, empty).orderBy("part_no").collect()] == ["One.", "Two"]


def test_learned_sets_are_whole(spark):
    """Of more than 100,000 starters-to-be the weakest still cuts."""
    letters = "abcdefghij"
    filler = F.concat(F.lit("y"), F.translate(F.col("id").cast("string"), "0123456789", letters))
    many = spark.range(100_010).select((F.col("id") % 40).alias("g"), filler.alias("w")).groupBy("g").agg(F.concat_ws(" ", F.collect_list("w")).alias("w"))
    many = many.select("g", F.concat_ws(" ", "w", "w").alias("text"))
    extra = "He met the Dr. Miller there! " * 30 + "She saw zz there! He met the Dr. Zz came!"
    df = many.select("text").union(spark.createDataFrame([(extra,)], "text string"))
    model = se.learn_boundaries(df)
    assert "dr" in model.abbreviations and "zz" not in model.starters
    rows = se.trained_sentences(df.where("text LIKE 'He met%'"), model).collect()
    assert [r["part"] for r in sorted(rows, key=lambda r: r["part_no"])][-2:] == ["He met the Dr.", "Zz came!"]
    assert model.lower.count() > 100_010 and model.lower.where("next = 'zz'").count() == 1


@pytest.mark.parametrize("tables", [se.SETS, ("lower",), ("starters", "lower"), ("collocations",), ("abbreviations",)])
@pytest.mark.parametrize("most", [0, 100_000])
def test_sets_as_tables_cut_alike(spark, texts, monkeypatch, tables, most):
    """What texts look up in a table is joined (0) or sent whole."""
    extra = [(2000 + k, t) for k, t in enumerate(["He met the Dr. The river rose.", "He met the Dr. Miller. So it was, e.g. This one.", "In 3. The", "Dr. Xx", "mr. the"] * 3)]
    df = texts.union(texts.where("doc_id < 9")).union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    model = se.learn_boundaries(texts)
    model = se.replace(model, collocations=model.collocations | {("mr", "miller"), (se.NUMBER, "the")}, lower=model.lower | {"miller", "this"})
    schemas = {k: "type string, next string" if k == "collocations" else "type string" for k in tables}
    kept = {k: spark.createDataFrame([e if k == "collocations" else (e,) for e in getattr(model, k)], s) for k, s in schemas.items()}
    want = [(d, n, p) for d, t in df.collect() if t is not None for n, p in enumerate(se.cut_sentences(t, model))]
    monkeypatch.setattr(se, "HELD", most)
    got = se.trained_sentences(df, se.replace(model, **kept))
    assert got.columns == ["doc_id", "part_no", "part"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_large_sets_stay_tables(texts, monkeypatch):
    whole = se.learn_boundaries(texts)
    monkeypatch.setattr(se, "HELD", len(whole.abbreviations))
    few = se.learn_boundaries(texts)
    assert few.abbreviations == whole.abbreviations and {r[0] for r in few.lower.collect()} == whole.lower
    monkeypatch.setattr(se, "HELD_BYTES", 5)
    assert {r[0] for r in se.learn_boundaries(texts).abbreviations.collect()} == whole.abbreviations


def test_lookups_hold_all_that_cutting_needs():
    model = se.Boundaries(frozenset({"dr", "e.g"}), frozenset({("j", "weber"), ("dr", "the")}), frozenset({"the"}), frozenset({"so"}))
    rng = random.Random(9)
    tokens = ["Dr.", "e.g.", "J.", "Weber", "the", "The", "So", "end.", "...", "Dr...", "3.", "what?!", "so"]
    for _ in range(2000):
        text = " ".join(rng.choice(tokens) for _ in range(rng.randrange(0, 9)))
        gone = [k for k in se.SETS if rng.random() < 0.5]
        asked = se.lookups(text, se.replace(model, **dict.fromkeys(gone)))
        found = {k: frozenset((a, b) if k == "collocations" else a for i, a, b in asked if se.SETS[i] == k) & getattr(model, k) for k in gone}
        assert se.cut_sentences(text, se.replace(model, **found)) == se.cut_sentences(text, model), text
        assert {se.SETS[i] for i, _, _ in asked} <= set(gone)


def every_token(text, model):
    """The sentences, with a look at every token."""
    spots = list(re.finditer(r"\S+", text))
    bare = [re.sub(r"^[^\w.]+|[^\w.]+$|_", "", m.group()) for m in spots]

    def word(token: str) -> str:
        low = token.rstrip(".").lower()
        return se.NUMBER if re.fullmatch(r"[0-9][0-9.,]*", low) else low

    out, start = [], None
    for k, m in enumerate(spots):
        start = m.start() if start is None else start
        raw, token = m.group().rstrip("\"'”’»)]}"), bare[k]
        after = bare[k + 1] if k + 1 < len(spots) else ""
        if raw.endswith(("!", "?")):
            stop = True
        elif not raw.endswith("."):
            stop = False
        elif k + 1 == len(spots):
            stop = True
        elif (word(token), word(after)) in model.collocations:
            stop = False
        elif raw.endswith("..."):
            stop = after[:1].isupper()
        else:
            small = after[:1].islower()
            initial = len(word(token)) == 1 and word(token).isalpha()
            if word(token) in model.abbreviations or initial:
                stop = not initial and after[:1].isupper() and (word(after) in model.starters or word(after) in model.lower)
            elif word(token) == se.NUMBER:
                stop = not small
            else:
                stop = True
        if stop:
            out.append(text[start: m.end()])
            start = None
    if start is not None:
        out.append(text[start: spots[-1].end()])
    return out


def test_only_tokens_with_a_mark_are_looked_at(monkeypatch):
    model = se.Boundaries(frozenset({"dr", "e.g"}), frozenset({("j", "weber")}), frozenset({"the"}), frozenset({"so"}))
    rng = random.Random(8)
    tokens = ["Dr.", "e.g.", "J.", "Weber", "the", "The", "So", "end.", 'end."', "(x.)", "...", "well...", "3.", "4.5", "what?!", ".", "!", "a_b.", "so", "»oh!«", "'t.", ".x", "x.]}"]
    for _ in range(3000):
        text = "".join(rng.choice(tokens) + rng.choice([" ", " ", "\n", "\u00a0", "\x1c "]) for _ in range(rng.randrange(0, 9)))
        text = rng.choice(["", " ", "\t"]) + (text if rng.random() < 0.5 else text.rstrip())
        assert se.cut_sentences(text, model) == every_token(text, model), text
    looked = []

    class Bare:
        def sub(self, new, token):
            looked.append(token)
            return token

    monkeypatch.setattr(se, "_BARE", Bare())
    assert se.cut_sentences("word " * 5000 + "end. Then " + "word " * 5000, model) == ["word " * 5000 + "end.", ("Then " + "word " * 5000).rstrip()]
    assert looked == ["end.", "Then"]
