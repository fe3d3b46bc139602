import random
import re

from wordloom.llm import licenses as lc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return len(w), sorted((k, lb) for p, lb in lc.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


TEXTS = [None, "", "...", "MIT License mit-license/MIT LICENSE", "cc by cc by cc", "Apache\nLicense, GNU General Public License", "emit license mit licenses é mit license é",
         "The GNU General Public\tLicense " * 50, "x " * 20000 + "cc-by"]


def test_base_places():
    for t in TEXTS:
        n, found = lc.scan_text(t, lc.PHRASES, [])
        assert (n, sorted((a, lb) for lb, a, *_ in found)) == brute_base(t), t


def test_notices_with_errors_are_found():
    rng = random.Random(4)
    notices = [lc.Notice(*x) for x in lc.NOTICES]
    for k, notice in enumerate(notices):
        for _ in range(30):
            s = list(notice.raw.decode())
            for _ in range(rng.randint(0, notice.edits)):
                at = rng.randrange(1, len(s) - 1)
                what = rng.randrange(3)
                s[at : at + 1] = [[], ["z"], [s[at], "q"]][what]
            typo = "".join(s)
            # the same words, upper case, other separators
            _, found = lc.scan_text("Some intro. " + typo.upper().replace(" ", ", ") + " (end)", (), [notice])
            assert len(found) == 1 and found[0][0] == lc.NOTICES[k][1], typo
            assert found[0][3] <= distance(" ".join(typo.split()), notice.raw.decode())
    _, clean = lc.scan_text("this work is about the general public and a licence to sing", lc.PHRASES, notices)
    assert clean == []


def test_operator(spark):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1.5)], "doc_id bigint, text string, Places double")
    out = lc.scan_licenses(docs)
    assert sorted(out.columns) == ["doc_id", "n_words", "places", "text"] and out.count() == len(TEXTS) + 1
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_words"], sorted((x["first"], x["label"]) for x in got[i]["places"] if x["base"])) == brute_base(t)
    assert lc.scan_licenses(docs.limit(0)).count() == 0
