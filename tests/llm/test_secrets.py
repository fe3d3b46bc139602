import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wordloom.llm import secrets as se

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def texts():
    rng = random.Random(3)
    alphabet = "ABCabc0123456789+/=-"
    out = [None, "", "plain", "token = secret: abcdefghijklm", 'é "api_key" : "Zx8+/Qw19kLmN0pR7sTu"', "AKIA" * 9, "🙂password=" + "f" * 40,
           "0123456789abcdef" * 3, "id 3f2504e0-4f89-41d3-9a0c-0305e82c3301 ok", "a1" * 9000]
    for _ in range(40):
        out.append(" ".join(rng.choice(["token=", "Secret: ", "AKIA", "é", "\n", ""]) + "".join(rng.choices(alphabet, k=rng.randint(1, 45))) for _ in range(9)))
    out.append(" ".join("deadbeefdeadbeef" for _ in range(700)))  # many matches in one text
    return out


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id bigint, text string, Secrets int")
    got = {r["doc_id"]: [(x["start"], x["k"], x["end"], x["kind"]) for x in r["secrets"]] for r in se.scan_secrets(docs).collect()}
    for i, t in enumerate(texts()):
        assert got[i] == brute(t), t


KEY = "A-Za-z0-9+/_=-"
ALLOW = re.compile(
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"
    r"|[A-Za-z0-9]{0,40}(?i:example|sample|placeholder|dummy|changeme)[A-Za-z0-9]{0,40}"
    rf"|(?i:0123456789|abcdefghij)|([{KEY}])\1{{7,}}|(?<![0-9A-Za-z])sha(?:1|256|384|512)-[A-Za-z0-9+/=]+")


def brute_entropy(t, allow):
    """Every window on its own."""
    out = []
    for run in re.finditer(f"[{KEY}]{{20,}}", t or ""):
        s = run[0]
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
            continue
        gone = [m.span() for m in ALLOW.finditer(s)] if allow else []
        found = []
        for label, chars, bits in (("hex", "0-9a-fA-F", 3.0), ("alnum", "A-Za-z0-9", 3.7), ("base64", KEY, 3.9)):
            spans = []
            edges = [0, *[e for g in gone for e in g], len(s)]
            for lo, hi in zip(edges[::2], edges[1::2]):
                for m in re.finditer(f"[{chars}]{{20,}}", s[lo:hi]):
                    if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                        at = [k for k in range(len(m[0]) - 19) if entropy(m[0][k : k + 20]) >= bits - 1e-9]
                        if at:
                            start = run.start() + lo + m.start()
                            spans.append((start + at[0], start + at[-1] + 20, "entropy_" + label, m[0][at[0] : at[-1] + 20]))
            found += [x for x in spans if not any(y[0] <= x[0] and x[1] <= y[1] for y in found)]
        out += found
    return sorted(out)


def entropy_texts():
    rng = random.Random(11)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = texts()
    out += [f"/sample-app/keys/{pick(b64, 44)}", "b3BlbnNzaC1rZXktdjEA" + "A" * 12 + pick(b64, 60), "sha256-" + pick(b64, 43) + "=",
            "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "x" * 30 + pick("0123456789abcdef", 40) + "zz", pick(b64, 700) + "EXAMPLE" + pick(b64, 900)]
    out += [f"SESSION_KEY={pick('0123456789ABCDEF', 32)}" for _ in range(100)]
    out += [pick(b64 + "_-=", rng.randrange(15, 90)) for _ in range(40)]
    out += [pick("ab01", 40) + pick("ghij23", 40) + "/" + pick("xy", 60) for _ in range(10)]
    return out


def test_entropy_by_windows(spark):
    docs = spark.createDataFrame(list(enumerate(entropy_texts())), "doc_id bigint, text string")
    for allow in ((), se.ALLOW):
        rows = {r["doc_id"]: r["entropy"] for r in se.scan_secrets(docs, allow=allow).collect()}
        for i, t in enumerate(entropy_texts()):
            assert [(x["start"], x["end"], x["kind"], x["text"]) for x in rows[i]] == brute_entropy(t, allow), t


def test_keys_that_a_whole_run_would_hide(spark):
    found = dict(se.scan_secrets(spark.createDataFrame(list(enumerate(entropy_texts())), "doc_id bigint, text string")).select("doc_id", F.size("entropy")).collect())
    n = len(texts())
    assert found[n] and found[n + 1] and not found[n + 2]
    assert all(found[n + 6 + k] for k in range(100))


def test_one_run_of_a_million_characters(spark):
    rng = random.Random(2)
    t = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    rows = se.scan_secrets(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).select("entropy.start", "entropy.end", "entropy.kind").first()
    assert "entropy_base64" in rows["kind"]
    k = rows["kind"].index("entropy_base64")
    windows = lambda at: entropy(t[at : at + 20]) >= 3.9 - 1e-9
    assert windows(rows["start"][k]) and not any(map(windows, range(rows["start"][k])))
    assert windows(rows["end"][k] - 20) and not any(map(windows, range(rows["end"][k] - 19, len(t) - 19)))


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghijkl", "a", "b", 3)], "doc_id bigint, text string, _text string, _base string, _more int")
    row = se.redacted(se.scan_secrets(docs)).first()
    assert (row["_text"], row["_base"], row["_more"], row["text"]) == ("a", "b", 3, "[SECRET]")


def test_allow_list_redaction_and_empty(spark):
    docs = spark.createDataFrame([(1, "id 3f2504e0-4f89-41d3-9a0c-0305e82c3301 token=abcdefghijkl. x"), (2, None)], "doc_id bigint, text string")
    found = se.scan_secrets(docs)
    assert found.where("doc_id = 1").select(F.size("entropy")).first()[0] == 0
    assert sorted(r["text"] or "" for r in se.redacted(found).collect()) == ["", "id 3f2504e0-4f89-41d3-9a0c-0305e82c3301 [SECRET] x"]
    assert se.scan_secrets(docs.limit(0)).count() == 0
