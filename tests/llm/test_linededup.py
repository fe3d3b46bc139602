import duckdb
from pyspark.sql import functions as F

from wordloom.llm import linededup as ld

LINE = "A line of some length"
DOCS = [
    (5, f"{LINE}\nown five text line"), (2, f" \t{LINE.upper()} \r\n{LINE}\nshort\n"), (9, None), (1, ""), (3, "short\nshort\n" + LINE), (7, "\n".join(["tenletters"] * 3)),
    (8, "TENLETTERS\nninechars\nx"), (10, "ninechars"), (11, "élan élan é\nÉLAN ÉLAN É"), (12, "élan élan é"), (13, "Élan élan É"), (14, "\n\n\n"), (15, "x" * 200_000 + "\n" + LINE),
    *[(20 + k, f"common line here\nline number {k} is own") for k in range(120)],
]


def brute(docs):
    key = lambda s: s.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_matches_brute_force_for_any_batches(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id bigint, text string, N_LINES int").repartition(3)
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        out = ld.dedup_lines(docs, batches=batches, fanout=fanout)
        assert sorted(out.columns) == ["doc_id", "n_dropped", "n_lines", "text"]
        assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == brute(DOCS)


def test_oracle_and_repeated_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = ld.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ld._SQL).fetchall())
    twice = docs.where("doc_id in (2, 5)").union(docs.where("doc_id in (2, 5)"))
    assert sorted(r["n_dropped"] for r in ld.dedup_lines(twice).collect()) == [0, 0, 1, 1]
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = ld.LineRuns(spark, fanout=2)
    for k in range(5):
        rows = spark.createDataFrame([(10 * k + j, bytes([j])) for j in range(k + 2)], "doc_id bigint, h binary")
        dropped = {(r["doc_id"], bytes(r["h"])) for r in runs.add(rows).collect()}
        assert dropped == {(10 * k + j, bytes([j])) for j in range(k + 1 if k else 0)}
    assert sum(map(len, runs.levels.values())) == 2  # five batches: one run of four, one of one
    assert sorted(r["h"][0] for run in runs.runs() for r in run.collect()) == list(range(6))
