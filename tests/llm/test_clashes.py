"""Columns of the input keep their names and values, also those that operators use inside."""

import pytest

from wordloom.llm import decontam, licenses, linededup, pii, urlfilter

INSIDE = ("dedup_drop", "dedup_id", "dedup_new", "h", "batch", "last", "_found", "_text", "_key", "_h", "_p", "_node", "_host", "rest_", "row", "found_", "tokens_", "n", "window", "w", "Rule", "suffix")
TEXT = "mail a.b@example.org\nthe same line here\nmit license text one two three four five six seven eight nine ten eleven twelve thirteen"


def docs(spark, extra=INSIDE):
    rows = [(k, TEXT, f"http://a.net/{k}", "<p>", *[f"{c}{k}" for c in extra]) for k in range(3)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", "url string", "html string", *[f"`{c}` string" for c in extra]]))


def operators(spark):
    benchmark = spark.createDataFrame([("i", "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id string, text string")
    return {
        "line_dedup": (linededup.dedup_lines, {"n_lines", "n_dropped"}),
        "url_filter": (lambda d: urlfilter.judge_urls(d, urlfilter.rule_table(spark)), {"host", "path", "rule", "verdict"}),
        "personal_data": (pii.find_personal_data, {"base", "added"}),
        "licenses": (licenses.scan_licenses, {"n_words", "places"}),
        "decontaminate": (lambda d: decontam.scan(d, benchmark), {"n_words", "n_hit", "spans", "contaminated"}),
        "decontaminate by join": (lambda d: decontam.scan(d, benchmark, max_windows=0), {"n_words", "n_hit", "spans", "contaminated"}),
    }


@pytest.mark.parametrize("name", ["line_dedup", "url_filter", "personal_data", "licenses", "decontaminate", "decontaminate by join"])
def test_columns_stay(spark, name):
    work, new = operators(spark)[name]
    df = docs(spark)
    out = work(df)
    assert {c.lower() for c in out.columns} == {c.lower() for c in df.columns} | new
    plain = work(docs(spark, ())).select("doc_id", *sorted(new))
    got = {r["doc_id"]: r for r in out.collect()}
    for r in plain.collect():
        assert all(got[r["doc_id"]][c] == r[c] for c in new)
        assert all(got[r["doc_id"]][c] == f"{c}{r['doc_id']}" for c in INSIDE if c.lower() not in new)


def test_items_of_rows_with_and_without_windows(spark):
    benchmark = spark.createDataFrame([("i", "a b c"), ("j", "a b c"), (None, "x y")], "item_id string, text string")
    df = spark.createDataFrame([(1, "z a b c"), (2, "q"), (3, None), (3, None), (None, ""), (4, "x y")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_items"], r["items"]) for r in decontam.items_of(decontam.scan(df, benchmark), benchmark).collect()), key=str)
    assert got == sorted([(1, 2, ["i", "j"]), (2, 0, []), (3, 0, []), (3, 0, []), (None, 0, []), (4, 0, [])], key=str)
