import duckdb
from pyspark.sql import functions as F

from wordloom.llm import graph, urlfilter as uf


def canonical(href):
    return f"<head><LINK rel='canonical' href=\"{href}\"></head>"


PAGES = [
    (1, "http://a.net/x", ""), (2, "https://b.com/1", canonical("http://a.net/x#top")), (3, "https://c.com/2", canonical("//b.com/1")),
    (4, "http://d.org/fr/3", canonical("https://c.com/2")), (5, "http://e.org/3", '<meta http-equiv="refresh" content="0; url=http://d.org/fr/3">'),
    (6, "http://www.EXAMPLE.net/en/1?x#y", ""), (7, "http://example.net/EN/1", ""), (8, "http://xexample.com/de/", ""), (9, "ftp://a.example.com/de/?q", ""),
    (10, None, None), (11, "no scheme", canonical("/x")), (12, "x://net", ""), (13, "x://net/", canonical("?page=1")), (14, "http://f.org/a/b?q=1", canonical("c")),
    (15, "http://f.org/a/c", canonical("http://net/?a=1&amp;b=2")), (16, "http://f.org/a/c#z", ""), (17, "http://g.org/", ""), (17, "http://g.org/", ""),
    (18, "http://net.net/a\n/b", ""), (19, "", ""), (None, "http://h.org:80/fr/", ""),
]
WANT = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "block", 8: "allow", 9: "block", 10: "allow", 11: "allow", 12: "allow",
        13: "block", 14: "block", 15: "block", 16: "block", 17: "allow", 18: "block", 19: "allow", None: "allow"}


def test_rules_aliases_and_oracle(spark):
    pages = spark.createDataFrame([(*p, "kept") for p in PAGES], "page_id bigint, url string, html string, Host string")
    out = uf.judge_urls(pages, uf.rule_table(spark))
    assert sorted(out.columns) == ["host", "html", "page_id", "path", "rule", "url", "verdict"]
    rows = out.select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(rows) == len(PAGES) and {r["page_id"]: r["verdict"] for r in rows} == WANT
    pages.toPandas()
    frame = pages.toPandas()
    con = duckdb.connect()
    con.register("pages", frame)
    want = con.execute(uf._SQL).fetchall()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(want, key=repr)


def test_redirects_and_empty(spark):
    pages = spark.createDataFrame(PAGES[:1] + PAGES[-5:], "page_id bigint, url string, html string")
    moved = spark.createDataFrame([("http://g.org/", "http://t.co/1"), ("http://t.co/1", "https://a.net/x"), (None, "http://t.co/1")], "src string, dst string")
    got = uf.judge_urls(pages, uf.rule_table(spark), moved).where("page_id = 17").select("verdict").distinct().collect()
    assert [r[0] for r in got] == ["block"]
    assert uf.judge_urls(pages.limit(0), uf.rule_table(spark)).count() == 0
    assert uf.judge_urls(pages, uf.rule_table(spark).limit(0)).where("verdict <> 'allow'").count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame(path + star + [(5, 5), (None, 3), (7, 6)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)}
    assert graph.components(edges.limit(0)).count() == 0
    assert graph.components(edges).agg(F.countDistinct("node"), F.count("*")).first()[0] == 501
