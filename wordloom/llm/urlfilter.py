"""URL filters: host and path rules, carried over to redirect and canonical aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import carried, lower_ascii, set_columns, table, written
from wordloom.llm.graph import components
from wordloom.llm.registry import query

# Fixed values of the contract: verdict and rule (host, then path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up
    to ``?``, ``#`` or the end.  A null url or one without ``://`` has neither (both empty)."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What a url names: host, path and query; scheme and fragment do not count.  Null without a host."""
    host, path = host_and_path(url)
    asked = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, path, F.coalesce(asked, F.lit(""))))


def _absolute(base: Column, link: Column) -> Column:
    """A link as found on the page ``base``."""
    host, path = host_and_path(base)
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_replace(path, "[^/]*$", "")
    return (
        F.when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit("x://"), host, link))
        .when(F.startswith(link, F.lit("#")), base)
        .when(F.startswith(link, F.lit("?")), F.concat(F.lit("x://"), host, path, link))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", "/").otherwise(folder), link)))


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page and of its canonical link or of where it refreshes to."""
    html = F.when(F.regexp_like("html", F.lit("(?i)canonical|refresh")), F.col("html"))
    canonical = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda x: F.regexp_like(x, F.lit(r"""(?i)\brel\s*=\s*["']?canonical\b""")))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda x: F.regexp_like(x, F.lit(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")))
    targets = F.concat(
        F.transform(canonical, lambda x: F.regexp_extract(x, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda x: F.regexp_extract(x, r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)))
    found = pages.select("url", F.explode(targets).alias("link")).where("link <> ''")
    return found.select(node_of(F.col("url")).alias("a"), node_of(_absolute(F.col("url"), F.col("link"))).alias("b"))


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for distinct (host, path) that a rule fits: the longest rule,
    an allow before a block of the same length, then the first by name.

    Each suffix of the host at a dot is looked up, so the cost does not grow with the number of rules.
    """
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = rules.select(
        F.regexp_extract("rule", "^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("start"), "rule", "action",
        (F.length("rule") * 2 + (F.col("action") == "allow").cast("int")).alias("weight"))
    each = urls.where("host <> ''").select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    fits = each.join(keyed, "suffix").where(F.startswith("path", "start"))
    best = fits.groupBy("host", "path").agg(F.array_min(F.collect_list(F.struct((-F.col("weight")).alias("w"), "rule", "action"))).alias("best"))
    return best.select("host", "path", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Sets host, path, rule and verdict on every row of ``pages`` (url, html).

    ``rules``: (action allow or block, rule).  A page under a rule gets the rule's
    verdict.  Another page is blocked if a page or link target that it is an
    alias of, over any chain of canonical links, refreshes and rows of
    ``redirects`` (src, dst), is under a block rule; an explicit allow of the
    page itself comes first.  All others are allowed.  Urls are one node if they
    differ in scheme or fragment only; pages without a host are allowed.  Other columns may have any name.
    """
    return carried(pages, ("url", "html"), ("host", "path", "rule", "verdict"), lambda rows: _judge(rows, rules, redirects))


def _judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None) -> DataFrame:
    host, path = host_and_path(pages["url"])
    links = alias_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    classes = written(components(links, "a", "b"), "url-classes")
    node_host, node_path = host_and_path(F.concat(F.lit("x://"), F.col("node")))
    nodes = classes.select("node", "root", node_host.alias("host"), node_path.alias("path"))
    known = written(decide(pages.select(host.alias("host"), path.alias("path")).unionByName(nodes.select("host", "path")), rules), "url-rules")
    bad = nodes.join(known.where("action = 'block'").select("host", "path"), ["host", "path"]).select("root").distinct()
    bad = written(bad, "url-blocked")
    blocked = classes.join(bad, "root").select(F.col("node").alias("_node"), F.lit("block").alias("_alias"))
    named = known.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("rule").alias("_rule"), F.col("action").alias("_action"))
    out = pages.withColumn("_host", host).withColumn("_path", path).withColumn("_key", node_of(pages["url"]))
    # no broadcast: both tables grow with the pages, and compress so well that their files look small
    named, blocked = named.hint("merge"), blocked.hint("merge")
    out = out.join(named, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left").join(blocked, F.col("_key") == F.col("_node"), "left")
    verdict = F.coalesce("_action", "_alias", F.lit("allow"))
    return set_columns(out, {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": verdict}).drop(
        "_host", "_path", "_key", "_h", "_p", "_rule", "_action", "_node", "_alias")


def rule_table(spark, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule string")


def _host_path_sql(url: str) -> str:
    rest = f"coalesce(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END, '')"
    low = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"{low} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


_NODE = r"CASE WHEN host <> '' THEN host || path || coalesce(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '') END AS node"
_SQL = rf"""
WITH RECURSIVE rules(action, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
p AS (SELECT *, {_NODE} FROM (SELECT page_id, url, html, {_host_path_sql('url')} FROM pages)),
links AS (
  SELECT host, path, node, url, regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link
  FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS t FROM p) WHERE regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')
  UNION ALL
  SELECT host, path, node, url, regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) AS link
  FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) AS t FROM p) WHERE regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
targets AS (SELECT node AS a, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN l LIKE '//%' THEN 'x:' || l
    WHEN l LIKE '/%' THEN 'x://' || host || l WHEN l LIKE '#%' THEN url WHEN l LIKE '?%' THEN 'x://' || host || path || l
    ELSE 'x://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || l END AS url
  FROM (SELECT *, replace(link, '&amp;', '&') AS l FROM links WHERE link <> '')),
e AS (SELECT a, node AS b FROM (SELECT a, url, {_NODE} FROM (SELECT a, url, {_host_path_sql('url')} FROM targets))),
both_ways AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
nodes AS (SELECT DISTINCT node, {_host_path_sql("'x://' || node")} FROM (SELECT a AS node FROM both_ways)),
fit AS (SELECT host, path, rule, action, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, action, rule) AS k
  FROM (SELECT DISTINCT host, path FROM p UNION SELECT host, path FROM nodes) JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
bad AS (SELECT DISTINCT reach.a AS node FROM reach JOIN nodes ON reach.b = nodes.node JOIN fit USING (host, path) WHERE k = 1 AND action = 'block')
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path AND k = 1 LEFT JOIN bad ON p.node = bad.node
"""


@query("op4_url_filter", _SQL)
def op4_url_filter(spark, sf):
    out = judge_urls(table(spark, sf, "pages", "page_id", "url", "html"), rule_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")
