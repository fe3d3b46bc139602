"""Benchmark decontamination: windows of test words looked up in training texts.

The benchmark's windows are bounded by its size and checked: up to ``MAX_WINDOWS``
they travel with the plan as hash sets and each document is judged in its own
row, without a shuffle.  A larger benchmark is joined by window hash instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import carried, let, lower_ascii, set_columns, table, written
from wordloom.llm.registry import query

N = 13
MAX_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words (letters of either case, digits, non-ASCII)
SPANS = "array<struct<s:int,e:int,window:string>>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def _hashes(w: Column) -> Column:
    """Equal words that differ in the case of A-Z have equal hashes."""
    return F.transform(w, lambda x: F.xxhash64(F.lower(x)))


def _probe(h: Column, i: Column, n: int) -> Column:
    """Hash of a window's first, middle and last word: all that most windows need."""
    return F.xxhash64(h[i], h[i + n // 2], h[i + (n - 1)])


def _window(w: Column, i: Column, n: int) -> Column:
    return lower_ascii(F.array_join(F.slice(w, i + 1, n), " "))


def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item_id, n, window, probe): the windows of ``n`` words of each item; a shorter
    item with words is one window.  Null or wordless texts have none."""
    cut = benchmark.select("item_id", words(benchmark["text"]).alias("w")).where("size(w) > 0")
    sizes = F.least(F.size("w"), F.lit(n))
    each = cut.select("item_id", "w", sizes.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - sizes)).alias("i"))
    at = each.withColumn("part", F.slice("w", F.col("i") + 1, F.col("n"))).select(
        "item_id", "n", lower_ascii(F.array_join("part", " ")).alias("window"), _hashes(F.col("part")).alias("h"))
    probe = F.xxhash64(F.col("h")[0], F.col("h")[(F.col("n") / 2).cast("int")], F.col("h")[F.col("n") - 1])
    return at.select("item_id", "n", "window", probe.alias("probe"))


def _found_in_row(text: Column, known: dict[int, tuple[list[int], list[str]]]) -> Column:
    """struct(n_words, spans, n_hit): verified windows, as word ranges, from hash sets."""

    def scan(w: Column, h: Column) -> Column:
        return F.concat(F.array().cast(SPANS), *[of_length(w, h, n, *sets) for n, sets in sorted(known.items())])

    def of_length(w: Column, h: Column, n: int, probes: list[int], texts: list[str]) -> Column:
        maybe = F.filter(_starts(w, n), lambda i: _probe(h, i, n).isin(probes))
        cut = F.transform(maybe, lambda i: F.struct(i.alias("s"), (i + n).alias("e"), _window(w, i, n).alias("window")))
        return F.filter(cut, lambda x: x["window"].isin(texts))

    def judged(w: Column) -> Column:
        return let(let(_hashes(w), lambda h: scan(w, h)), lambda spans: _result(F.size(w), spans))

    return let(words(text), judged)


def _result(n_words: Column, spans: Column) -> Column:
    return F.struct(n_words.cast("bigint").alias("n_words"), spans.alias("spans"), _covered(spans).alias("n_hit"))


def _found_by_join(docs: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark of any size: window hashes of each text joined with the
    benchmark's, two independent 64-bit hashes for the whole window."""

    def keyed(w: Column, i: Column, n: Column) -> Column:
        part = F.slice(w, i + 1, n)
        joined = lower_ascii(F.array_join(part, " "))
        return F.struct(F.xxhash64(joined).alias("k1"), F.xxhash64(F.lit(1), joined).alias("k2"))

    tid = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    cut = docs.select(tid.alias("_tid"), words(docs["text"]).alias("w"))

    def of_length(w: Column, n: int) -> Column:
        return F.transform(_starts(w, n), lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), keyed(w, i, F.lit(n)).alias("k")))

    each = let(F.col("w"), lambda w: F.concat(*[of_length(w, n) for n in lengths]))
    hits = cut.select("_tid", F.explode(each).alias("x")).select("_tid", "x.n", "x.i", "x.k.k1", "x.k.k2")
    known = wins.select("n", "window").distinct().select("n", "window", F.xxhash64("window").alias("k1"), F.xxhash64(F.lit(1), "window").alias("k2"))
    spans = hits.join(known, ["n", "k1", "k2"]).select("_tid", F.struct(F.col("i").alias("s"), (F.col("i") + F.col("n")).alias("e"), "window").alias("x"))
    lists = written(spans.groupBy("_tid").agg(F.collect_set("x").cast(SPANS).alias("_spans")), "decontam-hits")
    joined = docs.withColumn("_key", tid).join(lists, F.col("_key") == F.col("_tid"), "left")
    found = _result(F.size(words(docs["text"])), F.coalesce("_spans", F.array().cast(SPANS)))
    return joined.withColumn("_found", F.explode(F.array(found))).drop("_key", "_tid", "_spans")


def _covered(spans: Column) -> Column:
    """Words inside any span: spans by start, each adds what lies beyond the last end."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("sum"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("sum")),
        lambda a: a["sum"])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Sets n_words, n_hit, spans (word ranges and their windows) and contaminated.

    Every row of ``docs`` stays a row, with its other columns.  Null, empty and
    wordless texts have no words and are never contaminated; an empty benchmark
    contaminates nothing; equal windows of several items count once.  Other columns may have any name.
    """
    return carried(docs, ("text",), ("n_words", "n_hit", "spans", "contaminated"), lambda rows: _scan(rows, benchmark, n, max_windows))


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int) -> DataFrame:
    wins = windows(benchmark, n)
    some = wins.select("n", "window", "probe").distinct().limit(max_windows + 1).collect()  # bounded
    if len(some) <= max_windows:
        known: dict[int, tuple[list[int], list[str]]] = {}
        for r in some:
            probes, texts = known.setdefault(r["n"], ([], []))
            probes.append(r["probe"])
            texts.append(r["window"])
        # a generator: no later filter or column makes Spark compute the scan twice
        found = docs.withColumn("_found", F.explode(F.array(_found_in_row(docs["text"], known))))
    else:
        found = _found_by_join(docs, wins, list(range(1, n + 1)))
    n_hit = F.col("_found.n_hit")
    bad = (n_hit > 0) & (20 * n_hit >= F.col("_found.n_words"))
    return set_columns(found, {"n_words": F.col("_found.n_words"), "n_hit": n_hit, "spans": F.col("_found.spans"), "contaminated": bad}).drop("_found")


def items_of(scanned: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) from ``scan``: the items whose
    windows occur, as sorted strings.  Equal rows are taken together and given back as often."""
    keys = ["doc_id", "n_words", "n_hit", "contaminated", "wins"]
    rows = scanned.select("doc_id", "n_words", "n_hit", "contaminated", F.array_distinct(F.col("spans.window")).alias("wins"))
    once = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    items = windows(benchmark, n).where("item_id is not null").select("item_id", "window").distinct()
    # rows without a window get a key of their own that no window has: null keys would meet in one task
    own = F.concat(F.lit("\n"), F.xxhash64("doc_id", "n_words", "copies").cast("string"))
    each = once.withColumn("window", F.explode(F.when(F.size("wins") > 0, F.col("wins")).otherwise(F.array(own))))
    named = each.join(items, "window", "left").groupBy(*keys, "copies").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return named.withColumn("n_items", F.size("items").cast("bigint")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("_", "copies", "wins")


def without_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without contaminated rows; columns as they were."""
    found = scan(docs.select(F.struct("*").alias("row"), docs["text"].alias("text")), benchmark, n)
    return found.where("not contaminated").select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the words inside benchmark windows cut out of ``text``, together with
    what stands before each; texts without a hit stay as they are."""
    found = scan(docs.select(F.struct("*").alias("row"), docs["text"].alias("text")), benchmark, n)
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"
    kept = let(F.col("spans"), lambda spans: F.filter(
        F.regexp_extract_all("text", F.lit(piece), 0), lambda p, i: ~F.exists(spans, lambda x: (x["s"] <= i) & (i < x["e"]))))
    text = F.when(F.col("n_hit") > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    return set_columns(found.withColumn("_text", text).select("row.*", "_text"), {"text": F.col("_text")}).drop("_text").select(*docs.columns)


_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, greatest(0, len(w) - n + 1))) AS i FROM d CROSS JOIN lens)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op9_decontaminate", _SQL)
def op9_decontaminate(spark, sf):
    benchmark = table(spark, sf, "benchmark", "item_id", "text")
    scanned = scan(table(spark, sf, "documents", "doc_id", "text"), benchmark)
    out = items_of(scanned, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
