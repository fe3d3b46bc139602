"""Secret scans: patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import BLOCK, let, running_sum, set_columns, table
from wordloom.llm.registry import query

# Fixed values of the contract: kind, pattern, group that is measured, its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # shorter runs fail anyway and hide nothing
)

WINDOW = 20
CHUNK = 64  # window starts that one fold goes through
# A candidate is a whole run of key characters, at least a window long, that mixes letters and digits.
_KEY = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_KEY}])(?=[{_KEY}]*?[0-9])(?=[{_KEY}]*?[A-Za-z])[{_KEY}]{{{WINDOW},}}+"
# Character classes, narrow to wide: characters, those that no narrower class has, least
# entropy in bits of a window.
CLASSES = (("hex", "0-9a-fA-F", "", 3.0), ("alnum", "A-Za-z0-9", "g-zG-Z", 3.7), ("base64", _KEY, "+/_=-", 3.9))
# Strings that look random and are no secrets; a window that touches one does not count.
_WORD = "[A-Za-z0-9]{0,40}"
ALLOW = (
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])",  # a UUID
    rf"{_WORD}(?i:example|sample|placeholder|dummy|changeme){_WORD}",
    rf"(?i:0123456789|abcdefghij)|(?<same>[{_KEY}])\k<same>{{7,}}",
    r"(?<![0-9A-Za-z])sha(?:1|256|384|512)-[A-Za-z0-9+/=]+",  # integrity digests are public
)
_SPAN = "array<struct<start:bigint,k:int,end:bigint,kind:string,text:string>>"


def _spans(text: Column, pattern: str, kind: str, k: int, group: int, least: int) -> Column:
    """Spans of a pattern's matches, in code points: the pieces between the matches and
    the matches themselves add up to the positions."""

    def place(m: Column, size: Column, before: Column, gaps: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct(
            (before[i] + gaps[i]).alias("start"), F.lit(k).alias("k"), (before[i] + gaps[i] + F.length(x)).alias("end"),
            F.lit(kind).alias("kind"), x.alias("text"), size[i].alias("size")))

    def found() -> Column:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        all_of = let(matches, lambda m: let(measured, lambda size: let(gaps, lambda g: let(
            running_sum(F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, y: F.length(x) + y)), lambda before: place(m, size, before, g)))))
        long = F.filter(all_of, lambda x: x["size"] >= least)
        return F.transform(long, lambda x: F.struct(
            x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind"), x["text"].alias("text")))

    return F.when(F.regexp_like(text, F.lit(pattern)), found()).otherwise(F.array().cast(_SPAN))


def _weight(count: Column) -> Column:
    """count * log2(count) from a table."""
    values = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)])
    return F.element_at(values, count + 1)


def _count(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def peak_range(s: Column, least: Column) -> Column:
    """struct(first, last): starts of the first and last window whose entropy is at least
    ``least`` bits; -1 if none.

    The sum of count * log2(count) over a window's characters changes by two terms
    when the window moves: those of the leaving and of the entering character.
    """
    chars = F.filter(F.split(F.substring(s, 1, WINDOW), ""), lambda c: c != "")
    opening = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + _weight(_count(F.substring(s, 1, WINDOW), c)))

    def passes(total: Column) -> Column:
        return F.lit(math.log2(WINDOW)) - total / WINDOW >= least

    def move(a: Column, i: Column) -> Column:  # the window that starts at i (from 0)
        shared = F.substring(s, i + 1, F.lit(WINDOW - 1))
        out, into = F.substring(s, i, F.lit(1)), F.substring(s, i + WINDOW, F.lit(1))
        lost, won = _count(shared, out), _count(shared, into)
        total = a["sum"] - _weight(lost + 1) + _weight(lost) + _weight(won + 1) - _weight(won)
        return let(total, lambda t: F.struct(
            t.alias("sum"), F.when((a["first"] < 0) & passes(t), i).otherwise(a["first"]).alias("first"),
            F.when(passes(t), i).otherwise(a["last"]).alias("last")))

    first = let(opening, lambda t: F.struct(t.alias("sum"), F.when(passes(t), 0).otherwise(-1).alias("first"), F.when(passes(t), 0).otherwise(-1).alias("last")))
    steps = F.when(F.length(s) > WINDOW, F.sequence(F.lit(1), F.length(s) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, first, move)


def peak_span(s: Column, least: Column) -> Column:
    """struct(first, last) like ``peak_range`` of a string of any length: it is cut into chunks
    that overlap by a window, so that every step works on a short string."""

    def joined(chunks: Column) -> Column:
        whole = F.transform(chunks, lambda c, i: F.concat(c, F.coalesce(F.substring(F.get(chunks, i + 1), 1, WINDOW - 1), F.lit(""))))
        ranges = F.transform(whole, lambda c, i: F.when(F.length(c) >= WINDOW, let(peak_range(c, least), lambda p: F.when(
            p["first"] >= 0, F.struct((p["first"] + i * CHUNK).alias("first"), (p["last"] + i * CHUNK).alias("last"))))))
        return let(F.filter(ranges, lambda r: r.isNotNull()), lambda r: F.when(F.size(r) > 0, F.struct(
            F.element_at(r, 1)["first"].alias("first"), F.element_at(r, -1)["last"].alias("last"))))

    return let(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), joined)


def _between(s: Column, pattern: str) -> Column:
    """struct(start, text) of what the pattern's matches leave of a string."""

    def placed(parts: Column) -> Column:
        sizes = F.zip_with(parts, F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda x, y: F.length(x) + F.coalesce(F.length(y), F.lit(0)))
        return let(running_sum(sizes), lambda before: F.transform(parts, lambda x, i: F.struct(before[i].alias("start"), x.alias("text"))))

    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), s.alias("text")))
    return F.when(F.regexp_like(s, F.lit(pattern)), let(F.split(s, pattern, -1), placed)).otherwise(whole)


# The steps from runs to spans.  Each is a column of its own: nested into one expression they
# would be more levels than the analyzer resolves.
def _pieces(runs: Column, allow: tuple[str, ...]) -> Column:
    """struct(start, text) of the runs without their allow-listed parts."""
    pattern = "|".join(f"(?:{p})" for p in allow)

    def of(x: Column) -> Column:
        if not allow:
            return F.array(F.struct(x["start"].alias("start"), x["text"].alias("text")))
        return F.transform(_between(x["text"], pattern), lambda p: F.struct((x["start"] + p["start"]).alias("start"), p["text"].alias("text")))

    return F.filter(F.flatten(F.transform(runs, of)), lambda p: F.length(p["text"]) >= WINDOW)


def _class_runs(pieces: Column, number: int) -> Column:
    """Maximal runs of a class that mix letters and digits, with the class' number."""
    label, chars, own, _ = CLASSES[number]
    found = F.flatten(F.transform(pieces, lambda p: F.transform(
        _spans(p["text"], f"[{chars}]{{{WINDOW},}}+", "entropy_" + label, len(BASE), 0, WINDOW),
        lambda r: F.struct((p["start"] + r["start"]).alias("start"), r["k"].alias("k"), r["kind"].alias("kind"), r["text"].alias("text"), F.lit(number).alias("width")))))
    mixed = F.filter(found, lambda r: F.regexp_like(r["text"], F.lit("[0-9]")) & F.regexp_like(r["text"], F.lit("[A-Za-z]")))
    return F.filter(mixed, lambda r: F.regexp_like(r["text"], F.lit(f"[{own}]"))) if own else mixed


def _high(runs: Column) -> Column:
    """Spans from the first to the last window of a run that passes."""
    need = F.array(*[F.lit(bits) for *_, bits in CLASSES])
    peaks = F.transform(runs, lambda r: F.struct(r.alias("r"), peak_span(r["text"], F.element_at(need, r["width"] + 1)).alias("p")))
    return F.transform(F.filter(peaks, lambda y: y["p"].isNotNull()), lambda y: F.struct(
        (y["r"]["start"] + y["p"]["first"]).alias("start"), y["r"]["k"].alias("k"), (y["r"]["start"] + y["p"]["last"] + WINDOW).alias("end"),
        y["r"]["kind"].alias("kind"), F.substring(y["r"]["text"], y["p"]["first"] + 1, y["p"]["last"] - y["p"]["first"] + WINDOW).alias("text"),
        y["r"]["width"].alias("width")))


def _outer(spans: Column) -> Column:
    """Without spans that lie inside one of a narrower class.

    In order of their starts it is enough to know how far the narrower spans before
    reach: block by block, and among the few of the span's own block.
    """
    none = F.lit(-1).cast("bigint")
    narrow = [k for k in range(len(CLASSES) - 1)]

    def furthest(k: int):
        return lambda a, x: F.when(x["width"] == k, F.greatest(a, x["end"])).otherwise(a)

    def reach(block: Column) -> Column:
        return F.struct(*[F.aggregate(block, none, furthest(k)).alias(f"c{k}") for k in narrow])

    def ahead(reaches: Column) -> Column:  # how far the blocks before each one reach
        start = F.struct(F.struct(*[none.alias(f"c{k}") for k in narrow]).alias("upto"), F.filter(reaches, lambda r: F.lit(False)).alias("out"))
        return F.aggregate(reaches, start, lambda a, r: F.struct(
            F.struct(*[F.greatest(a["upto"][f"c{k}"], r[f"c{k}"]).alias(f"c{k}") for k in narrow]).alias("upto"),
            F.concat(a["out"], F.array(a["upto"])).alias("out")))["out"]

    def inside(m: Column, at: Column, block: Column, upto: Column) -> Column:
        far = F.exists(F.array(*[F.struct(F.lit(k).alias("k"), upto[f"c{k}"].alias("end")) for k in narrow]), lambda u: (u["k"] < m["width"]) & (u["end"] >= m["end"]))
        return far | F.exists(F.slice(block, F.lit(1), at), lambda x: (x["width"] < m["width"]) & (x["end"] >= m["end"]))

    def kept(blocks: Column) -> Column:
        return let(ahead(F.transform(blocks, reach)), lambda before: F.flatten(F.transform(blocks, lambda block, i: F.filter(
            block, lambda m, j: ~inside(m, j, block, before[i])))))

    def cut(all_of: Column) -> Column:
        starts = F.when(F.size(all_of) > 0, F.sequence(F.lit(1), F.size(all_of), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda s: F.slice(all_of, s, F.lit(BLOCK))), kept)

    # fields in the order they are compared in: start, then the narrower class
    keyed = F.transform(spans, lambda m: F.struct(*[m[c].alias(c) for c in ("start", "width", "end", "k", "kind", "text")]))
    return let(F.array_sort(keyed), cut)


def _plain(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda m: F.struct(*[m[c].alias(c) for c in ("start", "k", "end", "kind", "text")])))


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Sets ``secrets`` (base spans) and ``entropy`` (high-entropy spans): arrays of
    (start, k, end, kind, text) in order.

    Positions are code points of the whole text; a null text counts as empty and
    has none.  In a run of key characters every maximal run of one class is judged by
    that class' threshold; its span goes from the first window that passes to the last.
    A match of the allow-list cuts a run: windows that touch it do not count, the others
    do.  A span inside one of a narrower class is left out; otherwise entropy spans may
    overlap each other and base spans.  Rows and other columns stay, whatever their names;
    columns named ``secrets`` or ``entropy`` are replaced.  The cost grows with the length
    of a text, also of one that is a single run.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    base = [_spans(text, pattern, kind, k, group, least) for k, (kind, pattern, group, least) in enumerate(BASE)]
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    steps = docs.select(row, F.array_sort(F.concat(*base)).alias("secrets"), _spans(text, CANDIDATE, "entropy", len(BASE), 0, WINDOW).alias("runs"))
    steps = steps.select("row", "secrets", _pieces(F.col("runs"), allow).alias("pieces"))
    steps = steps.select("row", "secrets", let(F.col("pieces"), lambda p: F.concat(*[_class_runs(p, k) for k in range(len(CLASSES))])).alias("runs"))
    steps = steps.select("row", "secrets", _high(F.col("runs")).alias("spans"))
    steps = steps.select("row", "secrets", _outer(F.col("spans")).alias("spans"))
    found = steps.select("row", "secrets", _plain(F.col("spans")).alias("entropy"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("secrets", "entropy")]
    return found.select(*kept, "secrets", "entropy")


def redacted(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``text`` with each secret's characters replaced, overlapping spans as one."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<string>").alias("out"))

    def cut(text: Column) -> Column:
        spans = F.array_sort(F.concat("secrets", "entropy"))
        folded = F.aggregate(spans, start, lambda a, x: F.struct(
            F.greatest(a["end"], x["end"]).alias("end"),
            F.when(x["start"] >= a["end"], F.concat(a["out"], F.array(F.substring(text, (a["end"] + 1).cast("int"), (x["start"] - a["end"]).cast("int")), F.lit(mask)))).otherwise(a["out"]).alias("out")))
        return let(folded, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["end"] + 1).cast("int"), F.length(text))))

    return set_columns(scanned, {"text": F.when(scanned["text"].isNotNull(), cut(scanned["text"]))})


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op2_secret_scan")
def op2_secret_scan(spark, sf):
    found = scan_secrets(table(spark, sf, "documents", "doc_id", "text"))
    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", "secrets", "entropy").select(
        "doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(_joined(F.col("secrets")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("secrets", "entropy"))).alias("spans"))
