"""Sentence boundaries learned from the texts themselves.

No list of abbreviations is given.  Words that nearly always carry a period, are short
and have periods inside are abbreviations; words that follow clear sentence ends more
often than chance are starters; pairs that a period does not part are collocations.
All three come from counts by likelihood ratios.  The learned sets are whole: one that is
too large to be sent to every worker stays a table, and what cutting looks up in it is joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.operators.curate import explode_parts
from wordloom.operators.joins import lookup_join
from wordloom.session import checkpointed

# Thresholds of the published method
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
ALMOST_ALWAYS = 0.99
HELD, HELD_BYTES = 100_000, 4_000_000  # a learned set up to this size is sent whole to the Python workers
NUMBER = "##"
_TRIM = r"^[^\p{L}\p{N}.]+|[^\p{L}\p{N}.]+$"
CLOSERS = "\"'”’»)]}"
_BARE, _NUMBER, _TOKEN = re.compile(r"^[^\w.]+|[^\w.]+$|_"), re.compile(r"[0-9][0-9.,]*"), re.compile(r"\S+")
_MARKED = re.compile(rf"(?<!\S)\S*[.!?][{re.escape(CLOSERS)}]*(?!\S)")
_CLOSE = r"[.!?:][^\p{L}\p{N}]*$"


@dataclass(frozen=True)
class Boundaries:
    """The learned sets; one beyond HELD or HELD_BYTES is a table of its entries."""

    abbreviations: frozenset[str] | DataFrame
    collocations: frozenset[tuple[str, str]] | DataFrame
    starters: frozenset[str] | DataFrame
    lower: frozenset[str] | DataFrame  # starters-to-be: words after abbreviations that are written small elsewhere, never large inside a sentence


def token_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """token, closes (a mark that may end a sentence is last), after (the next token or NULL):
    white-space separated, without quotes and brackets around them.  Every occurrence is a
    row; NULL texts have none."""
    words = F.filter(F.transform(F.split(F.col(text), r"\s+"), lambda w: F.struct(
        F.regexp_replace(w, _TRIM, "").alias("token"), F.regexp_like(w, F.lit(_CLOSE)).alias("closes"))), lambda w: w["token"] != "")
    cut = df.select(F.coalesce(words, F.filter(F.array(F.struct(F.lit("").alias("token"), F.lit(False).alias("closes"))), lambda w: F.lit(False))).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a["token"].alias("token"), a["closes"].alias("closes"), b["token"].alias("after")))
    return cut.select(F.explode(pairs).alias("p")).select("p.*")


def word_type(token: Column) -> Column:
    """The word without its last period, in lower case; numbers are one word."""
    bare = F.lower(F.regexp_replace(token, r"\.+$", ""))
    return F.when(F.regexp_like(bare, F.lit(r"^[0-9][0-9.,]*$")), F.lit(NUMBER)).otherwise(bare)


def _period(token: Column) -> Column:
    return F.endswith(token, F.lit("."))


def boundary_types(tokens: DataFrame) -> DataFrame:
    """type, n (occurrences), n_period (those with a period), score: how surely it is an abbreviation.

    The score is twice the log-likelihood ratio of "almost always with a period" against
    "as often as any word", less for long words and for each occurrence without one.
    """
    rows = tokens.select(word_type(F.col("token")).alias("type"), _period(F.col("token")).alias("dot"))
    counts = checkpointed(rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("dot").alias("n_period")))
    total = counts.agg(F.sum("n").alias("all"), F.sum("n_period").alias("dots")).first()
    share = min(max((total["dots"] or 0) / max(total["all"] or 0, 1), 1e-9), 1 - 1e-9)
    a, b = F.col("n_period"), F.col("n") - F.col("n_period")

    def log_likelihood(p: float) -> Column:
        return a * F.log(F.lit(p)) + b * F.log(F.lit(1 - p))

    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters + 1
    ratio = (log_likelihood(ALMOST_ALWAYS) - log_likelihood(share)) * 2
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -b)
    fits = (a > 0) & (letters > 0) & F.regexp_like("type", F.lit(r"\p{L}"))
    return counts.select("type", "n", "n_period", F.when(fits, score).otherwise(0.0).alias("score"))


def _ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Twice the log-likelihood ratio that ``second`` depends on ``first``."""

    def part(k: Column, n: Column, p: Column) -> Column:
        safe = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(safe) + (n - k) * F.log(1 - safe)

    rest = F.greatest(total - first, F.lit(1))
    p, inside, outside = second / total, both / first, (second - both) / rest
    return 2 * (part(both, first, inside) + part(second - both, rest, outside) - part(both, first, p) - part(second - both, rest, p))


def _entries(df: DataFrame, most: int | None, *columns: str) -> frozenset | DataFrame:
    """All entries, or the ``most`` strongest: a set if HELD and HELD_BYTES allow, else a table."""
    if most is not None:
        df = df.orderBy(F.col("score").desc(), *columns).limit(most)
    table = checkpointed(df.select(*columns))
    if not _fits(table, *columns):
        return table
    return frozenset(r[0] if len(columns) == 1 else tuple(r) for r in table.collect())


def _fits(table: DataFrame, *columns: str) -> bool:
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.octet_length(c) for c in columns), F.lit(0))).alias("bytes")).first()
    return size["n"] <= HELD and (size["bytes"] or 0) <= HELD_BYTES


def learn_boundaries(df: DataFrame, text: str = "text", most: int | None = None) -> Boundaries:
    """Learn from all texts: one count of words, one of the pairs around periods.  With ``most``
    only that many entries of each set are kept, the strongest first."""
    tokens = token_rows(df, text)
    types = checkpointed(boundary_types(tokens))
    total = F.lit(types.agg(F.sum("n")).first()[0] or 1).cast("double")
    abbreviations = _entries(types.where(F.col("score") >= ABBREVIATION), most, "type")
    pairs = tokens.where(_period(F.col("token")) & F.col("after").isNotNull())
    large = F.regexp_like("after", F.lit(r"^\p{Lu}"))
    pairs = pairs.select(word_type(F.col("token")).alias("type"), word_type(F.col("after")).alias("next"), large.alias("large"))
    pairs = checkpointed(pairs.groupBy("type", "next").agg(F.count(F.lit(1)).alias("both"), F.count_if("large").alias("large")))
    known = types.select("type", "n", "n_period", (F.col("score") >= ABBREVIATION).alias("abbreviation"))
    named = pairs.join(known, "type").join(types.select(F.col("type").alias("next"), F.col("n").alias("n_next")), "next")
    weak = F.col("abbreviation") | (F.length("type") == 1) | (F.col("type") == NUMBER)
    tied = named.where(weak).withColumn("score", _ratio(F.col("both"), F.col("n_period"), F.col("n_next"), total))
    tied = tied.where((F.col("score") >= COLLOCATION) & (F.col("both") / F.col("n_period") > F.col("n_next") / total) & (2 * F.col("large") < F.col("both")))
    ends = named.where(~weak)
    breaks = ends.agg(F.sum("both")).first()[0] or 1
    begun = ends.groupBy("next").agg(F.sum("both").alias("both"), F.first("n_next").alias("n_next"))
    begun = begun.withColumn("score", _ratio(F.col("both"), F.lit(breaks), F.col("n_next"), total))
    begun = begun.where((F.col("score") >= STARTER) & (F.col("both") / breaks > F.col("n_next") / total))
    # written small somewhere, and large only after a clear end
    case = tokens.where(F.col("after").isNotNull()).select(
        word_type(F.col("after")).alias("next"), F.regexp_like("after", F.lit(r"^\p{Lu}")).alias("up"), F.col("closes").alias("end"))
    case = case.groupBy("next").agg(F.count_if(~F.col("up")).alias("score"), F.count_if(F.col("up") & ~F.col("end")).alias("inside"))
    return Boundaries(
        abbreviations, _entries(tied, most, "type", "next"), _entries(begun, most, "next"),
        _entries(case.where("score > 0 AND inside = 0"), most, "next"))


def cut_sentences(text: str, model: Boundaries) -> list[str]:
    """The sentences of one text, without the white space between them; all sets of the model are at hand."""
    def bare(token: str) -> str:
        return _BARE.sub("", token)

    def word(token: str) -> str:
        low = token.rstrip(".").lower()
        return NUMBER if _NUMBER.fullmatch(low) else low

    first = _TOKEN.search(text)
    if first is None:
        return []
    out, start = [], first.start()
    for m in _MARKED.finditer(text):  # only a token with a mark at its end can end a sentence
        raw, token, following = m.group().rstrip(CLOSERS), bare(m.group()), _TOKEN.search(text, m.end())
        after = bare(following.group()) if following else ""
        if raw.endswith(("!", "?")):
            stop = True
        elif following is None:
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
            elif word(token) == NUMBER:
                stop = not small
            else:
                stop = True
        if stop:
            out.append(text[start: m.end()])
            start = following.start() if following else None
    if start is not None:
        out.append(text[start:].rstrip())
    return out


SETS = ("abbreviations", "collocations", "starters", "lower")
_ENTRY = ["kind", "first", "second"]  # place in SETS, word, second word or ""


class _Asked(set):
    """Notes what is looked up in a set that is not at hand, and gives the answer after which more is looked up."""

    def __init__(self, answer: bool):
        super().__init__()
        self.answer = answer

    def __contains__(self, entry: object) -> bool:
        self.add(entry)
        return self.answer


def lookups(text: str, model: Boundaries) -> list[tuple[int, str, str]]:
    """All that cutting the text may look up in the sets of ``model`` that are None."""
    notes = {k: _Asked(k == "abbreviations") for k in SETS if getattr(model, k) is None}
    cut_sentences(text, replace(model, **notes))
    return [(SETS.index(k), *(e if isinstance(e, tuple) else (e, ""))) for k, note in notes.items() for e in note]


def _with(model: Boundaries, found: list[tuple[int, str, str]]) -> Boundaries:
    """The model with the found entries in place of its sets that are None."""
    sets = {k: frozenset((a, b) if k == "collocations" else a for i, a, b in found if SETS[i] == k) for k in SETS if getattr(model, k) is None}
    return replace(model, **sets)


def trained_sentences(df: DataFrame, model: Boundaries, text: str = "text", part: str = "part") -> DataFrame:
    """One row per sentence with its number; a text without words has none, a NULL text too.

    Of a learned set that is a table, only what these texts look up matters.  If that is
    within HELD it is sent to the workers like the other sets; else every text gets what it
    looks up by a join, and no worker holds more than the entries of one text.
    """
    spark = df.sparkSession
    tables = {k: getattr(model, k) for k in SETS if isinstance(getattr(model, k), DataFrame)}
    model = replace(model, **dict.fromkeys(tables))
    found = None
    if tables:
        known = spark.sparkContext.broadcast(model)

        @F.arrow_udf("array<struct<kind:int,first:string,second:string>>")
        def ask(texts: pa.Array) -> pa.Array:
            rows = [[dict(zip(_ENTRY, e)) for e in lookups(t, known.value)] for t in texts.to_pylist()]
            return pa.array(rows, pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.string()), ("second", pa.string())])))

        row = F.xxhash64(text).alias("_row")  # texts of one hash share what they find: more than one looks up, all of it in the sets
        asked = df.where(F.col(text).isNotNull()).select(row, F.explode(ask(F.col(text))).alias("_e")).select("_row", "_e.*")
        entries = None
        for k, table in tables.items():
            names = [F.col(c) for c in table.columns] + [F.lit("")]
            rows = table.select(F.lit(SETS.index(k)).alias("kind"), names[0].alias("first"), names[1].alias("second"))
            entries = rows if entries is None else entries.union(rows)
        found = checkpointed(entries.join(asked.select(*_ENTRY).distinct(), _ENTRY, "left_semi"))
        if _fits(found, "first", "second"):
            model, found = _with(model, [tuple(r) for r in found.select(*_ENTRY).collect()]), None
    shared = spark.sparkContext.broadcast(model)
    if found is None:

        @F.arrow_udf("array<string>")
        def cut(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else cut_sentences(t, shared.value) for t in texts.to_pylist()], pa.list_(pa.string()))

        return explode_parts(df, cut(F.col(text)), text, part)

    @F.arrow_udf("array<string>")
    def cut_by(texts: pa.Array, own: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), own.to_pylist())
        return pa.array([None if t is None else cut_sentences(t, _with(shared.value, [(e["kind"], e["first"], e["second"]) for e in es or ()])) for t, es in rows], pa.list_(pa.string()))

    hits = lookup_join(asked, found, _ENTRY, "left_semi", ["_row"])
    own = checkpointed(hits.groupBy("_row").agg(F.collect_set(F.struct(*_ENTRY)).alias("_own")))
    joined = df.select("*", row).join(own, "_row", "left").select(*df.columns, "_own")
    return explode_parts(joined, cut_by(F.col(text), F.col("_own")), text, part).drop("_own")
