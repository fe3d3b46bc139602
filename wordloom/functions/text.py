"""Text expressions.  All are built-in Column expressions: no Python workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# --- fixed values: patterns and marks that define the text normalisation -------
NUMBER_MARK = "#NUMBER"
LINK_MARK = "#HLINK"
WORD_CHARS = r"\p{L}\p{N}_"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
NUMBER_JOINERS = r"@[,.]@"
LEADING_DIGITS = r"(^|[^\p{L}\p{N}_])\p{Nd}+"
LINK_PATTERN = r"http\S+"
PRETOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
EVAL_STRIP = "[0-9!:&“”—\\-_,@#$?;’.'()\"]"
CONTRACTION_STUBS = ("nt", "s", "re", "t", "d", "ll")
UTTERANCE_STRIP = {
    "A": "[,!@#$?;.'-`\"]",
    "B": "[!@#$?;.'\"]",
    "C": "[!,@#$?;.'\"]",
}
WORD_SUFFIXES = ("ion", "ing", "est", "er", "ed", "s")
NON_ALNUM = r"[^\p{L}\p{N}\s]+"  # underscores go too
MULTI_SPACE = r"[^\S\r\n]{2,}"  # blanks within a line
HYPHEN_MARK = r"@-@"
# -------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def preprocess_text(c: Column | str) -> Column:
    """Hyphens to spaces, numbers to ``#NUMBER``, links to ``#HLINK``.

    The order matters: digits are replaced before links, so a link holding
    ``/1`` is cut at the inserted space.  Only digits at a word start count.
    """
    out = F.replace(_col(c), F.lit("-"), F.lit(" "))
    out = F.regexp_replace(out, NUMBER_JOINERS, NUMBER_MARK)
    out = F.regexp_replace(out, LEADING_DIGITS, "$1" + NUMBER_MARK + " ")
    return F.regexp_replace(out, LINK_PATTERN, LINK_MARK)


def word_tokens(c: Column | str) -> Column:
    """Lowercased maximal runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def pre_tokens(c: Column | str) -> Column:
    """Runs of word characters and runs of punctuation, case kept."""
    return F.regexp_extract_all(_col(c), F.lit(PRETOKEN_PATTERN), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """Distinct tokens of a row with their counts, as (term, cnt) structs.

    Equal tokens are adjacent after sorting, so a count is the distance between
    two starts.  Inner arrays are bound through one-element arrays, which keeps
    them from being computed again for every element.
    """

    def counted(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )

        def entries(b: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(b, k + 1), F.size(s))
            return F.transform(
                b, lambda i, k: F.struct(F.get(s, i).alias("term"), (upto(k) - i).cast("bigint").alias("cnt"))
            )

        none = F.array().cast("array<struct<term:string,cnt:bigint>>")
        return F.when(F.size(s) > 0, F.get(F.transform(F.array(starts), entries), F.lit(0))).otherwise(none)

    return F.get(F.transform(F.array(F.sort_array(tokens)), counted), F.lit(0))


def space_words(c: Column | str) -> Column:
    """Split on single spaces; empty strings are kept and count as words."""
    return F.split(_col(c), " ")


def count_words(c: Column | str) -> Column:
    return F.size(space_words(c))


def eval_tokens(
    c: Column | str,
    drop_proper: bool = True,
    stubs: Sequence[str] = CONTRACTION_STUBS,
) -> Column:
    """Benchmark normaliser: drop cased words after the first, strip marks and
    digits, lower, drop empties and contraction stubs."""
    words = space_words(c)
    if drop_proper:
        words = F.filter(words, lambda w, i: (w == F.lower(w)) | (i == 0))
    words = F.transform(words, lambda w: F.regexp_replace(F.lower(w), EVAL_STRIP, ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stubs))


def utterance_tokens(
    c: Column | str, variant: str = "A", drop_empty: bool = False
) -> Column:
    """Split on spaces, lower, strip one of three character classes.

    Words left empty stay in the result unless ``drop_empty``.
    """
    strip = UTTERANCE_STRIP[variant]
    words = F.transform(space_words(c), lambda w: F.regexp_replace(F.lower(w), strip, ""))
    return F.filter(words, lambda w: w != "") if drop_empty else words


def count_substring(c: Column | str, part: str) -> Column:
    """Non-overlapping occurrences of a literal, anywhere in the text."""
    c = _col(c)
    gone = F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))
    return (gone / F.lit(len(part))).cast("bigint")


def has_word_suffix(c: Column | str) -> Column:
    """Word ends in one of the inflection endings accepted without lookup."""
    c = _col(c)
    hit = F.lit(False)
    for ending in WORD_SUFFIXES:
        hit = hit | c.endswith(ending)
    return hit


def age_bin(age: Column | str) -> Column:
    """Years to 1..6 with upper edges included; NULL outside (0, 6]."""
    age = _col(age)
    return F.when((age > 0) & (age <= 6), F.ceil(age).cast("int"))


def remove_newlines(c: Column | str) -> Column:
    """Delete line breaks, joining the words around them."""
    return F.replace(_col(c), F.lit("\n"), F.lit(""))


def strip_non_alphanumeric(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), NON_ALNUM, "")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), MULTI_SPACE, " ")


def plain_words(c: Column | str) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(_col(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def join_hyphen_marks(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), HYPHEN_MARK, "-")


def dot_sentences(c: Column | str) -> Column:
    """Split on every full stop; a final stop yields a last empty sentence."""
    return F.split(_col(c), r"\.")


def paragraphs(c: Column | str) -> Column:
    return F.split(_col(c), "\n\n")


def rule_sentences(c: Column | str) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space (a rule-based
    stand-in for a trained sentence splitter)."""
    return F.split(F.trim(_col(c)), r"(?<=[.!?])\s+")


def instance_text(columns: Sequence[str], allowed: Sequence[str]) -> Column:
    """Recognised text columns in table order, each followed by a space."""
    parts = []
    for name in columns:
        if name in allowed:
            parts += [F.col(name), F.lit(" ")]
    return F.concat(*parts) if parts else F.lit("")
