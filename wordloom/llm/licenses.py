"""License scans: exact phrases, and short notices found with a few errors.

A notice of k allowed edits is cut into k + 1 seeds; a text within k edits holds
one of them unchanged.  Seeds are looked up first, and only the stretch of text
around a seed goes to bounded-error matching, which gives span and edits.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import carried, table
from wordloom.llm.registry import query

# Fixed values of the contract: phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Short notices, as words: notice, label.
NOTICES = (
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
CHARS_PER_EDIT = 10
# Bytes of words (letters and digits, lower case, and all of non-ASCII); the others part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Notice:
    def __init__(self, words: str, label: str):
        self.raw, self.label = words.encode(), label
        self.edits = len(words) // CHARS_PER_EDIT
        parts = self.edits + 1
        cuts = [len(words) * i // parts for i in range(parts + 1)]
        self.seeds = [(self.raw[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(rb"(?b)(?<![^ ])(?:" + regex.escape(self.raw) + b"){e<=%d}(?![^ ])" % self.edits)

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of its places in normalised text: the best of each stretch."""
        stretches = []
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                stretches.append((max(0, at - offset - self.edits - 1), at - offset + len(self.raw) + self.edits + 1))
                at = text.find(seed, at + 1)
        out, reach = [], -1
        for a, b in sorted(stretches):
            # a stretch inside a place already found cannot begin another one
            m = self.pattern.search(text, a, min(b, len(text))) if b > reach else None
            if m and m.start() >= reach:
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                reach = m.end()
        return out


def scan_text(text: str | None, phrases: tuple, notices: list[Notice]) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
    """Number of words, and (label, first word, end word, edits, base) of each place."""
    words = (text or "").encode().translate(_WORDS).split()
    joined = b" ".join(words)
    framed = b" " + joined + b" "
    found = []
    for phrase, label in phrases:
        needle = b" " + phrase.encode() + b" "
        at, counted, before = framed.find(needle), 0, 0
        while at >= 0:
            before += framed.count(b" ", counted, at)
            counted = at
            found.append((label, before, before + phrase.count(" ") + 1, 0, True))
            at = framed.find(needle, at + 1)
    for notice in notices:
        counted = before = 0
        for a, b, edits in notice.find(joined):
            before += joined.count(b" ", counted, a)
            counted = a
            found.append((notice.label, before, before + joined.count(b" ", a, b) + 1, edits, False))
    return len(words), sorted(found, key=lambda x: (x[1], not x[4], x[0], x[2]))


_PLACE = "struct<label:string,first:bigint,end:bigint,edits:bigint,base:boolean,score:double>"


def licenses(text: Column, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> Column:
    """struct(n_words, places): places are (label, first, end, edits, base, score)."""

    @F.arrow_udf(f"struct<n_words:bigint,places:array<{_PLACE}>>")
    def run(texts: pa.Array) -> pa.Array:
        ready = [Notice(*x) for x in notices]
        counts, places = [], []
        for t in texts:
            n, found = scan_text(t.as_py(), phrases, ready)
            counts.append(n)
            places.append([{"label": lb, "first": a, "end": b, "edits": e, "base": base, "score": 1.0 / (1 + e)} for lb, a, b, e, base in found])
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(places, kind)], ["n_words", "places"])

    return run(text)


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Sets n_words and places (label, first, end, edits, base, score) on every row.

    Places are word ranges in order; ``base`` ones are exact phrases, also where
    they overlap, the others notices with at most one edit per CHARS_PER_EDIT
    characters.  A null, empty or wordless text has no words and no places; texts of any
    length are read whole.  Of places with the same label and range the one with fewer
    edits comes first.  Other columns may have any name.
    """
    def work(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("found_", licenses(rows["text"], phrases, notices))
        return found.withColumns({"n_words": F.col("found_.n_words"), "places": F.col("found_.places")})

    return carried(docs, ("text",), ("n_words", "places"), work)


@query("op8_license_scan")
def op8_license_scan(spark, sf):
    found = scan_licenses(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "n_words", "places")
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"))
