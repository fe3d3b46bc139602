"""Chat formatting: records of several layouts to canonical turns, one template.

A record is a variant.  Its nested field paths, without the values' types, are
hashed; the hash picks a declarative mapping that turns the record into turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import let, running_sum, table
from wordloom.llm.registry import query

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings, of this and of other templates: an opening character, then one of these.
_REST = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]"
BLOCK = 256  # turns gathered at once; a long conversation is put together from its blocks
TURNS = "array<struct<role:string,text:string>>"


# --- layouts ------------------------------------------------------------------------------
def _field(name: str) -> Callable[[Column], Column]:
    return lambda r: F.try_variant_get(r, f"$.{name}", "string")


def _said(role: str, text: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda r: F.array(F.struct(F.lit(role).alias("role"), F.coalesce(text(r), F.lit("")).alias("text")))


def _turn(role: str, text: str) -> Callable[[Column], Column]:
    return lambda r: F.array(F.struct(F.coalesce(_field(role)(r), F.lit("")).alias("role"), F.coalesce(_field(text)(r), F.lit("")).alias("text")))


def _pair(ask: Callable[[Column], Column], reply: str, system: str | None = None) -> Callable[[Column], Column]:
    def turns(r: Column) -> Column:
        parts = [_said("user", ask)(r), _said("assistant", _field(reply))(r)]
        return F.concat(*([_said("system", _field(system))(r)] if system else []), *parts)

    return turns


def _asked_with_input(r: Column) -> Column:
    more = _field("input")(r)
    return F.concat(F.coalesce(_field("instruction")(r), F.lit("")), F.when(F.length(more) > 0, F.concat(F.lit("\n\n"), more)).otherwise(""))


def _list(name: str, role: str, text: str) -> Callable[[Column], Column]:
    names = {"human": "user", "gpt": "assistant"}

    def one(x: Column) -> Column:
        said = F.coalesce(x[role], F.lit(""))
        for old, new in names.items():
            said = F.when(said == old, new).otherwise(said)
        return F.struct(said.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

    return lambda r: F.transform(F.try_variant_get(r, f"$.{name}", f"array<struct<{role}:string,{text}:string>>"), one)


# Field paths (fields of an object in order of name) and the mapping they select.
LAYOUTS: dict[str, Callable[[Column], Column]] = {
    "OBJECT<role: , text: >": _turn("role", "text"),
    "OBJECT<content: , role: >": _turn("role", "content"),
    "OBJECT<completion: , prompt: >": _pair(_field("prompt"), "completion"),
    "OBJECT<prompt: , response: >": _pair(_field("prompt"), "response"),
    "OBJECT<prompt: , response: , system: >": _pair(_field("prompt"), "response", "system"),
    "OBJECT<instruction: , output: >": _pair(_field("instruction"), "output"),
    "OBJECT<input: , instruction: , output: >": _pair(_asked_with_input, "output"),
    "OBJECT<messages: ARRAY<OBJECT<content: , role: >>>": _list("messages", "role", "content"),
    "OBJECT<conversations: ARRAY<OBJECT<from: , value: >>>": _list("conversations", "from", "value"),
}


def field_paths(record: Column) -> Column:
    """The record's nested field paths: its schema without the types of its values."""
    return F.regexp_replace(F.schema_of_variant(record), r"(?<=[ <])(?!OBJECT<|ARRAY<)[A-Z][A-Z0-9_]*(\(\d+, ?\d+\))?(?=[,>])", "")


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text) from (conv_id, turn, record variant).

    A record of an unknown layout, also a null one, becomes one turn of role ``unknown``
    with its JSON as text, so nothing is lost.  A list without messages has no turns.
    """
    paths = F.coalesce(field_paths(F.col("record")), F.lit(""))
    marked = records.select("conv_id", "turn", "record", F.xxhash64(paths).alias("layout"))
    turns = F.array(F.struct(F.lit("unknown").alias("role"), F.coalesce(F.to_json("record"), F.lit("")).alias("text")))
    for spec, mapping in LAYOUTS.items():
        turns = F.when(F.col("layout") == F.xxhash64(F.lit(spec)), mapping(F.col("record"))).otherwise(turns)
    for spec in ("OBJECT<messages: ARRAY<>>", "OBJECT<conversations: ARRAY<>>"):
        turns = F.when(F.col("layout") == F.xxhash64(F.lit(spec)), F.array().cast(TURNS)).otherwise(turns)
    return marked.select("conv_id", "turn", F.posexplode(turns).alias("part", "x")).select("conv_id", "turn", "part", "x.role", "x.text")


# --- template -----------------------------------------------------------------------------
def escape(text: Column) -> Column:
    """A backslash goes into each control string, behind any that stand there already."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({_REST})", r"$1$2$3")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask) from (conv_id, turn, part, role, text).

    A turn is START role SEP text END and a line break.  ``mask`` has a (start, end)
    in code points of ``formatted`` for each turn: its text if ``loss_role`` said it,
    else nothing (start = end).  Null role or text counts as empty, a null turn comes
    first; turns of the same number are ordered by role and text, repeated rows stay.
    Conversations are put together from blocks of turns, so that one with very many
    rows is formatted in many tasks.
    """
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    at = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**63)))
    head = F.length(role) + len(START) + len(SEP)
    size = F.when(F.coalesce("role", F.lit("")) == loss_role, F.length(text)).otherwise(0)
    each = turns.select(
        "conv_id", F.floor(at / BLOCK).alias("block"), at.alias("turn"), F.coalesce("part", F.lit(0)).alias("part"),
        F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END + "\n")).alias("said"), head.alias("head"), size.alias("size"))
    rows = each.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "part", "said", "head", "size"))).alias("x"))
    parts = rows.select("conv_id", F.struct(
        "block", F.array_join(F.col("x.said"), "").alias("said"),
        F.transform("x", lambda y: F.struct(F.length(y["said"]).alias("n"), y["head"].alias("head"), y["size"].alias("size"))).alias("cuts")).alias("b"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs")).select(
        "conv_id", F.array_join(F.col("bs.said"), "").alias("formatted"), F.flatten(F.col("bs.cuts")).alias("cuts"))
    mask = let(running_sum(F.transform("cuts", lambda c: c["n"])), lambda before: F.transform("cuts", lambda c, i: F.struct(
        (before[i] + c["head"]).alias("start"), (before[i] + c["head"] + c["size"]).alias("end"))))
    return whole.select("conv_id", "formatted", mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss): roles and texts, and the texts under the mask,
    unescaped, from what ``format_chats`` gave."""

    def parse(pieces: Column) -> Column:
        def turn(p: Column) -> Column:
            return let(F.split(p, r"<\|im_sep\|>", 2), lambda x: F.struct(
                unescape(F.substring(x[0], F.lit(len(START) + 1), F.length(x[0]))).alias("role"), unescape(x[1]).alias("text")))

        lost = let(running_sum(F.transform(pieces, lambda p: F.length(p) + len(END) + 1)), lambda before: F.zip_with(
            pieces, F.zip_with("mask", F.slice(before, F.lit(1), F.size(pieces)), lambda m, b: F.struct(
                (m["start"] - b + 1).cast("int").alias("at"), (m["end"] - m["start"]).cast("int").alias("n"))),
            lambda p, m: unescape(F.substring(p, m["at"], m["n"]))))
        return F.struct(F.transform(pieces, turn).alias("turns"), lost.alias("loss"))

    pieces = let(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))
    return chats.select("conv_id", "formatted", F.explode(F.array(let(pieces, parse))).alias("x")).select("conv_id", "formatted", "x.turns", "x.loss")


_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\])', '\1\2\\\3', 'g'))
  + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\])', '\1\2\\\3', 'g')) + 33 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""


def records_of(conversations: DataFrame) -> DataFrame:
    """One record a row of ``conversations``, and conversation -7 as a list of messages."""
    rows = conversations.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    text = F.lit("</s>[INST] ok [/INST]").alias("content")
    messages = F.array(F.struct(F.lit("user").alias("role"), text), F.struct(F.lit("assistant").alias("role"), text))
    extra = conversations.sparkSession.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
    return rows.unionByName(extra)


@query("op6_chat_format", _SQL)
def op6_chat_format(spark, sf):
    conversations = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    back = read_back(format_chats(canonical_turns(records_of(conversations))))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
