"""Table access, shared SQL fragments and the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.functions import text as tx
from wordloom.operators import vocab as vo
from wordloom.session import measured

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VOCAB_SIZE = 2000


def query(key: str, sql: str | None = None):
    """Register a query under ``key`` with its oracle SQL."""

    def wrap(fn):
        if key in QUERIES:
            raise KeyError(key)
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return wrap


# --- tables ----------------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str, *columns: str | Column) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark, sf, *columns) -> DataFrame:
    return table(spark, sf, "documents", *(columns or ("doc_id", "source", "text")))


def vocabulary(spark, sf, k: int = VOCAB_SIZE) -> DataFrame:
    """Target vocabulary: the commonest words of the English documents."""
    english = documents(spark, sf, "lang", "text").where("lang = 'en'")
    return measured(vo.top_vocabulary(vo.word_frequency(english), k).select("word"))


def frequencies(spark, sf) -> DataFrame:
    return vo.word_frequency(documents(spark, sf, "text"))


def ages(spark, sf) -> DataFrame:
    """word, age: first document of a word gives it an age within six years."""
    days = ((F.col("doc_id") * 7) % 2190 + 1).alias("days")
    words = documents(spark, sf, "doc_id", "text").select(days, F.explode(F.array_distinct(tx.word_tokens("text"))).alias("word"))
    return words.groupBy("word").agg((F.min("days") / F.lit(365.0)).alias("age"))


def dictionary(spark, sf, least: int = 3) -> DataFrame:
    """Words found in at least ``least`` documents."""
    words = documents(spark, sf, "text").select(F.explode(F.array_distinct(tx.word_tokens("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("word")


def transcripts(spark, sf) -> DataFrame:
    return table(
        spark, sf, "conversations",
        F.col("conv_id").alias("transcript_id"), "turn", F.col("role").alias("speaker_role"),
        (F.lit(365) + (F.col("conv_id") * 37) % 1825).alias("target_child_age"), F.col("text").alias("gloss"),
    )


def as_bigint(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- SQL fragments -----------------------------------------------------------------
def tok(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def prep(c: str) -> str:
    out = f"replace({c}, '-', ' ')"
    out = f"regexp_replace({out}, '@[,.]@', '#NUMBER', 'g')"
    out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}+', '\1#NUMBER ', 'g')"
    return rf"regexp_replace({out}, 'http\S+', '#HLINK', 'g')"


def hkey(seed, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


_STRIP = {
    "A": "[,!@#$?;.''-`\"]",
    "B": "[!@#$?;.''\"]",
    "C": "[!,@#$?;.''\"]",
}
_EVAL_STRIP = "[0-9!:&“”—\\-_,@#$?;’.''()\"]"


def utt(c: str, variant: str) -> str:
    return f"list_transform(string_split({c}, ' '), lambda w: regexp_replace(lower(w), '{_STRIP[variant]}', '', 'g'))"


def evtok(c: str, drop_proper: bool = True) -> str:
    words = f"string_split({c}, ' ')"
    if drop_proper:
        words = f"list_filter({words}, lambda w, i: w = lower(w) OR i = 1)"
    out = f"list_transform({words}, lambda w: regexp_replace(lower(w), '{_EVAL_STRIP}', '', 'g'))"
    return f"list_filter({out}, lambda w: w <> '' AND w NOT IN ('nt', 's', 're', 't', 'd', 'll'))"


VOCAB = (
    f"vocab AS (SELECT word FROM (SELECT unnest({tok('text')}) AS word FROM documents WHERE lang = 'en') "
    f"GROUP BY word ORDER BY count(*) DESC, word LIMIT {VOCAB_SIZE})"
)
FREQ = f"freq AS (SELECT word, count(*) AS frequency FROM (SELECT unnest({tok('text')}) AS word FROM documents) GROUP BY word)"
RANKED = FREQ + (
    ", ranked AS (SELECT word, frequency, row_number() OVER (ORDER BY frequency DESC, word) - 1 AS word_rank, "
    "CAST(sum(frequency) OVER (ORDER BY frequency DESC, word ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frequency_cum, "
    "sum(frequency) OVER (ORDER BY frequency DESC, word ROWS UNBOUNDED PRECEDING) / (SELECT sum(frequency) FROM freq) "
    "AS frequency_cum_pct FROM freq)"
)
AGES = (
    f"ages AS (SELECT word, min(doc_id * 7 % 2190 + 1) / 365.0 AS age "
    f"FROM (SELECT doc_id, unnest({tok('text')}) AS word FROM documents) GROUP BY word)"
)
DICT = (
    f"dict AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest({tok('text')}) AS word FROM documents) "
    "GROUP BY word HAVING count(*) >= 3)"
)
TRANSCRIPTS = (
    "ts AS (SELECT conv_id AS transcript_id, turn, role AS speaker_role, "
    "365 + (conv_id * 37) % 1825 AS target_child_age, text AS gloss FROM conversations)"
)
SPANS = (
    "cut AS (SELECT doc_id, source, string_split(lower(text), ' ') AS w FROM documents), "
    "spans AS (SELECT doc_id, source, s AS start, array_to_string(w[s + 1 : s + 110], ' ') AS span "
    "FROM (SELECT doc_id, source, w, unnest(range(0, len(w), 30)) AS s FROM cut))"
)
SPAN_TOKENS = f"{SPANS}, stoks AS (SELECT doc_id, source, start, span, unnest({tok(prep('span'))}) AS t FROM spans)"
KEPT = (
    f"{VOCAB}, {SPAN_TOKENS}, kept AS (SELECT doc_id, source, start, span, count(*) AS n_tokens "
    "FROM stoks LEFT JOIN vocab ON t = word GROUP BY ALL "
    "HAVING count(*) FILTER (WHERE word IS NULL) = 0 AND count(*) > 40)"
)
