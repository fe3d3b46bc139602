"""Evaluation sets: text selection, vocabulary filter, coverage, padding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.functions import text as tx
from wordloom.functions.arrays import pad_array
from wordloom.operators.curate import vocab_hits
from wordloom.operators.joins import lookup_join
from wordloom.operators.vocab import INLINE_WORDS, vocab_membership

# --- fixed values: text columns of the supported tasks --------------------------------
POSITIONAL_TEXT = {
    "wsc": (0,),
    "wsc.fixed": (0,),
    "winogrande-xl": (0,),
    "conll2003": (1,),
    "race": (1,),
    "ai2_arc": (1,),
    "martn-nguyen/adversarial_nli": (1,),
    "squad": (2, 3),
    "swag": (2, 6, 7, 8, 9),
    "copa": (0, 1, 2),
    "piqa": (0, 1, 2),
}
TASK_KEYS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
}
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
INSTANCE_FIELDS = (
    "sentence", "sentence1", "sentence2", "question", "question1", "question2", "hypothesis", "premise",
)
# ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TaskSpec:
    """How to read one evaluation set."""

    name: str
    text_columns: tuple[str, ...] | None = None
    label_kind: str = "class"  # class | regression


def text_columns(columns: Sequence[str], spec: TaskSpec) -> list[str]:
    """Columns whose text is judged: named fields first, then by position."""
    if spec.text_columns:
        return list(spec.text_columns)
    if "sentence" in columns:
        return ["sentence"]
    if "inputs" in columns:
        return ["inputs"]
    if "sentence1" in columns:
        return ["sentence1", "sentence2"]
    return [columns[i] for i in POSITIONAL_TEXT.get(spec.name, (0, 1))]


def example_text(columns: Sequence[str], spec: TaskSpec) -> Column:
    """The text of an example: its columns joined with a space."""
    return F.concat_ws(" ", *[F.col(c) for c in text_columns(columns, spec)])


def input_columns(columns: Sequence[str], task: str | None = None) -> tuple[str, str | None]:
    """One or two columns to encode: by task, by name, else the first two."""
    if task in TASK_KEYS:
        return TASK_KEYS[task]
    free = [c for c in columns if c != "label"]
    if "sentence1" in free and "sentence2" in free:
        return "sentence1", "sentence2"
    return (free[0], free[1]) if len(free) >= 2 else (free[0], None)


def filter_eval_examples(
    df: DataFrame, vocab: DataFrame, spec: TaskSpec, ids: Sequence[str],
    drop_proper: bool = True, inline: int = INLINE_WORDS,
) -> DataFrame:
    """Examples whose every normalised token is in the vocabulary.

    An example with no token left is kept.  Vocabulary words are not lowered.
    """
    tokens = tx.eval_tokens(example_text(df.columns, spec), drop_proper)
    hits = vocab_hits(df, ids, tokens, vocab, inline, keep="r.n_in_vocab = r.n_tokens")
    return hits.drop("n_tokens", "n_in_vocab")


def eval_coverage(
    df: DataFrame, vocab: DataFrame, ids: Sequence[str], tokens: Column, task: str = "task",
    inline: int = INLINE_WORDS,
) -> DataFrame:
    """Per task: share of examples fully covered, at most one token missing, and
    covered by four fifths."""
    hits = vocab_hits(df, ids, tokens, vocab, inline)
    n, k = F.col("n_tokens"), F.col("n_in_vocab")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return hits.groupBy(task).agg(
        share(n == k).alias("complete"),
        share((n == k) | (n == k + 1)).alias("complete_or_1_missing"),
        share(n <= k * 1.25).alias("mostly"),
    )


def dictionary_report(df: DataFrame, tokens: Column, dictionary: DataFrame) -> DataFrame:
    """word, in_dictionary, frequency over all tokens of a set."""
    freq = df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    return vocab_membership(freq, dictionary).select("word", F.col("in_vocab").alias("in_dictionary"), "frequency")


def strip_predictions(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Trim white space of both; the label becomes a one-element array."""
    strip = lambda c: F.btrim(F.col(c), F.lit(WHITE_SPACE))
    return df.withColumn(prediction, strip(prediction)).withColumn(label, F.array(strip(label)))


def pad_to_batch_max(df: DataFrame, ids: str, batch: str, pad_id: int) -> DataFrame:
    """Right-pad ids to the longest of the batch, at least one.

    The longest length per batch is a combined aggregate joined back, so a
    large batch is not gathered in one task.
    """
    longest = df.groupBy(batch).agg(F.greatest(F.max(F.size(ids)), F.lit(1)).alias("_max"))
    return lookup_join(df, longest, [batch], "inner", [ids]).withColumn(ids, pad_array(ids, F.col("_max"), pad_id)).drop("_max")
