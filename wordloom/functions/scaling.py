"""Cost formulas and band labels for model configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# --- fixed values ---------------------------------------------------------------
DEFAULT_VOCAB_SIZE = 19010
DEFAULT_SEQ_LEN = 128
SIZE_EDGES = (3125122, 7601346, 11304258)
BAND_NAMES = ("q1", "q2", "q3", "q4")
CONFIG_LEGENDS = {
    "embedding_size": "Emb. size",
    "hidden_size": "Hidden size",
    "intermediate_size": "Inter. size",
    "num_attention_heads": "Attn. heads",
    "num_hidden_layers": "Hidden layers",
}
# --------------------------------------------------------------------------------


def _num(c: Column | str | int) -> Column:
    if isinstance(c, str):
        c = F.col(c)
    elif not isinstance(c, Column):
        c = F.lit(c)
    return c.cast("double")


def flops_hoffman(
    embedding, hidden, intermediate, heads, layers,
    vocab_size=DEFAULT_VOCAB_SIZE, seq_len=DEFAULT_SEQ_LEN,
) -> Column:
    """Forward plus backward cost of one sequence (backward = 2 x forward)."""
    e, h, i, a, n, v, s = map(
        _num, (embedding, hidden, intermediate, heads, layers, vocab_size, seq_len)
    )
    embedding = 2 * s * v * e + 2 * s * e * h
    query_key_value = 2 * 3 * s * h * h
    scores = 2 * s * s * h
    softmax = 3 * a * s * s
    feed_forward = 2 * s * (h * i + h * i)
    logits = 2 * s * h * v
    forward = embedding + n * (query_key_value + scores + softmax + feed_forward) + logits
    return 3 * forward


def flops_kaplan(non_embedding_parameters, seq_len=DEFAULT_SEQ_LEN) -> Column:
    return 6 * _num(non_embedding_parameters) * _num(seq_len)


def band(c: Column | str, edges: Sequence[float], names: Sequence[str] = BAND_NAMES) -> Column:
    """Name of the first band whose upper edge is not exceeded, else the last."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(c <= edge, F.lit(name)).otherwise(out)
    return out


def size_bucket(parameters: Column | str, edges: Sequence[float] = SIZE_EDGES) -> Column:
    return band(parameters, edges)


def config_bucket(value: Column | str, edges: Sequence[float] = (32, 64, 128)) -> Column:
    return band(value, edges)


def config_label(feature: str, value: Column | str) -> Column:
    """Legend text of one configuration value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(CONFIG_LEGENDS[feature] + " = "), F.bround(value, 0).cast("bigint").cast("string"))


def perplexity(mean_loss: Column | str) -> Column:
    """exp(loss); overflow yields Infinity."""
    return F.exp(F.col(mean_loss) if isinstance(mean_loss, str) else mean_loss)
