"""Losses, classification metrics, predictions and checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.functions.scaling import perplexity
from wordloom.operators.joins import lookup_join
from wordloom.operators.ordering import global_position, global_running_sum, running_by_group
from wordloom.session import checkpointed

# --- fixed values: metrics by task ------------------------------------------------------
TASK_METRICS = {
    "cola": ("matthews_correlation",),
    "sst2": ("accuracy",),
    "mnli": ("accuracy",),
    "qnli": ("accuracy",),
    "rte": ("accuracy",),
    "wnli": ("accuracy",),
    "mrpc": ("accuracy", "f1"),
    "qqp": ("accuracy", "f1"),
    "stsb": ("pearson", "spearmanr"),
}
# ------------------------------------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def accuracy(pred: str, gold: str) -> Column:
    return F.avg(F.when(F.col(pred) == F.col(gold), 1.0).otherwise(0.0))


def _cells(pred: str, gold: str) -> tuple[Column, Column, Column, Column]:
    p, g = F.col(pred) == 1, F.col(gold) == 1
    return tuple(F.count_if(c).cast("double") for c in (p & g, p & ~g, ~p & g, ~p & ~g))


def f1(pred: str, gold: str) -> Column:
    tp, fp, fn, _ = _cells(pred, gold)
    return _ratio(2 * tp, 2 * tp + fp + fn)


def matthews(pred: str, gold: str) -> Column:
    tp, fp, fn, tn = _cells(pred, gold)
    return _ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, rank: 1-based mean rank of every distinct value."""
    counts = df.groupBy(value).agg(F.sum("_n").alias("_c"))
    cum = global_running_sum(counts, [value], {"_upto": F.col("_c")})
    return cum.select(value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(value + "_rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation from counts of distinct pairs; ties get mean ranks."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")
    ).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    pairs = checkpointed(pairs)  # read five times below
    mid = (pairs.agg(F.sum("_n")).scalar() + 1) / 2
    ranked = lookup_join(pairs, average_ranks(pairs, "_a"), ["_a"], "inner", ["_b"])
    ranked = lookup_join(ranked, average_ranks(pairs, "_b"), ["_b"], "inner", ["_a"])
    x, y, n = F.col("_x"), F.col("_y"), F.col("_n")
    ranked = ranked.select("_n", (F.col("_a_rank") - mid).alias("_x"), (F.col("_b_rank") - mid).alias("_y"))
    return ranked.agg(
        F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y))).alias("spearmanr")
    )


def classification_metrics(
    df: DataFrame, pred: str = "prediction", gold: str = "label", task: str | None = None, regression: bool = False,
) -> DataFrame:
    """One row with the task's metrics; several also get their mean.

    Without a task: mean squared error for regression, else accuracy.
    """
    if task is None:
        if regression:
            gap = F.col(pred) - F.col(gold)
            return df.agg(F.avg(gap * gap).alias("mse"))
        return df.agg(accuracy(pred, gold).alias("accuracy"))
    names = TASK_METRICS[task]
    if names == ("pearson", "spearmanr"):
        out = df.agg(F.corr(pred, gold).alias("pearson")).select(
            "pearson", spearman(df, pred, gold).scalar().alias("spearmanr")
        )
    else:
        makers = {"accuracy": accuracy, "f1": f1, "matthews_correlation": matthews}
        out = df.agg(*[makers[n](pred, gold).alias(n) for n in names])
    if len(names) > 1:
        out = out.withColumn("combined_score", sum(F.col(n) for n in names) / len(names))
    return out


def matched_mismatched(matched: DataFrame, mismatched: DataFrame, pred: str, gold: str, task: str = "mnli") -> DataFrame:
    """Metrics of two evaluation sets in one record, the second with ``_mm``."""
    first = classification_metrics(matched, pred, gold, task)
    second = classification_metrics(mismatched, pred, gold, task)
    extra = [second.select(c).scalar().alias(c + "_mm") for c in second.columns]
    return first.select("*", *extra)


def predict_argmax(df: DataFrame, logits: str, labels: DataFrame | None = None, name: str = "prediction") -> DataFrame:
    """Index of the first largest logit; with ``labels`` (label_id, label) also
    the label name in ``<name>_label``."""
    best = (F.array_position(logits, F.array_max(logits)) - 1).cast("bigint")
    out = df.withColumn(name, best)
    if labels is None:
        return out
    names = labels.select(F.col("label_id").alias(name), F.col("label").alias(name + "_label"))
    return lookup_join(out, names, [name])


def format_predictions(df: DataFrame, index: str, prediction: str, regression: bool = False) -> DataFrame:
    """index, prediction as written to a prediction file."""
    text = F.format_string("%.3f", F.col(prediction).cast("double")) if regression else F.col(prediction).cast("string")
    return df.select(F.col(index).alias("index"), text.alias("prediction"))


def label_list(df: DataFrame, label: str = "label") -> DataFrame:
    """label, label_id: sorted distinct labels, numbered from 0."""
    return global_position(df.select(label).where(F.col(label).isNotNull()).distinct(), [label], "label_id")


def encode_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_id``; the unknown mark -1 stays -1."""
    ids = labels.select(F.col("label").cast("string").alias("_l"), "label_id")
    key = F.col(label).cast("string")
    out = lookup_join(df.withColumn("_l", key), ids, ["_l"])
    return out.withColumn("label_id", F.when(F.col("_l") == "-1", F.lit(-1)).otherwise(F.col("label_id"))).drop("_l")


def mlm_eval_loss(
    df: DataFrame, batch: Sequence[str], loss: str = "loss", weight: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Mean over batches of the batch mean, its perplexity, and the mean over
    all rows (or tokens, with ``weight``)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    per_batch = df.groupBy(*by, *[b for b in batch if b not in by]).agg(
        F.avg(loss).alias("_mean"), F.sum(F.col(loss) * w).alias("_sum"), F.sum(w).alias("_w")
    )
    return (
        per_batch.groupBy(*by)
        .agg(F.avg("_mean").alias("loss"), F.try_divide(F.sum("_sum"), F.sum("_w")).alias("weighted_loss"))
        .withColumn("perplexity", perplexity("loss"))
    )


def position_accuracy(df: DataFrame, predicted: str, labels: str) -> DataFrame:
    """Share of equal positions over all positions, padding included."""
    same = F.size(F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l")), lambda x: x["p"] == x["l"]))
    return df.agg((F.sum(same) / F.sum(F.size(labels))).alias("accuracy"))


def best_checkpoint(evals: DataFrame, run: str = "run_name", step: str = "step", value: str = "perplexity") -> DataFrame:
    """First step with the lowest value, per run."""
    best = F.min(F.struct(F.col(value), F.col(step))).alias("_b")
    return evals.groupBy(run).agg(best).select(run, F.col("_b." + step).alias(step), F.col("_b." + value).alias(value))


def running_best(evals: DataFrame, run: str = "run_name", step: str = "step", value: str = "perplexity") -> DataFrame:
    """Adds ``best_so_far`` per run in step order."""
    return running_by_group(evals, [run], [step], {"best_so_far": ("min", F.col(value))})


def decile_checkpoints(batches: DataFrame, n: str = "n_batches") -> DataFrame:
    """pct, batch_idx: batch numbers at every tenth of a run."""
    pct = F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(10))).alias("pct")
    return batches.select("*", pct).withColumn("batch_idx", F.floor(F.col(n) * F.col("pct") / 100).cast("bigint"))


def scaling_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Power curve y = a * x^b by least squares on logarithms."""
    lx, ly = F.ln(x), F.ln(y)
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(
        F.regr_slope(ly, lx).alias("exponent"), F.exp(F.regr_intercept(ly, lx)).alias("factor")
    )
