"""Quality rules: statistics of a text and robust multivariate outliers.

A base rule rejects very short and very repetitive texts.  The others are
compared with their language and source: a minimum-covariance-determinant
estimate of the transformed statistics is found by concentration steps, each an
aggregation of sums, from two starts and until no determinant falls any more.
Documents far from it by Mahalanobis distance go; how far is learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import table, written
from wordloom.llm.registry import query
from wordloom.operators.ordering import global_running_sum

WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = re.compile(r"[#*$%&|<>]")

# Parameters of the estimate
SUPPORT = 0.75      # share of a group that an estimate rests on
STEPS = 10          # at most so many concentration steps from each start
TOLERANCE = 1e-2    # a step that lowers no group's log determinant by more is the last
CLEAN = 10.0        # a good text rejected costs as much as so many bad texts kept
FENCE = 1.5         # without labels: so many quartile ranges above the upper quartile, in logarithms
PRIOR = 200         # documents that the estimate of all documents counts for in a group's estimate
FLOOR = 0.02        # variance added to each feature: constant features stay invertible
DIMS = 4
STARTS = 2          # first orders that the steps begin from


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """STATS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    chars = len(b"".join(words).decode())
    symbols = len(_SYMBOLS.findall(text)) if text else 0
    dup, seen = 0, set()
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if len(words) > WINDOW:
        windows = list(zip(*[words[k:] for k in range(WINDOW)]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            upto = 0
            for at, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += at + WINDOW - max(upto, at)
                    upto = at + WINDOW
    return len(words), chars, symbols, dup, repeated


def stats(text: Column) -> Column:
    """struct of STATS; words are separated by ASCII white space, a null text has none."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in STATS) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        rows = np.array([text_stats(t.as_py()) for t in texts], np.int64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], list(STATS))

    return measure(text)


def base_failed(min_words: int = 10, max_repeat_pct: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def features() -> list[Column]:
    """The transformed statistics, DIMS of them, of similar scale: word length, and the shares
    of symbols, repeated lines and repeated words, on a scale that spreads small shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def share(c: str) -> Column:
        return F.asinh(F.col(c) / n * 20)

    return [F.log((F.col("word_chars") + 1) / n) * 4, share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _moments(weight: Column) -> list[Column]:
    w = F.when(weight, F.lit(1.0)).otherwise(F.lit(0.0))
    out = [F.sum(w).alias("w")]
    out += [F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIMS)]
    return out + [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and inverse covariance of each group from its sums; small groups lean
    on the estimate of all documents of their start, which counts for PRIOR documents."""
    sums = written(rows.groupBy(*keys).agg(*_moments(F.col("inside"))), "quality-sums")
    means, covs = np.zeros((STARTS, DIMS)), np.zeros((STARTS, DIMS, DIMS))
    for total in sums.groupBy("start_").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in keys]).collect():  # STARTS rows
        at, weight = total["start_"], total["w"] or 1.0
        means[at] = [total[f"s{i}"] / weight for i in range(DIMS)]
        for i, j in PAIRS:
            covs[at, i, j] = covs[at, j, i] = total[f"p{i}{j}"] / weight - means[at, i] * means[at, j]

    def solve(batches):
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in keys}
            w = col["w"]
            at = batch.column("start_").to_numpy()
            m0, c0 = means[at], covs[at]
            both = (w + PRIOR)[:, None]
            mean = (np.stack([col[f"s{i}"] for i in range(DIMS)], 1) + PRIOR * m0) / both
            cov = np.zeros((len(w), DIMS, DIMS))
            for i, j in PAIRS:
                second = (col[f"p{i}{j}"] + PRIOR * (c0[:, i, j] + m0[:, i] * m0[:, j])) / both[:, 0]
                cov[:, i, j] = cov[:, j, i] = second - mean[:, i] * mean[:, j]
            full = cov + FLOOR * np.eye(DIMS)
            inverse, logdet = np.linalg.inv(full), np.linalg.slogdet(full)[1]
            lists = [pa.array(x.reshape(len(w), -1).tolist(), pa.list_(pa.float64())) for x in (mean, inverse)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [*lists, pa.array(logdet)], [*keys, "m", "a", "logdet"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return written(sums.mapInArrow(solve, f"{types}, m array<double>, a array<double>, logdet double"), "quality-estimates")


def _distances(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    named = estimates.select(*[F.col(k).alias(f"e_{k}") for k in keys], "m", "a")
    joined = rows.join(named, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys], "left")
    diff = [F.col(f"x{i}") - F.col("m")[i] for i in range(DIMS)]
    d2 = sum(diff[i] * diff[j] * F.col("a")[i * DIMS + j] * (1 if i == j else 2) for i, j in PAIRS)
    return joined.withColumn("d2", d2).drop("m", "a", *[f"e_{k}" for k in keys])


def _measured(docs: DataFrame, keys: list[str], *others: Column) -> DataFrame:
    """``others``, the keys, STATS, base_failed and the features x0, x1, ... of each row."""
    kept = [docs[f"`{k}`"].alias(k) for k in keys]
    flat = docs.select(*[c.alias(f"other{i}") for i, c in enumerate(others)], *kept, stats(docs["text"]).alias("s"))
    flat = flat.select(*[f"other{i}" for i in range(len(others))], *keys, "s.*").withColumn("base_failed", base_failed())
    return flat.select("*", *[x.alias(f"x{i}") for i, x in enumerate(features())])


def _beside(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a group; null keys are a group."""
    renamed = table.select(*[F.col(k).alias(f"e_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys]).drop(*[f"e_{k}" for k in keys])


def _starts(fit: DataFrame, keys: list[str]) -> DataFrame:
    """Each text once for each start, which gives the first order: deviations from the group's
    medians, plain and by the feature's median absolute deviation."""
    dims = range(DIMS)
    middles = written(fit.groupBy(*keys).agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"c{i}") for i in dims]), "quality-medians")
    off = _beside(fit, middles, keys)
    spread = off.groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, 1000).alias(f"w{i}") for i in dims])
    both = _beside(off, written(spread, "quality-spreads"), keys)
    square = [F.pow(F.col(f"x{i}") - F.col(f"c{i}"), 2) for i in dims]
    scaled = [square[i] / (F.pow(f"w{i}", 2) + FLOOR) for i in dims]
    return both.select(*fit.columns, F.posexplode(F.array(sum(square), sum(scaled))).alias("start_", "d2"))


def _fit(rows: DataFrame, keys: list[str], support: float, steps: int) -> DataFrame:
    """The estimate of each group, from the texts that pass the base rule.

    A step estimates from the ``support`` share with the smallest d2.  All groups and both
    starts go together, until no determinant falls; a group takes its smallest one."""
    fit = rows.where("not base_failed").select(*keys, *[f"x{i}" for i in range(DIMS)])
    ordered, by, last = _starts(fit, keys), ["start_", *keys], None
    every = fit.select("*", F.posexplode(F.array(*[F.lit(0)] * STARTS)).alias("start_", "d2")).drop("d2")
    for _ in range(steps):
        bounds = ordered.groupBy(*by).agg(F.percentile_approx("d2", support, 1000).alias("bound"))
        estimates = _estimates(_beside(ordered, bounds, by).withColumn("inside", F.col("d2") <= F.col("bound")), by)
        if last is not None:  # one number per step
            fall = _beside(estimates, last.select(*by, F.col("logdet").alias("before")), by).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
            if fall is None or fall <= TOLERANCE:
                break
        last = estimates
        ordered = _distances(every, estimates, by)
    best = estimates.groupBy(*keys).agg(F.min(F.struct("logdet", "m", "a")).alias("best"))
    return written(best.select(*keys, "best.*"), "quality-best")


def fence(distances: DataFrame, width: float = FENCE) -> float:
    """A cutoff from the distances alone: ``width`` quartile ranges above the upper quartile,
    in logarithms.  Infinite if there are no distances."""
    logs = distances.where("d2 > 0").agg(F.percentile_approx(F.log("d2"), [0.25, 0.75], 10_000)).first()[0]
    return math.exp(min(logs[1] + width * (logs[1] - logs[0]), 700.0)) if logs else math.inf


def best_cutoff(distances: np.ndarray, good: np.ndarray, clean: float = CLEAN) -> float | None:
    """The cutoff of least cost on labelled texts: the geometric middle of the widest gap
    between neighbouring distances among those of least cost.  None without both labels, or
    if rejecting none of them costs least."""
    order = np.argsort(distances, kind="stable")
    d, g = distances[order], good[order]
    if not g.any() or g.all():
        return None
    cost = np.cumsum(~g) + clean * (g.sum() - np.cumsum(g))  # after rejecting all beyond entry k
    gaps = np.append(np.log(np.maximum(d[1:], 1e-9)) - np.log(np.maximum(d[:-1], 1e-9)), np.inf)
    cost = np.where(gaps > 0, cost, np.inf)  # equal distances are not parted
    if cost[-1] <= cost.min():
        return None
    k = max(np.flatnonzero(cost == cost.min()), key=lambda at: gaps[at])
    return float(np.sqrt(max(d[k], 1e-9) * d[k + 1]))


def fit_cutoff(distances: DataFrame, labels: DataFrame | None, clean: float = CLEAN) -> float:
    """A cutoff of squared distances for rows of doc_id, d2.

    ``labels`` (doc_id, quality 0 or 1): all their documents are compared, by the rule of
    ``best_cutoff``, on running counts over the ordered distances; one row reaches the driver.  The
    largest distance of a document's rows counts; of conflicting labels the worse; null ids and labels are not read.
    Without usable labels the cutoff is ``fence``.
    """
    distances = distances.where("d2 is not null")
    if labels is not None:
        known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        rows = distances.join(known, "doc_id").groupBy("doc_id").agg(F.greatest(F.max("d2"), F.lit(1e-9)).alias("d"), F.first("quality").alias("quality"))
        counts = rows.groupBy("d").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad"))
        sums = {"upto_good": F.col("good"), "upto_bad": F.col("bad")}
        upto = written(global_running_sum(counts, ["d"], sums, "at").select("at", "d", *sums), "quality-upto")
        good, bad = upto.agg(F.max("upto_good"), F.max("upto_bad")).first()
        if good and bad:
            following = upto.select((F.col("at") - 1).alias("at"), F.col("d").alias("after"))
            cost = F.col("upto_bad") + F.lit(float(clean)) * (good - F.col("upto_good"))  # after rejecting all beyond d
            steps = upto.join(following, "at").select("d", "after", cost.alias("cost"), (F.log("after") - F.log("d")).alias("gap"))
            best = steps.where("gap > 0").orderBy("cost", F.col("gap").desc(), "d").first()  # one row
            if best is not None and best["cost"] < bad:
                return math.sqrt(best["d"] * best["after"])
    return fence(distances)


def _kept(cutoff: float) -> Column:
    return F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce("d2", F.lit(0.0)) <= cutoff)


def _learned(rows: DataFrame, keys: list[str], labels: DataFrame | None, cutoff: float | None, support: float, steps: int) -> tuple[DataFrame, float]:
    """The estimates, and the cutoff if it is not given."""
    estimates = _fit(rows, keys, support, steps)
    if cutoff is None:
        passed = _distances(rows.where("not base_failed"), estimates, keys)
        cutoff = fit_cutoff(passed.select(F.col("other0").alias("doc_id"), "d2"), labels)
    return estimates, cutoff


def judge(
    docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), labels: DataFrame | None = None, cutoff: float | None = None,
    support: float = SUPPORT, steps: int = STEPS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keys``, STATS, base_failed, d2, kept.

    The first orders come from medians (``_starts``).  Each step takes the
    ``support`` share of a group with the smallest distances, a quantile sketch
    per group, and estimates again, until no group's determinant falls.  Texts
    that fail the base rule are in no estimate; null keys are a group of their
    own.  Null or empty texts have no words and fail; very long texts are measured
    whole.  ``cutoff`` is learned from ``labels`` (``fit_cutoff``) unless given.
    """
    keys = list(keys)
    rows = written(_measured(docs, keys, docs["doc_id"]), "quality-stats")
    estimates, cutoff = _learned(rows, keys, labels, cutoff, support, steps)
    out = _distances(rows, estimates, keys)
    return out.select(F.col("other0").alias("doc_id"), *keys, *STATS, "base_failed", "d2", _kept(cutoff).alias("kept"))


def keep(
    docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), labels: DataFrame | None = None, cutoff: float | None = None,
    support: float = SUPPORT, steps: int = STEPS,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all their columns.

    Texts are measured again in the last pass, which costs less than shuffling
    them to meet their verdicts: only the estimates, one row a group, are joined.
    """
    keys = list(keys)
    rows = written(_measured(docs, keys, docs["doc_id"]), "quality-stats")
    estimates, cutoff = _learned(rows, keys, labels, cutoff, support, steps)
    again = _distances(_measured(docs, keys, F.struct(*[docs[f"`{c}`"] for c in docs.columns])), estimates, keys)
    return again.where(_kept(cutoff)).select("other0.*")


@query("op10_quality_rules")
def op10_quality_rules(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "lang", "source", "text")
    out = judge(docs, labels=table(spark, sf, "labels", "doc_id", "quality"))
    return out.select("doc_id", *STATS, "base_failed", "kept")
