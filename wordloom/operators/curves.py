"""Least-squares fit of y = a * x^b + c.

Each pass over the rows is one aggregation of a few sums; the driver solves three
equations.  A first pass tries many exponents at once, for each of which a and c
follow from sums; Gauss-Newton steps with damping start at the best one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wordloom.session import checkpointed, local_table

GRID = tuple(sign * 0.05 * 1.3**k for sign in (1, -1) for k in range(24))  # exponents tried first, for logarithms within ±1
STEPS = 60         # at most so many passes
TOLERANCE = 1e-12  # relative fall of the squares' sum from which steps go on
SCHEMA = "factor double, exponent double, offset double, rss double, n bigint"


def power_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: factor a, exponent b, offset c, rss (sum of squared residuals) and n.

    Rows with x <= 0, nulls, infinities or NaN are not read.  With fewer than three
    different x no curve is determined: a, b, c and rss are null.  Equal y give
    factor 0 and exponent 0.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(F.ln(xs).alias("lx"), ys.alias("y")).where("lx between -1e300 and 1e300 and y between -1e300 and 1e300")
    rows = checkpointed(rows)
    spark = df.sparkSession
    base = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("lx").alias("lx"), F.min("lx").alias("low"), F.max("lx").alias("high"),
        F.avg("y").alias("y"), F.stddev_pop("y").alias("sy"),
    ).first()
    others = rows.where((F.col("lx") > F.lit(base["low"])) & (F.col("lx") < F.lit(base["high"])))
    if base["n"] < 3 or others.isEmpty():
        return local_table(spark, [(None, None, None, None, base["n"])], SCHEMA)
    if not base["sy"]:
        return local_table(spark, [(0.0, 0.0, base["y"], 0.0, base["n"])], SCHEMA)
    span = max(base["high"] - base["lx"], base["lx"] - base["low"])
    # t in [-1, 1] and v of mean 0 and deviation 1: v = a * exp(b * t) + c
    scaled = rows.select(((F.col("lx") - base["lx"]) / span).alias("t"), ((F.col("y") - base["y"]) / base["sy"]).alias("v"))
    at = _start(scaled, base["n"])
    best, sums, damping = None, None, 1e-3
    trial = at
    for _ in range(STEPS):
        got = _sums(scaled, *trial)
        if best is None or got[9] < best:
            fall = math.inf if best is None else best - got[9]
            best, sums, at, damping = got[9], got, trial, damping / 10
            if fall <= TOLERANCE * best or best <= 1e-26 * base["n"]:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
        step = _step(sums, damping)
        trial = tuple(p + d for p, d in zip(at, step))
        if max(abs(d) / (abs(p) + 1e-9) for p, d in zip(at, step)) < 1e-13:
            break
    a, b, c = at
    exponent = b / span
    factor = a * base["sy"] * math.exp(-exponent * base["lx"])
    return local_table(spark, [(factor, exponent, c * base["sy"] + base["y"], best * base["sy"] ** 2, base["n"])], SCHEMA)


def _start(scaled: DataFrame, n: int) -> tuple[float, float, float]:
    """The exponent of GRID with the least squares, and its a and c."""
    grid = F.explode(F.array(*[F.lit(b) for b in GRID])).alias("b")
    power = scaled.select("v", grid, "t").select("b", "v", F.exp(F.col("b") * F.col("t")).alias("p"))
    sums = power.groupBy("b").agg(
        F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("p") * F.col("v")).alias("pv"),
        F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("vv"),
    ).collect()  # a row for each exponent of GRID
    found = []
    for r in sums:
        spread, both = r["pp"] - r["p"] ** 2 / n, r["pv"] - r["p"] * r["v"] / n
        a = both / spread if spread > 0 else 0.0
        found.append((r["vv"] - r["v"] ** 2 / n - a * both, abs(r["b"]), r["b"], a, (r["v"] - a * r["p"]) / n))
    _, _, b, a, c = min(found)
    return a, b, c


def _sums(scaled: DataFrame, a: float, b: float, c: float) -> tuple[float, ...]:
    """Products of the derivatives (six), their products with the residuals (three), squares' sum."""
    power = F.exp(F.lit(b) * F.col("t"))
    rows = scaled.select("v", power.alias("ja"), (F.lit(a) * F.col("t") * power).alias("jb"), F.lit(1.0).alias("jc"))
    rows = rows.select("ja", "jb", "jc", (F.col("v") - F.lit(a) * F.col("ja") - F.lit(c)).alias("r"))
    j = ("ja", "jb", "jc")
    pairs = [(j[i], j[k]) for i in range(3) for k in range(i, 3)] + [(d, "r") for d in j] + [("r", "r")]
    got = tuple(rows.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"s{i}") for i, (p, q) in enumerate(pairs)]).first())
    return got if all(map(math.isfinite, got)) else (*[math.nan] * 9, math.inf)


def _step(sums: tuple[float, ...], damping: float) -> np.ndarray:
    products, k = np.zeros((3, 3)), 0
    for i in range(3):
        for j in range(i, 3):
            products[i, j] = products[j, i] = sums[k]
            k += 1
    damped = products + damping * np.diag(np.maximum(np.diag(products), 1e-12))
    return np.linalg.lstsq(damped, np.array(sums[6:9]), rcond=None)[0]
