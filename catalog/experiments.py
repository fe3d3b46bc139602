"""Experiment tables: configurations, costs, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import frequencies, query, rounded, table
from catalog.evaluation import LOG, eval_log
from wordloom.functions import scaling as sc
from wordloom.operators import curves as cv, metrics as me, runs as ru, vocab as vo


def run_table(spark, sf):
    """One configuration per user of the event table."""
    u = F.col("run_name")
    rows = table(spark, sf, "events", F.col("user_id").alias("run_name")).distinct()
    rows = rows.select(
        "run_name", (16 * F.pow(F.lit(2), u % 3)).cast("bigint").alias("embedding_size"),
        (32 * F.pow(F.lit(2), u % 4)).cast("bigint").alias("hidden_size"),
        (128 * F.pow(F.lit(2), u % 4)).cast("bigint").alias("intermediate_size"),
        F.pow(F.lit(2), u % 2 + 1).cast("bigint").alias("num_attention_heads"),
        (1 + u % 6).alias("num_hidden_layers"),
    )
    e, h, i, n = (F.col(c) for c in ("embedding_size", "hidden_size", "intermediate_size", "num_hidden_layers"))
    return rows.withColumn("total_parameters", 19010 * e + e * h + n * (4 * h * h + 2 * h * i))


RUNS = (
    "cfg AS (SELECT DISTINCT user_id AS run_name, CAST(16 * pow(2, user_id % 3) AS BIGINT) AS embedding_size, "
    "CAST(32 * pow(2, user_id % 4) AS BIGINT) AS hidden_size, CAST(128 * pow(2, user_id % 4) AS BIGINT) AS intermediate_size, "
    "CAST(pow(2, user_id % 2 + 1) AS BIGINT) AS num_attention_heads, 1 + user_id % 6 AS num_hidden_layers FROM events), "
    "runs AS (SELECT *, 19010 * embedding_size + embedding_size * hidden_size + num_hidden_layers * "
    "(4 * hidden_size * hidden_size + 2 * hidden_size * intermediate_size) AS total_parameters FROM cfg)"
)
FLOPS = (
    "3.0::DOUBLE * (2 * 128 * embedding_size * 19010 + 2 * 128 * embedding_size * hidden_size + num_hidden_layers * "
    "(6 * 128 * hidden_size * hidden_size + 2 * 128 * 128 * hidden_size + 3 * num_attention_heads * 128 * 128 "
    "+ 4 * 128 * hidden_size * intermediate_size) + 2 * 128 * hidden_size * 19010)"
)


def _flops():
    return sc.flops_hoffman(*ru.CONFIG_COLUMNS)


@query("flops_hoffman", f"WITH {RUNS} SELECT run_name, {FLOPS} AS flops FROM runs")
def _(spark, sf):
    return run_table(spark, sf).select("run_name", _flops().alias("flops"))


@query("flops_kaplan", f"WITH {RUNS} SELECT run_name, 6.0::DOUBLE * (total_parameters - 19010 * embedding_size) * 128 AS flops FROM runs")
def _(spark, sf):
    rest = F.col("total_parameters") - 19010 * F.col("embedding_size")
    return run_table(spark, sf).select("run_name", sc.flops_kaplan(rest).alias("flops"))


@query("size_bucket", f"""
WITH {RUNS} SELECT run_name, CASE WHEN total_parameters <= 3125122 THEN 'q1' WHEN total_parameters <= 7601346 THEN 'q2'
WHEN total_parameters <= 11304258 THEN 'q3' ELSE 'q4' END AS band FROM runs""")
def _(spark, sf):
    return run_table(spark, sf).select("run_name", sc.size_bucket("total_parameters").alias("band"))


@query("config_bucket", f"""
WITH {RUNS} SELECT run_name, CASE WHEN hidden_size <= 32 THEN 'q1' WHEN hidden_size <= 64 THEN 'q2' WHEN hidden_size <= 128 THEN 'q3'
ELSE 'q4' END AS band, 'Hidden size = ' || hidden_size AS label FROM runs""")
def _(spark, sf):
    return run_table(spark, sf).select(
        "run_name", sc.config_bucket("hidden_size").alias("band"), sc.config_label("hidden_size", "hidden_size").alias("label")
    )


@query("param_percentiles", f"""
WITH {RUNS} SELECT round(quantile_cont(total_parameters::DOUBLE, 0.25), 4) AS p25, round(quantile_cont(total_parameters::DOUBLE, 0.5), 4) AS p50,
round(quantile_cont(total_parameters::DOUBLE, 0.75), 4) AS p75, round(quantile_cont(total_parameters::DOUBLE, 1.0), 4) AS p100 FROM runs""")
def _(spark, sf):
    return rounded(ru.param_percentiles(run_table(spark, sf), "total_parameters"), "p25", "p50", "p75", "p100", digits=4)


@query("bucket_labels", f"""
WITH {RUNS}, p AS (SELECT unnest([1, 2, 3, 4]) AS band,
unnest(quantile_cont(total_parameters::DOUBLE, [0.25, 0.5, 0.75, 1.0])) AS upper FROM runs),
s AS (SELECT band, upper, CAST(round_even(upper / 1000000, 0) AS BIGINT) AS size FROM p)
SELECT CAST(band AS BIGINT) AS band, round(upper, 4) AS upper, coalesce(lag(size) OVER (ORDER BY band), 0) || ' < Num. par. <= ' || size || ' Mil.' AS label FROM s""")
def _(spark, sf):
    return rounded(ru.bucket_labels(run_table(spark, sf), "total_parameters"), "upper", digits=4)


@query("runs_with_evals", f"WITH {RUNS}, {LOG} SELECT runs.*, step, loss, round(perplexity, 6) AS perplexity FROM log JOIN runs USING (run_name)")
def _(spark, sf):
    return rounded(ru.runs_with_evals(run_table(spark, sf), eval_log(spark, sf)), "perplexity")


@query("run_config_lookup", f"""
WITH {RUNS} SELECT event_id, hidden_size, num_hidden_layers FROM events LEFT JOIN runs ON user_id = run_name""")
def _(spark, sf):
    wanted = table(spark, sf, "events", "event_id", F.col("user_id").alias("run_name"))
    return ru.run_config_lookup(run_table(spark, sf), wanted).select("event_id", "hidden_size", "num_hidden_layers")


@query("upsert_run_map", f"""
WITH {RUNS}, newer AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 20)
SELECT run_name, CASE WHEN run_name IN (SELECT user_id FROM newer) THEN hidden_size * 2 ELSE hidden_size END AS hidden_size FROM runs""")
def _(spark, sf):
    base = run_table(spark, sf).select("run_name", "hidden_size")
    again = table(spark, sf, "events").where("event_type = 'error' AND value > 20").select(F.col("user_id").alias("run_name")).distinct()
    return ru.upsert_run_map(base, base.join(again, "run_name").select("run_name", (F.col("hidden_size") * 2).alias("hidden_size")))


_GRID = {"num_hidden_layers": [2, 1], "hidden_size": [128, 64], "embedding_size": [16, 8]}
_GRID_SQL = (
    "pts(feature, value) AS (VALUES ('num_hidden_layers', 2), ('num_hidden_layers', 1), ('hidden_size', 128), ('hidden_size', 64), "
    "('embedding_size', 16), ('embedding_size', 8)), grid AS (SELECT run_name, total_parameters, feature, "
    "CAST(CASE WHEN feature = 'embedding_size' THEN value ELSE embedding_size END AS BIGINT) AS embedding_size, "
    "CAST(CASE WHEN feature = 'hidden_size' THEN value ELSE hidden_size END AS BIGINT) AS hidden_size, intermediate_size, num_attention_heads, "
    "CAST(CASE WHEN feature = 'num_hidden_layers' THEN value ELSE num_hidden_layers END AS BIGINT) AS num_hidden_layers FROM runs, pts)"
)


@query("config_grid", f"WITH {RUNS}, {_GRID_SQL} SELECT * FROM grid")
def _(spark, sf):
    return ru.vary_configs(run_table(spark, sf), _GRID)


@query("skip_configs", f"WITH {RUNS}, {_GRID_SQL} SELECT * FROM grid WHERE NOT (hidden_size = 64 AND num_hidden_layers > 4)")
def _(spark, sf):
    grid = ru.vary_configs(run_table(spark, sf), _GRID)
    return ru.skip_configs(grid, (F.col("hidden_size") == 64) & (F.col("num_hidden_layers") > 4))


def _results(spark, sf):
    return table(spark, sf, "events", "event_id", F.col("event_type").alias("tokenizer"), "value")


@query("filter_tokenizer_type", """
SELECT event_id, event_type AS tokenizer, value, CAST(CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS BIGINT) AS list_pos
FROM events WHERE event_type IN ('purchase', 'click') ORDER BY list_pos, event_id""")
def _(spark, sf):
    return ru.filter_tokenizer_type(_results(spark, sf), ["purchase", "click"]).orderBy("list_pos", "event_id")


@query("concat_results", """
SELECT event_id, event_type AS tokenizer, value FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    rows = _results(spark, sf)
    parts = [ru.filter_tokenizer_type(rows, [n]).drop("list_pos") for n in ("click", "error")]
    return parts[0].unionByName(parts[1])


@query("scaling_fit", f"""
WITH {RUNS}, {LOG}, m AS (SELECT run_name, min(perplexity) AS y FROM log GROUP BY 1), f AS (SELECT {FLOPS} AS x, y FROM m JOIN runs USING (run_name))
SELECT round(regr_slope(ln(y), ln(x)), 6) AS exponent, round(exp(regr_intercept(ln(y), ln(x))), 6) AS factor FROM f""")
def _(spark, sf):
    best = me.best_checkpoint(eval_log(spark, sf)).join(run_table(spark, sf), "run_name")
    return rounded(me.scaling_fit(best.select(_flops().alias("x"), "perplexity"), "x", "perplexity"), "exponent", "factor")


@query("power_fit")
def _(spark, sf):
    """Frequency as a power of the rank with an offset, over all words (no SQL form: iterated)."""
    ranked = vo.word_rank(frequencies(spark, sf))
    return rounded(cv.power_fit(ranked.select((F.col("word_rank") + 1).alias("rank"), "frequency"), "rank", "frequency"), "factor", "exponent", "offset", digits=3)
