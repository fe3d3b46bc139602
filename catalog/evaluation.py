"""Evaluation sets, metrics and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    DICT, VOCAB, as_bigint, dictionary, documents, evtok, hkey, query, rounded, table, tok, utt, vocabulary,
)
from wordloom.functions import arrays as ar, scaling as sc, text as tx
from wordloom.functions.keys import hash_key
from wordloom.session import scratch_dir
from wordloom.operators import curate as cu, evalset as ev, metrics as me
from wordloom.operators.ordering import running_by_group


# --- fixtures -----------------------------------------------------------------------
def turn_pairs(spark, sf):
    """Each turn with the next one: conv_id, turn, s1, s2."""
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s2"))
    return rows.withColumnRenamed("text", "s1").join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", "s1", "s2")


PAIRS = (
    "pairs AS (SELECT a.conv_id, a.turn, a.text AS s1, b.text AS s2 FROM conversations a "
    "JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
)


def sentences(spark, sf):
    """Dot sentences of all documents: doc_id, part_no, sentence."""
    return cu.explode_parts(documents(spark, sf, "doc_id", "text"), tx.dot_sentences("text"), "text", "sentence")


SENTENCES = (
    "sents AS (SELECT doc_id, unnest(range(0, len(p))) AS part_no, unnest(p) AS sentence "
    "FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents))"
)


def coverage_set(spark, sf):
    """task, k1, k2, text over three evaluation sets."""
    pick = lambda task, k1, k2, t: [F.lit(task).alias("task"), F.col(k1).alias("k1"), F.col(k2).cast("bigint").alias("k2"), t.alias("text")]
    single = sentences(spark, sf).select(*pick("sentences", "doc_id", "part_no", F.col("sentence")))
    bench = table(spark, sf, "benchmark").select(*pick("benchmark", "item_id", "item_id", F.col("text")))
    pairs = turn_pairs(spark, sf).select(*pick("pairs", "conv_id", "turn", F.concat_ws(" ", "s1", "s2")))
    return single.unionByName(bench).unionByName(pairs)


COVERAGE_SET = (
    f"{SENTENCES}, {PAIRS}, cs AS (SELECT 'sentences' AS task, sentence AS text FROM sents "
    "UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'pairs', s1 || ' ' || s2 FROM pairs)"
)


def _coverage_sql(tokens: str) -> str:
    return f"""
WITH {VOCAB}, {COVERAGE_SET}, n AS (SELECT task, row_number() OVER () AS id, {tokens} AS w FROM cs),
x AS (SELECT id, unnest(w) AS word FROM n),
h AS (SELECT id, count(*) AS k, count(vocab.word) AS i FROM x LEFT JOIN vocab USING (word) GROUP BY id),
f AS (SELECT task, coalesce(k, 0) AS k, coalesce(i, 0) AS i FROM n LEFT JOIN h USING (id))
SELECT task, round(avg(CASE WHEN k = i THEN 1.0 ELSE 0 END), 6) AS complete,
round(avg(CASE WHEN k = i OR k = i + 1 THEN 1.0 ELSE 0 END), 6) AS complete_or_1_missing,
round(avg(CASE WHEN k <= i * 1.25 THEN 1.0 ELSE 0 END), 6) AS mostly FROM f GROUP BY task"""


# --- text of examples ---------------------------------------------------------------------
@query("eval_tokens", f"SELECT doc_id, array_to_string({evtok('text')}, ' ') AS tokens FROM documents")
def _(spark, sf):
    return documents(spark, sf, "doc_id", F.array_join(tx.eval_tokens("text"), " ").alias("tokens"))


@query("example_text", f"WITH {PAIRS} SELECT conv_id, turn, s1 || ' ' || s2 AS text FROM pairs")
def _(spark, sf):
    df = turn_pairs(spark, sf).withColumnsRenamed({"s1": "sentence1", "s2": "sentence2"})
    return df.select("conv_id", "turn", ev.example_text(df.columns, ev.TaskSpec("mrpc")).alias("text"))


@query("pair_columns", f"WITH {PAIRS} SELECT conv_id, turn, s1 || ' ' || s2 AS text FROM pairs")
def _(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", F.concat_ws(" ", "s1", "s2").alias("text"))


@query("instance_text", f"WITH {PAIRS} SELECT conv_id, turn, s1 || ' ' || s2 || ' ' AS text FROM pairs")
def _(spark, sf):
    df = turn_pairs(spark, sf).withColumnsRenamed({"s1": "question", "s2": "sentence"})
    return df.select("conv_id", "turn", tx.instance_text(df.columns, ev.INSTANCE_FIELDS).alias("text"))


@query("strip_predictions", r"""
SELECT conv_id, turn, trim(text || chr(10), chr(32) || chr(9) || chr(10) || chr(13)) AS prediction,
       trim('  ' || text, chr(32) || chr(9) || chr(10) || chr(13)) AS label FROM conversations""")
def _(spark, sf):
    rows = table(
        spark, sf, "conversations", "conv_id", "turn", F.concat("text", F.lit("\n")).alias("prediction"),
        F.concat(F.lit("  "), "text").alias("label"),
    )
    return ev.strip_predictions(rows).withColumn("label", F.array_join("label", "|"))


# --- filters and coverage ----------------------------------------------------------------------
_KEPT = f"""x AS (SELECT k1, k2, unnest({evtok('t')}) AS word FROM e),
bad AS (SELECT DISTINCT k1, k2 FROM x WHERE word NOT IN (SELECT word FROM vocab))"""


@query("filter_eval_examples", f"""
WITH {VOCAB}, {SENTENCES}, e AS (SELECT doc_id AS k1, part_no AS k2, sentence AS t FROM sents), {_KEPT}
SELECT e.k1 AS doc_id, CAST(e.k2 AS BIGINT) AS part_no, e.t AS sentence FROM e LEFT JOIN bad USING (k1, k2) WHERE bad.k1 IS NULL""")
def _(spark, sf):
    kept = ev.filter_eval_examples(sentences(spark, sf), vocabulary(spark, sf), ev.TaskSpec("cola"), ["doc_id", "part_no"])
    return as_bigint(kept, "part_no")


@query("filter_eval_dataset", f"""
WITH {VOCAB}, {SENTENCES}, e AS (SELECT doc_id AS k1, part_no AS k2, sentence AS t FROM sents), {_KEPT}
SELECT e.k1 AS id, e.t AS article, CAST(e.k2 AS BIGINT) AS part_no FROM e LEFT JOIN bad USING (k1, k2) WHERE bad.k1 IS NULL""")
def _(spark, sf):
    """Text columns by position, as for a reading-comprehension set."""
    rows = sentences(spark, sf).select(F.col("doc_id").alias("id"), F.col("sentence").alias("article"), "part_no")
    kept = ev.filter_eval_examples(rows, vocabulary(spark, sf), ev.TaskSpec("race"), ["id", "part_no"])
    return as_bigint(kept, "part_no")


@query("filter_eval_examples_join", f"""
WITH {VOCAB}, {SENTENCES}, e AS (SELECT doc_id AS k1, part_no AS k2, sentence AS t FROM sents), {_KEPT}
SELECT e.k1 AS doc_id, CAST(e.k2 AS BIGINT) AS part_no, e.t AS sentence FROM e LEFT JOIN bad USING (k1, k2) WHERE bad.k1 IS NULL""")
def _(spark, sf):
    """The form for vocabularies beyond the inline bound."""
    kept = ev.filter_eval_examples(
        sentences(spark, sf), vocabulary(spark, sf), ev.TaskSpec("cola"), ["doc_id", "part_no"], inline=0
    )
    return as_bigint(kept, "part_no")


def _coverage(spark, sf, tokens):
    out = ev.eval_coverage(coverage_set(spark, sf), vocabulary(spark, sf), ["task", "k1", "k2"], tokens)
    return rounded(out, "complete", "complete_or_1_missing", "mostly")


@query("eval_coverage", _coverage_sql(evtok("text")))
def _(spark, sf):
    return _coverage(spark, sf, tx.eval_tokens("text"))


@query("eval_coverage_plain", _coverage_sql(utt("text", "C")))
def _(spark, sf):
    """The repeat with plain tokens: no name rule, empty tokens are missing."""
    return _coverage(spark, sf, tx.utterance_tokens("text", "C"))


@query("dictionary_report", f"""
WITH {DICT}, w AS (SELECT word, count(*) AS frequency FROM (SELECT unnest({utt('text', 'C')}) AS word FROM conversations) GROUP BY word)
SELECT word, word IN (SELECT word FROM dict) AS in_dictionary, frequency FROM w""")
def _(spark, sf):
    rows = table(spark, sf, "conversations", "text")
    return ev.dictionary_report(rows, tx.utterance_tokens("text", "C"), dictionary(spark, sf))


# --- arrays ---------------------------------------------------------------------------------------
def token_ids(spark, sf):
    """doc_id, ids: one id per token of the whole text, 4 + its length."""
    ids = F.transform(tx.word_tokens("text"), lambda t: (F.length(t) + 4).cast("int"))
    return documents(spark, sf, "doc_id", ids.alias("ids"))


IDS = f"ids AS (SELECT doc_id, list_transform({tok('text')}, lambda t: length(t) + 4) AS ids FROM documents)"


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ") for c in columns})


@query("pad_array", f"""
WITH {IDS} SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(0, greatest(128 - len(ids), 0)), lambda x: 3)), ' ') AS ids FROM ids""")
def _(spark, sf):
    return _joined(token_ids(spark, sf).withColumn("ids", ar.pad_array("ids", 128, 3)), "ids")


@query("truncate_array", f"WITH {IDS} SELECT doc_id, array_to_string(ids[1:128], ' ') AS ids FROM ids")
def _(spark, sf):
    return _joined(token_ids(spark, sf).withColumn("ids", ar.truncate_array("ids", 128)), "ids")


@query("pad_to_batch_max", f"""
WITH {IDS}, b AS (SELECT doc_id, doc_id // 32 AS batch, ids FROM ids), m AS (SELECT batch, greatest(max(len(ids)), 1) AS m FROM b GROUP BY batch)
SELECT doc_id, batch, array_to_string(list_concat(ids, list_transform(range(0, m - len(ids)), lambda x: 3)), ' ') AS ids FROM b JOIN m USING (batch)""")
def _(spark, sf):
    rows = token_ids(spark, sf).withColumn("batch", F.floor(F.col("doc_id") / 32))
    return _joined(ev.pad_to_batch_max(rows, "ids", "batch", 3), "ids").select("doc_id", "batch", "ids")


# --- labels and predictions ---------------------------------------------------------------------------
@query("label_list", """
SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT event_type AS label FROM events)""")
def _(spark, sf):
    return me.label_list(table(spark, sf, "events", F.col("event_type").alias("label")))


@query("encode_labels", """
WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> 'error'))
SELECT event_id, CASE WHEN event_type = 'error' THEN '-1' ELSE event_type END AS label,
CASE WHEN event_type = 'error' THEN -1 ELSE label_id END AS label_id FROM events LEFT JOIN l ON event_type = label""")
def _(spark, sf):
    rows = table(
        spark, sf, "events", "event_id", F.when(F.col("event_type") == "error", "-1").otherwise(F.col("event_type")).alias("label")
    )
    return me.encode_labels(rows, me.label_list(rows.where("label <> '-1'"))).select("event_id", "label", "label_id")


@query("predict_argmax", """
WITH p AS (SELECT vec_id, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS prediction FROM embeddings)
SELECT vec_id, CAST(prediction AS BIGINT) AS prediction, 'class ' || prediction AS prediction_label FROM p
WHERE prediction IN (SELECT label FROM embeddings) UNION ALL
SELECT vec_id, prediction, NULL FROM p WHERE prediction NOT IN (SELECT label FROM embeddings)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings", "vec_id", F.slice("embedding", 1, 10).alias("logits"), "label")
    names = rows.select(F.col("label").cast("bigint").alias("label_id")).distinct()
    names = names.withColumn("label", F.concat(F.lit("class "), F.col("label_id").cast("string")))
    return me.predict_argmax(rows, "logits", names).select("vec_id", "prediction", "prediction_label")


@query("write_predictions", """
SELECT event_id AS "index", printf('%.3f', value) AS prediction FROM events""")
def _(spark, sf):
    from wordloom.sources.writers import write_predictions

    path = scratch_dir(spark, "predictions")
    write_predictions(table(spark, sf, "events"), path, "event_id", "value", regression=True)
    return spark.read.schema("index bigint, prediction string").option("header", True).csv(path, sep="\t")


# --- metrics ----------------------------------------------------------------------------------------------
_PRED = f"lp AS (SELECT quality AS label, toxic, {hkey(0, 'doc_id')} % 2 AS prediction FROM labels)"
_CELLS = (
    "c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE prediction = label)::DOUBLE AS hit, "
    "count(*) FILTER (WHERE prediction = 1 AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE prediction = 1 AND label <> 1)::DOUBLE AS fp, "
    "count(*) FILTER (WHERE prediction <> 1 AND label = 1)::DOUBLE AS fn, count(*) FILTER (WHERE prediction <> 1 AND label <> 1)::DOUBLE AS tn FROM lp)"
)


def _gold(spark, sf):
    return table(
        spark, sf, "labels", F.col("quality").alias("label"), "toxic", (hash_key(0, "doc_id") % 2).alias("prediction")
    )


@query("classification_metrics_cola", f"""
WITH {_PRED}, {_CELLS} SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS matthews_correlation FROM c""")
def _(spark, sf):
    return rounded(me.classification_metrics(_gold(spark, sf), task="cola"), "matthews_correlation")


@query("classification_metrics_sst2", f"WITH {_PRED}, {_CELLS} SELECT round(hit / n, 6) AS accuracy FROM c")
def _(spark, sf):
    return rounded(me.classification_metrics(_gold(spark, sf), task="sst2"), "accuracy")


@query("classification_metrics_mrpc", f"""
WITH {_PRED}, {_CELLS} SELECT round(hit / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
round((hit / n + 2 * tp / (2 * tp + fp + fn)) / 2, 6) AS combined_score FROM c""")
def _(spark, sf):
    return rounded(me.classification_metrics(_gold(spark, sf), task="mrpc"), "accuracy", "f1", "combined_score")


_REG = "r AS (SELECT CAST(n_chars AS DOUBLE) AS label, CAST(len(string_split(text, ' ')) * 6 AS DOUBLE) AS prediction FROM documents)"


def _scores(spark, sf):
    return documents(
        spark, sf, F.col("n_chars").cast("double").alias("label"), (tx.count_words("text") * 6).cast("double").alias("prediction")
    )


@query("classification_metrics_stsb", f"""
WITH {_REG}, k AS (SELECT label, prediction, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS a,
rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2 AS b FROM r)
SELECT round(corr(prediction, label), 6) AS pearson, round(corr(a, b), 6) AS spearmanr,
round((corr(prediction, label) + corr(a, b)) / 2, 6) AS combined_score FROM k""")
def _(spark, sf):
    return rounded(me.classification_metrics(_scores(spark, sf), task="stsb"), "pearson", "spearmanr", "combined_score")


@query("classification_metrics_regression", f"WITH {_REG} SELECT round(avg((prediction - label) * (prediction - label)), 4) AS mse FROM r")
def _(spark, sf):
    return rounded(me.classification_metrics(_scores(spark, sf), regression=True), "mse", digits=4)


@query("classification_metrics_default", f"WITH {_PRED}, {_CELLS} SELECT round(hit / n, 6) AS accuracy FROM c")
def _(spark, sf):
    return rounded(me.classification_metrics(_gold(spark, sf)), "accuracy")


@query("matched_mismatched", f"""
WITH {_PRED} SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0 END) FILTER (WHERE toxic = 0), 6) AS accuracy,
round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0 END) FILTER (WHERE toxic = 1), 6) AS accuracy_mm FROM lp""")
def _(spark, sf):
    rows = _gold(spark, sf)
    out = me.matched_mismatched(rows.where("toxic = 0"), rows.where("toxic = 1"), "prediction", "label")
    return rounded(out, "accuracy", "accuracy_mm")


# --- evaluation log -------------------------------------------------------------------------------------------
def eval_log(spark, sf):
    """run_name, step, loss, perplexity from the event table."""
    rows = table(spark, sf, "events", F.col("user_id").alias("run_name"), "ts", "event_id", (F.col("value") / 100).alias("loss"))
    numbered = running_by_group(rows, ["run_name"], ["ts", "event_id"], {}, position="step")
    return numbered.select("run_name", (F.col("step") + 1).alias("step"), "loss", sc.perplexity("loss").alias("perplexity"))


LOG = (
    "log AS (SELECT user_id AS run_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, "
    "value / 100 AS loss, exp(value / 100) AS perplexity FROM events)"
)


@query("perplexity", f"WITH {LOG} SELECT run_name, step, round(perplexity, 6) AS perplexity FROM log")
def _(spark, sf):
    return rounded(eval_log(spark, sf).select("run_name", "step", "perplexity"), "perplexity")


@query("mlm_eval_loss", f"""
WITH {LOG}, b AS (SELECT run_name, step // 5 AS batch, avg(loss) AS m, sum(loss) AS s, count(*) AS n FROM log GROUP BY ALL)
SELECT run_name, round(avg(m), 11) AS loss, round(sum(s) / sum(n), 11) AS weighted_loss, round(exp(avg(m)), 11) AS perplexity FROM b GROUP BY run_name""")
def _(spark, sf):
    log = eval_log(spark, sf).withColumn("batch", F.floor(F.col("step") / 5))
    return rounded(me.mlm_eval_loss(log, ["batch"], by=["run_name"]), "loss", "weighted_loss", "perplexity", digits=11)


@query("best_checkpoint", f"""
WITH {LOG} SELECT run_name, step, round(perplexity, 6) AS perplexity FROM log
QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY perplexity, step) = 1""")
def _(spark, sf):
    return rounded(me.best_checkpoint(eval_log(spark, sf)), "perplexity")


@query("running_best", f"""
WITH {LOG} SELECT run_name, step, round(min(perplexity) OVER (PARTITION BY run_name ORDER BY step), 6) AS best_so_far FROM log""")
def _(spark, sf):
    return rounded(me.running_best(eval_log(spark, sf)), "best_so_far").select("run_name", "step", "best_so_far")


@query("decile_checkpoints", """
WITH n AS (SELECT user_id AS run_name, count(*) AS n_batches FROM events GROUP BY 1)
SELECT run_name, n_batches, CAST(p AS INT) AS pct, CAST(floor(n_batches * p / 100) AS BIGINT) AS batch_idx
FROM n, (SELECT unnest(range(0, 101, 10)) AS p)""")
def _(spark, sf):
    runs = table(spark, sf, "events", F.col("user_id").alias("run_name")).groupBy("run_name").agg(F.count(F.lit(1)).alias("n_batches"))
    return me.decile_checkpoints(runs)
