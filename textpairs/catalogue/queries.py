"""Queries over the whole sample tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.catalogue import inputs, sql
from textpairs.functions import sequences as seq
from textpairs.functions import text
from textpairs.functions.labels import decode_label, encode_label
from textpairs.functions.scores import argmax, softmax
from textpairs.operators import augment, batches, models, pooling, profile, rank, rows, sample, scoring, spans, split
from textpairs.operators.attention import SpanAttention
from textpairs.operators.dedup import dedup_keep_first
from textpairs.operators.vocab import build_vocab
from textpairs.plans import corpus, inference, sequences, training
from textpairs.sources import metrics as metric_files
from textpairs.sources import pairs as pair_files
from textpairs.sources import predictions, shards
from textpairs.storage import materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.drop_incomplete(inputs.pairs(spark, sf_dir)).withColumn("label", encode_label("label"))


def _stored(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Complete pairs as a table of their own, for operators that pass over them more than once."""
    df = _complete(spark, sf_dir)
    return materialise(df.select(*cols) if cols else df)


def _joined(ids: str | Column) -> Column:
    return F.array_join((F.col(ids) if isinstance(ids, str) else ids).cast("array<string>"), ",")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _big(name: str) -> Column:
    return F.col(name).cast("bigint")


# --- rows, labels, text ---------------------------------------------------------------------------


@query(_with(sql.COMPLETE) + ' SELECT idx AS "index", premise, hypothesis, label FROM complete')
def pairs_complete(spark, sf_dir):
    return _complete(spark, sf_dir)


@query(
    _with(sql.COMPLETE)
    + f""" SELECT idx AS "index", label AS code, {sql.label_name('label')} AS name,
    premise || '[SEP]' || hypothesis AS joined, 3 AS sentinel FROM complete"""
)
def labels_decoded(spark, sf_dir):
    df = _complete(spark, sf_dir)
    named = df.select(
        "index",
        F.col("label").alias("code"),
        decode_label("label").alias("name"),
        text.join_pair_text("premise", "hypothesis").alias("joined"),
        "label",
    )
    return rows.with_sentinel_label(named).withColumnRenamed("label", "sentinel")


@query(_with(sql.COMPLETE) + " SELECT premise, hypothesis, label FROM complete")
def projected_pairs(spark, sf_dir):
    return rows.project_pairs(_complete(spark, sf_dir))


@query(
    _with(sql.DIRTY)
    + f""" SELECT idx AS "index", {sql.clean('premise')} AS premise, {sql.clean('hypothesis')} AS hypothesis, label
    FROM dirty"""
)
def clean_pairs(spark, sf_dir):
    return rows.clean_pairs(inputs.dirty_pairs(spark, sf_dir))


@query(
    _with(sql.DIRTY)
    + f' SELECT idx AS "index", {sql.typo("premise")} AS premise, {sql.typo("hypothesis")} AS hypothesis FROM dirty'
)
def known_typos(spark, sf_dir):
    sides = [text.fix_known_typos(c).alias(c) for c in ("premise", "hypothesis")]
    return inputs.dirty_pairs(spark, sf_dir).select("index", *sides)


_CHARACTER_RULES = """ SELECT idx AS "index", '{0}' AS side, replace(replace({0}, chr(160), ''), chr(8), '') AS deleted,
    regexp_replace({0}, '[《》『』…]', ' ', 'g') AS spaced, replace({0}, '．', '.') AS stopped, {1} AS squeezed FROM dirty"""


@query(
    _with(sql.DIRTY)
    + " UNION ALL ".join(_CHARACTER_RULES.format(c, sql.squeezed(c)) for c in ("premise", "hypothesis"))
)
def character_rules(spark, sf_dir):
    df = inputs.dirty_pairs(spark, sf_dir)
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("t")) for c in ("premise", "hypothesis")])
    return df.select("index", F.explode(sides).alias("s")).select("index", "s.side", "s.t").select(
        "index",
        "side",
        text.delete_chars("t").alias("deleted"),
        text.chars_to_space("t").alias("spaced"),
        text.normalise_stop("t").alias("stopped"),
        text.squeeze_space("t").alias("squeezed"),
    )


@query(_with(sql.PAIRS) + ' SELECT idx AS "index", premise, hypothesis, label FROM pairs WHERE doc_id >= 50 AND doc_id < 150')
def sliced_rows(spark, sf_dir):
    per_doc = inputs.LINES_PER_DOCUMENT
    df = rows.slice_rows(inputs.pairs(spark, sf_dir), 50 * per_doc, 150 * per_doc)
    return df.select("index", "premise", "hypothesis", "label")


# --- profiles -------------------------------------------------------------------------------------


@query(_with(sql.PAIRS) + " SELECT label, count(*) AS n FROM pairs GROUP BY label")
def label_distribution(spark, sf_dir):
    return profile.label_distribution(inputs.pairs(spark, sf_dir))


_LENGTHS = """,
lengths AS (
  SELECT 'premise' AS "column", length(premise) AS len FROM pairs WHERE premise IS NOT NULL
  UNION ALL SELECT 'hypothesis', length(hypothesis) FROM pairs WHERE hypothesis IS NOT NULL)"""


@query(_with(sql.PAIRS) + _LENGTHS + ' SELECT "column", len // 10 * 10 AS bin_start, count(*) AS n FROM lengths GROUP BY ALL')
def length_histogram(spark, sf_dir):
    return profile.length_histogram(inputs.pairs(spark, sf_dir))


@query(
    _with(sql.PAIRS)
    + _LENGTHS
    + """ SELECT "column", count(*) AS n, min(len) AS min_length, max(len) AS max_length,
    round(avg(len), 6) AS avg_length, quantile_cont(len, 0.5)::double AS p50, round(quantile_cont(len, 0.9)::double, 6) AS p90
    FROM lengths GROUP BY ALL"""
)
def length_summary(spark, sf_dir):
    df = profile.length_summary(inputs.pairs(spark, sf_dir))
    return df.withColumn("avg_length", F.round("avg_length", 6)).withColumn("p90", F.round("p90", 6))


@query(
    _with(sql.COMPLETE, sql.DIALOG)
    + """ SELECT 'pairs' AS part, count(*) AS n FROM pairs UNION ALL SELECT 'complete', count(*) FROM complete
    UNION ALL SELECT 'dialog', count(*) FROM dialog"""
)
def dataset_sizes(spark, sf_dir):
    return profile.dataset_sizes(
        pairs=inputs.pairs(spark, sf_dir), complete=_complete(spark, sf_dir), dialog=inputs.dialog(spark, sf_dir)
    )


# --- de-duplication, order, splits, samples -------------------------------------------------------

_UNIQUE = f"""
unique_pairs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY premise || '[SEP]' || hypothesis ORDER BY idx) AS rn FROM complete)
  WHERE rn = 1)"""

_CLEAN_UNIQUE = f"""
cleaned AS (
  SELECT idx, {sql.clean('premise')} AS premise, {sql.clean('hypothesis')} AS hypothesis, label FROM complete),
ready AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY premise || '[SEP]' || hypothesis ORDER BY idx) AS rn FROM cleaned)
  WHERE rn = 1)"""


@query(_with(sql.COMPLETE, _UNIQUE) + ' SELECT idx AS "index", premise, hypothesis, label FROM unique_pairs')
def dedup_pairs(spark, sf_dir):
    return dedup_keep_first(_complete(spark, sf_dir))


@query(_with(sql.COMPLETE, sql.folds("complete")) + ' SELECT idx AS "index", label, fold FROM folded')
def kfold_assign(spark, sf_dir):
    return split.stratified_kfold(_stored(spark, sf_dir, "index", "label"), 5)


@query(
    _with(sql.COMPLETE, _CLEAN_UNIQUE, sql.folds("ready"))
    + " SELECT fold, label, count(*) AS n FROM folded GROUP BY ALL"
)
def kfold_counts(spark, sf_dir):
    return training.fold_report(training.folded_pairs(inputs.pairs(spark, sf_dir), 5))


@query(
    _with(sql.COMPLETE, sql.folds("complete"))
    + """ SELECT run::int AS run, CASE WHEN run = fold THEN 'validation' ELSE 'train' END AS part, label, count(*) AS n,
    sum(idx)::double AS index_sum FROM folded, range(5) t(run) GROUP BY ALL"""
)
def fold_pairs_long(spark, sf_dir):
    folded = split.stratified_kfold(_stored(spark, sf_dir, "index", "label"), 5)
    return (
        split.fold_pairs_long(folded, 5)
        .groupBy("run", "part", "label")
        .agg(F.count("*").alias("n"), F.sum("index").cast("double").alias("index_sum"))
    )


@query(_with(sql.COMPLETE) + ' SELECT label, count(*) AS "count" FROM complete GROUP BY label')
def class_sizes(spark, sf_dir):
    return split.class_sizes(_complete(spark, sf_dir))


_HOLDOUT = f"""
held AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {sql.draw(42, 'idx')}, idx)
    <= floor((count(*) OVER (PARTITION BY label))::double * 0.2::double) THEN 'validation' ELSE 'train' END AS part
  FROM complete)"""


@query(_with(sql.COMPLETE, _HOLDOUT) + ' SELECT idx AS "index", label, part FROM held')
def holdout_assign(spark, sf_dir):
    return split.holdout_assign(_stored(spark, sf_dir, "index", "label"), 0.2)


@query(
    _with(sql.COMPLETE, _HOLDOUT)
    + f""" SELECT part, idx AS "index", row_number() OVER (PARTITION BY part ORDER BY
    CASE part WHEN 'train' THEN {sql.draw(7, 'idx')} ELSE {sql.draw(8, 'idx')} END, idx) - 1 AS position FROM held"""
)
def holdout_shuffled(spark, sf_dir):
    parts = split.shuffle_parts(split.stratified_holdout(_stored(spark, sf_dir, "index", "label"), 0.2), seed=7)
    named = [df.select(F.lit(n).alias("part"), "index", "position") for n, df in zip(("train", "validation"), parts)]
    return named[0].unionByName(named[1])


@query(
    _with(sql.PAIRS)
    + f""" SELECT idx AS "index", row_number() OVER (ORDER BY {sql.draw(42, 'idx')}, idx) - 1 AS position FROM pairs"""
)
def shuffled_positions(spark, sf_dir):
    return rank.seeded_shuffle(inputs.pairs(spark, sf_dir).select("index")).select("index", "position")


@query(_with(sql.COMPLETE) + ' SELECT idx AS "index", row_number() OVER (ORDER BY idx) - 1 AS position FROM complete')
def source_positions(spark, sf_dir):
    return rank.with_position(_stored(spark, sf_dir, "index"), rows_per_piece=1000)


@query(
    _with(sql.COMPLETE)
    + f""" SELECT idx AS "index", premise, hypothesis, label FROM complete
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.draw(42, 'idx')}, idx) <= 300"""
)
def balanced_sample(spark, sf_dir):
    return sample.balanced_sample(_stored(spark, sf_dir), 300)


def _bins(alias: str) -> str:
    return (
        f"least(length({alias}.premise) // 20, 10) AS pb, least(length({alias}.hypothesis) // 20, 10) AS hb"
    )


@query(
    _with(sql.COMPLETE, sql.DIALOG)
    + f""",
target AS (SELECT pb, hb, count(*) AS c, sum(count(*)) OVER () AS total FROM (SELECT {_bins('d')} FROM dialog d) GROUP BY pb, hb),
quota AS (
  SELECT pb, hb, 500 * c // total + CASE WHEN row_number() OVER (ORDER BY 500 * c % total DESC, pb, hb)
    <= 500 - sum(500 * c // total) OVER () THEN 1 ELSE 0 END AS q FROM target),
pool AS (SELECT *, {_bins('p')} FROM complete p)
SELECT idx AS "index", premise, hypothesis, label FROM pool JOIN quota USING (pb, hb)
QUALIFY row_number() OVER (PARTITION BY label, pb, hb ORDER BY {sql.draw(42, 'idx')}, idx) <= q"""
)
def sample_like(spark, sf_dir):
    return sample.sample_like(_stored(spark, sf_dir), inputs.dialog(spark, sf_dir), 500)


@query(
    _with(sql.COMPLETE, sql.DIALOG)
    + """ SELECT 'train' AS source, idx AS "index", premise, hypothesis, label FROM complete
    UNION ALL SELECT 'dialog', idx, premise, hypothesis, 3 FROM dialog"""
)
def mixed_corpus(spark, sf_dir):
    return sample.mix(train=_complete(spark, sf_dir), dialog=inputs.dialog(spark, sf_dir))


# --- vocabulary, sequences, batches, spans --------------------------------------------------------


def _vocabulary(spark: SparkSession, sf_dir: str, source: Query = _complete) -> DataFrame:
    return build_vocab(source(spark, sf_dir), size=None)


_VOCAB = sql.vocabulary("complete")
_IDS = (sql.COMPLETE, _VOCAB, sql.encoded("complete"))
_DIALOG_IDS = (sql.DIALOG, sql.vocabulary("dialog"), sql.encoded("dialog"))


def _ids(spark: SparkSession, sf_dir: str, max_length: int | None = None) -> DataFrame:
    return sequences.encoded_pairs(_complete(spark, sf_dir), _vocabulary(spark, sf_dir), max_length)


def _dialog_ids(spark: SparkSession, sf_dir: str, max_length: int | None = 512) -> DataFrame:
    return sequences.encoded_pairs(inputs.dialog(spark, sf_dir), _vocabulary(spark, sf_dir, inputs.dialog), max_length)


@query(_with(sql.PAIRS, sql.vocabulary("pairs")) + " SELECT token, token_count, token_id::int AS token_id FROM vocab")
def vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir, inputs.pairs)


@query(
    _with(*_IDS, sql.assembled())
    + """ SELECT idx AS "index", array_to_string(input_ids, ',') AS input_ids, len(input_ids) AS length FROM sequences"""
)
def encoded_pairs(spark, sf_dir):
    return _ids(spark, sf_dir).select("index", _joined("input_ids").alias("input_ids"), _big("length").alias("length"))


@query(
    _with(*_IDS, sql.assembled(64))
    + """ SELECT idx AS "index", array_to_string(input_ids, ',') AS input_ids, len(input_ids) AS length FROM sequences"""
)
def truncate_tail(spark, sf_dir):
    return _ids(spark, sf_dir, 64).select("index", _joined("input_ids").alias("input_ids"), _big("length").alias("length"))


@query(
    _with(*_IDS)
    + """,
sized AS (SELECT *, 61 AS t, len(p) AS np, len(h) AS nh FROM encoded)
SELECT idx AS "index",
  array_to_string(p[1:CASE WHEN np + nh <= t THEN np WHEN nh <= t // 2 THEN t - nh WHEN np <= (t + 1) // 2 THEN np ELSE (t + 1) // 2 END], ',') AS premise_ids,
  array_to_string(h[1:CASE WHEN np + nh <= t THEN nh WHEN np <= (t + 1) // 2 THEN t - np WHEN nh <= t // 2 THEN nh ELSE t // 2 END], ',') AS hypothesis_ids
FROM sized"""
)
def truncate_longest_first(spark, sf_dir):
    p, h = seq.truncate_longest_first("premise_ids", "hypothesis_ids", 64)
    return _ids(spark, sf_dir).select("index", _joined(p).alias("premise_ids"), _joined(h).alias("hypothesis_ids"))


_BATCHED = """
batched AS (
  SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS width FROM (
    SELECT *, (row_number() OVER (ORDER BY idx) - 1) // 16 AS batch_id FROM sequences))"""


@query(
    _with(*_IDS, sql.assembled(512), _BATCHED)
    + """ SELECT idx AS "index", batch_id, width,
    array_to_string(input_ids, ',') || repeat(',1', (width - len(input_ids))::bigint) AS input_ids FROM batched"""
)
def padded_batches(spark, sf_dir):
    df = batches.batch_and_pad(materialise(_ids(spark, sf_dir, 512).select("index", "input_ids")))
    return df.select("index", "batch_id", F.size("input_ids").cast("bigint").alias("width"), _joined("input_ids").alias("input_ids"))


@query(
    _with(*_IDS, sql.assembled(512))
    + """ SELECT idx AS "index", array_to_string(input_ids, ',') || repeat(',1', 512 - len(input_ids)::bigint) AS input_ids
    FROM sequences"""
)
def padded_fixed(spark, sf_dir):
    return _ids(spark, sf_dir, 512).select("index", _joined(seq.pad_fixed("input_ids", 512)).alias("input_ids"))


@query(
    _with(*_IDS, sql.assembled(512), _BATCHED)
    + """ SELECT idx AS "index", repeat('1', len(input_ids)::bigint) || repeat('0', (width - len(input_ids))::bigint) AS mask,
  repeat('0', list_position(input_ids, 2)::bigint) || repeat('1', (len(input_ids) - list_position(input_ids, 2))::bigint)
    || repeat('0', (width - len(input_ids))::bigint) AS segments FROM batched"""
)
def attention_and_segments(spark, sf_dir):
    df = batches.batch_and_pad(materialise(_ids(spark, sf_dir, 512).select("index", "input_ids")))
    return df.select(
        "index",
        F.array_join(seq.attention_mask("input_ids").cast("array<string>"), "").alias("mask"),
        F.array_join(seq.segment_ids("input_ids").cast("array<string>"), "").alias("segments"),
    )


_ITEMS = """
cut AS (
  SELECT idx, 253 AS t, p, h, len(p) AS np, len(h) AS nh FROM encoded),
sequences AS (
  SELECT idx, list_concat(list_concat(list_concat([0::bigint],
    p[1:CASE WHEN np + nh <= t THEN np WHEN nh <= t // 2 THEN t - nh WHEN np <= (t + 1) // 2 THEN np ELSE (t + 1) // 2 END]),
    list_concat([2::bigint],
    h[1:CASE WHEN np + nh <= t THEN nh WHEN np <= (t + 1) // 2 THEN t - np WHEN nh <= t // 2 THEN nh ELSE t // 2 END])),
    [2::bigint]) AS input_ids FROM cut)"""


@query(
    _with(*_IDS, _ITEMS, _BATCHED)
    + """ SELECT idx AS "index", batch_id, array_to_string(input_ids, ',') || repeat(',1', (width - len(input_ids))::bigint) AS input_ids,
  repeat('1', len(input_ids)::bigint) || repeat('0', (width - len(input_ids))::bigint) AS mask,
  repeat('0', list_position(input_ids, 2)::bigint) || repeat('1', (len(input_ids) - list_position(input_ids, 2))::bigint)
    || repeat('0', (width - len(input_ids))::bigint) AS segments FROM batched"""
)
def encoded_items(spark, sf_dir):
    items = sequences.encoded_items(_complete(spark, sf_dir), _vocabulary(spark, sf_dir))
    return items.select(
        "index",
        "batch_id",
        _joined("input_ids").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("mask"),
        F.array_join(F.col("token_type_ids").cast("array<string>"), "").alias("segments"),
    )


@query(
    _with(*_DIALOG_IDS, sql.assembled(512), _BATCHED)
    + """,
spans AS (
  SELECT idx, s, e, CASE WHEN s <= n - 2 AND e <= n - 2 AND (s > m OR e < m) THEN 0 ELSE 1000000 END AS mask
  FROM (SELECT idx, len(input_ids) AS n, list_position(input_ids, 2) - 1 AS m, width, unnest(range(1, width - 1)) AS s FROM batched) b,
  LATERAL (SELECT unnest(range(s, width - 1)) AS e) x)
SELECT idx AS "index", s::int AS span_start, count(*) AS n, sum(e)::bigint AS end_sum, sum(mask)::bigint AS mask_sum FROM spans GROUP BY ALL"""
)
def spans_masked(spark, sf_dir):
    padded = batches.batch_and_pad(materialise(_dialog_ids(spark, sf_dir).select("index", "input_ids", "length")))
    table = spans.span_intervals(padded, ["index"])
    n = (F.col("last_end") - F.col("first_end") + 1).cast("bigint")
    return table.groupBy("index", "span_start").agg(
        F.sum(n).alias("n"),
        F.sum(F.expr("(first_end + last_end) * (last_end - first_end + 1L) div 2")).alias("end_sum"),
        F.sum(n * F.col("span_mask")).alias("mask_sum"),
    )


@query(
    _with(*_DIALOG_IDS, sql.assembled(512))
    + """,
starts AS (SELECT idx, len(input_ids) AS n, list_position(input_ids, 2) - 1 AS m, unnest(range(1, len(input_ids) - 1)) AS s FROM sequences),
spans AS (SELECT idx, s, m, unnest(range(s, n - 1)) AS e FROM starts)
SELECT idx AS "index", s::int AS span_start, count(*) AS n, sum(e)::bigint AS end_sum FROM spans WHERE s > m OR e < m GROUP BY ALL"""
)
def valid_spans(spark, sf_dir):
    table = spans.valid_spans(_dialog_ids(spark, sf_dir), ["index"])
    return table.groupBy("index", "span_start").agg(F.count("*").alias("n"), F.sum("span_end").alias("end_sum"))


@query(
    _with(*_IDS)
    + """ SELECT idx AS "index", list_sum(range(1, len(p) + 1))::bigint + list_sum(range(1, len(h) + 1))::bigint AS span_count
    FROM encoded WHERE len(p) > 0 AND len(h) > 0
    UNION ALL SELECT idx, coalesce(list_sum(range(1, len(p) + len(h) + 1)), 0)::bigint FROM encoded WHERE len(p) = 0 OR len(h) = 0"""
)
def span_counts(spark, sf_dir):
    return _ids(spark, sf_dir).select("index", seq.valid_span_count("premise_ids", "hypothesis_ids").alias("span_count"))


_MLM = f"""
mlm AS (
  SELECT idx, {sql.clean('sentence')} AS sentence, label FROM (
    SELECT idx, premise || '[SEP]' || hypothesis AS sentence, label FROM unique_pairs))"""


@query(_with(sql.COMPLETE, _UNIQUE, _MLM) + ' SELECT idx AS "index", sentence, label FROM mlm')
def mlm_corpus(spark, sf_dir):
    return corpus.mlm_corpus(rows.drop_incomplete(inputs.pairs(spark, sf_dir)))


@query(
    _with(sql.COMPLETE, _UNIQUE, _MLM, _VOCAB)
    + f""",
mlm_words AS (
  SELECT idx, list_concat(list_concat(['[START]'], list_filter(string_split(replace(sentence, '[SEP]', ' [SEP] '), ' '),
    lambda w: w <> '')), ['[SEP]']) AS ws FROM mlm),
mlm_ids AS (
  SELECT idx, i, CASE WHEN i = 0 THEN 0 WHEN token = '[SEP]' THEN 2 ELSE coalesce(token_id, 3) END AS id,
    md5('42:' || idx || ':' || i) AS d
  FROM (SELECT idx, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS token FROM mlm_words) LEFT JOIN vocab USING (token)),
drawn AS (
  SELECT *, ('0x' || substr(d, 1, 8))::bigint < 644245094 AND id > 2 AS picked, ('0x' || substr(d, 9, 8))::bigint % 10 AS kind,
    5 + ('0x' || substr(d, 17, 8))::bigint % (SELECT count(*) FROM vocab) AS other FROM mlm_ids)
SELECT idx AS "index", string_agg(CASE WHEN NOT picked THEN id WHEN kind < 8 THEN 4 WHEN kind = 8 THEN other ELSE id END::varchar, ',' ORDER BY i) AS masked_ids,
  string_agg(CASE WHEN picked THEN id ELSE -100 END::varchar, ',' ORDER BY i) AS labels
FROM drawn GROUP BY idx"""
)
def mlm_masked(spark, sf_dir):
    lines = corpus.mlm_corpus(rows.drop_incomplete(inputs.pairs(spark, sf_dir)))
    masked = corpus.masked_corpus(lines, materialise(_vocabulary(spark, sf_dir)))
    return masked.select("index", _joined("masked_ids").alias("masked_ids"), _joined("labels").alias("labels"))


# --- scores ---------------------------------------------------------------------------------------


def _rounded(arr: str, names: str = "p") -> list[Column]:
    return [F.round(F.col(arr)[i], 6).alias(f"{names}{i}") for i in range(3)]


_ARGMAX = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END"


@query(
    _with(sql.SCORES)
    + f""" SELECT model_id, row_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2,
    {_ARGMAX.format('a', 'b', 'c')} AS pred FROM probs"""
)
def softmax_argmax(spark, sf_dir):
    df = inputs.scores(spark, sf_dir).withColumn("_p", softmax("logits"))
    return df.select("model_id", "row_id", *_rounded("_p"), argmax("logits").alias("pred"))


_ENSEMBLE = f"""
means AS (
  SELECT row_id, any_value(gold) AS gold, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(p0) AS p0, avg(p1) AS p1,
         avg(p2) AS p2 FROM probs GROUP BY row_id),
voted AS (SELECT *, {_ARGMAX.format('a', 'b', 'c')} AS pred FROM means)"""


@query(_with(sql.SCORES, _ENSEMBLE) + " SELECT row_id, round(a, 6) AS l0, round(b, 6) AS l1, round(c, 6) AS l2 FROM means")
def mean_logits(spark, sf_dir):
    return scoring.mean_logits(inputs.scores(spark, sf_dir)).select("row_id", *_rounded("logits", "l"))


@query(_with(sql.SCORES, _ENSEMBLE) + f" SELECT row_id, {sql.label_name('pred')} AS pred_label FROM voted")
def ensemble_labels(spark, sf_dir):
    return scoring.ensemble_labels(inputs.scores(spark, sf_dir))


@query(_with(sql.SCORES, _ENSEMBLE) + " SELECT row_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM means")
def ensemble_probs(spark, sf_dir):
    return scoring.ensemble_probs(inputs.scores(spark, sf_dir)).select("row_id", *_rounded("probs"))


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = inputs.scores(spark, sf_dir)
    gold = scores.where("model_id = 0").select("row_id", "gold")
    labels = scoring.ensemble_labels(scores).select("row_id", encode_label("pred_label").alias("pred"))
    return labels.join(gold, "row_id")


@query(_with(sql.SCORES, _ENSEMBLE) + " SELECT round(avg((pred = gold)::int), 6) AS accuracy, count(*) AS n FROM voted")
def accuracy_overall(spark, sf_dir):
    return scoring.accuracy(_voted(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    _with(sql.SCORES, _ENSEMBLE, sql.folds("voted", "row_id", "gold"))
    + " SELECT fold, round(avg((pred = gold)::int), 6) AS accuracy, count(*) AS n FROM folded GROUP BY fold"
)
def accuracy_by_fold(spark, sf_dir):
    folded = split.stratified_kfold(_voted(spark, sf_dir), 5, label="gold", key="row_id")
    return scoring.accuracy(folded, "fold").withColumn("accuracy", F.round("accuracy", 6))


@query(
    _with(sql.SCORES, _ENSEMBLE)
    + f""",
parts AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY gold ORDER BY {sql.draw(42, 'row_id')}, row_id)
    <= floor((count(*) OVER (PARTITION BY gold))::double * 0.5::double) THEN 'public' ELSE 'private' END AS part FROM voted)
SELECT part, round(avg((pred = gold)::int), 6) AS accuracy, count(*) AS n FROM parts GROUP BY part"""
)
def accuracy_by_part(spark, sf_dir):
    halves = split.holdout_assign(_voted(spark, sf_dir), 0.5, label="gold", key="row_id")
    named = halves.withColumn("part", F.when(F.col("part") == "validation", "public").otherwise("private"))
    return scoring.accuracy_by_part(named).withColumn("accuracy", F.round("accuracy", 6))


_NLL = """
nll AS (
  SELECT model_id, -ln(CASE gold WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS nll,
         -(ln(p0) + ln(p1) + ln(p2)) / 3 AS uniform FROM probs)"""


@query(_with(sql.SCORES, _NLL) + " SELECT model_id, round(avg(nll), 6) AS loss FROM nll GROUP BY model_id")
def cross_entropy(spark, sf_dir):
    return scoring.cross_entropy(inputs.scores(spark, sf_dir), ["model_id"]).withColumn("loss", F.round("loss", 6))


@query(_with(sql.SCORES, _NLL) + " SELECT model_id, round(avg(0.8 * nll + 0.2 * uniform), 6) AS loss FROM nll GROUP BY model_id")
def smoothed_cross_entropy(spark, sf_dir):
    df = scoring.smoothed_cross_entropy(inputs.scores(spark, sf_dir), by=["model_id"])
    return df.withColumn("loss", F.round("loss", 6))


_WEIGHTS = """
starts AS (
  SELECT idx, len(input_ids) AS n, list_position(input_ids, 2) - 1 AS m, unnest(range(1, len(input_ids) - 1)) AS s FROM sequences),
spans AS (SELECT *, unnest(range(s, n - 1)) AS e FROM starts),
scored AS (
  SELECT idx AS row_id, s, e, (idx * 7 + s * 3 + e * 5) % 11 / 4.0 AS score,
         CASE WHEN s > m OR e < m THEN 0 ELSE 1000000 END AS mask FROM spans),
shifted AS (SELECT *, exp(score - mask - max(score - mask) OVER (PARTITION BY row_id)) AS x FROM scored),
weights AS (SELECT *, x / sum(x) OVER (PARTITION BY row_id) AS weight FROM shifted)"""
_WEIGHTED = (*_DIALOG_IDS, sql.assembled(512), _WEIGHTS)


def _attention(spark: SparkSession, sf_dir: str) -> SpanAttention:
    return inputs.span_attention(spark, sf_dir, _vocabulary(spark, sf_dir, inputs.dialog))


@query(_with(*_WEIGHTED) + """ SELECT row_id, s::int AS span_start, count(*) AS n, sum(e)::bigint AS end_sum, round(sum(weight), 9) AS weight,
    round(sum(weight * e), 6) AS end_weight FROM weights GROUP BY ALL""")
def masked_softmax(spark, sf_dir):
    sums = _attention(spark, sf_dir).weights().groupBy("row_id", "span_start").agg(
        F.count("*").alias("n"),
        F.sum("span_end").alias("end_sum"),
        F.round(F.sum("weight"), 9).alias("weight"),
        F.round(F.sum(F.col("weight") * F.col("span_end")), 6).alias("end_weight"),
    )
    return sums


@query(
    _with(*_WEIGHTED)
    + """ SELECT row_id, round(sum(weight * s / 10), 6) AS v0, round(sum(weight * e / 10), 6) AS v1,
    round(sum(weight * (e - s)), 6) AS v2, round(sum(weight * score), 6) AS v3 FROM weights GROUP BY row_id"""
)
def weighted_pool(spark, sf_dir):
    pooled = _attention(spark, sf_dir).pool("vec", 4)
    return pooled.select("row_id", *[F.round(F.col("pooled")[i], 6).alias(f"v{i}") for i in range(4)])


@query(
    _with(*_WEIGHTED)
    + """ SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY score - mask DESC, s, e) AS rank, s::int AS span_start,
    e::int AS span_end, round(weight, 9) AS weight FROM weights QUALIFY rank <= 5"""
)
def top_spans(spark, sf_dir):
    top = _attention(spark, sf_dir).top(5)
    return top.select("row_id", _big("rank").alias("rank"), "span_start", "span_end", F.round("weight", 9).alias("weight"))


@query(
    _with(*_WEIGHTED)
    + """ SELECT round(avg(q), 9) AS regulariser FROM (SELECT sum(weight * weight) AS q FROM weights GROUP BY row_id)"""
)
def span_regulariser(spark, sf_dir):
    df = _attention(spark, sf_dir).regulariser()
    return df.withColumn("regulariser", F.round("regulariser", 9))


@query(
    """WITH layers AS (
      SELECT vec_id // 10 AS row_id, vec_id % 10 AS layer, embedding FROM embeddings
      QUALIFY row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id % 10 DESC) <= 4),
    items AS (SELECT row_id, layer, unnest(embedding)::double AS value, generate_subscripts(embedding, 1) AS i FROM layers)
    SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY layer DESC, i) - 1 AS pos, round(value, 6) AS value FROM items"""
)
def concat_last_layers(spark, sf_dir):
    df = pooling.concat_last_layers(inputs.layers(spark, sf_dir))
    return df.select("row_id", F.posexplode("features").alias("pos", "value")).select(
        "row_id", _big("pos").alias("pos"), F.round("value", 6).alias("value")
    )


@query(
    """SELECT user_id AS run, event_id AS step, value FROM events WHERE event_type = 'view'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1"""
)
def best_checkpoint(spark, sf_dir):
    return scoring.best_checkpoint(inputs.runs(spark, sf_dir), "view")


# --- files ----------------------------------------------------------------------------------------


@query(_with(sql.DIRTY) + """ SELECT idx AS "index", premise, hypothesis, label FROM dirty""")
def csv_pairs(spark, sf_dir):
    path = _scratch(spark, "csv")
    df = inputs.dirty_pairs(spark, sf_dir).select("label", "premise", "hypothesis", "index")
    df.write.option("header", True).option("escape", '"').csv(path)
    return pair_files.read_pairs(spark, path)


@query(_with(sql.DIRTY) + """ SELECT idx AS "index", premise, hypothesis, 3 AS label FROM dirty""")
def csv_unlabelled(spark, sf_dir):
    path = _scratch(spark, "csv")
    inputs.dirty_pairs(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return pair_files.read_unlabelled(spark, path)


@query(
    _with(sql.PAIRS)
    + """ SELECT 'tsv' AS source, idx AS "index", premise, hypothesis, label FROM pairs
    UNION ALL SELECT 'json', idx, premise, hypothesis, label FROM pairs"""
)
def external_pairs(spark, sf_dir):
    mapping = {"index": "id", "premise": "sentence1", "hypothesis": "sentence2", "label": "gold_label"}
    foreign = inputs.pairs(spark, sf_dir).select(*[F.col(c).alias(n) for c, n in mapping.items()])
    tsv, json = _scratch(spark, "tsv"), _scratch(spark, "json")
    foreign.write.option("header", True).option("sep", "\t").option("quote", "\u0000").option("compression", "gzip").csv(tsv)
    foreign.write.option("compression", "gzip").json(json)
    return sample.mix(
        tsv=pair_files.read_external(spark, tsv, "tsv", mapping),
        json=pair_files.read_external(spark, json, "json", mapping),
    )


@query(
    _with(sql.SCORES, _ENSEMBLE)
    + f""" SELECT row_id, {sql.label_name('pred')} AS pred_label, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2
    FROM voted"""
)
def prediction_file(spark, sf_dir):
    path = _scratch(spark, "predictions")
    predictions.write_predictions(scoring.ensemble(inputs.scores(spark, sf_dir)), path)
    back = spark.read.schema("row_id bigint, pred_label string, probs string").csv(path, header=True, escape='"')
    return back.withColumn("_p", F.from_json("probs", "array<double>")).select("row_id", "pred_label", *_rounded("_p"))


@query(
    _with(sql.SCORES, _ENSEMBLE)
    + f""" SELECT doc_id AS "index", {sql.label_name('pred')} AS label FROM documents LEFT JOIN voted ON doc_id = row_id"""
)
def submission_fill(spark, sf_dir):
    template = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.lit("").alias("label"))
    labels = scoring.ensemble_labels(inputs.scores(spark, sf_dir)).withColumnRenamed("row_id", "index")
    filled = predictions.fill_template(template, labels)
    path = _scratch(spark, "submission")
    predictions.write_submission(filled, path)
    return spark.read.schema("index bigint, label string").csv(path, header=True)


@query(
    """SELECT user_id::varchar AS run, event_id AS step, event_type AS metric, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1"""
)
def metrics_file(spark, sf_dir):
    path = _scratch(spark, "metrics")
    best = scoring.best_checkpoint(inputs.runs(spark, sf_dir), None, ("run", "metric"))
    group = F.floor(F.col("run") / 100).cast("int")  # run is a folder, so runs are few: one per hundred users
    table = best.select(group.alias("run"), F.col("run").alias("user"), "step", "metric", "value")
    halves = [table.where("metric = 'view'"), table.where("metric <> 'view'")]
    for half in halves:
        metric_files.append_metrics(half, path)
    back = metric_files.read_metrics(spark, path)
    return back.select(F.col("user").cast("string").alias("run"), "step", "metric", "value")


# --- augmentation ---------------------------------------------------------------------------------

_SIDES = ("premise", "hypothesis")


def _reverse(texts: list[str]) -> list[str]:
    """Stands for a translator: refuses some texts, has no answer for others."""
    if any(len(t) % 13 == 0 for t in texts):
        raise RuntimeError("refused")
    return ["" if len(t) % 17 == 0 else t[::-1] for t in texts]


def _reverse_and_mark(texts: list[str]) -> list[str]:
    return [t[::-1] + (" again" if len(t) % 2 == 0 else "") for t in texts]


def _round_tripped(col: str) -> str:
    return (
        f"CASE WHEN length({col}) % 13 = 0 OR length({col}) % 17 = 0 THEN '' "
        f"ELSE {col} || CASE WHEN length({col}) % 2 = 0 THEN ' again' ELSE '' END END"
    )


@query(
    _with(sql.COMPLETE)
    + f""",
tripped AS (SELECT *, {_round_tripped('premise')} AS p, {_round_tripped('hypothesis')} AS h FROM complete)
SELECT 'rtt' AS source, idx AS "index", p AS premise, h AS hypothesis, label FROM tripped
WHERE p NOT IN ('', ' ') AND h NOT IN ('', ' ')
  AND ({sql.clean('p')} <> {sql.clean('premise')} OR {sql.clean('h')} <> {sql.clean('hypothesis')})"""
)
def round_trip_augment(spark, sf_dir):
    path = _scratch(spark, "shards")
    df = _stored(spark, sf_dir)
    options = {"shard_rows": 200 * inputs.LINES_PER_DOCUMENT, "shards_per_job": 100, "tasks": 8}

    def trip(col: str) -> DataFrame:
        return augment.round_trip(df, col, _reverse, _reverse_and_mark, f"{path}/{col}", **options)

    with ThreadPool(len(_SIDES)) as pool:
        tripped = pool.map(inheritable_thread_target(spark)(trip), _SIDES)
    return augment.augmented_pairs(df, *tripped)


_OVERLAP = """
sides AS (SELECT idx, 'premise' AS hop, premise AS t, label FROM complete UNION ALL SELECT idx, 'hypothesis', hypothesis, label FROM complete),
tripped AS (
  SELECT idx, hop, t, CASE WHEN length(t) % 13 = 0 OR length(t) % 17 = 0 THEN '' ELSE reverse(t) END AS text,
    CASE WHEN length(t) % 13 = 0 THEN 'failed' WHEN length(t) % 17 = 0 THEN 'empty' ELSE 'ok' END AS status
  FROM sides)"""


def _overlapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """For each text column a hop with one wide range holding everything, and a narrow one over it whose texts are all there."""
    path = _scratch(spark, "shards")
    df = _stored(spark, sf_dir)
    stop, narrow = 2**62, 100 * inputs.LINES_PER_DOCUMENT
    for side in _SIDES:
        shards.write_shard(augment.enrich_column(df, side, _reverse), path, side, 0, stop)
        repaired = df.select(F.col("index").alias("row_index"), F.reverse(side).alias("text"), F.lit("ok").alias("status"))
        shards.write_shard(repaired, path, side, 0, narrow)
    return df, {side: shards.read_shards(spark, path, side) for side in _SIDES}


def _both(parts: dict[str, DataFrame], *cols: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(side).alias("hop"), *cols) for side, df in parts.items()])


@query(
    _with(sql.COMPLETE, _OVERLAP)
    + """ SELECT hop, idx AS row_index, CASE WHEN idx < 100000000 AND status <> 'ok' THEN reverse(t) ELSE text END AS text,
    CASE WHEN idx < 100000000 THEN 'ok' ELSE status END AS status FROM tripped"""
)
def shards_assembled(spark, sf_dir):
    parts = {side: augment.assemble_hop(df) for side, df in _overlapping(spark, sf_dir)[1].items()}
    return _both(parts, "row_index", "text", "status")


@query(
    _with(sql.COMPLETE, _OVERLAP)
    + " SELECT hop, idx AS row_index, status FROM tripped WHERE status <> 'ok' AND idx >= 100000000"
)
def failed_rows(spark, sf_dir):
    parts = {side: augment.failed_rows(df) for side, df in _overlapping(spark, sf_dir)[1].items()}
    return _both(parts, "row_index", "status")


@query(_with(sql.COMPLETE, _OVERLAP) + ' SELECT hop, idx AS "index", label FROM sides WHERE idx >= 100000000')
def pending_rows(spark, sf_dir):
    df, done = _overlapping(spark, sf_dir)
    name = shards.shard_name(0, 100 * inputs.LINES_PER_DOCUMENT)
    held = {side: part.where(F.col("shard") == name).select(F.col("row_index").alias("index")) for side, part in done.items()}
    return _both({side: rows.pending_rows(df, part) for side, part in held.items()}, "index", "label")


# --- models ---------------------------------------------------------------------------------------


def _estimator():
    return models.default_estimator()


@query()
def oof_predictions(spark, sf_dir):
    stored, fitted = training.train_folds(inputs.pairs(spark, sf_dir), 5, _estimator())
    out = models.out_of_fold(stored, fitted.models)
    return out.select("index", "label", "fold", "pred", *_rounded("probs"))


@query()
def fold_metrics(spark, sf_dir):
    return training.train_folds(inputs.pairs(spark, sf_dir), 5, _estimator())[1].metrics


@query()
def scored_ensemble(spark, sf_dir):
    _, fitted = training.train_folds(inputs.pairs(spark, sf_dir), 5, _estimator())
    named = {f"run_{fold}": m for fold, m in fitted.models.items()}
    out = inference.predict(inputs.dialog(spark, sf_dir), named)
    return out.select("index", "pred_label", *_rounded("probs"))


_BAYES = f"""
counted AS (
  SELECT *, len(string_split(premise, ' ')) AS x0, len(string_split(hypothesis, ' ')) AS x1,
    len(list_intersect(string_split(premise, ' '), string_split(hypothesis, ' '))) AS x2 FROM folded),
sums AS (
  SELECT run, label AS c, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2
  FROM counted, range(5) t(run) WHERE fold <> run GROUP BY ALL),
theta AS (
  SELECT run, c, ln(n + 1) - ln(sum(n) OVER (PARTITION BY run) + count(*) OVER (PARTITION BY run)) AS prior,
    ln(s0 + 1) - ln(s0 + s1 + s2 + 3) AS t0, ln(s1 + 1) - ln(s0 + s1 + s2 + 3) AS t1, ln(s2 + 1) - ln(s0 + s1 + s2 + 3) AS t2 FROM sums)"""
_BAYES_FOLDS = (sql.COMPLETE, _CLEAN_UNIQUE, sql.folds("ready"), _BAYES)
_BAYES_SCORED = """
raw AS (SELECT o.idx, o.label, o.fold, t.run, c, prior + x0 * t0 + x1 * t1 + x2 * t2 AS l FROM {rows} o JOIN theta t ON {on}),
soft AS (SELECT *, exp(l - max(l) OVER w) / sum(exp(l - top)) OVER w AS p FROM (
  SELECT *, max(l) OVER (PARTITION BY idx, run) AS top FROM raw) WINDOW w AS (PARTITION BY idx, run))"""


def _bayes_folds(spark: SparkSession, sf_dir: str, **options: str) -> tuple[DataFrame, models.FoldFit]:
    return training.train_folds(inputs.pairs(spark, sf_dir), 5, models.bayes_estimator(), **options)


@query(
    _with(*_BAYES_FOLDS, _BAYES_SCORED.format(rows="counted", on="o.fold = t.run"))
    + """ SELECT idx AS "index", any_value(label) AS label, any_value(fold) AS fold, first(c ORDER BY l DESC, c) AS pred,
    round(max(p) FILTER (c = 0), 6) AS p0, round(max(p) FILTER (c = 1), 6) AS p1, round(max(p) FILTER (c = 2), 6) AS p2
    FROM soft GROUP BY idx"""
)
def oof_bayes(spark, sf_dir):
    stored, fitted = _bayes_folds(spark, sf_dir)
    return models.out_of_fold(stored, fitted.models).select("index", "label", "fold", "pred", *_rounded("probs"))


@query(
    _with(*_BAYES_FOLDS, _BAYES_SCORED.format(rows="counted", on="o.fold = t.run"))
    + """,
hits AS (SELECT idx, any_value(fold) AS fold, (first(c ORDER BY l DESC, c) = any_value(label))::int AS hit FROM soft GROUP BY idx)
SELECT fold, 'accuracy' AS metric, round(avg(hit), 6) AS value FROM hits GROUP BY fold
UNION ALL SELECT f::int, 'train_samples', count(*) FROM hits, range(5) t(f) WHERE fold <> f GROUP BY f"""
)
def fold_metrics_bayes(spark, sf_dir):
    metrics = _bayes_folds(spark, sf_dir)[1].metrics
    return metrics.select("fold", "metric", F.round("value", 6).alias("value"))


@query(
    _with(*_BAYES_FOLDS, sql.DIALOG)
    + f""",
asked AS (
  SELECT idx, NULL AS label, NULL AS fold, len(string_split(p, ' ')) AS x0, len(string_split(h, ' ')) AS x1,
    len(list_intersect(string_split(p, ' '), string_split(h, ' '))) AS x2
  FROM (SELECT idx, {sql.clean('premise')} AS p, {sql.clean('hypothesis')} AS h FROM dialog
    WHERE premise IS NOT NULL AND hypothesis IS NOT NULL)),
{_BAYES_SCORED.format(rows="asked", on="true")},
means AS (SELECT idx, c, avg(l) AS l FROM soft GROUP BY ALL),
voted AS (SELECT idx, first(c ORDER BY l DESC, c) AS pred FROM means GROUP BY idx)
SELECT d.idx AS "index", {sql.label_name('pred')} AS label FROM dialog d LEFT JOIN voted USING (idx)"""
)
def submission_from_models(spark, sf_dir):
    path = _scratch(spark, "models")
    _bayes_folds(spark, sf_dir, model_path=path)
    asked = inputs.dialog(spark, sf_dir)
    template = asked.select("index", F.lit("").alias("label"))
    return inference.submission(template, asked, models.load_models(path, range(5)))


@query(
    _with(sql.COMPLETE)
    + f""" SELECT idx AS "index", a * 0.5 AS l0, b * 0.25 AS l1, (a - b) * 0.125 AS l2,
    {_ARGMAX.format('(a * 0.5)', '(b * 0.25)', '((a - b) * 0.125)')} AS pred
    FROM (SELECT idx, length(premise)::double AS a, length(hypothesis)::double AS b FROM complete)"""
)
def scored_batches(spark, sf_dir):
    def load() -> Callable:
        import numpy as np

        return lambda a, b: np.stack([a * 0.5, b * 0.25, (a - b) * 0.125], axis=1).astype(np.float32)

    lengths = _complete(spark, sf_dir).select(
        "index", *[F.char_length(c).cast("double").alias(n) for c, n in (("premise", "a"), ("hypothesis", "b"))]
    )
    out = models.score_batches(lengths, load, ["a", "b"])
    return out.select("index", *[F.col("logits")[i].alias(f"l{i}") for i in range(3)], "pred")


@query(
    _with(sql.COMPLETE, _CLEAN_UNIQUE, sql.folds("ready"), sql.DIALOG)
    + """,
mixed AS (
  SELECT 'train' AS source, label, fold FROM folded UNION ALL SELECT 'dialog', 3, NULL FROM dialog
  UNION ALL SELECT 'reversed', label, fold FROM folded)
SELECT run::int AS run, CASE WHEN run = fold THEN 'validation' ELSE 'train' END AS part, source, label, count(*) AS n
FROM mixed, range(5) t(run) WHERE source = 'train' OR fold IS NULL OR fold <> run GROUP BY ALL"""
)
def mixed_folds(spark, sf_dir):
    folded = training.folded_pairs(inputs.pairs(spark, sf_dir), 5)
    backwards = _complete(spark, sf_dir).withColumns({c: F.reverse(c) for c in ("premise", "hypothesis")})
    mixed = training.mixed_folds(folded, {"dialog": inputs.dialog(spark, sf_dir)}, {"reversed": backwards})
    return training.mixed_runs(mixed, 5).groupBy("run", "part", "source", "label").agg(F.count("*").alias("n"))


@query(
    _with(sql.COMPLETE, sql.folds("complete"), _HOLDOUT)
    + """ SELECT 'fold' || fold AS part, count(*) AS n, sum(idx)::double AS index_sum FROM folded GROUP BY ALL
    UNION ALL SELECT part, count(*), sum(idx)::double FROM held GROUP BY ALL
    UNION ALL SELECT 'whole', count(*), sum(idx)::double FROM complete"""
)
def split_dispatch(spark, sf_dir):
    df = _stored(spark, sf_dir, "index", "label")
    parts = {f"fold{i}": s.validation for i, s in enumerate(split.split(df, k_fold=5))}
    parts |= dict(zip(("train", "validation"), split.split(df, val_ratio=0.2)[0], strict=True))
    parts["whole"] = split.split(df, train=False)
    sums = [F.count("*").alias("n"), F.sum("index").cast("double").alias("index_sum")]
    return reduce(DataFrame.unionByName, [d.agg(F.lit(p).alias("part"), *sums) for p, d in parts.items()])


@query(_with(sql.PAIRS) + " SELECT premise, hypothesis, label, count(*) AS n, count(*) AS numbers FROM pairs GROUP BY ALL")
def external_unnumbered(spark, sf_dir):
    path = _scratch(spark, "json")
    inputs.pairs(spark, sf_dir).drop("index").write.option("compression", "gzip").json(path)
    found = pair_files.read_external(spark, path, "json", {"index": None})
    cols = ("premise", "hypothesis", "label")
    total = found.agg(F.countDistinct("index").alias("d"), F.count("*").alias("t"), F.max("index").alias("m")).first()
    if not total["d"] == total["t"] == total["m"] + 1:
        raise ValueError("the numbers given to the rows are not dense")
    # All numbers differ, so those of a group need not be told apart by another shuffle of the texts.
    return found.groupBy(*cols).agg(F.count("*").alias("n"), F.count("index").alias("numbers"))
