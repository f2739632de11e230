"""Evaluation metrics for retrieval, classification, answers and agent runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx

K = 10

# Phrases by which an answer refuses, after normalization.
REFUSALS = (
    "not in the document", "cannot be answered", "not found", "does not contain",
    "no information", "not mentioned", "not enough information",
)
# Recall fallback factors for the second and third overlap score.
FALLBACK_FACTORS = (0.8, 0.9)


# -- retrieval --------------------------------------------------------------------------------

def retrieval_scores(
    queries: DataFrame, hits: DataFrame, relevant: DataFrame, k: int = K, per_document: bool = False
) -> DataFrame:
    """Hit, reciprocal rank and NDCG at k of every query; queries without hits score 0.

    ``hits(query_id, rank, doc_id)``, ``relevant(query_id, doc_id)``. Every hit row of a relevant
    document counts, so NDCG may pass 1 when a document has several chunks among the hits;
    ``per_document`` counts its best row only.
    """
    found = hits.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    if per_document:
        found = found.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    good = found.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"],
                      "left_semi")
    gains = good.groupBy("query_id").agg(
        F.min("rank").alias("_first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg")
    )
    wanted = relevant.groupBy("query_id").agg(F.countDistinct("doc_id").alias("_n"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0),
        lambda s, i: s + 1 / F.log2(i + 1),
    )
    return (
        queries.select("query_id")
        .join(gains, "query_id", "left")
        .join(wanted, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("_first").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
            F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
            F.coalesce(F.col("_dcg") / ideal, F.lit(0.0)).alias("ndcg"),
        )
    )


def macro_means(scores: DataFrame, *names: str) -> DataFrame:
    return scores.agg(*[F.round(F.avg(n), 4).alias(n) for n in names], F.count("*").alias("n"))


# -- classification ---------------------------------------------------------------------------

def confusion(predictions: DataFrame) -> DataFrame:
    """(actual, pred) counts with the confidence sum: the only pass over the predictions."""
    return predictions.groupBy("actual", "pred").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("confidence_sum")
    )


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    by_true = counts.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    by_pred = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    right = counts.filter(F.col("actual") == F.col("pred")).select(
        F.col("actual").alias("label"), F.col("n").alias("right")
    )
    joined = by_true.join(by_pred, "label", "full_outer").join(right, "label", "left").na.fill(0)

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return joined.select(
        "label", ratio("right", "predicted").alias("precision"),
        ratio("right", "support").alias("recall"),
        F.coalesce(2.0 * F.col("right") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)),
                   F.lit(0.0)).alias("f1"),
        "support",
    )


def weighted_summary(counts: DataFrame) -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, and mean confidence."""
    n = F.sum("support")
    weighted = class_report(counts).agg(*[
        F.round(F.sum(F.col(m) * F.col("support")) / n, 6).alias(m)
        for m in ("precision", "recall", "f1")
    ])
    overall = counts.agg(
        F.round(F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6)
        .alias("accuracy"),
        F.round(F.sum("confidence_sum") / F.sum("n"), 6).alias("avg_confidence"),
        F.sum("n").alias("n"),
    )
    return overall.select(
        "*", *[weighted.select(m).scalar().alias(m) for m in ("precision", "recall", "f1")]
    )


def confusion_matrix(counts: DataFrame, labels: list) -> DataFrame:
    return counts.groupBy("actual").pivot("pred", labels).agg(F.sum("n")).na.fill(0)


def original_class_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy per original class under the mapped labels (class_name, actual, pred)."""
    right = F.avg((F.col("actual") == F.col("pred")).cast("double"))
    return predictions.groupBy("class_name", F.col("actual").alias("mapped_to")).agg(
        F.round(right, 6).alias("accuracy"), F.count("*").alias("n")
    )


# -- answers ----------------------------------------------------------------------------------

def exact_match(prediction: Column, reference: Column) -> Column:
    return F.when(tx.normalize_answer(prediction) == tx.normalize_answer(reference), 1.0).otherwise(0.0)


def _f_measure(common: Column, n_pred: Column, n_ref: Column) -> Column:
    """2PR / (P + R) with counts; 0 where nothing is shared."""
    return F.when(common > 0, 2.0 * common / (n_pred + n_ref)).otherwise(0.0)


def token_f1(prediction: Column, reference: Column) -> Column:
    """Multiset token F1 of normalized answers, inside the row."""
    p, r = tx.words(tx.normalize_answer(prediction)), tx.words(tx.normalize_answer(reference))
    empty = (F.size(p) == 0) | (F.size(r) == 0)
    both = (F.size(p) == 0) & (F.size(r) == 0)
    return F.when(both, 1.0).when(empty, 0.0).otherwise(
        _f_measure(tx.multiset_overlap(p, r), F.size(p), F.size(r))
    )


def rouge_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    p, r = tx.ngrams(rouge_tokens(prediction), n), tx.ngrams(rouge_tokens(reference), n)
    return _f_measure(tx.multiset_overlap(p, r), F.size(p), F.size(r))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence with one big integer as the bit row of the table."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F-measure of the longest common word subsequence (Arrow batches)."""

    @F.arrow_udf("int")
    def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([lcs_length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    p, r = rouge_tokens(prediction), rouge_tokens(reference)
    return _f_measure(lcs(p, r), F.size(p), F.size(r))


def overlap_recall(prediction: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Share of distinct reference words found in the prediction, and its two scaled variants."""
    p = F.array_distinct(tx.words(F.lower(prediction)))
    r = F.array_distinct(tx.words(F.lower(reference)))
    recall = F.coalesce(F.size(F.array_intersect(p, r)) / F.nullif(F.size(r), F.lit(0)), F.lit(0.0))
    return recall, recall * FALLBACK_FACTORS[0], recall * FALLBACK_FACTORS[1]


def best_over_references(prediction: Column, references: Column, metric) -> Column:
    """Highest value of a metric over an array of references."""
    return F.array_max(F.transform(references, lambda r: metric(prediction, r)))


def refuses(prediction: Column) -> Column:
    normal = tx.normalize_answer(prediction)
    found = F.lit(False)
    for phrase in REFUSALS:
        found = found | normal.contains(phrase)
    return found


def answer_scores(examples: DataFrame) -> DataFrame:
    """EM and F1 per example, the best over its references; without references a refusal is right.

    ``examples(example_id, task_type, prediction, references)``.
    """
    p, refs = F.col("prediction"), F.col("references")
    refused = F.when(refuses(p), 1.0).otherwise(0.0)
    none = F.size(refs) == 0
    return examples.select(
        "example_id", "task_type",
        F.when(none, refused).otherwise(best_over_references(p, refs, exact_match)).alias("em"),
        F.when(none, refused).otherwise(best_over_references(p, refs, token_f1)).alias("f1"),
        (~none).alias("answerable"),
    )


def task_report(scores: DataFrame, *metrics: str) -> DataFrame:
    """Means per task and, as task ``overall``, over everything."""
    return scores.rollup("task_type").agg(
        *[F.round(F.avg(m), 4).alias(m) for m in metrics], F.count("*").alias("n"),
        F.grouping("task_type").alias("_g"),
    ).withColumn(
        "task_type", F.when(F.col("_g") == 1, "overall").otherwise(F.col("task_type"))
    ).drop("_g")


# -- agent runs -------------------------------------------------------------------------------

def agent_run_scores(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Status, steps, keyword hits and tool coverage of each run against its case.

    ``runs(case_id, status, tools, n_steps, final_answer)``,
    ``cases(case_id, workflow, expected_keywords, expected_tools, max_steps)``. A case without a
    run counts as an error with no steps.
    """
    answer = F.lower(F.coalesce("final_answer", F.lit("")))
    keyword_hits = F.size(F.filter("expected_keywords", lambda k: F.contains(answer, F.lower(k))))
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    tool_hits = F.size(F.filter("expected_tools", lambda x: F.array_contains(tools, x)))

    def share(hits: Column, total: Column) -> Column:
        return F.round(hits / F.greatest(total, F.lit(1)), 3)

    steps = F.coalesce("n_steps", F.lit(0))
    return cases.join(runs, "case_id", "left").select(
        "case_id", "workflow", F.coalesce("status", F.lit("error")).alias("status"),
        F.coalesce(F.col("status") == "completed", F.lit(False)).alias("completed"),
        steps.alias("n_steps"),
        share(keyword_hits, F.size("expected_keywords")).alias("keyword_score"),
        share(tool_hits, F.size("expected_tools")).alias("tool_coverage"),
        F.round(steps / F.greatest("max_steps", F.lit(1)), 3).alias("step_share"),
    )


def agent_report(scores: DataFrame) -> DataFrame:
    """Per workflow and overall (workflow ``overall``)."""
    return scores.rollup("workflow").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("completed").cast("double")), 3).alias("completion_rate"),
        F.round(F.avg("n_steps"), 1).alias("avg_steps"),
        F.round(F.avg("keyword_score"), 3).alias("avg_keyword_score"),
        F.round(F.avg("tool_coverage"), 3).alias("avg_tool_coverage"),
        F.grouping("workflow").alias("_g"),
    ).withColumn("workflow", F.when(F.col("_g") == 1, "overall").otherwise(F.col("workflow"))).drop("_g")
