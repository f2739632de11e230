"""Workflows as jobs over whole tables: invoice anomalies, summaries, research sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.functions.rows import unnest
from doclattice.operators.vectors import rank_per_query

# |z| limits of an unusual amount, by severity.
Z_LIMITS = (("HIGH", 3.0), ("MEDIUM", 2.0), ("LOW", 1.5))
REQUIRED = ("vendor", "invoice_date", "due_date", "amount", "tax")
SUMMARY_SENTENCES = {"one_line": 1, "executive": 4, "takeaways": 8}


def _finding(found: Column, kind: str, severity: Column | str, detail: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(found, F.struct(F.lit(kind).alias("anomaly"), level.alias("severity"), detail.alias("detail")))


def invoice_anomalies(
    invoices: DataFrame,
    duplicate_key: tuple[str, ...] = ("vendor", "invoice_date", "amount"),
    as_of: Column | None = None,
) -> DataFrame:
    """Findings of five rules over all invoices, as long rows (doc_id, anomaly, severity, detail).

    ``invoices(doc_id, vendor, invoice_date, due_date, amount, tax)``. Vendor statistics and
    duplicate counts are plain aggregates with map-side sums, joined back; nothing is collected per
    vendor, so a vendor may hold any share of the invoices.
    """
    vendors = invoices.filter("vendor is not null").groupBy("vendor").agg(
        F.avg("amount").alias("_mean"), F.stddev_samp("amount").alias("_sd"),
        F.min("invoice_date").alias("_first"), F.count("*").alias("_n"),
    )
    key = list(duplicate_key)
    copies = invoices.dropna(subset=key).groupBy(*key).agg(
        F.count("*").alias("_copies"), F.min("doc_id").alias("_original")
    ).filter("_copies > 1")
    judged = invoices.join(vendors, "vendor", "left").join(copies, key, "left")
    z = F.round((F.col("amount") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), 4)
    level = F.lit(None).cast("string")
    for name, limit in reversed(Z_LIMITS):
        level = F.when(F.abs("_z") >= limit, name).otherwise(level)
    absent = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()
    )
    late = F.col("due_date") < F.col("invoice_date")
    future = F.lit(False) if as_of is None else F.col("invoice_date") > as_of
    findings = [
        _finding(F.abs("_z") >= Z_LIMITS[-1][1], "unusual_amount", level,
                 F.concat(F.lit("z="), F.format_string("%.4f", F.col("_z")))),
        _finding(F.col("invoice_date") == F.col("_first"), "new_vendor", "LOW",
                 F.concat(F.lit("first invoice of "), F.col("vendor"))),
        _finding(F.col("doc_id") != F.col("_original"), "duplicate", "HIGH",
                 F.concat(F.lit("same as "), F.col("_original").cast("string"))),
        _finding(F.size("_m") > 0, "missing_fields", F.when(F.size("_m") > 1, "HIGH").otherwise("MEDIUM"),
                 F.array_join("_m", ",")),
        _finding(late | future, "date_anomaly", F.when(late, "MEDIUM").otherwise("HIGH"),
                 F.when(late, "due before invoice date").otherwise("invoice date in the future")),
    ]
    # All rules look at a row once; what they find are elements of one array.
    found = F.filter(F.array(*findings), lambda x: x.isNotNull())
    rows = judged.withColumn("_z", z).withColumn("_m", absent)
    return unnest(rows, ["doc_id"], found, "_i", "_f").select("doc_id", "_f.*")


def invoice_summary(invoices: DataFrame, top_vendors: int = 5) -> DataFrame:
    """Count and amount range, and the most frequent vendors, as (section, label, value)."""
    totals = invoices.agg(
        F.count("*").cast("double").alias("n"), F.min("amount").alias("lo"), F.max("amount").alias("hi")
    ).select(F.lit("summary").alias("section"),
             F.expr("stack(3, 'invoices', n, 'min_amount', lo, 'max_amount', hi) as (label, value)"))
    vendors = (
        invoices.filter("vendor is not null").groupBy("vendor").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "vendor").limit(top_vendors)
        .select(F.lit("vendor").alias("section"), F.col("vendor").alias("label"),
                F.col("n").cast("double").alias("value"))
    )
    return totals.unionByName(vendors)


def _sentence_sums(lists: Column) -> Column:
    """Per sentence of a document (an array of word arrays): how often its distinct words are in the
    document, added up, and how many they are. Counted on word numbers of whole Arrow batches."""

    @F.arrow_udf("array<struct<total:long,n:long>>")
    def sums(documents: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(documents), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sentences = documents.flatten()
        lengths = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = sentences.flatten().dictionary_encode()
        known = max(len(words.dictionary), 1)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(np.arange(len(lengths)), lengths)
        document = np.repeat(np.arange(len(sizes)), sizes)
        _, own, tf = np.unique(document[place] * known + code, return_inverse=True, return_counts=True)
        pairs, first = np.unique(place * known + code, return_index=True)
        total = np.bincount(pairs // known, weights=tf[own[first]], minlength=len(lengths)).astype(np.int64)
        n = np.bincount(pairs // known, minlength=len(lengths))
        found = pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(n, pa.int64())], ["total", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found)

    return sums(lists)


def _scored(documents: DataFrame) -> DataFrame:
    """(doc, sentences as an array of (score, pos, sentence)), all inside the row."""
    sents = documents.select("doc_id", tx.sentences(F.col("text")).alias("_s"))
    counted = sents.withColumn(
        "_c", _sentence_sums(F.coalesce(F.transform("_s", lambda s: tx.lexemes(s)), F.array().cast("array<array<string>>"))))
    score = lambda c: F.when(c["n"] > 0, F.round(c["total"] / c["n"], 6)).otherwise(0.0)
    rows = F.zip_with("_s", "_c", lambda s, c: F.struct(score(c).alias("score"), s.alias("sentence")))
    return counted.select("doc_id", F.transform(rows, lambda r, i: F.struct(
        r["score"].alias("score"), i.alias("pos"), r["sentence"].alias("sentence"))).alias("_r"))


def sentence_scores(documents: DataFrame) -> DataFrame:
    """(doc, pos, sentence, score): mean document frequency of the sentence's distinct lexemes.

    A document is scored inside its row: no word leaves it, so nothing is shuffled.
    """
    return unnest(_scored(documents), ["doc_id"], "_r", "_i", "_e").select(
        "doc_id", F.col("_i").alias("pos"), "_e.sentence", "_e.score")


def extractive_summaries(documents: DataFrame, levels: dict[str, int] = SUMMARY_SENTENCES) -> DataFrame:
    """Summary texts per document and level: the best sentences, in text order."""
    ranked = F.array_sort(F.transform("_r", lambda r: F.struct(
        (-r["score"]).alias("o"), r["pos"].alias("pos"), r["sentence"].alias("sentence"))))
    best = _scored(documents).filter(F.size("_r") > 0).select(
        "doc_id", F.slice(ranked, 1, max(levels.values())).alias("_b"))
    in_order = lambda n: F.array_sort(F.transform(
        F.slice("_b", 1, n), lambda b: F.struct(b["pos"].alias("pos"), b["sentence"].alias("sentence"))))
    per_level = F.array(*[
        F.struct(F.lit(name).alias("level"),
                 F.array_join(F.transform(in_order(n), lambda b: b["sentence"]), " ").alias("summary"),
                 F.least(F.size("_b"), F.lit(n)).cast("long").alias("n_sentences"))
        for name, n in levels.items()
    ])
    return unnest(best, ["doc_id"], per_level, "_n", "_l").select("doc_id", "_l.*")


def citation(name: Column, page: Column) -> Column:
    return F.concat(F.lit("[Source: "), name, F.lit(", page "),
                    F.coalesce(page.cast("string"), F.lit("?")), F.lit("]"))


def research_set(hits: DataFrame, per_document: int = 3, k: int = 20) -> DataFrame:
    """Best chunks of every document a query touches, at most ``per_document`` each, with citations."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    capped = hits.withColumn("in_document", F.row_number().over(w)).filter(
        F.col("in_document") <= per_document
    )
    return rank_per_query(capped.drop("rank"), k, "chunk_id").withColumn(
        "citation", citation(F.col("document_name"), F.col("page_number"))
    )
