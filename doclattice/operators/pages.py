"""Page tables: assembling documents, choosing between competing extractions, tables on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.functions.rows import unnest

MIN_NATIVE_CHARS = 50
LOW_OCR_CONFIDENCE = 0.5
STORED_TABLE_ROWS = 100


def split_pages(documents: DataFrame, lines_per_page: int = 10) -> DataFrame:
    """Cut texts into pages of whole lines, inside the row."""
    pages = tx.let(
        F.split("text", "\n"),
        lambda lines: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / F.lit(lines_per_page)).cast("int")),
            lambda p: F.array_join(
                F.slice(lines, p * lines_per_page + 1, F.lit(lines_per_page)), "\n"
            ),
        ),
    )
    return unnest(documents, ["doc_id"], pages, "p", "text").select(
        "doc_id", (F.col("p") + 1).alias("page_number"), "text"
    )


def full_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Non-empty pages in page order joined by a blank line; one document is one value."""
    return (
        pages.filter(F.col("text") != "")
        .groupBy(key)
        .agg(F.expr("listagg(text, '\\n\\n') within group (order by page_number)").alias("full_text"))
    )


def stripped_length(text: Column) -> Column:
    return F.length(tx.strip(F.coalesce(text, F.lit(""))))


def native_confidence(text: Column) -> Column:
    return F.when(stripped_length(text) >= MIN_NATIVE_CHARS, 1.0).otherwise(0.5)


def needs_ocr(text: Column) -> Column:
    return stripped_length(text) < MIN_NATIVE_CHARS


def mean_word_confidence(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean of the positive integer word confidences over 100, else 0."""
    good = F.when(F.col("conf").rlike(r"\A\p{Nd}+\z"), F.col("conf").try_cast("int"))
    return words.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(good > 0, good)) / 100, F.lit(0.0)).alias("confidence")
    )


def assemble_ocr_lines(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Page text and mean confidence from recognised lines."""
    return lines.groupBy(*keys).agg(
        F.expr("listagg(text, '\\n') within group (order by line_no)").alias("text"),
        F.avg("conf").alias("confidence"),
    )


def resolve_extractions(native: DataFrame, ocr: DataFrame, ocr_fallback: DataFrame) -> DataFrame:
    """Best text per page out of native extraction and two OCR engines.

    All three carry ``doc_id, page_number, text, confidence``. OCR replaces native text that needs
    it; the fallback engine counts only where OCR was used and is empty or under 0.5, and wins only
    with text and a strictly higher confidence. One shuffle per input on the page key.
    """
    key = ["doc_id", "page_number"]
    first = ocr.select(*key, F.struct("text", "confidence").alias("o1"))
    second = ocr_fallback.select(*key, F.struct("text", "confidence").alias("o2"))
    used_ocr = F.col("needs") & F.col("o1").isNotNull()
    weak = (F.coalesce(F.col("o1.text"), F.lit("")) == "") | (
        F.col("o1.confidence") < LOW_OCR_CONFIDENCE
    )
    used_fallback = (
        used_ocr
        & weak
        & F.col("o2").isNotNull()
        & (F.coalesce(F.col("o2.text"), F.lit("")) != "")
        & (F.col("o2.confidence") > F.col("o1.confidence"))
    )

    def pick(name: str) -> Column:
        return (
            F.when(F.coalesce(used_fallback, F.lit(False)), F.col(f"o2.{name}"))
            .when(used_ocr, F.col(f"o1.{name}"))
            .otherwise(F.col(name))
        )

    method = (
        F.when(F.coalesce(used_fallback, F.lit(False)), "fallback_ocr")
        .when(used_ocr, "ocr")
        .otherwise("native")
    )
    return (
        native.withColumn("needs", needs_ocr(F.col("text")))
        .join(first, key, "left")
        .join(second, key, "left")
        .select(
            *key,
            pick("text").alias("text"),
            pick("confidence").alias("confidence"),
            method.alias("extraction_method"),
        )
    )


def table_structs(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One table per page from rows of cells: ordered rows, headers = first row.

    ``rows`` has the keys, the order columns and ``cells`` (ARRAY<STRING>). A page is the unit the
    reader hands over, so its rows fit one value.
    """
    packed = F.array_sort(F.collect_list(F.struct(*order, "cells")))
    return (
        rows.groupBy(*keys)
        .agg(F.transform(packed, lambda r: r["cells"]).alias("rows"))
        .select(*keys, F.struct(
            F.lit(0).alias("table_index"), F.element_at("rows", 1).alias("headers"),
            F.col("rows").alias("rows"),
        ).alias("table"))
    )


def table_text(rows: Column) -> Column:
    """Cells joined by a pipe, rows by a line feed; NULL cells are empty."""
    return F.array_join(
        F.transform(
            rows,
            lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "),
        ),
        "\n",
    )


def captioned_table(index: Column, rows: Column) -> Column:
    return F.concat(F.lit("[Table "), (index + 1).cast("string"), F.lit("]\n"), table_text(rows))


def document_counters(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Page and chunk counts joined back to all documents; both sides are counted before the join."""
    n_pages = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    n_chunks = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    return (
        documents.select("doc_id")
        .join(n_pages, "doc_id", "left")
        .join(n_chunks, "doc_id", "left")
        .na.fill(0, ["page_count", "total_chunks"])
    )
