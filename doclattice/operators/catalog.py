"""Catalogue queries over documents, chunks and their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_TOKENS = 2000
ERROR_CHARS = 500
UNKNOWN_TYPE = "Unknown"


def list_documents(
    documents: DataFrame,
    page: int = 1,
    size: int = 20,
    status: str | None = None,
    document_type: str | None = None,
) -> DataFrame:
    """One page of the filtered listing, newest first, with the total and the page count."""
    for name, value in (("status", status), ("document_type", document_type)):
        if value is not None:
            documents = documents.filter(F.col(name) == value)
    total = documents.agg(F.count("*")).scalar()
    rows = documents.orderBy(F.desc("created_at"), "doc_id").offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("bigint")
    )


def look_up(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Status rows for many ids at once; unknown ids stay, with ``found`` false."""
    return (
        ids.select("doc_id").distinct()
        .join(documents.withColumn("found", F.lit(True)), "doc_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def chunk_page(chunks: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """The n-th page of chunks of every document. Indexes are dense, so a range filter is enough."""
    return chunks.filter(F.col("chunk_index").between((page - 1) * size, page * size - 1))


def text_within_budget(chunks: DataFrame, max_tokens: int = TEXT_TOKENS) -> DataFrame:
    """Leading chunks of each document while their running token total stays in the budget."""
    running = F.sum("token_count").over(
        Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        chunks.withColumn("_r", running).filter(F.col("_r") <= max_tokens)
        .groupBy("doc_id")
        .agg(F.expr("listagg(content, '\\n') within group (order by chunk_index)").alias("text"),
             F.max("_r").alias("tokens"))
    )


def leading_text(chunks: DataFrame, max_chunks: int = 10) -> DataFrame:
    return (
        chunks.filter(F.col("chunk_index") < max_chunks)
        .groupBy("doc_id")
        .agg(F.expr("listagg(content, '\\n\\n') within group (order by chunk_index)").alias("text"),
             F.count("*").alias("chunk_count"))
    )


def without_documents(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """What a cascade delete leaves of any table keyed by document."""
    return table.join(deleted.select("doc_id"), "doc_id", "left_anti")


def latest_status(log: DataFrame) -> DataFrame:
    """Current state per document from a status event log (doc_id, status, error, ts, event_id)."""
    newest = F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "event_id"))
    return log.groupBy("doc_id").agg(newest.alias("_n"), F.count("*").alias("n_changes")).select(
        "doc_id", F.col("_n.status").alias("status"),
        F.substring("_n.error", 1, ERROR_CHARS).alias("error_message"),
        F.col("_n.ts").alias("updated_at"), "n_changes",
    )


def newest_of_type(documents: DataFrame, document_type: str, limit: int = 20) -> DataFrame:
    return (
        documents.filter(F.col("document_type") == document_type)
        .orderBy(F.desc("created_at"), "doc_id")
        .limit(limit)
    )


def field_maps(documents: DataFrame, classifications: DataFrame, fields: DataFrame) -> DataFrame:
    """Document, its type (``Unknown`` if none) and a name -> value map of its fields."""
    maps = fields.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "field_value"))).alias("fields")
    )
    return (
        documents.select("doc_id")
        .join(classifications.select("doc_id", "document_type"), "doc_id", "left")
        .join(maps, "doc_id", "left")
        .withColumn("document_type", F.coalesce("document_type", F.lit(UNKNOWN_TYPE)))
    )


def change_kind(a: Column, b: Column, in_a: Column, in_b: Column) -> Column:
    return (
        F.when(~in_a, "added").when(~in_b, "removed").when(a.eqNullSafe(b), "same")
        .otherwise("modified")
    )


def compare_fields(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Field differences of document pairs (pair_id, doc_a, doc_b), by name.

    A full outer comparison as one aggregation: both sides are labelled, united and grouped by
    (pair, field), so each is shuffled once.
    """
    def side(doc: str, n: int) -> DataFrame:
        return pairs.select("pair_id", F.col(doc).alias("doc_id")).join(fields, "doc_id").select(
            "pair_id", "field_name", F.lit(n).alias("side"), "field_value"
        )

    both = side("doc_a", 1).unionByName(side("doc_b", 2))

    def value(n: int) -> Column:
        return F.max(F.when(F.col("side") == n, F.col("field_value")))

    def present(n: int) -> Column:
        return F.max(F.when(F.col("side") == n, 1)).isNotNull()

    return both.groupBy("pair_id", "field_name").agg(
        value(1).alias("value_a"), value(2).alias("value_b"),
        present(1).alias("_a"), present(2).alias("_b"),
    ).select(
        "pair_id", "field_name", "value_a", "value_b",
        change_kind(F.col("value_a"), F.col("value_b"), F.col("_a"), F.col("_b")).alias("change"),
    )


def compare_documents(pairs: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Both sides of each pair (pair_id, doc_a, doc_b): names, types, texts, and how many fields are
    added, removed, modified and the same. Pairs with a side that ``documents(doc_id, name,
    document_type, text)`` lacks drop out; a type that is not known is ``Unknown``."""
    def side(c: str) -> DataFrame:
        return documents.select(
            F.col("doc_id").alias(f"doc_{c}"), F.col("name").alias(f"name_{c}"),
            F.coalesce("document_type", F.lit("Unknown")).alias(f"type_{c}"), F.col("text").alias(f"text_{c}"))

    kinds = ("added", "removed", "modified", "same")
    changes = compare_fields(pairs, fields).groupBy("pair_id").agg(*[
        F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds])
    both = pairs.select("pair_id", "doc_a", "doc_b").join(side("a"), "doc_a").join(side("b"), "doc_b")
    return both.join(changes, "pair_id", "left").select(
        "pair_id", *[f"{n}_{c}" for n in ("name", "type", "text") for c in "ab"],
        (F.col("type_a") == F.col("type_b")).alias("same_type"),
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds])


def dashboard(documents: DataFrame, chunks: DataFrame, latest: int = 5) -> DataFrame:
    """Totals, counts per status and type, chunk sum and the newest documents, in long form."""
    def section(name: str, label: Column, value: Column) -> list[Column]:
        return [F.lit(name).alias("section"), label.cast("string").alias("label"),
                value.cast("bigint").alias("value")]

    grouped = documents.groupingSets(
        [[], ["status"], ["document_type"]], "status", "document_type"
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    counts = grouped.select(
        F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "status").otherwise("type")
        .alias("section"),
        F.when(F.col("g") == 1, F.col("status")).when(F.col("g") == 2, F.col("document_type"))
        .otherwise("documents").alias("label"),
        F.col("n").alias("value"),
    )
    total_chunks = chunks.agg(F.count("*").alias("n")).select(
        *section("total", F.lit("chunks"), F.col("n"))
    )
    newest = documents.orderBy(F.desc("created_at"), "doc_id").limit(latest).select(
        *section("latest", F.col("name"), F.col("doc_id"))
    )
    return counts.unionByName(total_chunks).unionByName(newest)
