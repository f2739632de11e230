"""Search over query tables: filters, fusion, dedupe, re-ranking and enrichment of hits.

A hits table has ``query_id, chunk_id, doc_id, score, rank, search_method`` (and ``content`` where
text is needed); a queries table has ``query_id, query_text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from doclattice.functions import text as tx
from doclattice.functions.rows import unnest
from doclattice.operators import lexical, vectors
from doclattice.session import plain_unions

RRF_K = 60
OVERFETCH = 2
DECAY_DAYS = 90.0
BOOST_WEIGHT = 0.15
TABLE_SCORE = 0.5
TABLE_CHARS = 1000
COMPRESSED_SENTENCES = 5
AGENT_CHARS = 500
GRAM = 3
#: Characters of queries that travel to all tasks as one automaton (some fifty bytes of memory each).
PATTERN_CHARS = 1 << 20
#: Most hits (some fifty bytes each) that are sent to all tasks to fetch their texts.
SENT_HITS = 1 << 18


# -- filters ----------------------------------------------------------------------------------

def document_filter(filters: DataFrame, documents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Per-query filters as a function that drops candidates before scoring.

    ``filters(query_id, document_type, document_ids, date_from, date_to)``: every field may be
    NULL; dates are inclusive. Queries without a row in ``filters`` are not restricted.
    """
    attributes = documents.select("doc_id", "document_type", "created_at")

    def absent_or(field: str, test: Column) -> Column:
        return F.col(f"_f.{field}").isNull() | test

    def allowed(candidates: DataFrame) -> DataFrame:
        wanted = filters.select(
            "query_id", F.struct("document_type", "document_ids", "date_from", "date_to").alias("_f")
        )
        keep = (
            absent_or("document_type", F.col("document_type") == F.col("_f.document_type"))
            & absent_or("document_ids", F.array_contains(F.col("_f.document_ids"), F.col("doc_id")))
            & absent_or("date_from", F.col("created_at") >= F.col("_f.date_from"))
            & absent_or("date_to", F.col("created_at") <= F.col("_f.date_to"))
        )
        return (
            candidates.join(wanted, "query_id", "left")
            .join(attributes, "doc_id")
            .filter(keep)
            .select(candidates.columns)
        )

    return allowed


# -- lists and fusion -------------------------------------------------------------------------

def with_filters(query_vectors: DataFrame, chunk_vectors: DataFrame, filters: DataFrame,
                 documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a vector search with what ``vectors.exact_top_k`` needs to apply the filters of
    :func:`document_filter`. Vectors of unknown documents drop out, as keyword candidates do."""
    wanted = filters.select("query_id", *vectors.FILTERS)
    attributes = documents.select("doc_id", "document_type", "created_at")
    return query_vectors.join(wanted, "query_id", "left"), chunk_vectors.join(attributes, "doc_id")


def semantic_search(
    query_vectors: DataFrame, chunk_vectors: DataFrame, k: int, digits: tuple[int, ...] = (lexical.SCORE_DIGITS,)
) -> DataFrame:
    """The ``k`` nearest chunks of each query by cosine, rounded as in :func:`vectors.exact_top_k`."""
    items = chunk_vectors.withColumnRenamed("chunk_id", "item_id")
    return vectors.exact_top_k(query_vectors, items, k, digits).select(
        "query_id", F.col("item_id").alias("chunk_id"), "score", "rank",
        F.lit("semantic").alias("search_method"),
    )


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; one aggregation over their union."""
    plain_unions(lists[0].sparkSession)
    union = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "chunk_id", "rank"))
    fused = union.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).withColumn(
        "search_method", F.lit("hybrid")
    )


def search(
    queries: DataFrame,
    index: DataFrame,
    statistics: DataFrame,
    query_vectors: DataFrame,
    chunk_vectors: DataFrame,
    mode: str = "hybrid",
    top_k: int = 10,
    filters: DataFrame | None = None,
    documents: DataFrame | None = None,
    frequencies: DataFrame | None = None,
    digits: tuple[int, ...] = (lexical.SCORE_DIGITS,),
) -> DataFrame:
    """Candidate lists of twice ``top_k`` per query, fused in hybrid mode.

    ``filters`` with ``documents`` (see :func:`document_filter`) restrict both sides of every mode,
    query by query, before the best are taken.
    """
    allowed = None
    if filters is not None:
        allowed = document_filter(filters, documents)
        query_vectors, chunk_vectors = with_filters(query_vectors, chunk_vectors, filters, documents)
    depth = top_k * OVERFETCH
    if mode not in ("hybrid", "semantic", "keyword"):
        raise ValueError(f"unknown search mode {mode}")
    lists = []
    if mode in ("hybrid", "semantic"):
        lists.append(semantic_search(query_vectors, chunk_vectors, depth, digits))
    if mode in ("hybrid", "keyword"):
        lists.append(lexical.keyword_search(queries, index, statistics, depth, allowed, frequencies=frequencies))
    return reciprocal_rank_fusion(lists) if mode == "hybrid" else lists[0]


# -- several phrasings of a query -------------------------------------------------------------

def fan_out(queries: DataFrame, expansions: DataFrame, max_alternatives: int = 2) -> DataFrame:
    """Each query as branch 0 and its alternatives as branches 1..n; ``variant_id`` is unique."""
    width = max_alternatives + 1
    original = queries.select("query_id", F.lit(0).alias("branch"), "query_text")
    others = expansions.filter(F.col("branch").between(1, max_alternatives)).select(
        "query_id", F.col("branch").cast("int").alias("branch"), "query_text"
    )
    return original.unionByName(others).withColumn(
        "variant_id", F.col("query_id") * width + F.col("branch")
    )


def first_occurrences(hits: DataFrame) -> DataFrame:
    """First hit per query and chunk (table hits: per document, page and first 200 characters)."""
    key = F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("c"), F.col("chunk_id").cast("string"))
                 ).otherwise(F.concat_ws(
                     ":", F.lit("t"), F.col("doc_id").cast("string"),
                     F.col("page_number").cast("string"),
                     F.md5(F.substring(F.coalesce("content", F.lit("")), 1, 200))))
    first = Window.partitionBy("query_id", "_key").orderBy("branch", "rank")
    return (
        hits.withColumn("_key", key)
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .drop("_key", "_n")
    )


# -- re-ranking -------------------------------------------------------------------------------

def lexical_overlap(query_text: Column, content: Column) -> Column:
    """Share of the distinct query lexemes found in the content (default pair score)."""
    wanted = F.array_distinct(tx.lexemes(query_text))
    return F.coalesce(
        F.size(F.array_intersect(wanted, tx.lexemes(content))) / F.nullif(F.size(wanted), F.lit(0)),
        F.lit(0.0),
    )


def model_pair_score(factory: Callable[[], Callable[[list, list], list]]) -> Callable:
    """Pair scorer around a cross-encoder built once per worker."""

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        predict = factory()
        for queries, contents in batches:
            yield pa.array(
                [float(x) for x in predict(queries.to_pylist(), contents.to_pylist())],
                pa.float64(),
            )

    return score


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    top_k: int,
    scorer: Callable[[Column, Column], Column] = lexical_overlap,
) -> DataFrame:
    """Score (query, content) pairs anew, mark the method, keep the best ``top_k``."""
    texts = queries.select("query_id", "query_text")
    scored = (
        hits.drop("score", "rank")
        .join(texts, "query_id")
        .withColumn("score", F.round(scorer(F.col("query_text"), F.col("content")), 6))
        .withColumn("search_method", F.concat("search_method", F.lit("+reranked")))
        .drop("query_text")
    )
    return vectors.rank_per_query(scored, top_k, "chunk_id")


# -- enrichment -------------------------------------------------------------------------------

def sent(hits: DataFrame, most: int | None) -> DataFrame:
    """Hits that travel to the texts, so that these are not shuffled, if ``most`` says that they are few."""
    return F.broadcast(hits) if most is not None and most <= SENT_HITS else hits


def attach_chunks(
    hits: DataFrame, chunks: DataFrame, documents: DataFrame, most_hits: int | None = None
) -> DataFrame:
    """Result shape: chunk text and position, and the document name. ``most_hits`` is for :func:`sent`."""
    extra = [c for c in ("content", "chunk_index", "page_number") if c in chunks.columns]
    return (
        sent(hits.drop("doc_id"), most_hits)
        .join(chunks.select("chunk_id", "doc_id", *extra), "chunk_id")
        .join(documents.select("doc_id", F.col("name").alias("document_name")), "doc_id")
    )


def expand_to_neighbours(
    hits: DataFrame, chunks: DataFrame, window: int = 1, most_hits: int | None = None
) -> DataFrame:
    """Replace the content by that of the chunks around it, in order, if there is more than one.

    The window is spelled out as wanted positions, so this is an equi-join on (document, index);
    ``most_hits`` is for :func:`sent`.
    """
    wanted = hits.select(
        "query_id", "chunk_id", "doc_id",
        F.explode(F.sequence(F.greatest(F.col("chunk_index") - window, F.lit(0)),
                             F.col("chunk_index") + window)).alias("chunk_index"),
    )
    context = (
        sent(wanted, most_hits and most_hits * (2 * window + 1)).join(
            chunks.select("doc_id", "chunk_index", F.col("content").alias("_c")),
            ["doc_id", "chunk_index"],
        )
        .groupBy("query_id", "chunk_id")
        .agg(
            F.expr("listagg(_c, '\\n') within group (order by chunk_index)").alias("_context"),
            F.count("*").alias("_n"),
        )
    )
    return (
        hits.join(context, ["query_id", "chunk_id"], "left")
        .withColumn("parent_child", F.coalesce(F.col("_n") > 1, F.lit(False)))
        .withColumn("content", F.when(F.col("parent_child"), F.col("_context")).otherwise(F.col("content")))
        .drop("_context", "_n")
    )


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    )


def substring_matches(queries: DataFrame, texts: DataFrame, id_cols: list[str]) -> DataFrame:
    """(query, text) pairs where the lower-cased text contains the lower-cased query.

    Queries of up to ``PATTERN_CHARS`` characters in all become one automaton that reads every text
    once, whatever their number. More than that is not sent to tasks; then queries and texts meet
    through trigrams.
    """
    low = queries.select("query_id", F.lower("query_text").alias("_q")).filter("_q <> ''")
    size = low.agg(F.sum(F.length("_q"))).first()[0] or 0
    if size > PATTERN_CHARS:
        return _trigram_matches(queries, texts, id_cols)
    asked: dict[str, list] = {}
    for row in low.collect():  # PATTERN_CHARS at most
        asked.setdefault(row["_q"], []).append(row["query_id"])
    found = [name for name in id_cols]
    schema = T.StructType([queries.schema["query_id"], *(texts.schema[c] for c in found)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern, ids in asked.items():
            automaton.add_word(pattern, ids)
        automaton.make_automaton()
        for batch in batches:
            rows, ids = [], []
            for i, text in enumerate(batch.column(len(found)).to_pylist()):
                if text and asked:
                    hits = {id(own): own for _, own in automaton.iter(text)}
                    for own in hits.values():
                        ids.extend(own)
                        rows.extend([i] * len(own))
            at = pa.array(rows, pa.int64())
            kind = to_arrow_type(schema["query_id"].dataType)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *(batch.column(c).take(at) for c in range(len(found)))], schema.names)

    return texts.select(*found, F.lower("text").alias("_t")).mapInArrow(scan, schema)


def _trigram_matches(queries: DataFrame, texts: DataFrame, id_cols: list[str]) -> DataFrame:
    """Queries meet texts only through the query's rarest character trigram (the whole query if it is
    shorter), which every containing text must have; the containment test then decides.
    """
    low = F.lower("query_text")
    q = queries.select("query_id", low.alias("_q")).filter("_q <> ''")
    q = q.select(
        "query_id", "_q",
        F.explode(F.when(F.length("_q") < GRAM, F.array("_q")).otherwise(_grams(F.col("_q"), GRAM)))
        .alias("gram"),
    )
    t = texts.select(*id_cols, F.lower("text").alias("_t"))
    # Shorter grams are cut only if some query is that short.
    shortest = q.agg(F.min(F.length("_q"))).scalar()
    none = F.array().cast("array<string>")
    cut = F.concat(
        _grams(F.col("_t"), GRAM),
        *[F.when(shortest <= n, _grams(F.col("_t"), n)).otherwise(none) for n in range(1, GRAM)],
    )
    # Grams travel with the ids only. The semi joins can build just their right, small side, so
    # the exploded table is never the one that gets broadcast or sorted with its texts.
    exploded = unnest(t, id_cols, cut, "_n", "gram").drop("_n")
    counts = (
        exploded.select("gram").join(q.select("gram").distinct(), "gram", "left_semi")
        .groupBy("gram").agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0)).alias("n")
    rarest = (
        q.join(counts, "gram", "left")
        .groupBy("query_id", "_q")
        .agg(F.min(F.struct(n, F.col("gram")))["gram"].alias("gram"))
    )
    candidates = exploded.join(rarest.select("gram").distinct(), "gram", "left_semi").join(
        rarest, "gram"
    )
    return (
        candidates.join(t, id_cols)
        .filter(F.contains(F.col("_t"), F.col("_q")))
        .select("query_id", *id_cols)
    )


def table_search(queries: DataFrame, tables: DataFrame, k: int = 5) -> DataFrame:
    """Tables whose text contains the query, k per query in (document, page, table) order.

    ``tables(doc_id, page_number, table_index, text)``.
    """
    ids = ["doc_id", "page_number", "table_index"]
    found = substring_matches(queries, tables, ids)
    order = Window.partitionBy("query_id").orderBy(*ids)
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return sent(top, queries.count() * k).join(tables.select(*ids, "text"), ids).select(
        "query_id", "rank", F.lit(None).cast("bigint").alias("chunk_id"), "doc_id", "page_number",
        "table_index", F.substring("text", 1, TABLE_CHARS).alias("content"),
        F.lit(TABLE_SCORE).alias("score"), F.lit("table").alias("search_method"),
    )


def compress(content: Column, query_text: Column, max_sentences: int = COMPRESSED_SENTENCES) -> Column:
    """The sentences that share most words with the query, in text order; short texts unchanged.

    Equal overlaps keep the earlier sentence; every repeat of a kept sentence stays.
    """

    def kept_sentences(parts: Column, wanted: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                parts,
                lambda s, i: F.struct(
                    (-F.size(F.array_intersect(wanted, tx.words(F.lower(s))))).alias("o"),
                    i.alias("i"), s.alias("s"),
                ),
            )
        )
        return F.transform(F.slice(ranked, 1, max_sentences), lambda r: r["s"])

    def shorten(parts: Column) -> Column:
        kept = tx.let(
            F.array_distinct(tx.words(F.lower(query_text))), lambda w: kept_sentences(parts, w)
        )
        return F.when(F.size(parts) <= max_sentences, content).otherwise(
            tx.let(kept, lambda k: F.array_join(
                F.filter(parts, lambda s: F.array_contains(k, s)), " "))
        )

    return tx.let(tx.loose_sentences(content), shorten)


def temporal_boost(
    hits: DataFrame,
    documents: DataFrame,
    as_of: Column,
    decay_days: float = DECAY_DAYS,
    weight: float = BOOST_WEIGHT,
) -> DataFrame:
    """Add ``weight * exp(-age in days / decay_days)`` and rank again."""
    dates = documents.select("doc_id", "created_at")
    age = F.timestamp_diff("MICROSECOND", F.col("created_at"), as_of) / F.lit(86_400_000_000.0)
    boosted = hits.join(dates, "doc_id", "left").withColumn(
        "score",
        F.round(
            F.col("score") + F.coalesce(weight * F.exp(-age / decay_days), F.lit(0.0)), 6
        ),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return boosted.drop("created_at").withColumn("rank", F.row_number().over(order))


def agent_search(
    queries: DataFrame,
    index: DataFrame,
    statistics: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    k: int = 5,
    document_type: str | None = None,
) -> DataFrame:
    """Keyword search with short contents, optionally within one document type."""
    allowed = None
    if document_type is not None:
        typed = documents.filter(F.col("document_type") == document_type).select("doc_id")

        def allowed(c):
            return c.join(typed, "doc_id", "left_semi")

    hits = lexical.keyword_search(queries, index, statistics, k, allowed)
    return attach_chunks(hits, chunks, documents, queries.count() * k).select(
        "query_id", "rank", "doc_id", "document_name",
        F.substring("content", 1, AGENT_CHARS).alias("content"), F.col("score").alias("relevance"),
    )
