"""Everything around the answer model: context, prompt, confidence, sources, cache, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions import text as tx

HIGH, MEDIUM = 0.7, 0.4
HISTORY_TURNS = 6
RECENT_MESSAGES = 10
SNIPPET_CHARS = 200
TITLE_CHARS = 100
CACHE_SECONDS = 3600
MESSAGE_LIMIT = 100
CONVERSATION_LIMIT = 50
SUPPORT_RATIO = 0.5

# Texts that are part of the output.
EMPTY_CONTEXT = "No relevant documents found."
BLOCK_RULE = "\n\n---\n\n"
UNSUPPORTED_NOTE = (
    "\n\n⚠️ Note: Some parts of this answer may not be fully supported by the provided documents."
)
NO_RESULTS_ANSWER = (
    "I couldn't find any relevant documents to answer your question. "
    "Please try uploading relevant documents first."
)


def retrieve(hits: DataFrame, table_hits: DataFrame, max_tables: int = 3) -> DataFrame:
    """Chunk hits, then at most three table hits per query behind them."""
    shape = ["query_id", "chunk_id", "doc_id", "document_name", "page_number", "content", "score",
             "search_method", "rank"]
    both = hits.select(*shape, F.lit(False).alias("_t")).unionByName(
        table_hits.filter(F.col("rank") <= max_tables).select(*shape, F.lit(True).alias("_t")))
    # One window over both kinds: a query has few hits, and neither side is planned twice.
    last = F.max(F.when(~F.col("_t"), F.col("rank"))).over(Window.partitionBy("query_id"))
    rank = F.when(F.col("_t"), F.col("rank") + F.coalesce(last, F.lit(0))).otherwise(F.col("rank"))
    return both.withColumn("rank", rank).select(shape)


def build_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One numbered source block per hit, joined by a rule; a fixed text where nothing was found."""
    page = F.when(
        F.coalesce(F.col("page_number"), F.lit(0)) != 0,
        F.concat(F.lit(", page "), F.col("page_number").cast("string")),
    ).otherwise("")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    blocks = hits.withColumn("_n", number).select(
        "query_id", "_n",
        F.concat(F.lit("[Source "), F.col("_n").cast("string"), F.lit(": "), "document_name", page,
                 F.lit("]\n"), "content").alias("_b"),
    )
    rule = BLOCK_RULE.replace("\n", "\\n")
    context = blocks.groupBy("query_id").agg(
        F.expr(f"listagg(_b, '{rule}') within group (order by _n)").alias("context")
    )
    return queries.select("query_id", "query_text").join(context, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(EMPTY_CONTEXT))
    )


def recent_messages(
    messages: DataFrame, n: int = RECENT_MESSAGES, order: str = "newest"
) -> DataFrame:
    """n messages per conversation in time order: the newest, or (``first``) the oldest ones."""
    by = F.desc("turn") if order == "newest" else F.asc("turn")
    w = Window.partitionBy("conv_id").orderBy(by)
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def messages_of(messages: DataFrame, limit: int = MESSAGE_LIMIT) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("position", F.row_number().over(w)).filter(
        F.col("position") <= limit
    )


def history_text(messages: DataFrame, turns: int = HISTORY_TURNS, order: str = "newest") -> DataFrame:
    """``Role: content`` lines of the last turns of each conversation."""
    kept = recent_messages(recent_messages(messages, RECENT_MESSAGES, order), turns)
    lines = kept.select(
        "conv_id", "turn", F.concat(F.initcap("role"), F.lit(": "), "content").alias("_l")
    )
    return lines.groupBy("conv_id").agg(
        F.expr("listagg(_l, '\\n') within group (order by turn)").alias("history")
    )


def build_prompt(context: Column, question: Column, history: Column) -> Column:
    return F.concat(
        F.lit("Context:\n"), context,
        F.coalesce(F.concat(F.lit("\n\n\nConversation history:\n"), history), F.lit("")),
        F.lit("\n\n\nCurrent question: "), question,
    )


def bucket(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Bucket of the best score per query; no hits means low."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", bucket(F.col("_best")).alias("confidence")
    )


def support_ratio(answer: Column, context: Column) -> Column:
    """Share of the distinct answer lexemes that occur in the context (default verdict)."""
    said = F.array_distinct(tx.lexemes(answer))
    return F.coalesce(
        F.size(F.array_intersect(said, tx.lexemes(context))) / F.nullif(F.size(said), F.lit(0)),
        F.lit(1.0),
    )


def downgrade_unsupported(answers: DataFrame, min_support: float = SUPPORT_RATIO) -> DataFrame:
    """Answers below high confidence that the context does not carry become low, with a note."""
    unsupported = (F.col("confidence") != "high") & (
        support_ratio(F.col("answer"), F.col("context")) < min_support
    )
    return answers.withColumn("_u", unsupported).withColumns({
        "answer": F.when(F.col("_u"), F.concat("answer", F.lit(UNSUPPORTED_NOTE))).otherwise(
            F.col("answer")),
        "confidence": F.when(F.col("_u"), "low").otherwise(F.col("confidence")),
    }).drop("_u")


def sources(hits: DataFrame) -> DataFrame:
    """Source references with snippets, in rank order (a list per query is bounded by top k)."""
    return hits.select(
        "query_id", "rank", "doc_id", "document_name", "page_number", "chunk_id",
        F.col("score").alias("relevance_score"),
        F.substring("content", 1, SNIPPET_CHARS).alias("snippet"),
    )


def source_lists(hits: DataFrame) -> DataFrame:
    fields = ["doc_id", "document_name", "page_number", "chunk_id", "relevance_score", "snippet"]
    return sources(hits).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))),
                    lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("sources")
    )


# -- answer cache -----------------------------------------------------------------------------

def cache_key(query_text: Column, filters_json: Column | None = None) -> Column:
    raw = F.lower(tx.strip(query_text))
    if filters_json is not None:
        raw = F.concat(raw, F.coalesce(F.concat(F.lit("|"), filters_json), F.lit("")))
    return F.concat(F.lit("rag:answer:"), F.sha2(raw, 256))


def request_key(query_text: Column, filters_json: Column, conversation_id: Column) -> Column:
    """Key of a request that may be answered from the cache; NULL inside a conversation, whose answers
    depend on what was said before. ``filters_json`` has its names in order; NULL: no filters."""
    return F.when(conversation_id.isNull(), cache_key(query_text, filters_json))


def serve_from_cache(requests: DataFrame, answers: DataFrame, seconds: int = CACHE_SECONDS) -> DataFrame:
    """:func:`cache_lookup` for requests and answers of which some have no key: those neither look
    anything up nor are looked up, and stay out of the windows."""
    found = cache_lookup(requests.filter("key is not null"), answers.filter("key is not null"), seconds)
    alone = requests.filter("key is null").select(
        F.col("request_id").cast("bigint").alias("request_id"), "key", "ts", F.lit(None).cast("bigint").alias("answer_id"))
    return found.unionByName(alone)


def cache_lookup(
    requests: DataFrame, answers: DataFrame, seconds: int = CACHE_SECONDS
) -> DataFrame:
    """As-of match: each request gets the latest earlier answer of its key younger than ``seconds``.

    ``requests(request_id, key, ts)``, ``answers(answer_id, key, ts)``. Time is cut into slots of
    the cache life and every answer also enters the next slot, so the window runs per (key, slot):
    a key that holds a large share of all requests is spread over its slots, and no pairs are made.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    slot = F.floor(micros / F.lit(seconds * 1_000_000))
    given = answers.select(
        "key", "ts", F.explode(F.array(slot, slot + 1)).alias("slot"),
        F.lit(None).cast("bigint").alias("request_id"),
        F.struct("ts", "answer_id").alias("_a"),
    )
    asked = requests.select(
        "key", "ts", slot.alias("slot"), F.col("request_id").cast("bigint").alias("request_id"),
        F.lit(None).cast("struct<ts:timestamp_ntz,answer_id:bigint>").alias("_a"),
    )
    # Answers sort before requests of the same instant; the newest answer id wins a tie.
    w = Window.partitionBy("key", "slot").orderBy(
        "ts", F.col("request_id").isNotNull(), F.col("_a.answer_id")
    ).rowsBetween(Window.unboundedPreceding, 0)
    latest = given.unionByName(asked).withColumn("_l", F.last("_a", ignorenulls=True).over(w))
    age = F.timestamp_diff("MICROSECOND", F.col("_l.ts"), F.col("ts"))
    return latest.filter("request_id is not null").select(
        "request_id", "key", "ts",
        F.when(age < seconds * 1_000_000, F.col("_l.answer_id")).alias("answer_id"),
    )


def hydrate_hits(hits: DataFrame) -> DataFrame:
    """Two message rows of a fresh conversation for each cached answer served.

    ``hits(request_id, query_text, answer, confidence)``.
    """
    shape = ["request_id", F.substring("query_text", 1, TITLE_CHARS).alias("title")]
    user = hits.select(*shape, F.lit(0).alias("turn"), F.lit("user").alias("role"),
                       F.col("query_text").alias("content"),
                       F.lit(None).cast("string").alias("confidence"))
    reply = hits.select(*shape, F.lit(1).alias("turn"), F.lit("assistant").alias("role"),
                        F.col("answer").alias("content"), "confidence")
    return user.unionByName(reply)


# -- conversations ----------------------------------------------------------------------------

def titles(messages: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Given title, else the first 100 characters of the first user message."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(
        F.substring(F.min_by("content", "turn"), 1, TITLE_CHARS).alias("_first")
    )
    convs = messages.select("conv_id").distinct().join(first, "conv_id", "left")
    if given is None:
        return convs.select("conv_id", F.col("_first").alias("title"))
    return convs.join(given.select("conv_id", F.col("title").alias("_given")), "conv_id", "left"
                      ).select("conv_id", F.coalesce(F.nullif("_given", F.lit("")), "_first")
                               .alias("title"))


def latest_conversations(messages: DataFrame, limit: int = CONVERSATION_LIMIT) -> DataFrame:
    return (
        messages.groupBy("conv_id")
        .agg(F.max("ts").alias("updated_at"), F.count("*").alias("n_messages"))
        .orderBy(F.desc("updated_at"), "conv_id")
        .limit(limit)
    )
