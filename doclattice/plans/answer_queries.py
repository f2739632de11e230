"""Retrieval for answers, prompts, caching and conversations (RAG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import answers, search
from doclattice.plans import search_queries as sq
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.search_queries import ids
from doclattice.plans.views import CTE, with_ctes


def retrieved_v(t: Tables) -> DataFrame:
    """What the steps of an answer read: retrieved once for the batch of queries, and written."""
    return t.stored("retrieved", lambda: retrieval(t))


def retrieval(t: Tables) -> DataFrame:
    hits = sq.expanded_v(t).withColumn("page_number", F.lit(None).cast("bigint"))
    tables = search.table_search(sq.part_queries_v(t), sq.table_texts_v(t), 5).withColumn(
        "document_name", F.concat(F.lit("order/"), F.col("doc_id").cast("string"))
    )
    return answers.retrieve(hits, tables)


CTE["retrieved_v"] = (("expanded_v", "table_hits_v"), """
  select query_id, chunk_id, doc_id, document_name, cast(null as bigint) as page_number, content,
         score, 'hybrid+reranked' as search_method, rank from expanded_v
  union all
  select t.query_id, null, t.doc_id, 'order/' || t.doc_id, t.page_number, t.content, t.score, 'table',
         t.rank + coalesce(m.r, 0)
  from table_hits_v t left join (select query_id, max(rank) as r from expanded_v group by 1) m
    using (query_id) where t.rank <= 3""")
CTE["contexts_v"] = (("queries_v", "retrieved_v"), """
  select query_id, query_text, coalesce(c, 'No relevant documents found.') as context
  from queries_v left join (
    select query_id, string_agg('[Source ' || n || ': ' || document_name
        || case when coalesce(page_number, 0) <> 0 then ', page ' || page_number else '' end || ']'
        || chr(10) || content,
      chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n) as c
    from (select *, row_number() over (partition by query_id order by rank) as n from retrieved_v)
    group by 1) using (query_id)""")


@query("rag_01_retrieve", with_ctes(["retrieved_v"], "select * from retrieved_v"))
def _(t: Tables):
    return ids(retrieval(t))


@query("rag_02_context", with_ctes(["contexts_v"], "select * from contexts_v"))
def _(t: Tables):
    return answers.build_context(sq.queries_v(t), retrieved_v(t))


def messages_v(t: Tables) -> DataFrame:
    at = F.make_dt_interval(mins=(F.col("conv_id") * 7919 % 100000).cast("int"),
                            secs=F.col("turn").cast("decimal(18,6)"))
    return t.conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + at).alias("ts"),
    )


CTE["messages_v"] = ((), """
  select conv_id, turn, role, text as content, timestamp '2024-01-01 00:00:00'
    + to_minutes(conv_id * 7919 % 100000) + to_seconds(turn) as ts from conversations""")
CTE["history_v"] = (("messages_v",), """
  select conv_id, string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || content,
      chr(10) order by turn) as history
  from (select *, row_number() over (partition by conv_id order by turn desc) as n from messages_v)
  where n <= 6 group by 1""")


@query("rag_03_prompt", with_ctes(["contexts_v", "history_v"], """
    select query_id, 'Context:' || chr(10) || context || coalesce(chr(10) || chr(10) || chr(10)
      || 'Conversation history:' || chr(10) || history, '') || chr(10) || chr(10) || chr(10)
      || 'Current question: ' || query_text as prompt
    from contexts_v left join history_v on conv_id = query_id"""))
def _(t: Tables):
    history = answers.history_text(messages_v(t)).withColumnRenamed("conv_id", "query_id")
    context = answers.build_context(sq.queries_v(t), retrieved_v(t))
    return context.join(history, "query_id", "left").select(
        "query_id",
        answers.build_prompt(F.col("context"), F.col("query_text"), F.col("history")).alias("prompt"),
    )


_BUCKET = "case when {s} >= 0.7 then 'high' when {s} >= 0.4 then 'medium' else 'low' end"
CTE["confidence_v"] = (("queries_v", "retrieved_v"), f"""
  select query_id, {_BUCKET.format(s='m')} as confidence from queries_v left join (
    select query_id, max(score) as m from retrieved_v group by 1) using (query_id)""")


@query("rag_04_confidence", with_ctes(["confidence_v"], "select * from confidence_v"))
def _(t: Tables):
    return answers.confidence(sq.queries_v(t), retrieved_v(t))


@query("rag_05_faithfulness", with_ctes(["contexts_v", "confidence_v"], f"""
    , a as (select query_id, context, confidence, coalesce(m.text, query_text) as answer
      from contexts_v join confidence_v using (query_id) left join conversations m
        on m.conv_id = query_id and m.turn = 1),
    s as (select *, confidence <> 'high' and coalesce(len(list_intersect(l,
          {v.sql_lexemes('context')})) / nullif(len(l), 0)::double, 1) < 0.5 as bad
      from (select *, list_distinct({v.sql_lexemes('answer')}) as l from a))
    select query_id, case when bad then answer || {v.sql_str(answers.UNSUPPORTED_NOTE)}
        else answer end as answer, case when bad then 'low' else confidence end as confidence
    from s""".replace("\n    , a as", ", a as", 1)))
def _(t: Tables):
    hits = retrieved_v(t)
    said = t.conversations.filter("turn = 1").select(F.col("conv_id").alias("query_id"), "text")
    drafts = (
        answers.build_context(sq.queries_v(t), hits)
        .join(answers.confidence(sq.queries_v(t), hits), "query_id")
        .join(said, "query_id", "left")
        .withColumn("answer", F.coalesce("text", "query_text"))
    )
    return answers.downgrade_unsupported(drafts).select("query_id", "answer", "confidence")


@query("rag_06_sources", with_ctes(["retrieved_v"], """
    select query_id, rank, doc_id, document_name, page_number, chunk_id, score as relevance_score,
      substr(content, 1, 200) as snippet from retrieved_v"""))
def _(t: Tables):
    return ids(answers.sources(retrieved_v(t)))


# Requests are page views, answers were given at purchases; the key is the text of the query.
def cache_requests(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.filter("event_type = 'view'").select(
        F.col("event_id").alias("request_id"), "ts", F.concat(F.lit(" Query "), k).alias("query_text")
    ).withColumn("key", answers.cache_key(F.col("query_text")))


def cache_answers(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("answer_id"), "ts",
        answers.cache_key(F.concat(F.lit("query "), k)).alias("key"),
    )


CTE["lookup_v"] = ((), """
  select r.event_id as request_id, r.key, r.query_text, r.ts, (
      select max_by(a.event_id, (a.ts, a.event_id)) from events a
      where a.event_type = 'purchase' and a.props = r.props and a.ts <= r.ts
        and a.ts > r.ts - interval 3600 second) as answer_id
  from (select *, ' Query ' || json_extract_string(props, '$.k') as query_text,
          'rag:answer:' || sha256('query ' || json_extract_string(props, '$.k')) as key
        from events where event_type = 'view') r""")


@query("rag_07_answer_cache", with_ctes(["lookup_v"], """
    select request_id, key, answer_id, answer_id is not null as hit from lookup_v"""))
def _(t: Tables):
    found = answers.cache_lookup(cache_requests(t), cache_answers(t))
    return found.select("request_id", "key", "answer_id", F.col("answer_id").isNotNull().alias("hit"))


# Filters come with even numbers, conversations with every third user.
_ASKED = """select event_id, ts, event_type, case when user_id % 3 > 0 then 'rag:answer:' || sha256('query ' || k ||
      case when k % 2 = 0 then '|{"document_type":"en","limit":' || k || '}' else '' end) end as key
    from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def keyed_events(t: Tables, kind: str, name: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    wanted = F.when(k % 2 == 0, F.to_json(F.struct(F.lit("en").alias("document_type"), k.alias("limit"))))
    conversation = F.when(F.col("user_id") % 3 == 0, F.col("user_id"))
    key = answers.request_key(F.concat(F.lit("Query "), k.cast("string"), F.lit(" ")), wanted, conversation)
    return t.events.filter(F.col("event_type") == kind).select(F.col("event_id").alias(name), "ts", key.alias("key"))


@query("rag_07_filtered_cache", f"""
    with e as ({_ASKED})
    select r.event_id as request_id, r.key, (
      select max_by(a.event_id, (a.ts, a.event_id)) from e a where a.event_type = 'purchase' and a.key = r.key
        and a.ts <= r.ts and a.ts > r.ts - interval 3600 second) as answer_id
    from e r where r.event_type = 'view'""")
def _(t: Tables):
    found = answers.serve_from_cache(keyed_events(t, "view", "request_id"), keyed_events(t, "purchase", "answer_id"))
    return found.select("request_id", "key", "answer_id")


@query("rag_08_cached_messages", with_ctes(["lookup_v"], """
    select request_id, query_text as title, 0::bigint as turn, 'user' as role,
      query_text as content, cast(null as varchar) as confidence from lookup_v
      where answer_id is not null
    union all select request_id, query_text, 1, 'assistant', 'answer ' || answer_id, 'high'
      from lookup_v where answer_id is not null"""))
def _(t: Tables):
    found = answers.cache_lookup(cache_requests(t), cache_answers(t)).filter("answer_id is not null")
    served = found.join(cache_requests(t).select("request_id", "query_text"), "request_id").select(
        "request_id", "query_text",
        F.concat(F.lit("answer "), F.col("answer_id").cast("string")).alias("answer"),
        F.lit("high").alias("confidence"),
    )
    return ids(answers.hydrate_hits(served))


@query("rag_09_titles", """
    select conv_id, substr(min_by(text, turn) filter (role = 'user'), 1, 100) as title
    from conversations group by 1""")
def _(t: Tables):
    return answers.titles(messages_v(t))


@query("rag_10_messages_in_order", with_ctes(["messages_v"], """
    select conv_id, turn, role, content, position from (select *, row_number() over
      (partition by conv_id order by turn) as position from messages_v) where position <= 100"""))
def _(t: Tables):
    return ids(answers.messages_of(messages_v(t)).drop("ts"))


@query("rag_10_recent_history", with_ctes(["history_v"], "select * from history_v"))
def _(t: Tables):
    return answers.history_text(messages_v(t))


@query("rag_11_latest_conversations", with_ctes(["messages_v"], """
    select conv_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as updated_at, count(*) as n_messages
    from messages_v group by 1 order by max(ts) desc, conv_id limit 50"""))
def _(t: Tables):
    return answers.latest_conversations(messages_v(t)).withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")
    )
