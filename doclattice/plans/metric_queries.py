"""Evaluation metrics (EVL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import metrics, search
from doclattice.plans import search_queries as sq
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.sample_queries import samples_v
from doclattice.plans.search_queries import ids
from doclattice.plans.views import CTE, with_ctes
from doclattice.sources import adapters


# -- retrieval: relevant are the documents that contain the passage ----------------------------

def relevant_v(t: Tables) -> DataFrame:
    return search.substring_matches(
        sq.queries_v(t), t.documents.select("doc_id", "text"), ["doc_id"]
    )


CTE["relevant_v"] = (("queries_v",), """
  select query_id, doc_id from queries_v join documents on contains(lower(text), lower(query_text))""")


def scores_v(t: Tables) -> DataFrame:
    return metrics.retrieval_scores(sq.queries_v(t), sq.hybrid_hits_v(t), relevant_v(t))


CTE["retrieval_v"] = (("queries_v", "hybrid_hits_v", "relevant_v"), """
  select query_id, case when g.first is not null then 1.0::double else 0.0::double end as hit,
    coalesce(1.0::double / g.first, 0) as mrr, coalesce(g.dcg / i.ideal, 0) as ndcg
  from queries_v left join (
      select query_id, min(rank) as first, sum(1 / log2(rank + 1)) as dcg
      from hybrid_hits_v semi join relevant_v using (query_id, doc_id) group by 1) g using (query_id)
    left join (select query_id, list_sum(list_transform(range(1, least(count(*), 10) + 1),
      lambda i: 1 / log2(i + 1))) as ideal from relevant_v group by 1) i using (query_id)""")


@query("evl_01_hit_rate", with_ctes(["retrieval_v"], "select query_id, hit from retrieval_v"))
def _(t: Tables):
    return scores_v(t).select("query_id", "hit")


@query("evl_02_mrr", with_ctes(["retrieval_v"], "select query_id, round(mrr, 6) as mrr from retrieval_v"))
def _(t: Tables):
    return scores_v(t).select("query_id", F.round("mrr", 6).alias("mrr"))


@query("evl_03_ndcg", with_ctes(["retrieval_v"], """
    select query_id, round(ndcg, 6) as ndcg from retrieval_v"""))
def _(t: Tables):
    return scores_v(t).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("evl_03_relevant_documents", with_ctes(["relevant_v"], "select * from relevant_v"))
def _(t: Tables):
    return relevant_v(t)


@query("evl_04_retrieval_means", with_ctes(["retrieval_v"], """
    select round(avg(hit), 4) as hit, round(avg(mrr), 4) as mrr, round(avg(ndcg), 4) as ndcg,
      count(*) as n from retrieval_v"""))
def _(t: Tables):
    return metrics.macro_means(scores_v(t), "hit", "mrr", "ndcg")


# -- classification: language against a hashed prediction --------------------------------------

def predictions_v(t: Tables) -> DataFrame:
    u = v.hash_unit(F.lit("pred"), F.col("doc_id"))
    return t.documents.select(
        "doc_id", F.col("lang").alias("actual"),
        F.when(u < 0.7, F.col("lang")).when(u < 0.8, "en").when(u < 0.9, "de").otherwise("fr")
        .alias("pred"),
        F.round(u, 3).alias("confidence"), (F.col("n_chars") % 16).cast("int").alias("label"), "text",
    )


CTE["predictions_v"] = ((), f"""
  select doc_id, lang as actual, case when u < 0.7 then lang when u < 0.8 then 'en' when u < 0.9
      then 'de' else 'fr' end as pred, round(u, 3) as confidence, n_chars % 16 as label
  from (select *, {v.sql_hash_unit("'pred'", 'doc_id')} as u from documents)""")
CTE["report_v"] = (("predictions_v",), """
  select cls as label, coalesce(r / nullif(p, 0)::double, 0) as precision,
    coalesce(r / nullif(s, 0)::double, 0) as recall, coalesce(2.0::double * r / nullif(s + p, 0), 0)
      as f1, s as support
  from (select cls, (select count(*) from predictions_v where actual = cls) as s,
      (select count(*) from predictions_v where pred = cls) as p,
      (select count(*) from predictions_v where pred = cls and actual = cls) as r
    from (select actual as cls from predictions_v union select pred from predictions_v))""")


@query("evl_05_weighted_scores", with_ctes(["report_v", "predictions_v"], """
    select (select round(avg(case when actual = pred then 1.0::double else 0 end), 6) from predictions_v)
        as accuracy, (select round(avg(confidence), 6) from predictions_v) as avg_confidence,
      (select count(*) from predictions_v) as n,
      round(sum(precision * support) / sum(support), 6) as precision,
      round(sum(recall * support) / sum(support), 6) as recall,
      round(sum(f1 * support) / sum(support), 6) as f1 from report_v"""))
def _(t: Tables):
    return metrics.weighted_summary(metrics.confusion(predictions_v(t)))


@query("evl_06_class_report", with_ctes(["report_v"], """
    select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
      support from report_v"""))
def _(t: Tables):
    r = metrics.class_report(metrics.confusion(predictions_v(t)))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("evl_06_confusion_matrix", with_ctes(["predictions_v"], """
    select actual, count(*) filter (pred = 'de') as de, count(*) filter (pred = 'en') as en,
      count(*) filter (pred = 'es') as es, count(*) filter (pred = 'fr') as fr
    from predictions_v group by 1"""))
def _(t: Tables):
    return metrics.confusion_matrix(metrics.confusion(predictions_v(t)), ["de", "en", "es", "fr"])


_SCAN = "(values " + ", ".join(
    f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(adapters.SCAN_CATEGORIES.items())
) + ") m(i, class_name, mapped_to)"


@query("evl_07_original_class_accuracy", with_ctes(["predictions_v"], f"""
    select class_name, mapped_to, count(*) as n, round(avg(case when pred = actual and confidence < 0.6
      or mapped_to = 'Other' and pred <> actual then 1.0::double else 0 end), 6) as accuracy
    from predictions_v join {_SCAN} on i = label group by 1, 2"""))
def _(t: Tables):
    named = adapters.scan_records(predictions_v(t))
    sure = (F.col("pred") == F.col("actual")) & (F.col("confidence") < 0.6)
    wrong = F.col("pred") != F.col("actual")
    guess = F.when(sure, F.col("category")).when(wrong, "Other").otherwise("none")
    return metrics.original_class_accuracy(
        named.select("class_name", F.col("category").alias("actual"), guess.alias("pred")))


# -- answers: assistant turns against user turns ------------------------------------------------

def examples_v(t: Tables) -> DataFrame:
    """Reply as prediction; references are the question and the reply's own first five words;
    a third of the examples has none."""
    head = F.array_join(F.slice(tx.words(F.col("output")), 1, 5), " ")
    return samples_v(t).select(
        F.col("sample_id").alias("example_id"), "task_type",
        F.when(F.col("task_type") == "summarization", F.concat(F.lit("This is not found. "), head))
        .when(F.col("source") == "first", head).otherwise(F.col("output")).alias("prediction"),
        F.col("input").alias("reference"),
        F.when(F.col("task_type") == "summarization", F.array().cast("array<string>"))
        .otherwise(F.array("input", head)).alias("references"),
    )


_HEAD = f"array_to_string({v.sql_words('output')}[1:5], ' ')"
CTE["examples_v"] = (("samples_v",), f"""
  select sample_id as example_id, task_type, case when task_type = 'summarization' then
      'This is not found. ' || {_HEAD} when source = 'first' then {_HEAD} else output end as prediction,
    input as reference, case when task_type = 'summarization' then [] else [input, {_HEAD}] end
      as refs from samples_v""")


def sql_normal(e: str) -> str:
    w = "[^\\p{L}\\p{N}_]"
    doubled = f"regexp_replace(lower({e}), '({w})', '\\1\\1', 'g')"
    free = f"regexp_replace({doubled}, '(^|{w})(?:a|an|the)({w}|$)', '\\1 \\2', 'g')"
    plain = f"regexp_replace({free}, '{tx.PUNCTUATION_CLASS}', '', 'g')"
    return f"array_to_string({v.sql_words(plain)}, ' ')"


def sql_overlap(rows: str, key: str, a: str, b: str) -> str:
    """(key, common, na, nb): multiset overlap of two list columns by counting exploded tokens."""
    return f"""
    select {key}, coalesce(sum(least(ca, cb)), 0)::bigint as common, sum(ca)::bigint as na,
      sum(cb)::bigint as nb from (
      select {key}, w, count(*) filter (s = 'a') as ca, count(*) filter (s = 'b') as cb from (
        select {key}, 'a' as s, unnest({a}) as w from {rows}
        union all select {key}, 'b', unnest({b}) from {rows}) group by all) group by {key}"""


CTE["normal_v"] = (("examples_v",), f"""
  select example_id, {sql_normal('prediction')} as p, {sql_normal('reference')} as r from examples_v""")


@query("evl_08_normalized_answers", with_ctes(["normal_v"], """
    select example_id, p as prediction, r as reference from normal_v"""))
def _(t: Tables):
    return examples_v(t).select("example_id", tx.normalize_answer(F.col("prediction")).alias("prediction"),
                                tx.normalize_answer(F.col("reference")).alias("reference"))


CTE["ref_scores_v"] = (("examples_v",), f"""
  with pairs as (select example_id * 10 + i as id, example_id, p, {sql_normal('ref')} as r from (
      select example_id, {sql_normal('prediction')} as p, unnest(range(len(refs))) as i,
        unnest(refs) as ref from examples_v)),
  tokens as (select id, {v.sql_words('p')} as a, {v.sql_words('r')} as b from pairs),
  overlap as ({sql_overlap('tokens', 'id', 'a', 'b')})
  select example_id, case when p = r then 1.0::double else 0.0::double end as em,
    case when p = '' and r = '' then 1.0::double when coalesce(common, 0) > 0
      then 2.0::double * common / (na + nb) else 0 end as f1
  from pairs left join overlap using (id)""")
CTE["answer_scores_v"] = (("examples_v", "ref_scores_v"), f"""
  select example_id, task_type, len(refs) > 0 as answerable,
    case when len(refs) = 0 then refused else em end as em,
    case when len(refs) = 0 then refused else f1 end as f1
  from (select *, case when {' or '.join(f"contains({sql_normal('prediction')}, '{p}')" for p in metrics.REFUSALS)}
          then 1.0::double else 0.0::double end as refused from examples_v)
  left join (select example_id, max(em) as em, max(f1) as f1 from ref_scores_v group by 1)
    using (example_id)""")


@query("evl_09_em_and_f1", with_ctes(["answer_scores_v"], """
    select example_id, em, round(f1, 6) as f1 from answer_scores_v"""))
def _(t: Tables):
    return metrics.answer_scores(examples_v(t)).select("example_id", "em", F.round("f1", 6).alias("f1"))


CTE["rouge_words_v"] = (("examples_v",), """
  select example_id as id, list_filter(regexp_split_to_array(lower(prediction), '[^a-z0-9]+'),
      lambda w: w <> '') as a, list_filter(regexp_split_to_array(lower(reference), '[^a-z0-9]+'),
      lambda w: w <> '') as b from examples_v""")
_GRAMS = "list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"
CTE["rouge_pairs_v"] = (("rouge_words_v",), f"""
  select id, {_GRAMS.format(x='a')} as a, {_GRAMS.format(x='b')} as b from rouge_words_v""")
_F = "coalesce(case when {t}.common > 0 then 2.0::double * {t}.common / ({t}.na + {t}.nb) end, 0)"


@query("evl_10_rouge_1_2", with_ctes(["rouge_words_v", "rouge_pairs_v"], f"""
    select example_id, round({_F.format(t='x')}, 6) as rouge1, round({_F.format(t='y')}, 6) as rouge2
    from examples_v left join ({sql_overlap('rouge_words_v', 'id', 'a', 'b')}) x on x.id = example_id
    left join ({sql_overlap('rouge_pairs_v', 'id', 'a', 'b')}) y on y.id = example_id"""))
def _(t: Tables):
    p, r = F.col("prediction"), F.col("reference")
    return examples_v(t).select(
        "example_id", F.round(metrics.rouge_n(p, r, 1), 6).alias("rouge1"),
        F.round(metrics.rouge_n(p, r, 2), 6).alias("rouge2"))


# The longest common subsequence row by row: the row of the table after each word of b.
_NEXT = ("list_reduce(range(1, len(a) + 1), lambda row, j: list_append(row, case when a[j] = b[i + 1] then last[j] + 1 "
         "else greatest(last[j + 1], row[len(row)]) end), [0::bigint])")


@query("evl_10_rouge_l", with_ctes(["rouge_words_v"], f"""
    , lcs_v(id, i, last) as (
      select id, 0::bigint, list_transform(range(0, len(a) + 1), lambda x: 0::bigint) from rouge_words_v
      union all select l.id, i + 1, {_NEXT} from lcs_v l join rouge_words_v w on w.id = l.id where i < len(b)),
    c as (select id, len(a) as na, len(b) as nb, last[len(last)] as common from lcs_v join rouge_words_v using (id) where i = len(b))
    select example_id, round({_F.format(t='c')}, 6) as "rougeL" from examples_v left join c on c.id = example_id
    """.replace("\n    , lcs_v", ", lcs_v", 1)).replace("with ", "with recursive ", 1))
def _(t: Tables):
    p, r = F.col("prediction"), F.col("reference")
    return examples_v(t).select("example_id", F.round(metrics.rouge_l(p, r), 6).alias("rougeL"))


_DISTINCT = "list_distinct({w})"


@query("evl_10_overlap_recall", with_ctes(["examples_v"], f"""
    select example_id, round(x, 6) as rouge1, round(x * 0.8::double, 6) as rouge2,
      round(x * 0.9::double, 6) as "rougeL" from (select example_id, coalesce(len(list_intersect(a, b)) /
          nullif(len(b), 0)::double, 0) as x from (select example_id,
        list_distinct({v.sql_words('lower(prediction)')}) as a,
        list_distinct({v.sql_words('lower(reference)')}) as b from examples_v))"""))
def _(t: Tables):
    one, two, long = metrics.overlap_recall(F.col("prediction"), F.col("reference"))
    return examples_v(t).select("example_id", F.round(one, 6).alias("rouge1"),
                                F.round(two, 6).alias("rouge2"), F.round(long, 6).alias("rougeL"))


@query("evl_11_refusals", with_ctes(["answer_scores_v"], """
    select answerable, round(avg(em), 4) as em, count(*) as n from answer_scores_v group by 1"""))
def _(t: Tables):
    return metrics.answer_scores(examples_v(t)).groupBy("answerable").agg(
        F.round(F.avg("em"), 4).alias("em"), F.count("*").alias("n"))


@query("evl_12_task_report", with_ctes(["answer_scores_v"], """
    select case when grouping(task_type) = 1 then 'overall' else task_type end as task_type,
      round(avg(em), 4) as em, round(avg(f1), 4) as f1, count(*) as n
    from answer_scores_v group by rollup(task_type)"""))
def _(t: Tables):
    return metrics.task_report(metrics.answer_scores(examples_v(t)), "em", "f1")


# -- agent runs: the events of a user and day are one run ---------------------------------------

def runs_v(t: Tables) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.groupBy(F.concat_ws("/", F.col("user_id").cast("string"), day).alias("case_id")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("_last"),
        F.collect_set("event_type").alias("tools"), F.count("*").cast("int").alias("n_steps"),
        F.max_by("props", F.struct("ts", "event_id")).alias("final_answer"),
    ).withColumn("status", F.when(F.col("_last") == "error", "failed").otherwise("completed")).drop("_last")


def cases_v(t: Tables) -> DataFrame:
    """A case per user and day with an order of workflows, keywords and tools to expect."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.select("user_id", day.alias("day")).distinct().select(
        F.concat_ws("/", F.col("user_id").cast("string"), "day").alias("case_id"),
        F.when(F.col("user_id") % 2 == 0, "research").otherwise("summarization").alias("workflow"),
        F.array(F.lit("K"), F.concat(F.lit(": "), F.substring("day", 10, 1))).alias("expected_keywords"),
        F.array(F.lit("view"), F.lit("click")).alias("expected_tools"), F.lit(15).alias("max_steps"),
    )


CTE["agent_scores_v"] = ((), """
  select case_id, case when u % 2 = 0 then 'research' else 'summarization' end as workflow,
    case when last = 'error' then 'failed' else 'completed' end as status, last <> 'error' as completed,
    n as n_steps, round((contains(lower(answer), 'k')::int
      + contains(lower(answer), ': ' || substr(day, 10, 1))::int) / 2.0::double, 3) as keyword_score,
    round(((views > 0)::int + (clicks > 0)::int) / 2.0::double, 3) as tool_coverage,
    round(n / 15.0::double, 3) as step_share
  from (select user_id as u, strftime(ts, '%Y-%m-%d') as day, user_id || '/' ||
      strftime(ts, '%Y-%m-%d') as case_id, count(*) as n, max_by(event_type, (ts, event_id)) as last,
      max_by(props, (ts, event_id)) as answer, count(*) filter (event_type = 'view') as views,
      count(*) filter (event_type = 'click') as clicks from events group by 1, 2, 3)""")


@query("evl_13_agent_runs", with_ctes(["agent_scores_v"], "select * from agent_scores_v"))
def _(t: Tables):
    return ids(metrics.agent_run_scores(runs_v(t), cases_v(t)))


@query("evl_14_agent_report", with_ctes(["agent_scores_v"], """
    select case when grouping(workflow) = 1 then 'overall' else workflow end as workflow,
      count(*) as n, round(avg(completed::int), 3) as completion_rate,
      round(avg(n_steps), 1) as avg_steps, round(avg(keyword_score), 3) as avg_keyword_score,
      round(avg(tool_coverage), 3) as avg_tool_coverage
    from agent_scores_v group by rollup(workflow)"""))
def _(t: Tables):
    return metrics.agent_report(metrics.agent_run_scores(runs_v(t), cases_v(t)))
