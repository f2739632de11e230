"""Workflows (WRK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclattice.operators import workflows
from doclattice.plans import search_queries as sq
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.search_queries import ids
from doclattice.plans.views import with_ctes


@query("wrk_01_invoice_anomalies", with_ctes(["invoices_v"], """
    , s as (select vendor, avg(amount) as m, stddev_samp(amount) as sd, min(invoice_date) as first
      from invoices_v where vendor is not null group by 1),
    z as (select doc_id, round((amount - m) / nullif(sd, 0), 4) as z from invoices_v join s using (vendor)),
    d as (select vendor, invoice_date, min(doc_id) as original from invoices_v
      where vendor is not null group by 1, 2 having count(*) > 1),
    n as (select doc_id, array_to_string(list_filter([case when vendor is null then 'vendor' end,
        case when due_date is null then 'due_date' end, case when tax is null then 'tax' end],
        lambda x: x is not null), ',') as names from invoices_v)
    select doc_id, 'unusual_amount' as anomaly, case when abs(z) >= 3 then 'HIGH' when abs(z) >= 2
      then 'MEDIUM' else 'LOW' end as severity, 'z=' || printf('%.4f', z) as detail from z
      where abs(z) >= 1.5
    union all select doc_id, 'new_vendor', 'LOW', 'first invoice of ' || vendor
      from invoices_v join s using (vendor) where invoice_date = first
    union all select doc_id, 'duplicate', 'HIGH', 'same as ' || original from invoices_v
      join d using (vendor, invoice_date) where doc_id <> original
    union all select doc_id, 'missing_fields', case when contains(names, ',') then 'HIGH' else 'MEDIUM'
      end, names from n where names <> ''
    union all select doc_id, 'date_anomaly', case when due_date < invoice_date then 'MEDIUM' else 'HIGH'
      end, case when due_date < invoice_date then 'due before invoice date' else
      'invoice date in the future' end from invoices_v
      where due_date < invoice_date or invoice_date > date '2001-06-30'
    """.replace("\n    , s as", ", s as", 1)))
def _(t: Tables):
    return workflows.invoice_anomalies(
        v.invoices_v(t), ("vendor", "invoice_date"), F.lit("2001-06-30").cast("date"))


@query("wrk_02_invoice_summary", with_ctes(["invoices_v"], """
    select 'summary' as section, 'invoices' as label, count(*)::double as value from invoices_v
    union all select 'summary', 'min_amount', min(amount) from invoices_v
    union all select 'summary', 'max_amount', max(amount) from invoices_v
    union all (select 'vendor', vendor, count(*)::double from invoices_v where vendor is not null
      group by 2 order by 3 desc, 2 limit 5)"""))
def _(t: Tables):
    return workflows.invoice_summary(v.invoices_v(t))


@query("wrk_03_extractive_summaries", f"""
    with s as (select doc_id, unnest(range(len(ss))) as pos, unnest(ss) as sentence from (
      select doc_id, {v.sql_sentences('text')} as ss from documents)),
    w as (select doc_id, pos, unnest({v.sql_lexemes('sentence')}) as w from s),
    tf as (select doc_id, w, count(*) as tf from w group by 1, 2),
    sc as (select doc_id, pos, round(sum(tf) / count(*)::double, 6) as score
      from (select distinct doc_id, pos, w from w) join tf using (doc_id, w) group by 1, 2),
    r as (select doc_id, pos, sentence, row_number() over (partition by doc_id
        order by coalesce(score, 0) desc, pos) as r from s left join sc using (doc_id, pos))
    select doc_id, level, string_agg(sentence, ' ' order by pos) as summary, count(*) as n_sentences
    from r join (values ('one_line', 1), ('executive', 4), ('takeaways', 8)) l(level, n) on r <= n
    group by 1, 2""")
def _(t: Tables):
    return workflows.extractive_summaries(t.documents)


@query("wrk_04_research_set", with_ctes(["hybrid_hits_v"], f"""
    select query_id, chunk_id, doc_id, score, rank, '[Source: ' || document_name || ', page ?]' as citation
    from ({sq.sql_top('''(select *  exclude (rank) from (select *, row_number() over (partition by
        query_id, doc_id order by rank) as i from hybrid_hits_v) where i <= 1)''', 5)})"""))
def _(t: Tables):
    hits = sq.hybrid_hits_v(t).withColumn("page_number", F.lit(None).cast("int"))
    return ids(workflows.research_set(hits, per_document=1, k=5),
               "query_id", "chunk_id", "doc_id", "score", "rank", "citation")
