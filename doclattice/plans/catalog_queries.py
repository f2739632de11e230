"""Sources and catalogue (SRC, DOC)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.operators import catalog
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.search_queries import ids
from doclattice.plans.views import CTE, with_ctes
from doclattice.sources import files, tabular

_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _stamp(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query("doc_01_listing", with_ctes(["docs_v"], f"""
    select doc_id, name, status, document_type, {_TS.format(c='created_at')} as created_at,
      (select count(*) from docs_v where status = 'completed') as total,
      (select (count(*) + 19) // 20 from docs_v where status = 'completed') as pages
    from docs_v where status = 'completed' order by docs_v.created_at desc, doc_id limit 20 offset 20"""))
def _(t: Tables):
    page = catalog.list_documents(v.docs_v(t), page=2, size=20, status="completed")
    return _stamp(page.select("doc_id", "name", "status", "document_type", "created_at", "total",
                              "pages"), "created_at")


@query("doc_02_lookup", with_ctes(["docs_v"], """
    select i.doc_id, status, d.doc_id is not null as found from
      (select distinct event_id as doc_id from events) i left join docs_v d on d.doc_id = i.doc_id"""))
def _(t: Tables):
    wanted = t.events.select(F.col("event_id").alias("doc_id"))
    return catalog.look_up(wanted, v.docs_v(t)).select("doc_id", "status", "found")


@query("doc_03_chunk_page", with_ctes(["chunks_v"], """
    select doc_id, cast(chunk_index as bigint) as chunk_index, content from (
      select *, row_number() over (partition by doc_id order by chunk_index) as n from chunks_v)
    where n between 3 and 4"""))
def _(t: Tables):
    return ids(catalog.chunk_page(v.chunks_v(t), 2, 2), "doc_id", "chunk_index", "content")


@query("doc_04_text_within_budget", with_ctes(["chunks_v"], """
    select doc_id, string_agg(content, chr(10) order by chunk_index) as text,
      max(r)::bigint as tokens from (select *, sum(token_count) over (partition by doc_id
        order by chunk_index) as r from chunks_v) where r <= 2000 group by 1"""))
def _(t: Tables):
    return ids(catalog.text_within_budget(v.chunks_v(t)))


@query("doc_05_leading_text", with_ctes(["chunks_v"], """
    select doc_id, string_agg(content, chr(10) || chr(10) order by chunk_index) as text,
      count(*) as chunk_count from (select *, row_number() over (partition by doc_id
        order by chunk_index) as n from chunks_v) where n <= 10 group by 1"""))
def _(t: Tables):
    return catalog.leading_text(v.chunks_v(t))


@query("doc_06_cascade_delete", with_ctes(["chunks_v"], """
    select doc_id, chunk_id from chunks_v where doc_id not in
      (select doc_id from labels where toxic = 1)"""))
def _(t: Tables):
    gone = t.labels.filter("toxic = 1")
    return catalog.without_documents(v.chunks_v(t), gone).select("doc_id", "chunk_id")


@query("doc_07_latest_status", """
    select user_id as doc_id, max_by(event_type, (ts, event_id)) as status,
      substr(max_by(props, (ts, event_id)), 1, 500) as error_message,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') as updated_at, count(*) as n_changes
    from events group by 1""")
def _(t: Tables):
    log = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"),
                          F.col("props").alias("error"), "ts", "event_id")
    return _stamp(catalog.latest_status(log), "updated_at")


@query("doc_08_newest_of_type", with_ctes(["docs_v"], f"""
    select doc_id, name, {_TS.format(c='created_at')} as created_at from docs_v
    where document_type = 'de' order by docs_v.created_at desc, doc_id limit 20"""))
def _(t: Tables):
    newest = catalog.newest_of_type(v.docs_v(t), "de", 20)
    return _stamp(newest.select("doc_id", "name", "created_at"), "created_at")


@query("doc_09_field_map", with_ctes(["invoices_v", "invoice_fields_v"], """
    select i.doc_id, case when i.status = 'P' then 'Unknown' else 'Invoice' end as document_type,
      f.fields from invoices_v i left join (select doc_id, string_agg(field_name || '=' ||
        field_value, ';' order by field_name) as fields from invoice_fields_v group by 1) f
      using (doc_id)"""))
def _(t: Tables):
    inv = v.invoices_v(t)
    typed = inv.filter("status <> 'P'").select("doc_id", F.lit("Invoice").alias("document_type"))
    maps = catalog.field_maps(inv, typed, v.invoice_fields_v(t))
    pairs = F.transform(F.array_sort(F.map_entries("fields")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("doc_id", "document_type", F.array_join(pairs, ";").alias("fields"))


@query("doc_10_compare_fields", with_ctes(["invoice_fields_v"], """
    , a as (select o_orderkey as pair_id, f.field_name, f.field_value from orders
        join invoice_fields_v f on f.doc_id = o_orderkey
        where o_orderkey + 1 in (select o_orderkey from orders)),
    b as (select o_orderkey - 1 as pair_id, f.field_name, f.field_value from orders
        join invoice_fields_v f on f.doc_id = o_orderkey
        where o_orderkey - 1 in (select o_orderkey from orders))
    select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.field_name, b.field_name) as
      field_name, a.field_value as value_a, b.field_value as value_b,
      case when a.pair_id is null then 'added' when b.pair_id is null then 'removed'
           when a.field_value = b.field_value then 'same' else 'modified' end as change
    from a full join b on a.pair_id = b.pair_id and a.field_name = b.field_name
    """.replace("\n    , a as", ", a as", 1)))
def _(t: Tables):
    return catalog.compare_fields(order_pairs(t), v.invoice_fields_v(t))


def order_pairs(t: Tables) -> DataFrame:
    """Every order and the one with the next number."""
    pairs = t.orders.select(F.col("o_orderkey").alias("doc_a"),
                            (F.col("o_orderkey") + 1).alias("doc_b"))
    pairs = pairs.join(t.orders.select(F.col("o_orderkey").alias("doc_b")), "doc_b", "left_semi")
    return pairs.withColumn("pair_id", F.col("doc_a"))


@query("doc_10_compare_documents", with_ctes(["invoice_fields_v", "invoice_text_v", "invoices_v"], """
    , d as (select t.doc_id, 'invoice ' || t.doc_id as name, t.text, case when i.status = 'P' then 'Unknown' else 'Invoice' end as type
        from invoice_text_v t join invoices_v i using (doc_id)),
    p as (select a.doc_id as pair_id, a.name as name_a, b.name as name_b, a.type as type_a, b.type as type_b,
        a.text as text_a, b.text as text_b from d a join d b on b.doc_id = a.doc_id + 1),
    c as (select coalesce(a.doc_id, b.doc_id - 1) as pair_id,
        case when a.doc_id is null then 'added' when b.doc_id is null then 'removed'
          when a.field_value = b.field_value then 'same' else 'modified' end as change
      from invoice_fields_v a full join invoice_fields_v b on b.doc_id = a.doc_id + 1 and b.field_name = a.field_name),
    n as (select pair_id, count(*) filter (change = 'added') as n_added, count(*) filter (change = 'removed') as n_removed,
        count(*) filter (change = 'modified') as n_modified, count(*) filter (change = 'same') as n_same from c group by 1)
    select pair_id, name_a, name_b, type_a, type_b, text_a, text_b, type_a = type_b as same_type,
      coalesce(n_added, 0) as n_added, coalesce(n_removed, 0) as n_removed, coalesce(n_modified, 0) as n_modified,
      coalesce(n_same, 0) as n_same from p left join n using (pair_id)""".replace("\n    , d as", ", d as", 1)))
def _(t: Tables):
    texts = v.invoice_text_v(t).join(v.invoices_v(t).select("doc_id", "status"), "doc_id").select(
        "doc_id", F.concat(F.lit("invoice "), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("status") != "P", "Invoice").alias("document_type"), "text")
    return catalog.compare_documents(order_pairs(t), texts, v.invoice_fields_v(t))


@query("doc_11_dashboard", with_ctes(["docs_v", "chunks_v"], """
    select 'total' as section, 'documents' as label, count(*) as value from docs_v
    union all select 'total', 'chunks', count(*) from chunks_v
    union all select 'status', status, count(*) from docs_v group by 2
    union all select 'type', document_type, count(*) from docs_v group by 2
    union all (select 'latest', name, doc_id from docs_v order by created_at desc, doc_id limit 5)"""))
def _(t: Tables):
    return catalog.dashboard(v.docs_v(t), v.chunks_v(t))


# -- sources ----------------------------------------------------------------------------------

# Uploads out of the web pages: the type follows from the end of the address, the size from the
# payload blown up so that some exceed the limit.
CTE["uploads_v"] = ((), """
  select page_id as file_id, url as filename, case page_id % 8 when 0 then 'application/pdf'
      when 1 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      when 2 then 'text/plain' when 3 then 'text/csv' when 4 then 'application/vnd.ms-excel'
      when 5 then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
      when 6 then 'application/x-msdownload' end as mime_type,
    length(html) * 10000 as size_bytes from pages""")


def uploads_v(t: Tables) -> DataFrame:
    kinds = F.create_map(
        *[x for i, m in enumerate((*files.EXTRACTORS, "application/x-msdownload"))
          for x in (F.lit(i).cast("bigint"), F.lit(m))]
    )
    return t.pages.select(
        F.col("page_id").alias("file_id"), F.col("url").alias("filename"),
        kinds[F.col("page_id") % 8].alias("mime_type"),
        (F.length("html").cast("bigint") * 10000).alias("size_bytes"),
    )


_CSV = """
    with lines as (select l_orderkey, 'Line | Part | Price' as header, l_linenumber || ' | ' ||
        l_partkey || ' | ' || printf('%.2f', l_extendedprice) as line, row_number() over
        (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_shipdate) as n from lineitem)"""


def order_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("block"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("pos"),
        F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                F.format_string("%.2f", F.col("l_extendedprice"))).alias("cells"),
    )


@query("src_02_tabular_pages", _CSV + """
    select l_orderkey as doc_id, (n - 1) // 5 + 1 as page_number, 'Columns: ' || any_value(header)
      || chr(10) || chr(10) || string_agg(line, chr(10) order by n) as text from lines group by 1, 2""")
def _(t: Tables):
    paged = tabular.tabular_pages(order_rows(t), ("Line", "Part", "Price"), rows_per_page=5)
    return ids(paged.withColumnRenamed("file", "doc_id"))


@query("src_02_stored_table_head", _CSV + """
    select l_orderkey as doc_id, string_agg(line, chr(10) order by n) filter (n <= 3) as head,
      count(*) as total_rows, 3::bigint as total_columns from lines group by 1""")
def _(t: Tables):
    head = tabular.table_heads(order_rows(t), ("Line", "Part", "Price"), head_rows=3)
    text = F.array_join(F.transform("table.rows", lambda r: F.array_join(r, " | ")), "\n")
    return head.select(
        F.col("file").alias("doc_id"), text.alias("head"),
        F.col("table.total_rows").alias("total_rows"),
        F.col("table.total_columns").cast("bigint").alias("total_columns"),
    )


@query("src_04_mime_dispatch", with_ctes(["uploads_v"], """
    select file_id, mime_type, case when mime_type = 'application/pdf' then 'pdf'
      when mime_type = 'text/plain' then 'txt' when mime_type like '%wordprocessingml%' then 'docx'
      when mime_type in ('text/csv', 'application/vnd.ms-excel') or mime_type like
        '%spreadsheetml%' then 'csv' end as extractor from uploads_v"""))
def _(t: Tables):
    routed, rejected = files.route_by_mime(uploads_v(t))
    none = rejected.withColumn("extractor", F.lit(None).cast("string"))
    return routed.unionByName(none).select("file_id", "mime_type", "extractor")


@query("src_05_upload_validation", with_ctes(["uploads_v"], """
    select file_id, case when mime_type is null or mime_type = 'application/x-msdownload'
      then 'Unsupported file type: ' || coalesce(mime_type, 'unknown')
      when size_bytes > 52428800 then 'File exceeds max size of 50MB' end as error from uploads_v"""))
def _(t: Tables):
    accepted, errors = files.validate_uploads(uploads_v(t))
    return accepted.withColumn("error", F.lit(None).cast("string")).select(
        "file_id", "error").unionByName(errors.select("file_id", "error"))


@query("src_11_corrections_export", with_ctes(["invoice_fields_v"], """
    select f.doc_id, field_name, field_value as original_value, '0.00' as corrected_value,
      'manual' as extraction_method
    from invoice_fields_v f join orders on o_orderkey = f.doc_id
    where o_orderstatus = 'F' and field_name = 'tax_amount'"""))
def _(t: Tables):
    from doclattice.operators import fields as fo
    from doclattice.plans.field_queries import stored_fields_v

    fixes = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("tax_amount").alias("field_name"),
        F.lit("0.00").alias("field_value"),
    )
    have = stored_fields_v(t).select("doc_id", "field_name")
    fixes = fixes.join(have, ["doc_id", "field_name"], "left_semi")
    return fo.corrections_export(fo.apply_corrections(stored_fields_v(t), fixes))


@query("src_13_form_adapter", f"""
    with w as (select doc_id, unnest(range(len(ws))) as pos, unnest(ws) as word from (
      select doc_id, {v.sql_words('text')} as ws from documents))
    select doc_id, count(*) as n_words, count(*) filter (length(word) % 8 in (1, 3, 5)) as n_begin,
      max(1000 * (length(word) + pos) // 2000) as x_max from w group by 1""")
def _(t: Tables):
    from doclattice.functions import text as tx
    from doclattice.sources import adapters

    w = tx.words(F.col("text"))
    raw = t.documents.select(
        "doc_id", w.alias("words"),
        F.transform(w, lambda x, i: F.array(i, i, F.length(x) + i, i)).alias("bboxes"),
        F.transform(w, lambda x: F.length(x) % 8).alias("ner_tags"),
        F.lit(2000).alias("width"), F.lit(2000).alias("height"),
    )
    forms = adapters.form_records(raw)
    begins = F.filter("ner_labels", lambda x: x.startswith("B-"))
    return ids(forms.select(
        "doc_id", F.size("words").alias("n_words"), F.size(begins).alias("n_begin"),
        F.array_max(F.transform("bboxes", lambda b: F.element_at(b, 3))).alias("x_max"),
    ))
