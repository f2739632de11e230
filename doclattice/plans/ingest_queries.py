"""Pages, cleaning and table text (PAGE, CLN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import pages
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.views import with_ctes


@query("page_01_full_text", with_ctes(["pages_v"], """
    select doc_id, string_agg(text, chr(10) || chr(10) order by page_number) as full_text
    from pages_v where text <> '' group by doc_id"""))
def _(t: Tables):
    return pages.full_text(v.pages_v(t))


_LEN = "length(" + v.sql_strip("text") + ")"


@query("page_02_native_confidence", with_ctes(["lines_v"], f"""
    select doc_id, page_number, case when {_LEN} >= 50 then 1.0::double else 0.5::double end
      as confidence from lines_v"""))
def _(t: Tables):
    return v.ocr_v(t)[0].select("doc_id", F.col("page_number").cast("bigint").alias("page_number"),
                                "confidence")


@query("page_03_needs_ocr", with_ctes(["lines_v"], f"""
    select doc_id, page_number, text from lines_v where {_LEN} < 50"""))
def _(t: Tables):
    native = v.ocr_v(t)[0]
    return native.filter(pages.needs_ocr(F.col("text"))).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "text"
    )


@query("page_04_word_confidence", f"""
    with w as (select doc_id, unnest(range(1, len(ws) + 1)) as pos, unnest(ws) as word from (
        select doc_id, {v.sql_words('text')} as ws from documents)),
    c as (select doc_id, case when h < 0.1 then '-1' when h < 0.15 then '0' when h < 0.2 then '95.5'
             else cast(cast(floor(h * 100) as integer) as varchar) end as conf
          from (select doc_id, {v.sql_hash_unit('doc_id', 'pos', 'word')} as h from w))
    select doc_id, round(coalesce(avg(case when regexp_matches(conf, '^[0-9]+$') and
        try_cast(conf as integer) > 0 then cast(conf as integer) end) / 100, 0), 6) as confidence
    from c group by doc_id""")
def _(t: Tables):
    h = v.hash_unit(F.col("doc_id"), F.col("pos") + 1, F.col("word"))
    ocr_words = t.documents.select(
        "doc_id", F.posexplode(tx.words(F.col("text"))).alias("pos", "word")
    ).select(
        "doc_id",
        F.when(h < 0.1, "-1").when(h < 0.15, "0").when(h < 0.2, "95.5")
        .otherwise(F.floor(h * 100).cast("int").cast("string")).alias("conf"),
    )
    return pages.mean_word_confidence(ocr_words, ("doc_id",)).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query("page_05_line_ocr_pages", with_ctes(["ocr1_v"], """
    select doc_id, (page_number - 1) // 10 + 1 as page_number,
      string_agg(text, chr(10) order by page_number) as text, round(avg(confidence), 6) as confidence
    from ocr1_v group by 1, 2"""))
def _(t: Tables):
    lines = v.ocr_v(t)[1].select(
        "doc_id",
        (F.floor((F.col("page_number") - 1) / 10) + 1).cast("bigint").alias("page_number"),
        F.col("page_number").alias("line_no"),
        "text",
        F.col("confidence").alias("conf"),
    )
    return pages.assemble_ocr_lines(lines, ("doc_id", "page_number")).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query("page_06_best_extraction", with_ctes(["lines_v", "ocr1_v", "ocr2_v"], f"""
    select doc_id, page_number,
      case when fb then t2 when o1 then t1 else text end as text,
      case when fb then c2 when o1 then c1 else conf end as confidence,
      case when fb then 'fallback_ocr' when o1 then 'ocr' else 'native' end as extraction_method
    from (select *, o1 and (t1 = '' or c1 < 0.5) and c2 is not null and t2 <> '' and c2 > c1 as fb
      from (select l.doc_id, l.page_number, l.text,
              case when {_LEN.replace('text', 'l.text')} >= 50 then 1.0::double else 0.5::double end
                as conf,
              {_LEN.replace('text', 'l.text')} < 50 and a.confidence is not null as o1,
              a.text as t1, a.confidence as c1, b.text as t2, b.confidence as c2
            from lines_v l left join ocr1_v a using (doc_id, page_number)
            left join ocr2_v b using (doc_id, page_number)))"""))
def _(t: Tables):
    return pages.resolve_extractions(*v.ocr_v(t)).withColumn(
        "page_number", F.col("page_number").cast("bigint")
    )


@query("page_07_table_struct", with_ctes(["tables_v"], """
    select doc_id, page_number, 0::bigint as table_index, array_to_string(list_transform(rows[1],
      lambda c: coalesce(c, '')), '|') as headers, len(rows) as n_rows,
      len(rows[1]) as n_columns from tables_v"""))
def _(t: Tables):
    head = F.transform("table.headers", lambda c: F.coalesce(c, F.lit("")))
    return v.tables_v(t).select(
        "doc_id", "page_number", F.col("table.table_index").cast("bigint").alias("table_index"),
        F.array_join(head, "|").alias("headers"),
        F.size("table.rows").cast("bigint").alias("n_rows"),
        F.size("table.headers").cast("bigint").alias("n_columns"),
    )


@query("page_08_table_text", with_ctes(["tables_v"], f"""
    select doc_id, page_number, '[Table 1]' || chr(10) || {v.sql_table_text('rows')} as text
    from tables_v"""))
def _(t: Tables):
    return v.tables_v(t).select(
        "doc_id", "page_number",
        pages.captioned_table(F.col("table.table_index"), F.col("table.rows")).alias("text"),
    )


@query("page_09_document_counters", with_ctes(["pages_v", "chunks_v"], """
    select doc_id, coalesce(p, 0) as page_count, coalesce(c, 0) as total_chunks
    from documents left join (select doc_id, count(*) p from pages_v group by 1) using (doc_id)
    left join (select doc_id, count(*) c from chunks_v group by 1) using (doc_id)"""))
def _(t: Tables):
    return pages.document_counters(t.documents, v.pages_v(t), v.chunks_v(t))


# -- cleaning: every rule over the rendered invoices and over the documents --------------------

def _sql_remove(e: str, patterns) -> str:
    for p in patterns:
        e = f"regexp_replace({e}, {v.sql_str(p)}, '', 'g')"
    return e


def _sql_whitespace(e: str) -> str:
    e = f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    e = f"regexp_replace({e}, '(?m)[ \\t]+$', '', 'g')"
    return v.sql_strip(e)


def _sql_clean(e: str) -> str:
    for rules in (tx.PAGE_NUMBER_PATTERNS, tx.WATERMARK_PATTERNS, tx.HEADER_FOOTER_PATTERNS,
                  tx.NOISE_PATTERNS):
        e = _sql_remove(e, rules)
    return _sql_whitespace(e)


def _texts(t: Tables):
    docs = t.documents.select(F.lit("document").alias("kind"), "doc_id", "text")
    return v.invoice_text_v(t).select(F.lit("invoice").alias("kind"), "doc_id", "text").unionByName(
        docs
    )


def _clean_oracle(expr: str) -> str:
    return with_ctes(["invoice_text_v"], f"""
    select kind, doc_id, {expr} as text from (
      select 'invoice' as kind, doc_id, text from invoice_text_v
      union all select 'document', doc_id, text from documents)""")


def _clean_query(name, column_fn, expr):
    @query(name, _clean_oracle(expr))
    def _(t: Tables):
        return _texts(t).withColumn("text", column_fn(F.col("text")))


_clean_query("cln_01_page_numbers", tx.remove_page_numbers,
             _sql_remove("text", tx.PAGE_NUMBER_PATTERNS))
_clean_query("cln_02_watermarks", tx.remove_watermarks, _sql_remove("text", tx.WATERMARK_PATTERNS))
_clean_query("cln_03_headers_footers", tx.remove_headers_footers,
             _sql_remove("text", tx.HEADER_FOOTER_PATTERNS))
_clean_query("cln_04_noise", tx.remove_noise, _sql_remove("text", tx.NOISE_PATTERNS))
_clean_query("cln_05_whitespace", tx.normalize_whitespace, _sql_whitespace("text"))
_clean_query("cln_07_all_rules", tx.clean_text, _sql_clean("text"))

_D = f"[{tx.INLINE_BLANK}]*\\p{{Nd}}{{1,4}}[{tx.INLINE_BLANK}]*"


@query("cln_06_page_edges", with_ctes(["pages_v"], f"""
    with n as (select doc_id, count(*) as total from pages_v group by 1),
    c as (select doc_id, page_number, total, case when page_number = 1 then
            regexp_replace(text, '\\A(?:{_D}(?:\\n|\\z))+', '') else text end as text
          from (select doc_id, page_number, total,
                  case when page_number % 2 = 1 then '12' || chr(10) || text else text end
                    || chr(10) || ' 7 ' as text
                from pages_v join n using (doc_id)))
    select doc_id, page_number, case when page_number = total then
        regexp_replace(text, '(?:(?:\\A|\\n){_D})+\\z', '') else text end as text from c
    """).replace("\n    with n as", "\n, n as", 1))
def _(t: Tables):
    p = v.pages_v(t)
    # The page count is joined, not windowed: it is a small table and keeps texts out of a sort.
    total = p.groupBy("doc_id").agg(F.count("*").alias("total"))
    noisy = F.concat(
        F.when(F.col("page_number") % 2 == 1, F.concat(F.lit("12\n"), "text")).otherwise(
            F.col("text")
        ),
        F.lit("\n 7 "),
    )
    return p.join(total, "doc_id").select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"),
        tx.trim_page_edges(noisy, F.col("page_number"), F.col("total")).alias("text"),
    )
