"""Derived inputs shared by queries, each in Spark and as an SQL common table expression.

The given tables have no page, chunk, invoice or model-call tables; these views derive them from
whole tables with the same expression on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import chunking, pages
from doclattice.plans.registry import Tables

B = tx.BLANK  # class body, also used inside the oracle statements


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '\\A[{B}]+|[{B}]+\\z', '', 'g')"


def sql_words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '[{B}]+'), lambda w: w <> '')"


def sql_pieces(e: str) -> str:
    return f"regexp_extract_all({e}, '[{B}]*[^{B}]+(?:[{B}]+\\z)?')"


SQL_STOP = "(" + ",".join(sql_str(w) for w in tx.ENGLISH_STOP_WORDS) + ")"


def sql_lexemes(e: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: w <> '' and w not in {SQL_STOP})"
    )


def sql_sentences(e: str) -> str:
    cut = f"regexp_replace({e}, '([.!?])[{B}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    # A second pass catches one-letter sentences, whose capital the first match has consumed.
    cut = f"regexp_replace({cut}, '([.!?])[{B}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return (
        f"list_filter(list_transform(string_split({cut}, chr(1)), "
        f"lambda s: {sql_strip('s')}), lambda s: s <> '')"
    )


def hash_unit(*cols: Column) -> Column:
    """Deterministic pseudo-random number in [0, 1) from column values, same in any engine."""
    joined = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 7), 16, 10).cast("bigint") / F.lit(268435456.0)


def sql_hash_unit(*exprs: str) -> str:
    joined = "concat_ws('|', " + ", ".join(f"cast({e} as varchar)" for e in exprs) + ")"
    return f"(cast('0x' || substr(md5({joined}), 1, 7) as bigint) / 268435456.0::double)"


# -- pages ------------------------------------------------------------------------------------

def pages_v(t: Tables) -> DataFrame:
    return pages.split_pages(t.documents)


CTE: dict[str, tuple[tuple[str, ...], str]] = {}
CTE["pages_v"] = ((), """
  select doc_id, p + 1 as page_number,
         array_to_string(lines[p * 10 + 1 : p * 10 + 10], chr(10)) as text
  from (select doc_id, lines, unnest(range((len(lines) - 1) // 10 + 1)) as p
        from (select doc_id, string_split(text, chr(10)) as lines from documents))""")


# -- chunks over whole documents --------------------------------------------------------------

def chunks_v(t: Tables) -> DataFrame:
    """Fixed-size chunks, keyed by document; chunk_id is document and index in one number."""
    return t.stored("chunks", lambda: with_chunk_id(
        chunking.fixed_size_chunks(t.documents, keys=("doc_id", "lang", "source"))
    ))


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn(
        "chunk_id", F.col("doc_id") * 100000 + F.col("chunk_index").cast("bigint")
    )


CTE["chunks_v"] = ((), f"""
  select doc_id, lang, source, cast(i as integer) as chunk_index,
         doc_id * 100000 + i as chunk_id,
         {sql_strip("array_to_string(toks[i * 340 + 1 : i * 340 + 400], '')")} as content,
         len(toks[i * 340 + 1 : i * 340 + 400]) as token_count
  from (select *, unnest(range(case when len(toks) <= 400 then 1
                     else cast(ceil((len(toks) - 400) / 340.0) as bigint) + 1 end)) as i
        from (select doc_id, lang, source, {sql_pieces('text')} as toks from documents
              where regexp_matches(text, '[^{B}]')))""")


# -- document catalogue -----------------------------------------------------------------------

def docs_v(t: Tables) -> DataFrame:
    """Catalogue rows: name, type, status, size and a creation time hashed from the id."""
    minutes = (F.col("doc_id") * 7919 % 525600).cast("int")
    u = hash_unit(F.lit("status"), F.col("doc_id"))
    return t.documents.select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.col("lang").alias("document_type"),
        F.col("source").alias("collection"),
        F.when(u < 0.7, "completed").when(u < 0.8, "failed").when(u < 0.9, "processing")
        .otherwise("pending").alias("status"),
        "n_chars",
        (F.expr("timestamp_ntz'2023-01-01 00:00:00'")
         + F.make_dt_interval(mins=minutes)).alias("created_at"),
    )


CTE["docs_v"] = ((), f"""
  select doc_id, source || '/' || doc_id || '.txt' as name, lang as document_type,
         source as collection, case when u < 0.7 then 'completed' when u < 0.8 then 'failed'
           when u < 0.9 then 'processing' else 'pending' end as status, n_chars,
         timestamp '2023-01-01 00:00:00' + to_minutes(doc_id * 7919 % 525600) as created_at
  from (select *, {sql_hash_unit("'status'", 'doc_id')} as u from documents)""")


# -- invoices out of the order tables ---------------------------------------------------------

def invoices_v(t: Tables) -> DataFrame:
    """One invoice per order: vendor = supplier of its first line, due date, tax, line count."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("s_suppkey"),
        F.max("l_shipdate").alias("due"),
        # Money adds up exactly as decimals, so that half cents round the same everywhere.
        F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")
                      * F.col("l_tax").cast("decimal(4,2)")), 2).cast("double").alias("tax"),
        F.count("*").alias("n_lines"),
    )
    vendors = t.supplier.select("s_suppkey", F.col("s_name").alias("vendor"))
    return (
        t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(vendors, "s_suppkey", "left")
        .select(
            F.col("o_orderkey").alias("doc_id"),
            "vendor",
            F.to_date("o_orderdate").alias("invoice_date"),
            F.to_date("due").alias("due_date"),
            F.col("o_totalprice").alias("amount"),
            "tax",
            "n_lines",
            F.col("o_orderstatus").alias("status"),
        )
    )


CTE["invoices_v"] = ((), """
  select o_orderkey as doc_id, s_name as vendor, cast(o_orderdate as date) as invoice_date,
         cast(due as date) as due_date, o_totalprice as amount, tax, n_lines,
         o_orderstatus as status
  from orders left join (
      select l_orderkey, min((l_linenumber, l_suppkey)).l_suppkey as sk, max(l_shipdate) as due,
             cast(round(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2))), 2)
               as double) as tax, count(*) as n_lines
      from (select l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_tax
            from lineitem) group by 1) on o_orderkey = l_orderkey
  left join supplier on s_suppkey = sk""".replace(
    "min((l_linenumber, l_suppkey)).l_suppkey",
    "min({'a': l_linenumber, 'b': l_suppkey}).b"))


def _money(c: str) -> Column:
    return F.format_string("%.2f", F.col(c))


def invoice_text_v(t: Tables) -> DataFrame:
    """Invoices as noisy page text: page lines, footers, amounts, dates, links, rules."""
    return invoices_v(t).select(
        "doc_id",
        F.concat(
            F.lit("Page "), (F.col("doc_id") % 7 + 1).cast("string"), F.lit(" of 7\n"),
            F.lit("Confidential - do not copy\nINVOICE "), F.col("doc_id").cast("string"),
            F.lit("  \nVendor: "), F.coalesce("vendor", F.lit("unknown")),
            F.lit("\nDate: "), F.col("invoice_date").cast("string"),
            F.lit("\n__________\nTotal: $"), _money("amount"),
            F.lit("\n\n\n\nDRAFT terms ........ net 30\nMail billing"),
            F.col("doc_id").cast("string"), F.lit("@example.com or call 555-010-"),
            F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"),
            F.lit("\nSee https://example.com/i/"), F.col("doc_id").cast("string"),
            F.lit(" for details\n\f© 2024 Example Inc. All Rights Reserved\n- "),
            (F.col("doc_id") % 9).cast("string"), F.lit(" -\nPrinted on 01/02/2024 by system\n"),
            (F.col("doc_id") % 7 + 1).cast("string"), F.lit("/7\n"),
        ).alias("text"),
    )


CTE["invoice_text_v"] = (("invoices_v",), """
  select doc_id, 'Page ' || (doc_id % 7 + 1) || ' of 7' || chr(10)
    || 'Confidential - do not copy' || chr(10) || 'INVOICE ' || doc_id || '  ' || chr(10)
    || 'Vendor: ' || coalesce(vendor, 'unknown') || chr(10) || 'Date: ' || invoice_date || chr(10)
    || '__________' || chr(10) || 'Total: $' || printf('%.2f', amount)
    || chr(10) || chr(10) || chr(10) || chr(10) || 'DRAFT terms ........ net 30' || chr(10)
    || 'Mail billing' || doc_id || '@example.com or call 555-010-'
    || lpad(cast(doc_id % 10000 as varchar), 4, '0') || chr(10)
    || 'See https://example.com/i/' || doc_id || ' for details' || chr(10) || chr(12)
    || '© 2024 Example Inc. All Rights Reserved' || chr(10) || '- ' || (doc_id % 9) || ' -'
    || chr(10) || 'Printed on 01/02/2024 by system' || chr(10) || (doc_id % 7 + 1) || '/7'
    || chr(10) as text
  from invoices_v""")


def invoice_fields_v(t: Tables) -> DataFrame:
    """Invoice fields in long form (document, name, value); absent values give no row."""
    return (
        invoices_v(t)
        .select(
            "doc_id",
            F.expr(
                "stack(5, 'vendor_name', vendor, 'date', cast(invoice_date as string),"
                " 'due_date', cast(due_date as string), 'total_amount', format_string('%.2f', amount),"
                " 'tax_amount', if(tax is null, null, format_string('%.2f', tax)))"
                " as (field_name, field_value)"
            ),
        )
        .filter("field_value is not null")
    )


CTE["invoice_fields_v"] = (("invoices_v",), """
  select doc_id, f.n as field_name, f.v as field_value from (
    select doc_id, unnest([
      {'n': 'vendor_name', 'v': vendor}, {'n': 'date', 'v': cast(invoice_date as varchar)},
      {'n': 'due_date', 'v': cast(due_date as varchar)},
      {'n': 'total_amount', 'v': printf('%.2f', amount)},
      {'n': 'tax_amount', 'v': case when tax is not null then printf('%.2f', tax) end}]) as f
    from invoices_v) where f.v is not null""")


# -- tables on pages --------------------------------------------------------------------------

TABLE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def table_rows_v(t: Tables) -> DataFrame:
    """Invoice lines as rows of cells; a page of an invoice holds the lines of one ship month."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return t.lineitem.join(parts, "l_partkey", "left").select(
        F.col("l_orderkey").alias("doc_id"),
        F.expr("year(l_shipdate) * 12 + month(l_shipdate) - 1").cast("bigint").alias("page_number"),
        *TABLE_ORDER,
        F.array(
            F.col("l_linenumber").cast("string"),
            F.col("p_name"),
            F.format_string("%.2f", F.col("l_extendedprice")),
            F.nullif(F.col("l_returnflag"), F.lit("N")),
        ).alias("cells"),
    )


def tables_v(t: Tables) -> DataFrame:
    return pages.table_structs(table_rows_v(t), ("doc_id", "page_number"), TABLE_ORDER)


CTE["table_rows_v"] = ((), """
  select l_orderkey as doc_id, year(l_shipdate) * 12 + month(l_shipdate) - 1 as page_number,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
         [cast(l_linenumber as varchar), p_name,
          printf('%.2f', l_extendedprice), nullif(l_returnflag, 'N')] as cells
  from lineitem left join part on p_partkey = l_partkey""")
CTE["tables_v"] = (("table_rows_v",), """
  select doc_id, page_number,
         list(cells order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, cells)
           as rows
  from table_rows_v group by 1, 2""")


def sql_table_text(rows: str) -> str:
    return (
        f"array_to_string(list_transform({rows}, lambda r: array_to_string(list_transform(r, "
        "lambda c: coalesce(c, '')), ' | ')), chr(10))"
    )


# -- competing extractions --------------------------------------------------------------------

def ocr_v(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Short lines as pages: native text, and two engines with hashed text and confidence."""
    lines = t.documents.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")
    ).select("doc_id", (F.col("p") + 1).alias("page_number"), "text")
    u1, u2 = (
        hash_unit(F.lit(e), F.col("doc_id"), F.col("page_number")) for e in ("ocr1", "ocr2")
    )

    def engine(u: Column, name: str) -> DataFrame:
        return lines.filter(u < 0.9).select(
            "doc_id", "page_number",
            F.when(u < 0.1, "").otherwise(F.concat(F.lit(name + ": "), "text")).alias("text"),
            F.round(u, 3).alias("confidence"),
        )

    native = lines.withColumn("confidence", pages.native_confidence(F.col("text")))
    return native, engine(u1, "ocr1"), engine(u2, "ocr2")


CTE["lines_v"] = ((), """
  select doc_id, unnest(range(1, len(l) + 1)) as page_number, unnest(l) as text
  from (select doc_id, string_split(text, chr(10)) as l from documents)""")
for _e in ("ocr1", "ocr2"):
    _u = sql_hash_unit(f"'{_e}'", "doc_id", "page_number")
    CTE[f"{_e}_v"] = (("lines_v",), f"""
  select doc_id, page_number, case when {_u} < 0.1 then '' else '{_e}: ' || text end as text,
         round({_u}, 3) as confidence
  from lines_v where {_u} < 0.9""")


def with_ctes(names: tuple[str, ...] | list[str], body: str) -> str:
    """Prefix ``body`` with the named views and everything they need, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTE[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as materialized ({CTE[n][1]})" for n in order)
    return f"with {ctes}\n{body}"
