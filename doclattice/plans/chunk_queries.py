"""Tokens and chunks (CHK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import chunking
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.views import B, with_ctes


@query("chk_01_token_count", f"""
    select doc_id, len({v.sql_words('text')}) as tokens,
           len({v.sql_pieces('text')}) as pieces from documents""")
def _(t: Tables):
    return t.documents.select(
        "doc_id", tx.word_count(F.col("text")).cast("bigint").alias("tokens"),
        F.size(tx.word_pieces(F.col("text"))).cast("bigint").alias("pieces"),
    )


@query("chk_02_fixed_size_chunks", with_ctes(["chunks_v"], """
    select doc_id, cast(chunk_index as bigint) as chunk_index, content, token_count from chunks_v"""))
def _(t: Tables):
    return chunking.fixed_size_chunks(t.documents, keys=("doc_id",)).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content",
        F.col("token_count").cast("bigint").alias("token_count"),
    )


@query("chk_03_char_offsets", f"""
    select doc_id, i as chunk_index,
      length(array_to_string(toks[1 : i * 340], '')) as char_start,
      length(array_to_string(toks[1 : i * 340 + 400], '')) as char_end
    from (select *, unnest(range(case when len(toks) <= 400 then 1
            else cast(ceil((len(toks) - 400) / 340.0) as bigint) + 1 end)) as i
          from (select doc_id, {v.sql_pieces('text')} as toks from documents
                where regexp_matches(text, '[^{B}]')))""")
def _(t: Tables):
    chunks = chunking.fixed_size_chunks(t.documents, keys=("doc_id",))
    return chunks.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c)
                    for c in ("chunk_index", "char_start", "char_end")]
    )


@query("chk_04_sentences", f"""
    select doc_id, unnest(range(len(s))) as pos, unnest(s) as sentence
    from (select doc_id, {v.sql_sentences('text')} as s from documents)""")
def _(t: Tables):
    return t.documents.select(
        "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def sql_packed(size: int, carry: int) -> str:
    """Greedy packing, one recursion step per sentence: packed_v(doc_id, g, first, last, sents, toks)."""
    return f"""
    with recursive d as (select doc_id, text, s as sents, list_transform(s, lambda x: len({v.sql_words('x')})) as toks
      from (select doc_id, text, {v.sql_sentences('text')} as s from documents) where len(s) > 0),
    r as (
      select doc_id, 1::bigint as i, 0::bigint as g, 1::bigint as first, toks[1]::bigint as n from d
      union all
      select doc_id, i + 1, g + full_up::bigint, case when full_up then fresh else first end,
        case when full_up then coalesce(list_sum(toks[fresh:i]), 0)::bigint else n end + toks[i + 1]
      from (select r.*, toks, n + toks[i + 1] > {size} as full_up,
              case when {carry} > 0 and i - first + 1 > {carry} then i - {carry} + 1 else i + 1 end as fresh
            from r join d using (doc_id) where i < len(toks))),
    packed_v as (select doc_id, g, min(first) as first, max(i) as last from r group by 1, 2)"""


_PACKED = """
      select doc_id, cast(g as integer) as chunk_index, array_to_string(sents[first:last], ' ') as content,
        cast(list_sum(toks[first:last]) as integer) as token_count from packed_v join d using (doc_id)"""


@query("chk_05_sentence_packing", f"""{sql_packed(120, chunking.OVERLAP_SENTENCES)}
    select * from ({_PACKED}) where doc_id in (select doc_id from d where list_sum(toks) > 120)
    union all select doc_id, 0::integer, {v.sql_strip('text')}, cast(list_sum(toks) as integer) from d
    where list_sum(toks) <= 120""")
def _(t: Tables):
    return chunking.sentence_chunks(t.documents, keys=("doc_id",), size=120)


@query("chk_08_merge_small_groups")
def _(t: Tables):
    from doclattice.operators.embedding import neighbour_similarities

    df = t.documents.withColumn("_sents", chunking._sentence_structs(F.col("text"))).withColumn(
        "_sims", neighbour_similarities()(F.transform("_sents", lambda x: x["s"]))
    )
    topics = chunking.topic_groups(F.col("_sents"), F.col("_sims"))
    df = df.filter(F.size("_sents") > 0).withColumn(
        "_g", chunking.merge_small_groups(topics, size=60)
    )
    return chunking.sentence_groups_to_chunks(df, ("doc_id",), "_g")


@query("chk_09_split_large_groups", f"{sql_packed(60, 0)} {_PACKED}")
def _(t: Tables):
    df = t.documents.withColumn(
        "_g", chunking.split_large_groups(
            F.array(chunking._sentence_structs(F.col("text"))), size=60)
    )
    return chunking.sentence_groups_to_chunks(df, ("doc_id",), "_g")


@query("chk_10_semantic_chunks")
def _(t: Tables):
    from doclattice.operators.embedding import neighbour_similarities

    return chunking.semantic_chunks(
        t.documents, neighbour_similarities(), keys=("doc_id",), size=120
    )


@query("chk_11_document_reindex", with_ctes(["pages_v"], f"""
    select doc_id, page_number, row_number() over (partition by doc_id order by page_number, i) - 1
        as chunk_index, token_count
    from (select doc_id, page_number, i, len(toks[i * 340 + 1 : i * 340 + 400]) as token_count
      from (select *, unnest(range(case when len(toks) <= 400 then 1
              else cast(ceil((len(toks) - 400) / 340.0) as bigint) + 1 end)) as i
            from (select doc_id, page_number, {v.sql_pieces('text')} as toks from pages_v
                  where regexp_matches(text, '[^{B}]'))))"""))
def _(t: Tables):
    chunks = chunking.reindex_chunks(chunking.fixed_size_chunks(v.pages_v(t)))
    return chunks.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c)
                    for c in ("page_number", "chunk_index", "token_count")]
    )


@query("chk_12_non_blank_pages", with_ctes(["lines_v"], f"""
    select doc_id, page_number, text from lines_v where regexp_matches(text, '[^{B}]')"""))
def _(t: Tables):
    native = v.ocr_v(t)[0]
    return chunking.non_blank_pages(native).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "text"
    )
