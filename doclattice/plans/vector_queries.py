"""Embeddings and vector search (VEC, CHK-6, CHK-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import cells, embedding, vectors
from doclattice.operators.chunking import TOPIC_THRESHOLD
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.views import CTE, with_ctes

_BUCKETS = ("list_transform(list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}\\p{{N}}]+'), "
            "lambda w: w <> ''), lambda w: cast('0x' || substr(md5(w), 1, 7) as bigint) % 64)")


def sql_embedding(rows: str, key: str, text: str) -> str:
    """SQL for (key, embedding) of a table: bucket counts over their norm, zeros included."""
    return f"""
    select {key}, list(coalesce(c, 0) / case when n = 0 then 1 else n end order by d) as embedding
    from (select k.{key}, k.d, c, sqrt(coalesce(sum(c * c) over (partition by k.{key}), 0)) as n
      from (select {key}, unnest(range(64)) as d from {rows}) k
      left join (select {key}, b as d, count(*)::double as c from (
          select {key}, unnest({_BUCKETS.format(e=text)}) as b from {rows}) group by 1, 2) x
        on x.{key} = k.{key} and x.d = k.d)
    group by {key}"""


CTE["chunk_vectors_v"] = (("chunks_v",), sql_embedding("chunks_v", "chunk_id", "content"))
CTE["query_vectors_v"] = ((), sql_embedding("benchmark", "item_id", "text"))

#: Scores are rounded to so many digits before they are ranked.
DIGITS = (6,)
# Cosine of two list<double> columns, rounded and free of negative zero.
SQL_COS = "round(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))), 6)"


def chunk_vectors_v(t: Tables) -> DataFrame:
    # What searches read: no hash of every content is made for them.
    return t.stored("vectors", lambda: embedding.embed_chunks(v.chunks_v(t)).select("chunk_id", "doc_id", "embedding"))


def query_vectors_v(t: Tables) -> DataFrame:
    return t.benchmark.select(
        F.col("item_id").alias("query_id"),
        embedding.hashed_embedding(F.col("text")).alias("embedding"),
    )


def stored_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding", "label")


def label_centroids(t: Tables) -> DataFrame:
    """One query per label: the mean of its vectors, summed per dimension."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    mean = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"])
        .alias("embedding")
    )


CTE["centroids_v"] = ((), """
    select label::bigint as query_id, list(x order by d) as embedding from (
      select label, d, avg(x) as x from (
        select label, unnest(range(64)) as d, unnest(embedding)::double as x from embeddings)
      group by 1, 2) group by 1""")
CTE["stored_v"] = ((), """
    select vec_id as item_id, label, list_transform(embedding, lambda x: x::double) as embedding
    from embeddings""")


@query("vec_01_chunk_embeddings", with_ctes(["chunk_vectors_v"], """
    select chunk_id, d as dim, round(x, 6) as weight from (
      select chunk_id, unnest(range(64)) as d, unnest(embedding) as x from chunk_vectors_v)
    where x > 0"""))
def _(t: Tables):
    return embedding.embed_chunks(v.chunks_v(t)).select(
        "chunk_id", F.posexplode("embedding").alias("dim", "weight")
    ).filter("weight > 0").select(
        "chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round("weight", 6).alias("weight")
    )


@query("vec_02_upsert_embeddings", """
    with stored as (select vec_id as chunk_id, label, case when label < 5 then 'model-a' else
        'model-b' end as model_name, embedding from embeddings),
    fresh as (select vec_id as chunk_id, label, 'model-a' as model_name,
        list_transform(embedding, lambda x: -x) as embedding from embeddings where label % 2 = 0),
    kept as (select * from fresh union all select * from stored s where not exists (
      select 1 from fresh f where f.chunk_id = s.chunk_id and f.model_name = s.model_name))
    select chunk_id, label::bigint as label, model_name, i - 1 as dim, round(embedding[i]::double, 6) as weight
    from kept, unnest(range(1, len(embedding) + 1)) as r(i)""")
def _(t: Tables):
    base = t.embeddings.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    stored = base.withColumn(
        "model_name", F.when(F.col("label") < 5, "model-a").otherwise("model-b")
    )
    fresh = base.filter("label % 2 = 0").withColumn("model_name", F.lit("model-a")).withColumn(
        "embedding", F.transform("embedding", lambda x: -x)
    )
    kept = embedding.upsert_embeddings(stored, fresh)
    return kept.select("chunk_id", "label", "model_name", F.posexplode("embedding").alias("dim", "weight")).select(
        "chunk_id", "label", "model_name", F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("weight").cast("double"), 6).alias("weight"))


_TOP = """
    select query_id, item_id, score, rank from (
      select *, row_number() over (partition by query_id order by score desc, item_id) as rank
      from (select q.query_id, s.item_id, {cos} + 0 as score
            from {q} q, {s} s {where})) where rank <= {k}"""


@query("vec_03_exact_top_k", with_ctes(["centroids_v", "stored_v"], _TOP.format(
    cos=SQL_COS.format(a="q.embedding", b="s.embedding"), q="centroids_v", s="stored_v",
    where="", k=10)))
def _(t: Tables):
    return _ranked(vectors.exact_top_k(label_centroids(t), stored_vectors(t), 10, DIGITS))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"),
                       F.col("rank").cast("bigint").alias("rank"))


@query("vec_03_passage_top_k", with_ctes(["query_vectors_v", "chunk_vectors_v"], _TOP.format(
    cos="round(list_inner_product(q.embedding, s.embedding), 6)",
    q="(select item_id as query_id, embedding from query_vectors_v)",
    s="(select chunk_id as item_id, embedding from chunk_vectors_v)", where="", k=20)))
def _(t: Tables):
    items = chunk_vectors_v(t).select(F.col("chunk_id").alias("item_id"), "embedding")
    return _ranked(vectors.exact_top_k(query_vectors_v(t), items, 20, DIGITS))


@query("vec_04_approximate_top_k")
def _(t: Tables):
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return _ranked(vectors.approximate_top_k(q, stored_vectors(t), 5, dim=64))


def sql_cells(name: str, items: str, q: str) -> None:
    """CTEs of the cell index over ``items(item_id, embedding)`` and its probes for queries ``q``."""
    unit = "list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding)))"
    cos = "round(coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0), 9)"
    CTE[f"{name}_unit"] = ((), f"""
      select item_id, {unit} as e, least(1.0::double, {cells.CELLS_PER_ROOT} / sqrt(n), {cells.CENTRE_BYTES // 512}.0::double / n) as share
      from {items}, (select count(*) as n from {items}) where list_inner_product(embedding, embedding) > 0""")
    CTE[f"{name}_near"] = ((f"{name}_unit",), f"""
      select s.item_id, arg_min(c.item_id, struct_pack(s := -{cos.format(a='s.e', b='c.e')}, i := c.item_id)) as cell
      from (select * from {name}_unit where {v.sql_hash_unit("'fit'", 'item_id')} < share * {cells.FIT_ROWS}) s,
        (select * from {name}_unit where {v.sql_hash_unit("'cell'", 'item_id')} < share) c group by 1""")
    CTE[f"{name}_centres"] = ((f"{name}_near",), f"""
      select cell, list(x order by d) as e from (
        select cell, d, avg(x) as x from (select cell, unnest(range(64)) as d, unnest(e) as x
          from {name}_near join {name}_unit using (item_id)) group by 1, 2) group by 1""")
    CTE[f"{name}_index"] = ((f"{name}_centres",), f"""
      select item_id, any_value(embedding) as embedding, arg_min(cell, struct_pack(s := -{cos.format(a='s.embedding', b='c.e')}, i := cell)) as cell
      from {items} s, {name}_centres c group by item_id""")
    CTE[f"{name}_probes"] = ((f"{name}_index",), f"""
      select query_id, embedding, cell from (
        select *, row_number() over (partition by query_id order by s desc, cell) as r from (
          select query_id, embedding, cell, {cos.format(a='q.embedding', b='c.e')} as s from {q} q, {name}_centres c))
      where r <= {cells.PROBES}""")
    CTE[f"{name}_hits"] = ((f"{name}_probes",), f"""
      select query_id, item_id, round(s, 6) + 0 as score, rank from (
        select *, row_number() over (partition by query_id order by s desc, item_id) as rank from (
          select query_id, item_id, {cos.format(a='q.embedding', b='i.embedding')} as s
          from {name}_probes q join {name}_index i using (cell))) where rank <= 10""")


CTE["chunk_items_v"] = (("chunk_vectors_v",), "select chunk_id as item_id, embedding from chunk_vectors_v")
CTE["passages_v"] = (("query_vectors_v",), "select item_id as query_id, embedding from query_vectors_v")
sql_cells("stored_cells", "stored_v", "(select item_id as query_id, embedding from stored_v)")
sql_cells("chunk_cells", "chunk_items_v", "passages_v")


def cells_v(t: Tables, name: str, vectors_of) -> tuple[DataFrame, DataFrame]:
    """The stored index and its centres."""
    centres = t.stored(f"{name}_centres", lambda: cells.fit_centres(vectors_of(t), embedding.DIM))
    return t.stored(f"{name}_index", lambda: cells.build(vectors_of(t), centres), by="part"), centres


def chunk_items(t: Tables) -> DataFrame:
    return chunk_vectors_v(t).select(F.col("chunk_id").alias("item_id"), "embedding")


@query("vec_04_cell_top_k", with_ctes(["stored_v", "stored_cells_hits"], "select * from stored_cells_hits"))
def _(t: Tables):
    """Neighbours of every stored vector by the cell index."""
    index, centres = cells_v(t, "stored_cells", lambda t: stored_vectors(t).drop("label"))
    return _ranked(cells.cell_top_k(stored_vectors(t).withColumnRenamed("item_id", "query_id"), index, centres, 10))


@query("vec_04_cell_passages", with_ctes(["passages_v", "chunk_items_v", "chunk_cells_hits"], "select * from chunk_cells_hits"))
def _(t: Tables):
    """Chunks near the benchmark's passages by the cell index."""
    index, centres = cells_v(t, "chunk_cells", chunk_items)
    return _ranked(cells.cell_top_k(query_vectors_v(t), index, centres, 10))


@query("vec_05_restricted_top_k", with_ctes(["centroids_v", "stored_v"], _TOP.format(
    cos=SQL_COS.format(a="q.embedding", b="s.embedding"), q="centroids_v", s="stored_v",
    where="""where s.item_id in (select doc_id from labels where quality = 1)
             and s.item_id in (select doc_id from documents where lang = 'en')""", k=10)))
def _(t: Tables):
    typed = t.documents.select("doc_id", F.col("lang").alias("document_type"))
    ids = t.labels.filter("quality = 1")
    kept = vectors.restrict_vectors(
        stored_vectors(t).withColumn("doc_id", F.col("item_id")), ids, typed, "en"
    )
    return _ranked(vectors.exact_top_k(label_centroids(t), kept, 10, DIGITS))


@query("vec_06_missing_embeddings", with_ctes(["chunks_v"], """
    select chunk_id, doc_id from chunks_v c where not exists (
      select 1 from (select chunk_id, sha256(case when lang = 'de' then content || '!' else content
        end) as h from chunks_v where lang <> 'fr') s
      where s.chunk_id = c.chunk_id and s.h = sha256(c.content))"""))
def _(t: Tables):
    chunks = v.chunks_v(t)
    # Stored state: French chunks are new, German ones have changed since they were embedded.
    stored = chunks.filter("lang <> 'fr'").select(
        "chunk_id", F.lit("m").alias("model_name"),
        F.sha2(F.when(F.col("lang") == "de", F.concat("content", F.lit("!")))
               .otherwise(F.col("content")), 256).alias("content_hash"),
    )
    return embedding.missing_embeddings(chunks, stored, "m").select("chunk_id", "doc_id")


CTE["sentence_sims_v"] = ((), f"""
    select doc_id, pos, sim from (
      select doc_id, pos, list_sum(list_transform(list_zip(e, lag(e) over w),
          lambda z: z[1] * z[2])) / (n * lag(n) over w + 1e-8) as sim
      from (select doc_id, pos, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n
        from (select doc_id, pos, list_transform(range(64), lambda d:
                len(list_filter(b, lambda x: x = d))::double) as e
          from (select doc_id, pos, {_BUCKETS.format(e='s')} as b
            from (select doc_id, unnest(range(len(ss))) as pos, unnest(ss) as s
              from (select doc_id, {v.sql_sentences('text')} as ss from documents)))))
      window w as (partition by doc_id order by pos)) where pos > 0""")


def sentence_sims_v(t: Tables) -> DataFrame:
    sims = embedding.neighbour_similarities()(tx.sentences(F.col("text")))
    return t.documents.select("doc_id", F.posexplode(sims).alias("p", "sim")).select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), "sim"
    )


@query("chk_06_neighbour_similarity", with_ctes(["sentence_sims_v"], """
    select doc_id, pos, round(sim, 5) + 0 as sim from sentence_sims_v"""))
def _(t: Tables):
    return sentence_sims_v(t).withColumn("sim", F.round("sim", 5) + 0)


@query("chk_07_topic_boundaries", with_ctes(["sentence_sims_v"], f"""
    select doc_id, pos from sentence_sims_v where sim < {TOPIC_THRESHOLD}"""))
def _(t: Tables):
    return sentence_sims_v(t).filter(F.col("sim") < TOPIC_THRESHOLD).select("doc_id", "pos")
