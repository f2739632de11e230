"""Registered queries of this subpackage, one per operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclattice.llm import (byte_dedup, chat, decontamination, infill, language, near_dedup, packing, pieces, quality, secrets,
                            toxicity, whitening, window_dedup)
from doclattice.llm.batches import crc32_mod
from doclattice.llm.tables import text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_MATCHES = """SELECT doc_id, src, {rank} AS rank, '{kind}' AS kind, {least} AS least,
  regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found,
  regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d WHERE regexp_matches(text, '{pattern}')"""
_KINDS = (("assign", ASSIGN, 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24),
          ("token", "[A-Za-z0-9_-]{20,}", 0, 20))
OP6_SQL = f"""
WITH d AS (SELECT doc_id, source AS src, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_MATCHES.format(rank=i, kind=k, pattern=p, group=g, least=n) for i, (k, p, g, n) in enumerate(_KINDS))}),
p AS (
  SELECT doc_id, src, rank, kind, vals[i] AS v, length(found[i]) AS n,
    list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT
      + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0)::BIGINT AS start, least
  FROM m, unnest(range(1, len(found) + 1)) AS r(i)),
s AS (
  SELECT *, start + n AS stop FROM p WHERE length(v) >= least
    AND (kind <> 'token' OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')))),
o AS (SELECT v, count(DISTINCT src) AS owners FROM s GROUP BY v),
j AS (
  SELECT s.*, owners < 3 AS live FROM s JOIN o USING (v)
  WHERE rank < 3 OR (owners < 3 AND NOT EXISTS (
    SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.rank < 3 AND b.start < s.stop AND s.start < b.stop))),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
    count(*) FILTER (WHERE rank = 2) AS n_hex, count(*) FILTER (WHERE live) AS n_live,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op6_secret_ownership", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(spark, folder, "documents")))


OP9_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', '')))
      + 4 * (length(role) - length(replace(role, '[', '')))
    + length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
      + 4 * (length(text) - length(replace(text, '[', ''))) + 9 + 8 + 8 AS size
  FROM raw)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op9_reply_tree_chat", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7. A conversation's turns form a chain: each row replies
    to the one before it (by turn, then role and text). Rows without conv_id belong to none."""
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).filter("conv_id is not null").unionByName(own)
    order = W.partitionBy("conv_id").orderBy("turn", text_or_empty("role"), text_or_empty("text"))
    at = F.row_number().over(order).cast("long")
    nodes = rows.withColumn("node_id", at).select(
        F.col("conv_id").alias("tree_id"), "node_id", (F.col("node_id") - 1).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"),
    )
    out = chat.read_back(chat.conversations(nodes))
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_quality_trees")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.judge(docs, model).drop("text")


@query("op7_toxic_segments")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id) mod 3 is not 1; scores all."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(crc32_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), spans=True)
    return scored.select(
        "doc_id", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "toxic_spans",
    )


@query("op8_hierarchical_language")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 3 is not 1; predicts all."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, keep=crc32_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def token_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of at most 1024 tokens of the public 50k byte vocabulary. The rank file holds the same
    vocabulary and merges as byte_bpe_50k.json and gives the same ids several times faster."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pieces(docs, ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(token_pieces(table(spark, folder, "documents"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 18, 1))) AS r(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, j FROM late, unnest(range(i, i + 20)) AS r(j)),
words AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(j)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text
         FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op1_window_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.remove_repeats(table(spark, folder, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM d, unnest(range(0, greatest(length(x) // 2 - 199, 0))) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
-- repeated windows that overlap or touch make one removed run
marked AS (SELECT *, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS new FROM again),
runs AS (SELECT doc_id, min(i) AS first, max(i) + 200 AS past FROM (
  SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
sums AS (SELECT doc_id, count(*) AS n_spans, sum(past - first) AS n_removed FROM runs GROUP BY doc_id),
borders AS (
  SELECT doc_id, past AS a, lead(first) OVER (PARTITION BY doc_id ORDER BY first) AS b FROM runs
  UNION ALL SELECT doc_id, 0, min(first) FROM runs GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, NULL FROM d ANTI JOIN runs USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, CASE WHEN b IS NULL THEN length(x) ELSE 2 * (b - a) END), '' ORDER BY a) AS k
         FROM borders JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


@query("op10_byte_dedup", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return byte_dedup.remove_repeats(table(spark, folder, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b),
low AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(c, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query("op4_minhash_near_dedup", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op5_spaced_seed_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
r AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT *, array_to_string(u[:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:], '') AS s FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return infill.fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(), 256).alias("restored_sha256"))


def piece_model() -> bytes:
    """The public 32k piece model, read by the driver; tasks get its bytes."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query("op12_piece_round_trip")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    model = piece_model()
    found = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), model)
    return pieces.decode(found.select("doc_id", "ids"), model).select("doc_id", *pieces.digests())


@query("op13_exact_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """One row per vector and component; a deviation that no long holds is NULL."""
    found = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    part = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained"))
    return found.filter(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", part.alias("p")).select(
        "vec_id", F.col("p.component").alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("p.whitened").alias("whitened"), F.col("p.explained").alias("explained"), "identity_error")
