"""Cosine search of whole query tables over whole vector tables.

Exact search cuts both sides into blocks of bounded size; each pair of blocks meets in one co-grouped
task, multiplies, and gives up k rows per query. That is the only path, whatever the size of either
side, and nothing runs while the plan is made. Filters of a query hold inside the task, before its
best k are taken.

The approximate search meets vectors only in hash buckets, with the same block task inside, so a
bucket of any size is cut into bounded blocks and never emits its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 20_000
QUERY_ROWS = 4_000
SCORED_AT_ONCE = 256
SCORE_DIGITS = 9
#: Squared lengths nearer to one than this are one; scores whose last digit is nearer to a half than
#: HALF_SLACK are summed again in a fixed order, as the order decides how they round.
UNIT_SLACK = 1e-13
HALF_SLACK = 1e-4
_PAIR = "query_id long, item_id long, score double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; NULL where a vector is all zero and no epsilon is given."""
    return dot(a, b) / F.nullif(norm(a) * norm(b) + epsilon, F.lit(0.0))


def _rows(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    return _unit(_rows(vectors))


def _inner(a: list[float], b: list[float]) -> float:
    """Summed from the first dimension to the last with fused steps, as the SQL engine does."""
    total = 0.0
    for x, y in zip(a, b):
        total = math.fma(x, y, total)
    return total


def _cosine_in_order(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine to the last bit as SQL has it; vectors of length one (up to rounding) are not scaled again."""
    a, b = a.tolist(), b.tolist()
    aa, bb = _inner(a, a), _inner(b, b)
    if abs(aa - 1) < UNIT_SLACK and abs(bb - 1) < UNIT_SLACK:
        return _inner(a, b)
    return _inner(a, b) / ((math.sqrt(aa) * math.sqrt(bb)) or 1.0)


#: What a query may ask of a vector's document; every field may be NULL, dates are inclusive.
FILTERS = ("document_type", "document_ids", "date_from", "date_to")
ATTRIBUTES = ("doc_id", "document_type", "created_at")


def _allowed(queries: pa.Table, items: pa.Table) -> np.ndarray | None:
    """Which items (columns) each query (rows) may get; None if the tables hold no filters."""
    if "document_ids" not in queries.column_names or "created_at" not in items.column_names:
        return None
    doc, kind = (np.array(items[c].to_pylist(), object) for c in ATTRIBUTES[:2])
    stamp = items["created_at"].to_numpy(zero_copy_only=False).astype("datetime64[us]")
    known: dict = {}
    out = np.ones((queries.num_rows, items.num_rows), bool)
    for i, asked in enumerate(queries.select(list(FILTERS)).to_pylist()):
        key = repr(asked)  # queries with the same filter share one mask
        if key not in known:
            mask = np.ones(items.num_rows, bool)
            if asked["document_type"] is not None:
                mask &= kind == asked["document_type"]
            if asked["document_ids"] is not None:
                mask &= np.isin(doc.astype(str), [str(x) for x in asked["document_ids"]])
            for name, side in (("date_from", np.greater_equal), ("date_to", np.less_equal)):
                if asked[name] is not None:
                    mask &= side(stamp, np.datetime64(asked[name].replace(tzinfo=None), "us"))
            known[key] = mask
        out[i] = known[key]
    return out


def _rounded(scores: np.ndarray, digits: tuple[int, ...]) -> np.ndarray:
    """To each of ``digits`` in turn, halves away from zero."""
    for n in digits:
        scaled = scores * 10.0**n
        whole = np.trunc(scaled)
        scores = (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**n
    return scores + 0.0


def _best(queries: pa.Table, items: pa.Table, k: int, digits: tuple[int, ...] = (SCORE_DIGITS,)) -> pa.Table:
    """Top k allowed items of each query by rounded score, then smaller id."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if queries.num_rows and items.num_rows:
        items = items.sort_by("item_id")
        q_ids, v_ids = queries["query_id"].to_numpy(), items["item_id"].to_numpy()
        q_rows, v_rows = _rows(queries["embedding"]), _rows(items["embedding"])
        q_unit, v_unit = _unit(q_rows), _unit(v_rows)
        allowed = _allowed(queries, items)
        for at in range(0, len(q_ids), SCORED_AT_ONCE):
            part = slice(at, at + SCORED_AT_ONCE)
            scores = q_unit[part] @ v_unit.T
            if allowed is not None:
                scores[~allowed[part]] = -np.inf
            n = min(k, scores.shape[1])
            least = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
            # Rounding can lift what is about a unit of the last digit below the k-th to its score.
            row, col = np.nonzero((scores >= least - 2.5 * 10.0 ** -min(digits)) & (scores > -np.inf))
            value = scores[row, col]
            for i in np.nonzero(np.abs(np.abs(value * 10.0 ** digits[0]) % 1 - 0.5) < HALF_SLACK)[0]:
                value[i] = _cosine_in_order(q_rows[at + row[i]], v_rows[col[i]])
            value = _rounded(value, digits)
            order = np.lexsort((col, -value, row))  # items are by id, so columns break ties
            row, col, value = row[order], col[order], value[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((q_ids[part][row[keep]], v_ids[col[keep]], value[keep]))
    return pa.table(dict(zip(("query_id", "item_id", "score"), (np.concatenate(c) for c in zip(*found)))))


def rank_per_query(pairs: DataFrame, k: int, item: str = "item_id") -> DataFrame:
    """Keep the k best rows per query. The limit is also applied before the shuffle by Spark."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(item))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, digits: tuple[int, ...] = (SCORE_DIGITS,)
) -> DataFrame:
    """``queries(query_id, embedding)`` x ``vectors(item_id, embedding)`` -> ranked cosine hits.

    Scores are rounded to each of ``digits`` in turn before anything is ranked; equal ones go by id.
    Queries that also have the columns FILTERS get only vectors (with the columns ATTRIBUTES) of
    documents that fit.
    """
    extra = lambda df, names: [c for c in names if c in df.columns]
    queries = queries.select(F.col("query_id").cast("long"), "embedding", *extra(queries, FILTERS))
    vectors = vectors.select(F.col("item_id").cast("long"), "embedding", *extra(vectors, ATTRIBUTES))
    return rank_per_query(_block_join(queries, vectors, [], k, digits=digits), k)


def _blocked(side: DataFrame, own: str, keys: list[str], counts: list[DataFrame]) -> DataFrame:
    """Cut one side into blocks and copy each row to all blocks of the other side."""
    other = "qb" if own == "vb" else "vb"
    id_col = "item_id" if own == "vb" else "query_id"
    n_v, n_q = counts
    if keys:
        side = side.join(n_v.join(n_q, keys), keys)  # only buckets that both sides fill
    else:
        side = side.withColumn("n_vb", n_v.scalar()).withColumn("n_qb", n_q.scalar())
    return side.select(
        # Fresh names: both sides may come from the same table.
        *[F.col(c).alias(c) for c in (*keys, id_col, "embedding")],
        *[F.col(c).alias(c) for c in dict.fromkeys(FILTERS + ATTRIBUTES) if c in side.columns and c not in keys],
        F.pmod(F.xxhash64(F.col(id_col)), F.col(f"n_{own}")).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other),
    )


def _block_join(
    queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, block: int = BLOCK_ROWS,
    query_block: int = QUERY_ROWS, digits: tuple[int, ...] = (SCORE_DIGITS,),
) -> DataFrame:
    """Multiply query and vector blocks that share ``keys`` (all of them without keys)."""

    def blocks(df: DataFrame, name: str, rows: int) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("int").alias(name)
        )

    counts = [blocks(vectors, "n_vb", block), blocks(queries, "n_qb", min(block, query_block))]
    group = [*keys, "vb", "qb"]
    v_side = _blocked(vectors, "vb", keys, counts).groupBy(*group)
    q_side = _blocked(queries, "qb", keys, counts).groupBy(*group)

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k, digits)

    return q_side.cogroup(v_side).applyInArrow(multiply, _PAIR)


def band_keys(embedding: Column, dim: int, bands: int, bits: int, seed: int = 7) -> Column:
    """Random-hyperplane signatures: one bucket number per band of ``bits`` sign bits."""
    planes = np.random.default_rng(seed).standard_normal((dim, bands * bits))
    weights = 1 << np.arange(bits)

    @F.arrow_udf("array<long>")
    def keys(vectors: pa.Array) -> pa.Array:
        signs = (_unit_rows(vectors) @ planes > 0).reshape(len(vectors), bands, bits)
        numbers = (signs * weights).sum(axis=2) + (np.arange(bands) << bits)
        offsets = pa.array(np.arange(len(vectors) + 1) * bands, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(numbers.reshape(-1), pa.int64()))

    return keys(embedding)


def approximate_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, dim: int, bands: int = 16, bits: int = 6
) -> DataFrame:
    """Cosine hits among vectors that share at least one hash bucket with the query."""

    def banded(df: DataFrame, id_col: str) -> DataFrame:
        return df.select(
            F.col(id_col).cast("long").alias(id_col), "embedding",
            F.explode(band_keys(F.col("embedding"), dim, bands, bits)).alias("band"),
        )

    pairs = _block_join(banded(queries, "query_id"), banded(vectors, "item_id"), ["band"], k)
    return rank_per_query(pairs.dropDuplicates(["query_id", "item_id"]), k)


def restrict_vectors(
    vectors: DataFrame,
    document_ids: DataFrame | None = None,
    classifications: DataFrame | None = None,
    document_type: str | None = None,
) -> DataFrame:
    """Keep vectors of the listed documents / of documents with a type, before any scoring."""
    if document_ids is not None:
        vectors = vectors.join(document_ids.select("doc_id"), "doc_id", "left_semi")
    if document_type is not None:
        typed = classifications.filter(F.col("document_type") == document_type).select("doc_id")
        vectors = vectors.join(typed, "doc_id", "left_semi")
    return vectors
