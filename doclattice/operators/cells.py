"""Approximate vector search in cells.

Vectors are put into the cell of their nearest centre and stored by cell; a query is compared only
with the vectors of its ``probes`` nearest cells. The number of cells follows the square root of the
table (``CELLS_PER_ROOT`` times it), so a cell stays small while the table grows. First centres are
vectors chosen by a hash of their id; one step of averaging over a sample (``FIT_ROWS`` vectors a
cell, chosen by another hash) moves them to the middle of what is near them. Every vector is stored,
sampled or not. Centres travel to all tasks, at most ``CENTRE_BYTES`` of them: beyond, cells grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.operators.vectors import SCORE_DIGITS, SCORED_AT_ONCE, _block_join, _unit_rows, exact_top_k, norm, rank_per_query

CELLS_PER_ROOT = 4
FIT_ROWS = 64
CENTRE_BYTES = 32 << 20
PROBES = 48
#: Folders of the stored index: cells are dealt over them, so a few cells are read from a few folders.
PARTS = 32


def _chosen(label: str, item: str) -> Column:
    """Pseudo-random number in [0, 1) of an id, the same in any SQL engine."""
    joined = F.concat_ws("|", F.lit(label), F.col(item).cast("string"))
    return F.conv(F.substring(F.md5(joined), 1, 7), 16, 10).cast("bigint") / F.lit(268435456.0)


def cell_part(cell: Column) -> Column:
    return F.pmod(F.xxhash64(cell), F.lit(PARTS)).cast("int")


def fit_centres(vectors: DataFrame, dim: int) -> DataFrame:
    """(cell, embedding) of ``vectors(item_id, embedding)``; a cell is named by its first centre."""
    n = F.count("*")
    share = vectors.agg(F.least(F.lit(1.0), CELLS_PER_ROOT / F.sqrt(n), F.lit(float(CENTRE_BYTES // (8 * dim))) / n).alias("s")).scalar()
    unit = vectors.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("embedding").cast("array<double>").alias("e")
    ).withColumn("n", norm(F.col("e"))).filter("n > 0").select("item_id", F.transform("e", lambda x: x / F.col("n")).alias("embedding"))
    first = unit.filter(_chosen("cell", "item_id") < share)
    sample = unit.filter(_chosen("fit", "item_id") < share * FIT_ROWS)
    near = exact_top_k(sample.select(F.col("item_id").alias("query_id"), "embedding"), first, 1)
    near = near.select(F.col("query_id").alias("_id"), F.col("item_id").alias("cell"))
    parts = sample.join(near, F.col("item_id") == F.col("_id")).select("cell", F.posexplode("embedding").alias("d", "x"))
    return parts.groupBy("cell", "d").agg(F.avg("x").alias("x")).groupBy("cell").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("embedding"))


def assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """``vectors`` with cell (nearest centre, of equal ones the smallest) and part. No shuffle: the
    centres, bounded by CENTRE_BYTES, go to the tasks."""
    rows = centres.orderBy("cell").collect()
    names = np.array([r["cell"] for r in rows], np.int64)
    matrix = np.array([r["embedding"] for r in rows], np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300) if len(rows) else 1.0
    sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    @F.arrow_udf("long")
    def nearest(embeddings: pa.Array) -> pa.Array:
        names, matrix = sent.value
        unit, best = _unit_rows(embeddings), []
        for at in range(0, len(unit), SCORED_AT_ONCE):
            best.append(np.round(unit[at:at + SCORED_AT_ONCE] @ matrix.T, SCORE_DIGITS).argmax(axis=1))
        return pa.array(names[np.concatenate(best)] if best else names[:0], pa.int64())

    return vectors.withColumn("cell", nearest(F.col("embedding").cast("array<double>"))).withColumn("part", cell_part(F.col("cell")))


def build(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """The index: vectors by cell, in order of cells inside each part; store it partitioned by part."""
    return assigned(vectors, centres).repartition(PARTS, "part").sortWithinPartitions("part", "cell", "item_id")


def cell_top_k(queries: DataFrame, index: DataFrame, centres: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """Ranked cosine hits of ``queries(query_id, embedding)`` among the vectors of their ``probes``
    nearest cells. Cells of any size are worked on in blocks; their pairs are never rows."""
    targets = centres.select(F.col("cell").alias("item_id"), "embedding")
    near = exact_top_k(queries, targets, probes).select(F.col("query_id").alias("_q"), F.col("item_id").alias("cell"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").join(near, F.col("query_id") == F.col("_q"))
    asked = asked.select("query_id", "embedding", "cell", cell_part(F.col("cell")).alias("part"))
    items = index.select(F.col("item_id").cast("long").alias("item_id"), "embedding", "cell", F.col("part").cast("int").alias("part"))
    return rank_per_query(_block_join(asked, items, ["part", "cell"], k), k)
