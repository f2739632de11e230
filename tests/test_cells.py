"""The cell index against exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclattice.operators import cells, vectors
from doclattice.plans import load_all
from doclattice.plans import vector_queries as vq
from doclattice.plans.registry import Tables

LARGER = "/root/testdata/sf0.01"


def recall(queries, items, index, centres, k, probes):
    exact = vectors.exact_top_k(queries, items, k).select("query_id", "item_id", "score")
    found = cells.cell_top_k(queries, index, centres, k, probes).select("query_id", "item_id", "score")
    # equal scores are as good as each other: count those not below the k-th
    last = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(last, "query_id").filter("score >= least").count()
    return good / exact.count()


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the larger test tables")
def test_recall_on_chunk_vectors(spark):
    load_all()
    t = Tables(spark, LARGER)
    index, centres = vq.cells_v(t, "chunk_cells", vq.chunk_items)
    items = vq.chunk_items(t)
    assert index.count() == items.count() == index.select("item_id").distinct().count()
    assert 2 * items.count() ** 0.5 < centres.count() < 8 * items.count() ** 0.5
    passages = vq.query_vectors_v(t)
    own = items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    found = [recall(q, items, index, centres, 10, cells.PROBES) for q in (passages, own)]
    assert min(found) >= 0.9
    assert recall(passages, items, index, centres, 10, 8) < found[0]  # fewer cells, fewer neighbours
    folders = index.inputFiles()
    assert len({f.split("part=")[1].split("/")[0] for f in folders}) > 1  # stored by cell


def test_cells_of_odd_tables(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0])] + [(50 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    centres = cells.fit_centres(items, 3)
    index = cells.assigned(items, centres)
    assert index.count() == len(rows)  # zero vectors and copies are stored too
    queries = items.withColumnRenamed("item_id", "query_id")
    every = cells.cell_top_k(queries, index, centres, 5, 10_000)
    exact = vectors.exact_top_k(queries, items, 5)
    same = lambda df: sorted(map(tuple, df.select("query_id", "item_id", "rank").collect()))
    assert same(every) == same(exact)  # all cells probed: the exact answer
    none = items.limit(0)
    assert cells.fit_centres(none, 3).count() == 0
    assert cells.cell_top_k(queries, cells.assigned(none, centres), centres, 5).count() == 0
    unit = np.array([c["embedding"] for c in centres.collect()])
    assert np.isfinite(unit).all()
