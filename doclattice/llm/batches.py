"""New columns from whole texts, block by block, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.llm.hashing import BLOCK_BYTES, blocks, encoded

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def with_text_columns(docs: DataFrame, fields: dict[str, str], make: Callable[[], Callable[[list[bytes]], dict]],
                      text: str = "text") -> DataFrame:
    """``docs`` and the columns named in ``fields`` (name -> type). ``make()`` runs once a task and
    gives the function from a block of UTF-8 texts (NULL: empty) to equally long columns. Columns of
    the input that have one of these names are replaced."""
    docs = docs.drop(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = encoded(batch.column(batch.schema.get_field_index(text)).to_pylist())
            for begin, end in blocks(texts, BLOCK_BYTES):
                new = work(texts[begin:end])
                part = batch.slice(begin, end - begin)
                arrays = [pa.array(new[n], ARROW[kind]) for n, kind in fields.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*batch.schema.names, *fields])

    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
             "string": T.StringType(), "binary": T.BinaryType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kinds[k]) for n, k in fields.items())])
    return docs.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id") -> DataFrame:
    """Texts of at most ``rows`` labelled documents, chosen by a hash of their id: (key, text, y).

    The chosen ids have a proven size bound, so they travel to the documents and no text is shuffled.
    Of several labels for one id the largest counts; NULL labels and ids do not.
    """
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(key), key).limit(rows)
    )
    return docs.select(key, "text").join(F.broadcast(chosen), key)


def crc32_mod(key: str, n: int):
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n


def concat_rows(values: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1) if values else np.zeros((0, 0), dtype)
