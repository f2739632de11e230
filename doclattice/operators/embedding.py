"""Embeddings: a text column in, vectors out, one Arrow batch at a time.

The default encoder hashes lower-cased words into ``dim`` buckets and L2-normalises the counts; it
needs no model file. Any other model plugs in as a factory that returns ``encode(list[str]) ->
ndarray``; it is built once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.functions.words import words_of

DIM = 64
MODEL_BATCH = 64
HASH_MODEL = "hashed-words-64"
EPSILON = 1e-8

EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def word_bucket(word: Column, dim: int = DIM) -> Column:
    """Bucket of a word: leading 28 bits of its md5 modulo ``dim`` (same in any SQL engine)."""
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") % dim).cast("int")


def text_buckets(text: Column, dim: int = DIM) -> Column:
    return F.transform(tx.lexemes(text, stop_words=()), lambda w: word_bucket(w, dim))


def _count_matrix(buckets: pa.ListArray, dim: int) -> np.ndarray:
    """Row-wise bucket counts of a list array."""
    lengths = np.diff(np.asarray(buckets.offsets))
    flat = np.asarray(buckets.flatten())
    rows = np.repeat(np.arange(len(buckets)), lengths)
    counts = np.bincount(rows * dim + flat, minlength=len(buckets) * dim)
    return counts.reshape(len(buckets), dim).astype(np.float64)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows over their length; zero rows stay zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _as_list_array(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(matrix.shape[0] + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), kind))


def _hashed(words: pa.ListArray, dim: int) -> pa.ListArray:
    """Buckets of lists of words, as :func:`word_bucket` has them; each different word is hashed once."""
    coded = words.flatten().dictionary_encode()
    known = [int(md5(w.encode()).hexdigest()[:7], 16) % dim for w in coded.dictionary.to_pylist()]
    flat = np.array(known, np.int32)[coded.indices.to_numpy()]
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Default embedding. Words are cut, hashed and counted on whole Arrow batches."""

    @F.arrow_udf("array<double>")
    def embed(lowered: pa.Array) -> pa.Array:
        return _as_list_array(_unit_rows(_count_matrix(_hashed(words_of(lowered), dim), dim)), pa.float64())

    return embed(F.lower(F.coalesce(text, F.lit(""))))


def model_embedding(text: Column, factory: EncoderFactory, batch: int = MODEL_BATCH) -> Column:
    """Embedding by a plugged-in model, built once per worker and fed ``batch`` texts at a time."""
    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = factory()
        for texts in batches:
            parts = [
                np.asarray(encode(texts.slice(i, batch).to_pylist()), dtype=np.float64)
                for i in range(0, len(texts), batch)
            ]
            yield _as_list_array(np.vstack(parts), pa.float64())

    return embed(F.coalesce(text, F.lit("")))


def embed_chunks(
    chunks: DataFrame, factory: EncoderFactory | None = None, model_name: str = HASH_MODEL
) -> DataFrame:
    """chunk_embeddings rows: chunk, document, vector, model and a hash of the embedded content."""
    vector = (
        hashed_embedding(F.col("content"))
        if factory is None
        else model_embedding(F.col("content"), factory)
    )
    return chunks.select(
        "chunk_id", "doc_id", F.sha2("content", 256).alias("content_hash"),
        F.lit(model_name).alias("model_name"), vector.alias("embedding"),
    )


def missing_embeddings(chunks: DataFrame, stored: DataFrame, model_name: str) -> DataFrame:
    """Chunks whose current content has no stored vector of this model."""
    have = stored.filter(F.col("model_name") == model_name).select("chunk_id", "content_hash")
    return chunks.withColumn("content_hash", F.sha2("content", 256)).join(
        have, ["chunk_id", "content_hash"], "left_anti"
    )


def upsert_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """New vectors replace stored ones of the same chunk and model; the rest is kept."""
    key = ["chunk_id", "model_name"]
    return stored.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def neighbour_similarities(dim: int = DIM, factory: EncoderFactory | None = None):
    """Function from an array of sentences to the cosines of each with the next.

    Sentences of a whole Arrow batch are flattened, embedded at once and multiplied pairwise, so
    topic detection needs neither an explode nor a shuffle.
    """

    def cosines(matrix: np.ndarray, lengths: np.ndarray) -> pa.Array:
        norms = np.linalg.norm(matrix, axis=1)
        if len(matrix) > 1:
            sims = np.einsum("ij,ij->i", matrix[:-1], matrix[1:]) / (
                norms[:-1] * norms[1:] + EPSILON
            )
        else:
            sims = np.zeros(0)
        ends = np.cumsum(lengths)
        keep = np.ones(max(len(matrix) - 1, 0), dtype=bool)
        inner = ends[:-1] - 1
        keep[inner[(inner >= 0) & (inner < len(keep))]] = False
        counts = np.maximum(lengths - 1, 0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(sims[keep], pa.float64())
        )

    if factory is None:

        @F.arrow_udf("array<double>")
        def hashed(sents: pa.Array) -> pa.Array:
            lengths = np.diff(np.asarray(sents.offsets))
            return cosines(_count_matrix(sents.flatten(), dim), lengths)

        return lambda s: hashed(F.transform(s, lambda x: text_buckets(x, dim)))

    @F.arrow_udf("array<double>")
    def modelled(sents: pa.Array) -> pa.Array:
        lengths = np.diff(np.asarray(sents.offsets))
        flat = sents.flatten().to_pylist()
        encode = factory()
        matrix = np.asarray(encode(flat), dtype=np.float64) if flat else np.zeros((0, dim))
        return cosines(matrix, lengths)

    return modelled
