"""Chunkers: page tables in, chunk tables out.

All of them work inside a row with higher-order functions, windows of words on Arrow batches, and
explode at the end, so chunking itself needs no shuffle; only the document-wide re-index does, on the document key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.functions.rows import unnest

CHUNK_TOKENS = 400
OVERLAP = 0.15
OVERLAP_SENTENCES = 2
TOPIC_THRESHOLD = 0.5
MIN_TOPIC_SENTENCES = 2

Pieces = Callable[[Column], Column]


def non_blank_pages(pages: DataFrame, text_col: str = "text") -> DataFrame:
    return pages.filter(~tx.is_blank(F.col(text_col)))


def fixed_size_chunks(
    pages: DataFrame,
    keys: tuple[str, ...] = ("doc_id", "page_number"),
    text_col: str = "text",
    size: int = CHUNK_TOKENS,
    overlap: float = OVERLAP,
    pieces: Pieces = tx.word_pieces,
) -> DataFrame:
    """Token windows with overlap.

    ``pieces`` turns a text into tokens whose concatenation is the text (words by default, or a
    byte-pair plug-in). A text of at most ``size`` tokens is one chunk; otherwise windows start
    every ``size - int(size * overlap)`` tokens and stop at the first one that reaches the end.
    Blank windows use up no index.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    step = size - int(size * overlap)
    filled = non_blank_pages(pages, text_col)
    if pieces is tx.word_pieces:
        # Words by their ends, a batch at a time: no string of its own for every word.
        windows, tokens = _word_windows(F.col(text_col), size, step), filled
    else:
        tokens = filled.select(*keys, pieces(F.col(text_col)).alias("_pieces"))
        windows, tokens = _piece_windows(tokens, size, step)
    return unnest(tokens, list(keys), windows, "chunk_index", "_w").select(
        *keys, "chunk_index", "_w.*"
    )


def _word_windows(text: Column, size: int, step: int) -> Column:
    @F.arrow_udf("array<struct<content:string,token_count:int,char_start:int,char_end:int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        word = re.compile(f"[^{re.escape(tx.BLANK_CHARS)}]+")
        for texts in batches:
            contents, numbers, offsets = [], [], [0]
            for value in texts:
                whole = value.as_py() or ""
                ends = [m.end() for m in word.finditer(whole)]
                n = len(ends)
                # The first window that reaches the end is the last one.
                for at in range(0, max(n - size + step, 1) if n else 0, step):
                    first = ends[at - 1] if at else 0
                    past = ends[at + size - 1] if at + size < n else len(whole)
                    contents.append(whole[first:past].strip(tx.BLANK_CHARS))
                    numbers.append((min(size, n - at), first, past))
                offsets.append(len(contents))
            columns = np.array(numbers, np.int32).reshape(-1, 3).T
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(contents, pa.string()), *map(pa.array, columns)],
                ["content", "token_count", "char_start", "char_end"]))

    return cut(text)


def _piece_windows(tokens: DataFrame, size: int, step: int) -> tuple[Column, DataFrame]:
    tok = F.col("_pieces")
    n = F.size(tok)
    last = F.when(n <= size, F.lit(0)).otherwise(
        F.ceil((n - size) / F.lit(float(step))).cast("int")
    )
    # Lengths of the step-sized segments; their running sums are the window start offsets.
    segments = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.length(F.array_join(F.slice(tok, i * step + 1, F.lit(step)), "")),
    )

    def window(i: Column) -> Column:
        raw = F.array_join(F.slice(tok, i * step + 1, F.lit(size)), "")
        start = F.aggregate(F.slice(F.col("_segments"), F.lit(1), i), F.lit(0), lambda a, x: a + x)
        return F.struct(
            tx.strip(raw).alias("content"),
            F.least(F.lit(size), n - i * step).alias("token_count"),
            start.alias("char_start"),
            (start + F.length(raw)).alias("char_end"),
        )

    windows = F.filter(
        F.transform(F.sequence(F.lit(0), last), window), lambda w: w["content"] != ""
    )
    return windows, tokens.withColumn("_segments", segments)


def reindex_chunks(chunks: DataFrame, doc: str = "doc_id", page: str = "page_number") -> DataFrame:
    """Replace per-page chunk indexes by one zero-based index over the document."""
    order = Window.partitionBy(doc).orderBy(page, "chunk_index")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1)


def _sentence_structs(text: Column) -> Column:
    return F.transform(
        tx.sentences(text), lambda s: F.struct(s.alias("s"), tx.word_count(s).alias("n"))
    )


_SENTENCES = "array<struct<s:string,n:int>>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _tokens(sents: Column) -> Column:
    return F.aggregate(sents, F.lit(0), lambda a, x: a + x["n"])


def _joined(sents: Column) -> Column:
    return F.array_join(F.transform(sents, lambda x: x["s"]), " ")


def _part(array: Column, first: Column, past: Column) -> Column:
    """Elements ``first`` to ``past - 1``, picked one by one: a slice would read the whole array."""
    return F.transform(F.sequence(first, past - 1), lambda i: F.get(array, i))


def _pack(sents: Column, size: int, carry: int) -> Column:
    """Greedy fold of sentences into groups of at most ``size`` tokens, carrying ``carry`` over.

    The fold keeps numbers only: where each group begins and ends. Groups are then one slice each, so
    no sentence is copied twice, however long the text.
    """
    number = lambda value, name: F.lit(value).cast("int").alias(name)
    start = F.struct(_empty("array<struct<first:int,past:int>>").alias("groups"), number(0, "first"), number(0, "at"), number(0, "n"))
    group = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["at"].alias("past")))

    def breaks(counts: Column) -> Column:
        def merge(acc: Column, x: Column) -> Column:
            full = (acc["n"] + x > size) & (acc["at"] > acc["first"])
            fresh = acc["at"]
            kept = F.lit(0)
            if carry > 0:
                long = acc["at"] - acc["first"] > carry
                fresh = F.when(long, acc["at"] - carry).otherwise(acc["at"])
                kept = F.when(long, sum(F.get(counts, acc["at"] - k) for k in range(1, carry + 1))).otherwise(0)
            return F.struct(
                F.when(full, F.concat(acc["groups"], group(acc))).otherwise(acc["groups"]).alias("groups"),
                F.when(full, fresh).otherwise(acc["first"]).alias("first"),
                (acc["at"] + 1).alias("at"),
                (F.when(full, kept).otherwise(acc["n"]) + x).cast("int").alias("n"),
            )

        return F.aggregate(counts, start, merge, lambda acc: F.when(
            acc["at"] > acc["first"], F.concat(acc["groups"], group(acc))).otherwise(acc["groups"]))

    def cut(own: Column) -> Column:
        return tx.let(F.transform(own, lambda x: x["n"]), lambda counts: F.transform(
            breaks(counts), lambda g: _part(own, g["first"], g["past"])))

    return tx.let(sents, cut)


def sentence_groups_to_chunks(df: DataFrame, keys: tuple[str, ...], groups: str) -> DataFrame:
    return unnest(df, list(keys), groups, "chunk_index", "_g").select(
        *keys, "chunk_index", _joined(F.col("_g")).alias("content"),
        _tokens(F.col("_g")).alias("token_count"),
    )


def _whole_text_group(text_col: str) -> Column:
    whole = tx.strip(F.col(text_col))
    return F.array(F.array(F.struct(whole.alias("s"), tx.word_count(whole).alias("n"))))


def sentence_chunks(
    pages: DataFrame,
    keys: tuple[str, ...] = ("doc_id", "page_number"),
    text_col: str = "text",
    size: int = CHUNK_TOKENS,
    overlap_sentences: int = OVERLAP_SENTENCES,
) -> DataFrame:
    """Whole sentences packed up to ``size`` tokens; the last ones open the next chunk."""
    text = F.col(text_col)
    groups = F.when(tx.word_count(text) <= size, _whole_text_group(text_col)).otherwise(
        _pack(F.col("_sents"), size, overlap_sentences)
    )
    df = (
        non_blank_pages(pages, text_col)
        .withColumn("_sents", _sentence_structs(text))
        .withColumn("_groups", groups)
    )
    return sentence_groups_to_chunks(df, keys, "_groups")


def topic_groups(sents: Column, sims: Column, threshold: float = TOPIC_THRESHOLD) -> Column:
    """Cut an array of sentence structs wherever the similarity to the next one is too low.

    The places of the cuts come first, each group is then one slice, so nothing is copied twice.
    """
    n = F.size(sents)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.coalesce(F.get(sims, i - 1), F.lit(1.0)) < threshold),
    )
    groups = tx.let(sents, lambda own: tx.let(starts, lambda c: F.transform(
        c, lambda p, j: _part(own, p, F.coalesce(F.get(c, j + 1), F.size(own))))))
    return F.when(n > 0, groups).otherwise(F.array(_empty(_SENTENCES)))


def merge_small_groups(
    groups: Column, size: int = CHUNK_TOKENS, min_sentences: int = MIN_TOPIC_SENTENCES
) -> Column:
    """Append a group to the one before it if that one is short or both fit into ``size``."""
    # The fold keeps only numbers: where merged groups begin, and the size of the last one.
    number = lambda name, value: F.lit(value).cast("int").alias(name)
    start = F.struct(_empty("array<int>").alias("starts"), number("at", 0), number("sents", 0), number("tokens", 0))

    def merge(acc: Column, g: Column) -> Column:
        join = (acc["sents"] < min_sentences) | (acc["tokens"] + _tokens(g) <= size)
        return tx.let(join, lambda j: F.struct(
            F.when(j, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"]))).alias("starts"),
            (acc["at"] + 1).alias("at"),
            F.when(j, acc["sents"] + F.size(g)).otherwise(F.size(g)).alias("sents"),
            F.when(j, acc["tokens"] + _tokens(g)).otherwise(_tokens(g)).cast("int").alias("tokens"),
        ))

    def cut(bound: Column) -> Column:
        n = F.size(bound)
        starts = F.aggregate(bound, start, merge, lambda acc: F.concat(F.array(F.lit(0)), acc["starts"]))
        return tx.let(starts, lambda c: F.transform(
            c, lambda p, j: F.flatten(_part(bound, p, F.coalesce(F.get(c, j + 1), n)))))

    return tx.let(groups, cut)


def split_large_groups(groups: Column, size: int = CHUNK_TOKENS) -> Column:
    """Split each group over ``size`` tokens greedily, without overlap."""
    return F.flatten(
        F.transform(
            groups, lambda g: F.when(_tokens(g) > size, _pack(g, size, 0)).otherwise(F.array(g))
        )
    )


def semantic_chunks(
    pages: DataFrame,
    similarities: Callable[[Column], Column] | None,
    keys: tuple[str, ...] = ("doc_id", "page_number"),
    text_col: str = "text",
    size: int = CHUNK_TOKENS,
    threshold: float = TOPIC_THRESHOLD,
    min_sentences: int = MIN_TOPIC_SENTENCES,
) -> DataFrame:
    """Topic chunks: cut at low similarity of neighbours, merge small groups, split large ones.

    ``similarities`` maps an array of sentences to the cosines of neighbours (one Arrow pass, see
    ``embedding.neighbour_similarities``). None packs by tokens alone, marked as fallback.
    """
    text = F.col(text_col)
    df = non_blank_pages(pages, text_col).withColumn("_sents", _sentence_structs(text))
    if similarities is None:
        long_groups, method = _pack(F.col("_sents"), size, 0), "semantic_fallback"
    else:
        df = df.withColumn("_sims", similarities(F.transform("_sents", lambda x: x["s"])))
        topics = topic_groups(F.col("_sents"), F.col("_sims"), threshold)
        long_groups = split_large_groups(merge_small_groups(topics, size, min_sentences), size)
        method = "semantic"
    short = (tx.word_count(text) <= size) | (F.size("_sents") < 2)
    df = df.withColumn(
        "_groups", F.when(short, _whole_text_group(text_col)).otherwise(long_groups)
    ).withColumn("_method", F.when(short, F.lit("semantic")).otherwise(F.lit(method)))
    return sentence_groups_to_chunks(df, (*keys, "_method"), "_groups").withColumnRenamed(
        "_method", "chunking_method"
    )
