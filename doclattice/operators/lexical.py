"""Full-text index as tables: postings, statistics, and BM25 search of a whole query table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.functions import text as tx
from doclattice.functions.words import split_words, words_of
from doclattice.operators.vectors import rank_per_query

K1 = 1.2
LENGTH_WEIGHT = 0.75
SCORE_DIGITS = 6
#: Folders of a stored index, by hash of the term, and files a folder is cut into by hash of the chunk,
#: so that the list of a very common term is not one file.
TERM_PARTS = 32
LIST_FILES = 4
#: Most candidates of a batch of queries (two numbers each) that are sent to all tasks.
SENT_CANDIDATES = 1 << 20
#: Chunks whose words are counted together.
COUNTED_AT_ONCE = 2_000
#: Most (query, term) pairs of a batch of queries that travel to the packed terms of the chunks.
SENT_TERMS = 1 << 20


def _lexemes(text: Column, stop_words: Iterable[str], stem: Callable | None) -> Column:
    drop = list(stop_words)

    @F.arrow_udf("array<string>")
    def cut(lowered: pa.Array) -> pa.Array:
        return words_of(lowered, drop)

    found = cut(F.lower(text))
    return F.transform(found, stem) if stem else found


def postings(
    chunks: DataFrame,
    text_col: str = "content",
    stop_words: Iterable[str] = tx.ENGLISH_STOP_WORDS,
    stem: Callable[[Column], Column] | None = None,
    keep: tuple[str, ...] = ("chunk_id", "doc_id"),
) -> DataFrame:
    """(chunk, term, tf, dl): counted inside the Arrow batch over word numbers, so no shuffle and no sort."""
    drop = list(stop_words)
    read = _lexemes(F.col(text_col), drop, stem) if stem else F.lower(text_col)
    terms = chunks.select(*keep, read.alias("_t"))
    schema = T.StructType([
        *(terms.schema[c] for c in keep), T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType()),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            lists = batch.column(len(keep)) if stem else words_of(batch.column(len(keep)), drop)
            dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            words = pc.list_flatten(lists).dictionary_encode()
            own = np.repeat(np.arange(len(dl), dtype=np.int64), dl)
            size = max(len(words.dictionary), 1)
            pairs, tf = np.unique(own * size + words.indices.to_numpy(), return_counts=True)
            row = pairs // size
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i).take(pa.array(row)) for i in range(len(keep))),
                words.dictionary.take(pa.array(pairs % size)),
                pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32()),
            ], schema.names)

    return terms.mapInArrow(count, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, COUNTED_AT_ONCE):
            yield whole.slice(at, COUNTED_AT_ONCE)


def chunk_words(
    chunks: DataFrame,
    text_col: str = "content",
    stop_words: Iterable[str] = tx.ENGLISH_STOP_WORDS,
    stem: Callable[[Column], Column] | None = None,
    keep: tuple[str, ...] = ("chunk_id", "doc_id"),
) -> DataFrame:
    """The lexemes of a chunk side by side in its row, with blanks between: (chunk, words, dl).

    Nothing is shuffled or sorted to build it, and a chunk that has all terms of a query is found in
    its own row, so a batch of queries travels to the chunks and no posting leaves its task.
    """
    if stem:
        found = _lexemes(F.col(text_col), stop_words, stem)
        return chunks.select(*keep, F.array_join(found, " ").alias("words"), F.size(found).alias("dl"))
    texts = chunks.select(*keep, F.lower(text_col).alias("_t"))
    schema = T.StructType([
        *(texts.schema[c] for c in keep), T.StructField("words", T.StringType()), T.StructField("dl", T.IntegerType()),
    ])
    drop = list(stop_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            lists = words_of(batch.column(len(keep)), drop)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(len(keep))), pc.binary_join(lists, " "), pc.list_value_length(lists),
            ], schema.names)

    return texts.mapInArrow(cut, schema)


def has_words(index: DataFrame) -> bool:
    return "words" in index.columns


def postings_of_words(index: DataFrame) -> DataFrame:
    """:func:`postings` out of :func:`chunk_words`."""
    keep = tuple(c for c in index.columns if c not in ("words", "dl"))
    return postings(index, "words", stop_words=(), keep=keep)


def _codes(lists: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of row and number of a word of the vocabulary, by word, then row, and how often they occur."""
    code = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size), dtype=np.int64), size)
    pairs, tf = np.unique((code * np.int64(len(size)) + row)[code >= 0], return_counts=True)
    return pairs % max(len(size), 1), pairs // max(len(size), 1), tf


def _vocabulary_counts(index: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(term, df) of the words of the vocabulary that any chunk has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            total += np.bincount(_codes(split_words(batch.column(0)), vocabulary)[1], minlength=len(vocabulary))
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(found)), pa.array(total[found])], ["term", "n"])

    counts = index.select("words").mapInArrow(count, "term string, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("df"))


def _matches_in_rows(asked: pa.Table, index: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(query, chunk, term, tf, dl) of the chunks that have all terms of a query, found in their rows:
    the chunks of the query's rarest term in the batch, less those without the next one, and so on."""
    keep = ("chunk_id", "doc_id")
    asked = asked.sort_by("query_id")
    ids, first, n = np.unique(asked["query_id"].to_numpy(), return_index=True, return_counts=True)
    words = pc.index_in(asked["term"], value_set=vocabulary).to_numpy()
    whole = asked["n_terms"].to_numpy()[first] == n
    schema = T.StructType([
        T.StructField("query_id", T.LongType()), *(index.schema[c] for c in keep), T.StructField("n_terms", T.IntegerType()),
        T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType()),
    ])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, code, tf = _codes(split_words(batch.column(len(keep))), vocabulary)
            start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(vocabulary)))])
            size = np.diff(start)
            found = [(np.zeros(0, np.int64),) * 3]
            possible = np.nonzero((np.minimum.reduceat(size[words], first) > 0) & whole)[0] if len(ids) else []
            for q in possible:
                own = words[first[q] : first[q] + n[q]]
                own = own[np.argsort(size[own], kind="stable")]
                rows = row[start[own[0]] : start[own[0] + 1]]
                for w in own[1:]:
                    theirs = row[start[w] : start[w + 1]]
                    near = np.minimum(np.searchsorted(theirs, rows), len(theirs) - 1)
                    rows = rows[theirs[near] == rows]
                    if not len(rows):
                        break
                for w in own if len(rows) else ():
                    found.append((np.full(len(rows), q), rows, start[w] + np.searchsorted(row[start[w] : start[w + 1]], rows)))
            query, rows, place = (np.concatenate(c) for c in zip(*found))
            if len(rows):
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[query], pa.int64()), *(batch.column(i).take(rows) for i in range(len(keep))),
                    pa.array(n[query], pa.int32()), vocabulary.take(pa.array(code[place])),
                    pa.array(tf[place], pa.int32()), batch.column(len(keep) + 1).take(rows),
                ], schema.names)

    return index.select(*keep, "words", "dl").mapInArrow(find, schema)


def term_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")


def by_term(index: DataFrame) -> DataFrame:
    """Postings with ``part``, to be stored in a folder per part: sorted by term, so a search opens the
    folders of its terms only and skips the rest of a file by its statistics."""
    piece = F.pmod(F.xxhash64("chunk_id"), F.lit(LIST_FILES))
    return (
        index.withColumn("part", term_part(F.col("term")))
        .repartition(TERM_PARTS * LIST_FILES, "part", piece)
        .sortWithinPartitions("part", "term", "chunk_id")
    )


def term_table(index: DataFrame) -> DataFrame:
    """(term, df): in how many chunks a term occurs; stored beside the index."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def index_missing(chunks: DataFrame, index: DataFrame, **options) -> DataFrame:
    """Postings of the chunks the index does not have yet."""
    done = index.select("chunk_id").distinct()
    return postings(chunks.join(done, "chunk_id", "left_anti"), **options)


def corpus_statistics(
    chunks: DataFrame,
    text_col: str = "content",
    stop_words: Iterable[str] = tx.ENGLISH_STOP_WORDS,
) -> DataFrame:
    """One row: number of chunks and their mean length in lexemes."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.avg(F.size(_lexemes(F.col(text_col), stop_words, None))).alias("avg_len"),
    )


def index_statistics(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """:func:`corpus_statistics` of chunks whose postings are there: their counts add up to the lengths,
    so no text is read again."""
    if has_words(index):
        return index.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avg_len"))
    lexemes = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_l"))
    return chunks.agg(F.count("*").alias("n_chunks")).crossJoin(lexemes).select(
        "n_chunks", (F.col("_l") / F.nullif("n_chunks", F.lit(0))).alias("avg_len"))


def query_terms(
    queries: DataFrame,
    stop_words: Iterable[str] = tx.ENGLISH_STOP_WORDS,
    stem: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(query_id, term, n_terms): the distinct lexemes every match must contain."""
    terms = F.array_distinct(_lexemes(F.col("query_text"), stop_words, stem))
    return (
        queries.select("query_id", terms.alias("_t"))
        .select("query_id", F.size("_t").alias("n_terms"), F.explode("_t").alias("term"))
    )


def bm25(tf: Column, dl: Column, df: Column, n: Column, avg_len: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * dl / avg_len))


def keyword_matches(
    terms: DataFrame,
    index: DataFrame,
    statistics: DataFrame,
    allowed: Callable[[DataFrame], DataFrame] | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """All chunks that contain every term of a query, with their BM25 score.

    Candidates come only from the rarest term of each query (a full match must contain it), so a
    frequent term never multiplies queries with its whole posting list. The candidates are then
    completed on (chunk, term), a key without hot values. ``allowed`` may drop candidates by
    document filters before anything is scored. An index with the column ``part`` (:func:`by_term`)
    is read in the folders of the queries' terms only; ``frequencies`` (:func:`term_table`) saves the
    count over the postings, and lets a search with few candidates leave the postings where they are.

    The queries travel to an index of :func:`chunk_words` instead, up to SENT_TERMS terms of them;
    its full matches are found row by row, and only they leave their task.
    """
    if has_words(index):
        asked = terms.select(F.col("query_id").cast("long"), "n_terms", "term").limit(SENT_TERMS + 1).toArrow()
        if asked.num_rows <= SENT_TERMS:
            vocabulary = pc.unique(asked["term"])
            found = _matches_in_rows(asked, index, vocabulary)
            known = _vocabulary_counts(index, vocabulary) if frequencies is None else frequencies
            matches = (found if allowed is None else allowed(found)).join(F.broadcast(known), "term")
            return _scored(matches, statistics)
        index = postings_of_words(index)
    keys = ["part", "term"] if "part" in index.columns else ["term"]
    vocabulary = terms.select("term", term_part(F.col("term")).alias("part")).distinct()
    used = index.join(vocabulary.select(*keys), keys, "left_semi")
    frequency = term_table(used) if frequencies is None else frequencies
    # A query with a term no chunk has cannot match: it loses that term here and is dropped.
    known = terms.join(frequency, "term")
    rarest = (
        known.groupBy("query_id", "n_terms")
        .agg(F.min(F.struct("df", "term")).alias("_r"), F.count("*").alias("n_known"))
        .filter("n_known = n_terms")
        .select("query_id", "_r.df", "_r.term")
    )
    # Counts that are stored tell how many candidates there will be. If few, they travel to the postings.
    few = frequencies is not None and (rarest.agg(F.sum("df")).first()[0] or 0) <= SENT_CANDIDATES
    sent = F.broadcast if few else lambda df: df
    candidates = used.select("term", "chunk_id", "doc_id").join(sent(rarest.drop("df")), "term").select(
        "query_id", "chunk_id", "doc_id"
    )
    if allowed is not None:
        candidates = allowed(candidates)
    theirs = used.select("chunk_id", "term", "tf", "dl")
    if few:
        theirs = theirs.join(F.broadcast(candidates.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return _scored(candidates.join(known, "query_id").join(theirs, ["chunk_id", "term"]), statistics)


def _scored(matches: DataFrame, statistics: DataFrame) -> DataFrame:
    """BM25 of the chunks with all terms, out of one row per query, chunk and term found."""
    scored = matches.withColumn(
        "_part",
        bm25(
            F.col("tf"), F.col("dl"), F.col("df"),
            statistics.select("n_chunks").scalar(), statistics.select("avg_len").scalar(),
        ),
    )
    return (
        scored.groupBy("query_id", "chunk_id", "doc_id", "n_terms")
        .agg(F.sum("_part").alias("score"), F.count("*").alias("n_found"))
        .filter("n_found = n_terms")
        .select("query_id", "chunk_id", "doc_id", F.round("score", SCORE_DIGITS).alias("score"))
    )


def keyword_search(
    queries: DataFrame,
    index: DataFrame,
    statistics: DataFrame,
    k: int,
    allowed: Callable[[DataFrame], DataFrame] | None = None,
    stop_words: Iterable[str] = tx.ENGLISH_STOP_WORDS,
    stem: Callable[[Column], Column] | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Top k keyword matches per query: rank by score, then chunk id."""
    found = keyword_matches(query_terms(queries, stop_words, stem), index, statistics, allowed, frequencies)
    return rank_per_query(found, k, "chunk_id").withColumn("search_method", F.lit("keyword"))
