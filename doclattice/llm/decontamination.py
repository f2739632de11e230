"""Benchmark passages in training texts, found by spaced seeds.

Only DataFrame functions. A seed hashes the words at the fixed places of a mask and ignores the
others, so a substituted word does not hide a passage. Seeds of all benchmark items and of all
positions of all texts are joined; each hit proposes an alignment (document, item, shift), along which
the best run of words is scored, +1 for an equal word and -2 for another one.

The seeds of a benchmark of up to ``BROADCAST_SEEDS`` (checked) travel to the texts, whose own seeds
then never leave their task; those of a larger benchmark are joined by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.functions.rows import unnest
from doclattice.llm.tables import text_or_empty, written

#: Places of the words of a seed: 111.1..1..1, 1111..1.1, 111.111 and 111.1..11. A run that overlaps()
#: accepts has a positive score (+1, MISMATCH) up to and from each of its words; every such run of an
#: item of SPAN words or more holds one of these (a test lists the runs).
MASKS = ((0, 1, 2, 4, 7, 10), (0, 1, 2, 3, 6, 8), (0, 1, 2, 4, 5, 6), (0, 1, 2, 4, 7, 8))
SPAN = 8
#: The same for shorter items, by their words: with so few words at most one of seven may differ.
SHORT_MASKS = {1: (0,), 2: (0, 1), 3: (0, 1, 2), 4: (0, 1, 2, 3), 5: (0, 1, 2, 3), 6: (0, 1, 2, 3, 4), 7: (0, 1, 2, 4, 5)}
#: Most seeds (16 bytes each) that are sent to every task.
BROADCAST_SEEDS = 1_000_000
#: A run of so many equal words is an overlap; for shorter items this share of their words.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
MISMATCH = -2


def word_hashes(text: Column) -> Column:
    """Letters and digits in a row, lower-cased, as array<long>."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def hash_of_text(text: str | Column = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def masks_of(n: int) -> dict[int, tuple[int, ...]]:
    """The masks, by number, of items of ``n`` words; SPAN stands for all longer ones."""
    return dict(enumerate(MASKS)) if n >= SPAN else {-n: SHORT_MASKS[n]}


def seeds_at(words: Column, at: Column, masks: dict[int, tuple[int, ...]]) -> Column:
    """Hashes of the words of each mask that starts at the 0-based place ``at``; past the end of the
    words NULL, which no item has."""
    return F.array(*(
        F.when(at + places[-1] < F.size(words), F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i in places)))
        for mask, places in masks.items()))


def seeds(rows: DataFrame, key: list[str], masks: dict[int, tuple[int, ...]]) -> DataFrame:
    """(*key, hash, place): the seeds at all places (0-based) of all rows (*key, words). Words become
    rows first, so hashing runs in generated code and not in a lambda."""
    at_all = unnest(rows, [*key, "words"], F.col("words"), "place", "_word")
    hashed = unnest(at_all, [*key, "place"], seeds_at(F.col("words"), F.col("place"), masks), "_mask", "hash")
    return hashed.filter(F.col("hash").isNotNull()).select(*key, "hash", "place")


def item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(hash, item, at): seeds of all items (item, words), whose words, up to SPAN, number ``lengths``."""
    n = F.least(F.size("words"), F.lit(SPAN))
    parts = [seeds(items.filter(n == k), ["item"], masks_of(k)) for k in lengths]
    return reduce(DataFrame.unionByName, parts).select("hash", "item", F.col("place").alias("at"))


def text_seeds(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, hashed, hash, place): the seeds at all places of all texts (doc_id, hashed, words)."""
    return seeds(texts, ["doc_id", "hashed"], {m: places for n in lengths for m, places in masks_of(n).items()})


def best_run(words: Column, item: Column, shift: Column) -> Column:
    """Struct (words, first, last) of the best-scoring run along a shift (text place minus item
    place): its equal words, and its first and last place in the text (1-based)."""
    begin = F.greatest(F.lit(1), 1 - shift)
    n = F.greatest(F.lit(0), F.least(F.size(item), F.size(words) - shift) - begin + 1)
    begin = F.least(begin, F.size(item))
    equal = F.zip_with(F.slice(words, F.greatest(F.lit(1), begin + shift), n), F.slice(item, begin, n), lambda a, b: a == b)
    zero = F.lit(0)
    start = F.struct(*(zero.alias(c) for c in ("at", "score", "same", "first", "top", "words", "from", "to")))

    def step(s: Column, hit: Column) -> Column:
        fresh = s["score"] <= 0
        score = F.when(hit, F.when(fresh, 1).otherwise(s["score"] + 1)).otherwise(s["score"] + MISMATCH)
        same = F.when(hit, F.when(fresh, 1).otherwise(s["same"] + 1)).otherwise(s["same"])
        first = F.when(hit & fresh, s["at"]).otherwise(s["first"])
        better = hit & (score > s["top"])
        keep = lambda new, old: F.when(better, new).otherwise(s[old]).alias(old)
        return F.struct((s["at"] + 1).alias("at"), score.alias("score"), same.alias("same"), first.alias("first"),
                        keep(score, "top"), keep(same, "words"), keep(first, "from"), keep(s["at"], "to"))

    at = begin + shift
    return F.aggregate(equal, start, step, lambda s: F.struct(
        s["words"].alias("words"), (s["from"] + at).alias("first"), (s["to"] + at).alias("last")))


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, hashed, item_id, run): benchmark items along every shift by which a text contains them.
    A text is known by its doc_id and hash, so rows that share an id, or have none, keep their own."""
    items = benchmark.select("item_id", word_hashes(text_or_empty("text")).alias("words"))
    items = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "words").filter(F.size("words") > 0), "benchmark-words")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).distinct().collect()] or [SPAN]  # <= SPAN rows
    wanted = written(item_seeds(items, lengths), "benchmark-seeds")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_SEEDS else wanted
    texts = docs.select("doc_id", hash_of_text().alias("hashed"), word_hashes(text_or_empty("text")).alias("words"))
    shifts = (
        text_seeds(texts, lengths).join(wanted, "hash")
        .select("doc_id", "hashed", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    )
    shifts = written(shifts, "alignments").join(items.withColumnRenamed("words", "wanted"), "item")
    shifts = shifts.withColumnsRenamed({"doc_id": "_doc", "hashed": "_hashed"})
    n = F.size("wanted")
    whole = docs.select("doc_id", hash_of_text().alias("hashed"), text_or_empty("text").alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hashed") == F.col("hashed"))
    return (
        # Texts are joined as they are: only those with an alignment are cut into words again.
        shifts.join(whole, same)
        .withColumn("words", word_hashes(F.col("_text")))
        .select("doc_id", "hashed", "item_id", n.alias("n"), best_run(F.col("words"), F.col("wanted"), F.col("shift")).alias("run"))
        .filter(F.col("run.words") >= F.least(F.lit(LEAST_WORDS), F.ceil(F.col("n") * LEAST_SHARE)))
        .drop("n")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, first_word, last_word): benchmark items that texts contain.

    An item is contained if along some shift a run has LEAST_WORDS equal words, or LEAST_SHARE of the
    words of a shorter item. One row for each doc_id and item_id, of its longest run. NULL and empty
    texts and items contain nothing and are in nothing. Of benchmark rows that share an item_id each
    counts; rows that share a doc_id (NULL included) have their texts looked at one by one and give
    one row for each item that any of them contains.
    """
    return (
        contained(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
        .select("doc_id", "item_id", F.col("run.words").cast("long").alias("n_words"),
                F.col("run.first").cast("long").alias("first_word"), F.col("run.last").cast("long").alias("last_word"))
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less those whose text overlaps with the benchmark. Rows are
    known by doc_id and text together: of rows that share a doc_id, or have none, only those with an
    overlap of their own go."""
    found = contained(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("hashed").alias("_hashed")).distinct()
    found = written(found, "contaminated")
    same = docs["doc_id"].eqNullSafe(found["_doc"]) & (hash_of_text(docs["text"]) == found["_hashed"])
    return docs.join(found, same, "left_anti")
