"""Best-fit packing of token sequences.

Texts are cut into pieces of at most ``width`` tokens. Lengths are whole numbers up to ``width``, so
best-fit decreasing needs only how many pieces there are of each length: pieces of one length are
placed in the tightest open bins, all alike bins at once. A segment tree over remaining capacities
finds the tightest bin in logarithmic time. The plan is a small table of runs (length, first rank,
last rank, first bin, offset); every piece finds its place from its rank among equal lengths, which is
counted in parts, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from doclattice.llm.tables import partitions, written

END_OF_TEXT = 2


class OpenBins:
    """Segment tree over remaining capacities 0..width: which of them have open bins."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, present: bool) -> None:
        at = self.size + capacity
        self.any[at] = present
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has open bins."""
        at = self.size + least
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Plan:
    """Runs sorted by (length, first rank): ranks from ``first`` on go to bins from ``bin`` on, one
    piece each, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Ranks stay far below 2**52 and lengths below 2**11, so the pair is one sortable number.
        run = np.searchsorted(self._key(self.length, self.first), self._key(length, rank), "right") - 1
        return self.bin[run] + rank - self.first[run], self.offset[run]

    @staticmethod
    def _key(length, rank):
        return (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64)


def best_fit_decreasing(counts: dict[int, int], width: int) -> Plan:
    """Plan for ``counts[length]`` pieces of each length. Work and plan size depend on the number of
    distinct lengths (at most ``width``), not on the number of pieces."""
    tree = OpenBins(width)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # capacity -> runs (first bin, bins)
    runs, n_bins = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        open_bins.setdefault(capacity, []).append((first, n))
        tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                # No open bin fits: each new bin takes this length as often as it can hold it.
                each = width // length
                for held, n in ((each, left // each), (left % each, 1)):
                    if held and n:
                        for slot in range(held):
                            runs.append((length, rank, n_bins, slot * length))
                            rank += n
                        add(width - held * length, n_bins, n)
                        n_bins += n
                break
            first, n = open_bins[capacity].pop()
            if not open_bins[capacity]:
                tree.set(capacity, False)
            take = min(n, left)
            runs.append((length, rank, first, width - capacity))
            rank, left = rank + take, left - take
            add(capacity - length, first, take)
            if take < n:
                add(capacity, first + take, n - take)
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(*table.T, n_bins)


def tokenizer(ranks_file: str, pattern: str, special: dict[str, int]):
    import base64

    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encoder(ranks_file: str, pattern: str, special: dict[str, int]):
    """text -> ids, whatever the text. The regex engine of the fast library gives up on very long runs
    (a million blanks); such texts are encoded by the tokenizer file that lies beside the ranks."""
    fast, allowed, whole = tokenizer(ranks_file, pattern, special), set(special), None

    def encode(text: str) -> list[int]:
        nonlocal whole
        try:
            return fast.encode(text, allowed_special=allowed, disallowed_special=())
        except ValueError:
            if whole is None:
                from tokenizers import Tokenizer

                whole = Tokenizer.from_file(f"{ranks_file.removesuffix('.tiktoken')}.json")
            return whole.encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, ranks_file: str, pattern: str, special: dict[str, int] | None = None, width: int = 1024,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all texts.

    A text is its ids and an end mark; NULL is empty, so every row gives at least one piece. Only
    texts over ``width`` are cut; the first piece takes what does not fill a whole one. Strings of
    special tokens in a text become their ids, as the tokenizer file has it. Rows that share a
    doc_id, or have none, are packed like any other.
    """
    special = special or {}

    def run(batches):
        encode = encoder(ranks_file, pattern, special)
        for batch in batches:
            out = []
            ids_of = batch.column(0).to_pylist()
            for doc_id, text in zip(ids_of, batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), END_OF_TEXT], "<u4")
                cuts = [0, *range(len(ids) % width or width, len(ids) + 1, width)] if len(ids) > width else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    raw = ids[a:b].tobytes()
                    out.append((doc_id, k, a, b - a, zlib.crc32(raw), ids[a:b] if with_ids else None))
            columns = list(zip(*out)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            n = 6 if with_ids else 5
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns[:n], kinds[:n])], names[:n])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(cut: DataFrame, width: int = 1024, parts: int | None = None) -> DataFrame:
    """``cut`` (with length and any other columns) and sequence_id, offset.

    Ranks among equal lengths are counted in ``parts`` per length (at least 256): each part numbers its own rows and
    adds the count of the parts before it, so the most common length is no hot key.
    """
    parts = parts or max(256, partitions(cut.sparkSession))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64(*[c for c in cut.columns if c != "ids"]), F.lit(parts)).cast("int"))
    cut = written(cut, "pieces")
    sizes = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = written(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= width rows
    plan = best_fit_decreasing(counts, width)
    order = [c for c in cut.columns if c not in ("length", "_part", "ids")]
    ranked = cut.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_part").orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(sizes.drop("n"), ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("before"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            places, offsets = plan.place(batch.column(at("length")).to_numpy(), batch.column(at("_rank")).to_numpy())
            kept = [n for n in batch.schema.names if n not in ("_rank",)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in kept), pa.array(places), pa.array(offsets)], [*kept, "sequence_id", "offset"])

    ranked = ranked.drop("_part", "before")
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("_rank").dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
