"""Documents in parts of a few megabytes that meet shards of hashed content.

Operators that look for repeated content go to and fro between two layouts: *parts* hold whole
documents, *shards* hold everything that has the same hash range. What travels are rows with packed
numpy arrays, one for each pair of part and shard that have something in common. A part is fixed by its
documents' ids and texts, so any task that sees it again (a later pass, or a retry after an executor was
lost) numbers its content alike, and answers can be bits in the order of what was asked; rows without
id or with one id are spread over all parts. All passes read the same exchange of the
documents, which Spark shuffles once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.tables import partitions

#: Text per part. Larger parts mean fewer, longer rows between parts and shards, and more memory: a
#: task holds some fifty bytes for each byte of its part.
PART_BYTES = 3 << 20


def in_parts(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(part, doc_id, text) with NULL text as empty, and the number of parts. Both follow from the
    size of all texts, counted in one scan."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), size // part_bytes + 1)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), n


def documents(table: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes], np.ndarray]:
    """Ids, ids as sortable numbers (NULL first), texts and digests of the texts of a part, by id, then
    by digest."""
    ids, texts = table.column("doc_id").to_pylist(), [t.encode() for t in table.column("text").to_pylist()]
    least = -(1 << 63)
    digests = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts]
    order = sorted(range(len(ids)), key=lambda i: (least if ids[i] is None else ids[i], digests[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    return ids, np.array([least if i is None else i for i in ids], np.int64), texts, np.array([digests[i] for i in order], np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_runs(shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of every run of equal numbers in a sorted list of shards."""
    first = np.flatnonzero(runs(shards))
    return list(zip(shards[first].tolist(), first.tolist(), np.append(first[1:], len(shards)).tolist()))


def arrays(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b or b"", dtype) for b in column.to_pylist()]


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a new value begins in columns sorted together."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by shard, in as many partitions as the session has: shards are dealt by what they cost to
    work on, not by their few bytes, so adaptive execution must not merge them into one task."""
    return rows.repartition(partitions(rows.sparkSession), "shard").groupBy("shard")
