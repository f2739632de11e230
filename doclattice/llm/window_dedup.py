"""Repeated word windows: a count-min sketch sifts, a second pass groups exactly.

First pass: every window of ``width`` words is represented by its anchor, the least hashed word
n-gram inside it (equal windows have equal anchors at equal places, so an anchor is met at least as
often as each of its windows). Every part counts its anchors in a count-min sketch of its own, ``ROWS``
rows of counters, and sends the counters that are not zero. A shard holds a range of each row and adds
the sketches of all parts; the estimate of an anchor is the least of its counters and never too small.
Parts get one bit for each counter they sent: whether it passed one.

Second pass: only windows whose anchor was estimated to be repeated send their exact digest (96 bits)
to a shard that groups equal ones; all but the first occurrence are reported back. Third pass: parts
drop the covered words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from doclattice.llm.hashing import Block, mix, window_hashes
from doclattice.llm.parts import arrays, dealt, documents, in_parts, runs, shard_of, shard_runs

_U = np.uint64
ROWS = 2  # rows of counters in a sketch
#: Counters of a row that one shard holds: some ten for each anchor of a part's size of text.
CELLS = 1 << 20


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of values[i : i + width], for every i."""
    at = np.arange(len(values))
    have = 1
    while have < width:
        shift = min(have, width - have)
        right = values[shift:] < values[:-shift]
        at = np.where(right, at[shift:], at[:-shift])
        values = np.where(right, values[shift:], values[:-shift])
        have += shift
    return at


def anchors(block: Block, hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the number of each window's anchor, and the anchors' hashes."""
    starts = block.windows(width)
    if not len(starts):
        return starts, starts, np.zeros(0, _U)
    grams = window_hashes(hashes, np.arange(len(hashes) - gram + 1), gram)
    place = least_places(grams, width - gram + 1)[starts]
    new = runs(place)
    # Least hashes are small numbers: mixed again, they spread evenly over counters and shards.
    return starts, np.cumsum(new) - 1, mix(grams[place[new]] + _U(1))


def partial_sketch(found: np.ndarray, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: the counters that anchors fall on (shard, then place in its range), how many
    anchors fall on each, and which of them each anchor falls on."""
    out = []
    for row in range(ROWS):
        slot = mix(found + _U(row) * _U(0x9E3779B97F4A7C15))
        cell = shard_of(slot, shards) * CELLS + (slot & _U(CELLS - 1)).astype(np.int64)
        cells, which, counts = np.unique(cell, return_inverse=True, return_counts=True)
        out.append((cells, counts, which))
    return out


def sketched(docs: DataFrame, shards: int, width: int, gram: int) -> DataFrame:
    """(part, shard, row, bits): for each counter of a part's sketch, whether all parts together pass one."""

    def ask(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        block = Block(documents(table)[2])
        block.split_words()
        _, _, found = anchors(block, block.word_hashes(), width, gram)
        rows = []
        for row, (cells, counts, _) in enumerate(partial_sketch(found, shards)):
            place, few = (cells % CELLS).astype("<u4"), np.minimum(counts, 255).astype(np.uint8)
            rows += [(s, part, row, place[a:b].tobytes(), few[a:b].tobytes()) for s, a, b in shard_runs(cells // CELLS)]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("shard", "part", "row", "cells", "counts"), columns, kinds)})

    def merge(table: pa.Table) -> pa.Table:
        cells, counts, rows = arrays(table.column("cells"), "<u4"), arrays(table.column("counts"), np.uint8), table.column("row").to_pylist()
        total = np.zeros((ROWS, CELLS), np.int32)
        for row, place, n in zip(rows, cells, counts):
            total[row, place] += n  # a part names a counter once
        bits = [np.packbits(total[row, place] > 1).tobytes() for row, place in zip(rows, cells)]
        return pa.table({**{c: table.column(c) for c in ("part", "shard", "row")}, "bits": pa.array(bits, pa.binary())})

    sent = docs.groupBy("part").applyInArrow(ask, "shard int, part int, row int, cells binary, counts binary")
    return dealt(sent).applyInArrow(merge, "part int, shard int, row int, bits binary")


def repeated(docs: DataFrame, marks: DataFrame, shards: int, width: int, gram: int) -> DataFrame:
    """(part, starts): windows, as word numbers within the part, that also start earlier."""

    def ask(table: pa.Table, bits: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() if len(table) else None
        _, keys, texts, digests = documents(table)
        block = Block(texts)
        block.split_words()
        words = block.word_hashes()
        starts, anchor, found = anchors(block, words, width, gram)
        replies = {(r, s): b for r, s, b in zip(bits.column("row").to_pylist(), bits.column("shard").to_pylist(), arrays(bits.column("bits"), np.uint8))}
        hot = np.ones(len(found), bool)
        for row, (cells, _, which) in enumerate(partial_sketch(found, shards)):
            flags = np.zeros(len(cells), bool)
            for s, a, b in shard_runs(cells // CELLS):
                flags[a:b] = np.unpackbits(replies[row, s], count=b - a)
            hot &= flags[which]
        starts = starts[hot[anchor]] if len(starts) else starts

        high = window_hashes(words, starts, width)
        low = (window_hashes(block.word_hashes(1), starts, width, 1) >> _U(32)).astype("<u4")
        order = np.lexsort((low, high))
        new = runs(high[order], low[order])
        first = np.sort(order[new]) if len(order) else order
        mine = np.zeros(len(order), bool)
        mine[first] = True
        local = starts[~mine].astype("<u4")
        out = {"shard": [part % shards] if len(local) else [], "high": [b""] * bool(len(local)), "low": [b""] * bool(len(local)),
               "starts": [local.tobytes()] if len(local) else [], **{c: [b""] * bool(len(local)) for c in ("ids", "ties", "counts")}}
        goes = shard_of(high[first], shards)
        by = np.argsort(goes, kind="stable")
        of = block.word_text[starts[first]] if len(first) else first
        for s, a, b in shard_runs(goes[by]):
            pick = by[a:b]
            ids, counts = np.unique(of[pick], return_counts=True)
            out["shard"].append(s)
            out["high"].append(high[first[pick]].tobytes())
            out["low"].append(low[first[pick]].tobytes())
            out["starts"].append(starts[first[pick]].astype("<u4").tobytes())
            out["ids"].append(keys[ids].tobytes())
            out["ties"].append(digests[ids].tobytes())
            out["counts"].append(counts.astype("<u4").tobytes())
        n = len(out["shard"])
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "part": pa.array([part] * n, pa.int32()),
                         **{c: pa.array(out[c], pa.binary()) for c in ("high", "low", "starts", "ids", "ties", "counts")}})

    def group(table: pa.Table) -> pa.Table:
        starts = arrays(table.column("starts"), "<u4")
        high, low = arrays(table.column("high"), _U), arrays(table.column("low"), "<u4")
        counts = arrays(table.column("counts"), "<u4")
        doc, tie = (np.concatenate([np.repeat(i, c) for i, c in zip(arrays(table.column(name), kind), counts)]) for name, kind in (("ids", np.int64), ("ties", _U)))
        row = np.repeat(np.arange(len(high)), [len(h) for h in high])
        high, low = np.concatenate(high), np.concatenate(low)
        order = np.lexsort((tie, doc, low, high))
        later = np.zeros(len(order), bool)
        later[order] = ~runs(high[order], low[order]) if len(order) else later
        cut = np.searchsorted(row, np.arange(len(starts) + 1))
        # A row without digests holds what its part settled alone; it goes back as it is.
        back = [s[later[a:b]].tobytes() if b > a else s.tobytes() for s, a, b in zip(starts, cut, cut[1:])]
        keep = [i for i, b in enumerate(back) if b]
        return pa.table({"part": table.column("part").take(pa.array(keep, pa.int64())), "starts": pa.array([back[i] for i in keep], pa.binary())})

    sent = docs.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(
        ask, "shard int, part int, high binary, low binary, starts binary, ids binary, ties binary, counts binary")
    return dealt(sent).applyInArrow(group, "part int, starts binary")


def keep_words(block: Block, keep: np.ndarray) -> list[memoryview]:
    """The kept words of each text, joined by one space."""
    data = np.append(block.data, np.uint8(10)).copy()
    data[block.word_end] = 32
    border = np.zeros(len(data) + 1, np.int8)
    border[block.word_start[keep]] += 1
    np.add.at(border, block.word_end[keep] + 1, -1)
    out = data[np.cumsum(border[:-1], dtype=np.int8) > 0]
    size = np.bincount(block.word_text[keep], block.word_end[keep] - block.word_start[keep] + 1, block.n).astype(np.int64)
    end = np.cumsum(size)
    view = memoryview(out.tobytes())
    return [view[e - n : max(e - 1, e - n)] for e, n in zip(end.tolist(), size.tolist())]


def remove_repeats(docs: DataFrame, width: int = 20, gram: int = 10, part_bytes: int | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII blanks, unchanged. Each word covered by a ``width``-word
    window that also starts earlier (smaller doc_id, or earlier in the same document) is removed;
    windows are judged on the input. NULL and empty texts have no words. Rows that share a doc_id
    count as one document after another, by a digest of their text; NULL ids come first. Other columns are ignored.
    """
    docs, shards = in_parts(docs, part_bytes) if part_bytes else in_parts(docs)
    marks = sketched(docs, shards, width, gram)
    later = repeated(docs, marks, shards, width, gram)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, _, own, _ = documents(table)
        block = Block(own)
        block.split_words()
        cover = np.zeros(len(block.word_text) + width + 1, np.int32)
        for s in arrays(replies.column("starts"), "<u4"):
            cover[s] += 1  # a window is reported once
            cover[s.astype(np.int64) + width] -= 1
        keep = np.cumsum(cover[: len(block.word_text)]) == 0
        kept = keep_words(block, keep)
        removed = np.bincount(block.word_text[~keep], minlength=block.n)
        out = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(block.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
               "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if texts:
            out["kept_text"] = pa.array([bytes(k).decode() for k in kept], pa.string())
        return pa.table(out)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return docs.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(finish, schema)
