"""Repeated byte strings, from intervals of a Burrows-Wheeler transform.

Where two documents share ``width`` bytes, they share the least hashed gram of those bytes at the
same place. Such anchors cut a text into *contexts*: the run of windows that have the same anchor.
First pass: anchors with a digest of their context meet in shards. Contexts that occur twice are
settled there, whatever their number; an anchor with one context is settled too. What is left are
different contexts of one anchor, at the edges of passages. Second pass: their bytes meet in a shard,
which builds the transform of all of them and extends intervals backwards, breadth first: level by
level this gives the common prefixes of neighbouring suffixes in order of length, and it stops at
``width``, so that exactly the suffixes sharing ``width`` bytes or more are left. Anchors with more
than ``most`` different contexts send a digest for each window instead, counted in shards by digest:
exact as well, and no task sees all contexts of a common line. Third pass: parts drop the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from doclattice.llm.hashing import Block, Ranges, blocks, byte_table, mix
from doclattice.llm.parts import arrays, dealt, documents, in_parts, runs, shard_of, shard_runs
from doclattice.llm.window_dedup import least_places

_U = np.uint64
BLOCK = 2 << 20
#: Bytes for which one transform is built.
TRANSFORM = 1 << 20
REPEATED, SHIP, MANY = 1, 2, 4


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still equal are sorted again."""
    n = len(text)
    wide = np.zeros(n + 4, np.int64)
    wide[:n] = text + 1
    bits = int(wide.max()).bit_length()
    take = max(1, min(4, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(take):
        key = (key << bits) | wide[k : n + k]
    order = np.argsort(key, kind="stable")
    new = runs(key[order])
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    size = np.diff(np.append(start, n))
    live = np.flatnonzero(np.repeat(size > 1, size))  # places in order whose suffixes are not unique
    reach = take
    while len(live):
        suffix = order[live]
        after = np.where(suffix + reach < n, rank[np.minimum(suffix + reach, n - 1)], -1)
        group = rank[suffix]
        by = np.lexsort((after, group))
        suffix, after, group = suffix[by], after[by], group[by]
        order[live] = suffix
        new = runs(group, after)
        begin = np.flatnonzero(new)
        rank[suffix] = live[begin[np.cumsum(new) - 1]]
        size = np.diff(np.append(begin, len(live)))
        live = live[np.repeat(size > 1, size)]
        reach *= 2
    return order


def shared_suffixes(text: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix shares its first ``width`` symbols with another one.

    An interval of the suffix array holds the suffixes that begin with some string; the last-to-first
    map takes it to the intervals of that string with one symbol put before it. Starting from the
    empty string, level by level, an interval whose upper border has no value yet sets it to the
    level (the length of the common prefix at that border) and is extended further.
    """
    n = len(text)
    order = suffix_array(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    last_to_first = place[order - 1]
    symbol = text[order]
    common = np.full(n + 1, -1, np.int32)
    common[0] = common[n] = 0
    begin, end = np.array([0]), np.array([n])
    owner_at = np.full(n, -1, np.int64)
    for level in range(width):
        sizes = end - begin
        total = int(sizes.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(begin)), sizes)
        inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[owner]
        at = last_to_first[inside]
        if total > n // 16:
            owner_at[at] = owner
            at = np.flatnonzero(owner_at >= 0)
            owner = owner_at[at]
            owner_at[at] = -1
        else:
            by = np.argsort(at)
            at, owner = at[by], owner[by]
        first = np.flatnonzero(runs(owner, symbol[at]))
        begin, end = at[first], at[np.append(first[1:], len(at)) - 1] + 1
        fresh = common[end] < 0
        begin, end = begin[fresh], end[fresh]
        common[end] = level
    long = np.flatnonzero(common[1:n] < 0) + 1
    out = np.zeros(n, bool)
    out[order[long]] = out[order[long - 1]] = True
    return out


def repeated_in(contexts: list[bytes], width: int) -> list[np.ndarray]:
    """For each context, which of its windows occur again in any of them, itself included."""
    n = len(contexts)
    text = np.concatenate([np.append(np.frombuffer(c, np.uint8).astype(np.int64) + n, i) for i, c in enumerate(contexts)])
    shared = shared_suffixes(text, width)
    end = np.cumsum([len(c) + 1 for c in contexts])
    return [shared[e - len(c) - 1 : max(e - width, e - len(c) - 1)] for e, c in zip(end, contexts)]


def anchors(block: Block, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window start, gram hash and context digest (64 and 32 bits) of every anchor."""
    n = len(block.data)
    starts = np.arange(max(0, n - width + 1))
    of = np.repeat(np.arange(block.n), block.text_length + 1)[:n]  # a text owns the feed behind it
    fits = block.text_start[of[starts]] + block.text_length[of[starts]] >= starts + width
    starts = starts[fits]
    if not len(starts):
        return (starts, starts, np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.uint32))
    first_hash = Ranges(block.byte_values(), 0)
    every = np.arange(n - gram + 1)
    grams = mix(first_hash(every, every + gram))
    place = least_places(grams, width - gram + 1)[starts]
    new = np.flatnonzero(runs(place) | np.append(True, starts[1:] != starts[:-1] + 1))
    low, high = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    at = place[new]
    salt = mix(((at - low).astype(_U) << _U(32)) + (high - low).astype(_U))
    wide = mix(first_hash(low, high + width) ^ salt)
    narrow = mix(Ranges(block.byte_values(1), 1)(low, high + width) + salt) >> _U(32)
    # Least hashes are small numbers: mixed again, they spread evenly over the shards.
    return low, high, mix(grams[at] + _U(1)), wide, narrow.astype(np.uint32)


class Anchors:
    """All anchors of a part: those that are equal in gram and context asked about once."""

    def __init__(self, texts: list[bytes], width: int, gram: int, shards: int):
        found, offset = [], 0
        for begin, end in blocks(texts, BLOCK):
            block = Block(texts[begin:end])
            low, high, *keys = anchors(block, width, gram)
            found.append((low + offset, high + offset, *keys))
            offset += len(block.data) + 1
        self.low, self.high, self.gram, self.wide, self.narrow = (np.concatenate(c) for c in zip(*found))
        self.order = np.lexsort((self.narrow, self.wide, self.gram))
        new = runs(self.gram[self.order], self.wide[self.order], self.narrow[self.order]) if len(self.order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.value = np.cumsum(new) - 1
        self.first = self.order[first]
        self.several = np.diff(np.append(first, len(self.order))) > 1
        self.runs = shard_runs(shard_of(self.gram[self.first], shards))


def settled(docs: DataFrame, shards: int, width: int, gram: int, most: int) -> DataFrame:
    """(part, shard, states): one byte for each distinct anchor and context that a part asked about."""

    def ask(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = Anchors(documents(table)[2], width, gram, shards)
        full = [s for s, _, _ in own.runs]
        pick = [own.first[a:b] for _, a, b in own.runs]
        column = lambda values: pa.array([values[p].tobytes() for p in pick], pa.binary())
        return pa.table({
            "shard": pa.array(full, pa.int32()), "part": pa.array([part] * len(full), pa.int32()),
            "gram": column(own.gram), "wide": column(own.wide), "narrow": column(own.narrow),
            "several": pa.array([own.several[a:b].tobytes() for _, a, b in own.runs], pa.binary()),
        })

    def merge(table: pa.Table) -> pa.Table:
        gram, wide = (np.concatenate(arrays(table.column(c), _U)) for c in ("gram", "wide"))
        narrow = np.concatenate(arrays(table.column("narrow"), "<u4"))
        several = arrays(table.column("several"), bool)
        cut = np.cumsum([0, *map(len, several)])
        row = np.repeat(np.array(table.column("part").to_pylist()), np.diff(cut))
        order = np.lexsort((row, narrow, wide, gram))
        context = runs(gram[order], wide[order], narrow[order])
        number = np.cumsum(context) - 1
        held = np.bincount(number, 1 + np.concatenate(several)[order])
        anchor = runs(gram[order])
        contexts = np.bincount(np.cumsum(anchor) - 1, context)[np.cumsum(anchor) - 1]
        again = held[number] > 1
        state = again * REPEATED + (context & (contexts > 1)) * SHIP + (contexts > most) * MANY
        out = np.empty(len(order), np.uint8)
        out[order] = state
        return pa.table({"part": table.column("part"), "shard": table.column("shard"),
                         "states": pa.array([out[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    sent = docs.groupBy("part").applyInArrow(ask, "shard int, part int, gram binary, wide binary, narrow binary, several binary")
    return dealt(sent).applyInArrow(merge, "part int, shard int, states binary")


def united(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching ranges as one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin))[: len(first)] - 1] if len(first) else end


def packed(begin: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([begin, end], axis=1).astype("<u4").tobytes()


_COLUMNS = ("spans", "gram", "at", "sizes", "bytes", "wide", "narrow")


def repeated(docs: DataFrame, states: DataFrame, shards: int, width: int, gram: int) -> DataFrame:
    """(part, spans): ranges of bytes of a part's joined texts that are covered by repeated windows."""

    def ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        part = table.column("part")[0].as_py() if len(table) else None
        texts = documents(table)[2]
        own = Anchors(texts, width, gram, shards)
        state = np.zeros(len(own.first), np.uint8)
        place = {s: (a, b) for s, a, b in own.runs}
        for s, states in zip(replies.column("shard").to_pylist(), arrays(replies.column("states"), np.uint8)):
            state[slice(*place[s])] = states
        again = np.zeros(len(own.order), bool)
        again[own.order] = ((state & REPEATED) > 0)[own.value]
        if again.any():
            rows.append((part % shards, packed(*united(own.low[again], own.high[again] + width)), b"", b"", b"", b"", b"", b""))
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        raw = data.tobytes()
        ship = own.first[((state & SHIP) > 0) & ((state & MANY) == 0)]
        ship = ship[np.argsort(own.gram[ship], kind="stable")]
        for s, a, b in shard_runs(shard_of(own.gram[ship], shards)):
            pick = ship[a:b]
            low, high = own.low[pick], own.high[pick] + width
            rows.append((s, b"", own.gram[pick].tobytes(), low.astype("<u4").tobytes(), (high - low).astype("<u4").tobytes(),
                         b"".join([raw[x:y] for x, y in zip(low.tolist(), high.tolist())]), b"", b""))
        many = own.first[((state & SHIP) > 0) & ((state & MANY) > 0)]
        if len(many):
            count = own.high[many] - own.low[many] + 1
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(own.low[many], count)
            wide = mix(Ranges(byte_table(0)[data], 0)(at, at + width))
            narrow = (mix(Ranges(byte_table(1)[data], 1)(at, at + width)) >> _U(32)).astype("<u4")
            order = np.argsort(wide, kind="stable")
            at, wide, narrow = at[order], wide[order], narrow[order]
            for s, a, b in shard_runs(shard_of(wide, shards)):
                rows.append((s, b"", b"", at[a:b].astype("<u4").tobytes(), b"", b"", wide[a:b].tobytes(), narrow[a:b].tobytes()))
        columns = list(zip(*rows)) or [()] * 8
        return pa.table({"shard": pa.array(columns[0], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()),
                         **{c: pa.array(v, pa.binary()) for c, v in zip(_COLUMNS, columns[1:])}})

    def find(table: pa.Table) -> pa.Table:
        part = np.array(table.column("part").to_pylist())
        back: list[tuple[int, bytes]] = [(p, s) for p, s in zip(part.tolist(), table.column("spans").to_pylist()) if s]
        sizes, at = arrays(table.column("sizes"), "<u4"), arrays(table.column("at"), "<u4")
        hits: list[tuple[np.ndarray, np.ndarray]] = []  # parts, window starts

        # Contexts by anchor; whole anchors are gathered up to the size of a transform.
        gram = np.concatenate(arrays(table.column("gram"), _U))
        held = [i for i, s in enumerate(sizes) if len(s)]
        if held:
            size = np.concatenate([sizes[i] for i in held]).astype(np.int64)
            start = np.concatenate([at[i] for i in held]).astype(np.int64)
            of = np.repeat(part[held], [len(sizes[i]) for i in held])
            raw = b"".join(table.column("bytes").to_pylist())
            end = np.cumsum(size)
            order = np.argsort(gram, kind="stable")
            new = runs(gram[order])
            room = np.cumsum(size[order]) // TRANSFORM
            group = np.maximum.accumulate(np.where(new, room, 0))
            for pick in np.split(order, np.flatnonzero(np.diff(group)) + 1):
                found = repeated_in([raw[end[i] - size[i]:end[i]] for i in pick.tolist()], width)
                own = np.repeat(pick, [len(f) for f in found])
                inner = np.concatenate([np.arange(len(f)) for f in found])
                mask = np.concatenate(found)
                hits.append((of[own[mask]], start[own[mask]] + inner[mask]))

        wide, narrow = np.concatenate(arrays(table.column("wide"), _U)), np.concatenate(arrays(table.column("narrow"), "<u4"))
        if len(wide):
            held = [i for i, (s, a) in enumerate(zip(sizes, at)) if len(a) and not len(s)]
            start = np.concatenate([at[i] for i in held]).astype(np.int64)
            of = np.repeat(part[held], [len(at[i]) for i in held])
            order = np.lexsort((narrow, wide))
            new = runs(wide[order], narrow[order])
            twice = ~new | np.append(~new[1:], False)
            hits.append((of[order[twice]], start[order[twice]]))

        if hits:
            of, start = (np.concatenate(c) for c in zip(*hits))
            order = np.lexsort((start, of))
            of, start = of[order], start[order]
            for pick in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if len(pick):
                    back.append((int(of[pick[0]]), packed(*united(start[pick], start[pick] + width))))
        return pa.table({"part": pa.array([b[0] for b in back], pa.int32()), "spans": pa.array([b[1] for b in back], pa.binary())})

    sent = docs.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(
        ask, "shard int, part int, " + ", ".join(f"{c} binary" for c in _COLUMNS))
    return dealt(sent).applyInArrow(find, "part int, spans binary")


def remove_repeats(docs: DataFrame, width: int = 200, gram: int = 100, most: int = 256, part_bytes: int | None = None,
                   content: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Each UTF-8 byte covered by a ``width``-byte string that also starts anywhere else, in any
    document, is removed; all occurrences go, and strings are judged on the input. NULL and empty
    texts have no bytes. Rows that share a doc_id are documents of their own, so equal ones remove
    each other. Other columns are ignored.
    """
    docs, shards = in_parts(docs, part_bytes) if part_bytes else in_parts(docs)
    found = repeated(docs, settled(docs, shards, width, gram, most), shards, width, gram)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, _, texts, _ = documents(table)
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        border = np.zeros(len(data) + 1, np.int32)
        for s in arrays(replies.column("spans"), "<u4"):
            np.add.at(border, s[::2], 1)
            np.add.at(border, s[1::2], -1)
        gone = np.cumsum(border[:-1]) > 0
        length = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(length + 1) - 1
        total = np.concatenate([[0], np.cumsum(gone)])
        edge = np.concatenate([[0], np.cumsum(gone & ~np.append(False, gone[:-1])[: len(gone)])])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip((end - length).tolist(), end.tolist())]
        out = {
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(length), "n_removed": pa.array(total[end] - total[end - length]),
            "n_spans": pa.array(edge[end] - edge[end - length]),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if content:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * content
    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(finish, schema)
