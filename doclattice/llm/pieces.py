"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised by the model's compiled character map, a double-array trie with replacements:
at each place the longest key that is a prefix of the rest is replaced, a character without one stays
as it is. All places of a block of texts walk the trie together, and each normalised character keeps
the byte offset of the source it came from, so a piece of the normalised text is projected on original
bytes by two lookups. A model without a map changes nothing but blanks.

Pieces are merged by falling score. No merge can cross two neighbouring characters that stand side by
side in no piece of the vocabulary, so the text is cut there first. Segments that a task has not met
yet are merged side by side, one pair of each in every round; those it knows become ids and spans by
one gather.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.llm.hashing import encoded, mix, range_sums

#: Text worked on at once; arrays take some fifty bytes for each byte of it.
BLOCK = 1 << 20
#: Segments and pieces that a task remembers before it begins anew.
SEGMENTS, PIECES = 1 << 19, 1 << 21
#: Segments up to this length are merged side by side in arrays, longer ones one by one with a heap.
SHORT = 64
_NEVER = 1 << 60
_SYMBOL_BITS = 21  # ids and code points both fit
_SPACE, _MARK = 0x20, 0x2581
_BIGRAM_BITS = 22
# Fixed values of the model format: piece kinds, the kind of model, and field numbers.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at:at + size]
            at += size


def codes_of(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(texts).decode().encode("utf-32-le"), np.uint32)


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, its values places of replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4:4 + size], "<u4").astype(np.int64)
        self.strings = compiled[4 + size:]
        self.places: dict[int, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __bool__(self) -> bool:
        return len(self.units) > 0

    @staticmethod
    def _child(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the longest key at each start (0: none) and its value; keys end by ``stops``."""
        size, value = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
        alive = np.arange(len(starts))
        node = np.full(len(starts), int(self._child(self.units[:1])[0]), np.int64)
        depth = 0
        while len(alive):
            place = starts[alive] + depth
            inside = place < stops[alive]
            alive, node, place = alive[inside], node[inside], place[inside]
            byte = data[place].astype(np.int64)
            node = node ^ byte
            known = node < len(self.units)
            alive, node, byte = alive[known], node[known], byte[known]
            unit = self.units[node]
            here = (unit & 0x800000FF) == byte
            alive, node, unit = alive[here], node[here], unit[here]
            depth += 1
            node = node ^ self._child(unit)
            ends = (unit >> 8) & 1 == 1
            size[alive[ends]] = depth
            value[alive[ends]] = self.units[node[ends]] & 0x7FFFFFFF
        return size, value

    def replacements(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin in ``pool`` and length of the replacement of each value."""
        kinds, which = np.unique(values, return_inverse=True)
        new = [v for v in kinds.tolist() if v not in self.places]
        if new:
            strings = [self.strings[v:self.strings.index(b"\0", v)] for v in new]
            lengths = np.array([len(s.decode()) for s in strings], np.int64)
            for k, v in enumerate(new):
                self.places[v] = len(self.begin) + k
            self.begin = np.append(self.begin, len(self.pool) + np.cumsum(lengths) - lengths)
            self.length = np.append(self.length, lengths)
            self.pool = np.append(self.pool, codes_of(strings))
        row = np.array([self.places[v] for v in kinds.tolist()], np.int64)[which]
        return self.begin[row], self.length[row]


class Normalizer:
    """Normalised code points of texts, each with the byte offset of its source."""

    def __init__(self, spec: bytes, blanks_last: bool = False):
        own = dict(_message(spec))
        self.map = CharacterMap(own.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if blanks_last:
            raise ValueError("models that put blanks last are not supported")

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, origin, cut): text i has codes[cut[i]:cut[i + 1]]; origin holds one entry more for
        each text (its end), so those of text i begin at cut[i] + i."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        start = np.flatnonzero((data & 0xC0) != 0x80)
        codes = codes_of(texts)
        owner = np.repeat(np.arange(len(texts)), length)[start]
        size = np.ones(len(start), np.int64)
        if self.map:
            codes, start, owner, size = self._mapped(data, codes, start, owner, (begin + length)[owner])
        # size: normalised characters of each source unit; origin per normalised character
        origin, text = np.repeat(start, size), np.repeat(owner, size)
        end = (begin + length).copy()
        lead = begin.copy()  # where the blank before a text is put
        if self.trim:
            codes, origin, text, lead, end = self._trimmed(codes, origin, text, start, owner, size, lead, end, self.escape)
        if self.dummy:
            filled = np.flatnonzero(np.bincount(text, minlength=len(texts)) > 0) if self.trim else np.flatnonzero(length > 0)
            at = np.searchsorted(text, filled)
            codes, origin, text = np.insert(codes, at, _SPACE), np.insert(origin, at, lead[filled]), np.insert(text, at, filled)
        if self.escape:
            codes = np.where(codes == _SPACE, np.uint32(_MARK), codes)
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        origin = np.insert(origin - begin[text] if len(text) else origin, cut[1:], end - begin)
        return codes.astype(np.uint32), origin, cut

    def _mapped(self, data, codes, start, owner, stop):
        size, value = self.map.longest(data, start, stop)
        width = np.diff(np.append(start, len(data)))
        size = np.where(size == 0, width, size)
        reached = np.ones(len(start), bool)
        past = 0
        for i in np.flatnonzero(size > width).tolist():  # keys of several characters swallow the next ones
            if start[i] >= past:
                past = int(start[i] + size[i])
                reached[i + 1:np.searchsorted(start, past)] = False
        codes, start, owner, value = codes[reached], start[reached], owner[reached], value[reached]
        count, source = np.ones(len(start), np.int64), np.zeros(len(start), np.int64)
        found = np.flatnonzero(value >= 0)
        if not len(found):
            return codes, start, owner, count
        source[found], count[found] = self.map.replacements(value[found])
        row = np.repeat(np.arange(len(start)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        mapped = value[row] >= 0
        out = codes[row]
        out[mapped] = self.map.pool[(source[row] + within)[mapped]]
        return out, start, owner, count

    @staticmethod
    def _trimmed(codes, origin, text, start, owner, size, lead, end, marks):
        """Blanks at the start and end of a text go, and those that open a unit after a blank."""
        blank = codes == _SPACE
        unit = np.repeat(np.arange(len(start)), size)
        stops = np.cumsum(size)
        within = np.arange(len(codes)) - np.repeat(stops - size, size)
        solid = np.concatenate([[0], np.cumsum(~blank)])
        opens = blank & (solid[np.arange(len(codes))] == solid[(stops - size)[unit]]) if len(codes) else blank
        some = np.flatnonzero(size > 0)
        after = np.ones(len(start), bool)
        if len(some):
            ends = blank[stops[some] - 1]
            last = np.searchsorted(some, np.arange(len(start))) - 1  # last filled unit before each
            known = (last >= 0) & (owner[some[np.maximum(last, 0)]] == owner)
            after = np.where(known, ends[np.maximum(last, 0)], True)
        keep = ~(opens & after[unit]) if len(codes) else np.zeros(0, bool)
        # the first unit that is not a single blank tells where the text begins
        single = size == 1
        single[single] = blank[(stops - 1)[single]]
        body = np.flatnonzero(~single)
        texts, first = np.unique(owner[body], return_index=True)
        lead[texts] = start[body[first]]
        codes, origin, text = codes[keep], origin[keep], text[keep]
        # blanks that end a text, and where blanks become marks also marks
        solid = np.flatnonzero((codes != _SPACE) & ((codes != _MARK) | (not marks)))
        n = len(lead)
        past = np.zeros(n, np.int64)
        past[text[solid]] = solid + 1  # the last one wins: positions rise
        none = np.ones(n, bool)
        none[text[solid]] = False
        cut = np.searchsorted(text, np.arange(n + 1))
        past = np.where(none, cut[:-1], past)
        trailing = past < cut[1:]
        end[trailing] = origin[past[trailing]]
        keep = np.arange(len(codes)) < past[text] if len(codes) else np.zeros(0, bool)
        return codes[keep], origin[keep], text[keep], lead, end


class PieceModel:
    """A byte-pair model with byte fallback; others, and models with own symbols, raise ValueError."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, b""
        for field, value in _message(data):
            if field == 1:
                pieces.append(dict(_message(value)))
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normalizer = value
        kinds = {p.get(3, NORMAL) for p in pieces}
        if trainer.get(3, 1) != BPE or not trainer.get(35) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("byte-pair models with byte fallback and without own symbols are supported")
        self.normalizer = Normalizer(normalizer, bool(trainer.get(24)))
        score = lambda p: float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0])
        normal = [(score(p), p[1].decode(), i) for i, p in enumerate(pieces) if p.get(3, NORMAL) == NORMAL]
        place = {value: k for k, value in enumerate(sorted({own[0] for own in normal}, reverse=True))}
        self.rank = {piece: (place[value], i) for value, piece, i in normal}
        self.byte_id = {int(p[1][3:5], 16): i for i, p in enumerate(pieces) if p.get(3) == BYTE}
        self.longest = max(map(len, self.rank))
        self.joined = np.zeros(1 << _BIGRAM_BITS, bool)
        codes = [codes_of([p.encode()]) for p in self.rank if len(p) > 1]
        for own in codes:
            self.joined[self._bigram(own)] = True
        self._pairs()
        self._forget()

    def _pairs(self) -> None:
        """For pairs of symbols that make a piece: place in the order of scores, and the piece. A symbol
        is the id of a piece, or 2**20 and the code point for a character that is none."""
        self.char = np.arange(0x110000, dtype=np.int64) + (1 << 20)
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        symbol = lambda p: self.rank[p][1] if p in self.rank else int(self.char[ord(p)]) if len(p) == 1 else None
        rows = []
        for piece, (place, i) in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left << _SYMBOL_BITS | right, place, i))
        rows.sort()
        self.pair, self.pair_place, self.pair_piece = np.array(rows, np.int64).reshape(-1, 3).T.copy()

    def _forget(self) -> None:
        # Known segments by two hashes, sorted by the first, with their rows in the table of pieces.
        self.known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        self.table = [np.zeros(0, np.int32) for _ in range(4)]  # ids, begins, ends; pieces of each segment

    @staticmethod
    def _bigram(codes: np.ndarray) -> np.ndarray:
        """A cell for each pair of neighbours; pairs that share a cell are only cut less often."""
        pair = codes[:-1].astype(np.uint64) << np.uint64(21) | codes[1:].astype(np.uint64)
        return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BIGRAM_BITS)).astype(np.int64)

    def _place(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece of pairs of symbols; pairs that make no piece have the place _NEVER."""
        key = left << _SYMBOL_BITS | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        found = self.pair[at] == key
        return np.where(found, self.pair_place[at], _NEVER), self.pair_piece[at]

    def _merged_short(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, symbol, begin) of what is left when no pair of any segment can be joined. A round
        joins the best pair of every segment, of equal ones the leftmost."""
        length = np.array([len(s) for s in segments], np.int64)
        symbol = self.char[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(segments)), length)
        begin = np.arange(len(symbol)) - np.repeat(np.cumsum(length) - length, length)
        done = []
        place, piece = np.full(len(symbol), _NEVER), np.zeros(len(symbol), np.int64)
        place[:-1], piece[:-1] = self._place(symbol[:-1], symbol[1:])
        place[:-1][owner[:-1] != owner[1:]] = _NEVER
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(owner)))
            best = np.minimum.reduceat(place, first)
            going = np.repeat(best < _NEVER, size)
            if not going.all():
                done.append((owner[~going], symbol[~going], begin[~going]))
                owner, symbol, begin, place, piece, best = owner[going], symbol[going], begin[going], place[going], piece[going], np.repeat(best, size)[going]
            else:
                best = np.repeat(best, size)
            if not len(symbol):
                break
            hit = np.flatnonzero(place == best)
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
            symbol[hit] = piece[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            hit = (np.cumsum(stay) - 1)[hit]
            owner, symbol, begin, place, piece = owner[stay], symbol[stay], begin[stay], place[stay], piece[stay]
            changed = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            after = np.minimum(changed + 1, len(symbol) - 1)
            value, joined = self._place(symbol[changed], symbol[after])
            place[changed] = np.where((after > changed) & (owner[after] == owner[changed]), value, _NEVER)
            piece[changed] = joined
        owner, symbol, begin = (np.concatenate(c) for c in zip(*done)) if done else (owner, symbol, begin)
        order = np.lexsort((begin, owner))
        return owner[order], symbol[order], begin[order]

    def _merged_long(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of the pieces of one segment, in time n log n."""
        n = len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and end[j] - i <= self.longest:
                best = self.rank.get(text[i:end[j]])
                if best is not None:
                    heapq.heappush(heap, (best[0], i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not 0 < j < n or end[j] != stop:
                continue  # one of the two has become part of another piece
            end[i], end[j], before[stop] = stop, 0, i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append((i, end[i]))
            i = end[i]
        return out

    def _learn(self, segments: list[str]) -> np.ndarray:
        """Take in the pieces of new segments, short ones first: the row of each in the table."""
        size = np.array([len(x) for x in segments], np.int64)
        order = np.concatenate([np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)])
        short, long = [x for x in segments if len(x) <= SHORT], [x for x in segments if len(x) > SHORT]
        owner, symbol, begin = self._merged_short(short)
        if long:
            spans = [(k, a, b) for k, text in enumerate(long, len(short)) for a, b in self._merged_long(text)]
            more = [self.rank[x][1] if (x := long[k - len(short)][a:b]) in self.rank else int(self.char[ord(x)]) for k, a, b in spans]
            owner, begin = (np.append(old, np.array([s[c] for s in spans], np.int64)) for old, c in ((owner, 0), (begin, 1)))
            symbol = np.append(symbol, np.array(more, np.int64))
        end = np.append(begin[1:], 0)
        length = np.array([len(x) for x in (*short, *long)], np.int64)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        end[last] = length[owner[last]]
        # characters that are no piece become bytes: the last one has their place, the others are empty before it
        count = np.ones(len(symbol), np.int64)
        other = np.flatnonzero(symbol >= 1 << 20)
        own = [[self.byte_id[b] for b in chr(c - (1 << 20)).encode()] for c in symbol[other].tolist()]
        count[other] = [len(x) for x in own]
        ids, begins, ends = (np.repeat(c, count) for c in (symbol, begin, end))
        stop = np.cumsum(count)
        for k, x in zip(other.tolist(), own):
            ids[stop[k] - len(x):stop[k]] = x
            ends[stop[k] - len(x):stop[k] - 1] = begin[k]
        counts = np.bincount(owner, weights=count, minlength=len(segments))
        had = len(self.table[3])
        self.table = [np.append(old, new.astype(old.dtype)) for old, new in zip(self.table, (ids, begins, ends, counts))]
        rows = np.empty(len(segments), np.int64)
        rows[order] = had + np.arange(len(segments))
        return rows

    def _rows(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The row of every segment in the table. Segments are told apart by two 64-bit hashes, which
        hold their length; where the first alone does not tell them apart, they are learned one by one
        and not remembered."""
        values = mix(codes.astype(np.uint64) + np.uint64(1))
        length = (stops - starts).astype(np.uint64)
        first, second = (mix(range_sums(values, starts, stops, seed) + length) for seed in (0, 1))
        kinds, one, which = np.unique(first, return_index=True, return_inverse=True)
        text = lambda k: codes[starts[k]:stops[k]].tobytes().decode("utf-32-le")
        if not (second[one][which] == second).all():
            return self._learn([text(k) for k in range(len(starts))])
        place = np.searchsorted(self.known[0], kinds)
        at = np.minimum(place, max(len(self.known[0]) - 1, 0))
        rows, taken = np.full(len(kinds), -1), np.zeros(len(kinds), bool)
        if len(self.known[0]):
            taken = self.known[0][at] == kinds
            same = taken & (self.known[1][at] == second[one])
            rows[same] = self.known[2][at[same]]
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._learn([text(k) for k in one[new].tolist()])
            keep = new[~taken[new]]
            self.known = [np.insert(old, place[keep], own[keep]) for old, own in zip(self.known, (kinds, second[one], rows))]
        return rows[which]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end, cut): pieces of text i are at cut[i]:cut[i + 1], spans in its bytes."""
        if len(self.known[0]) > SEGMENTS or len(self.table[0]) > PIECES:
            self._forget()
        codes, origin, cut = self.normalizer(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
        new = np.ones(len(codes), bool)
        new[1:] = ~self.joined[self._bigram(codes)]
        new[cut[:-1][cut[:-1] < len(codes)]] = True
        at = np.flatnonzero(new)
        rows = self._rows(codes, at, np.append(at[1:], len(codes)))
        ids, begins, ends, counts = self.table
        count = counts[rows].astype(np.int64)
        first = np.cumsum(count) - count
        pick = np.arange(count.sum()) + np.repeat((np.cumsum(counts, dtype=np.int64) - counts)[rows] - first, count)
        text = np.searchsorted(cut, at, side="right") - 1
        # origin has one entry more a text, so places move on by the number of the text
        shift = np.repeat(at + text, count)
        begin, end = begins[pick] + shift, ends[pick] + shift
        pieces = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
        return (ids[pick], origin[begin].astype(np.int32), origin[end].astype(np.int32),
                np.concatenate([[0], np.cumsum(pieces)]).astype(np.int32))


def _row_blocks(sizes: pa.Array) -> list[tuple[int, int]]:
    """Consecutive rows of about BLOCK in size together; only these become Python values at once."""
    edges = np.flatnonzero(np.diff(np.cumsum(np.asarray(sizes, np.int64)) // BLOCK, prepend=0)).tolist()
    return [(a, b) for a, b in zip([0, *edges], [*edges, len(sizes)]) if a < b]


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ids, begins and ends: the pieces of every text and their spans in its UTF-8 bytes.

    ``model`` is the content of a model file; ids are those of the sentencepiece library without begin
    and end marks. NULL and empty texts have no pieces. Texts of any length are encoded whole; equal
    rows give equal rows. Columns of the input with one of the new names are replaced, all others,
    doc_id of any value among them, are kept; an empty table gives an empty one.
    """
    new = T.StructType.fromDDL("ids array<int>, begins array<int>, ends array<int>")
    docs = docs.drop(*new.names)
    text_at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(sent.value)
        for batch in batches:
            for a, b in _row_blocks(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)):
                part = batch.slice(a, b - a)
                *values, cut = own.encode(encoded(part.column(text_at).to_pylist()))
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v)) for v in values]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, *new.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new.fields]))


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """``rows`` with decoded: the text of ``ids`` by the library's own decoder. NULL ids count as none;
    bytes that are no UTF-8 become replacement characters. Other columns are kept."""
    rows = rows.drop("decoded")
    ids_at = rows.columns.index("ids")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for batch in batches:
            # lists of some pieces at a time: as Python numbers they take much more room
            for a, b in _row_blocks(pc.fill_null(batch.column(ids_at).value_lengths(), 0)):
                part = batch.slice(a, b - a)
                lists = [i or [] for i in part.column(ids_at).to_pylist()]
                text = pa.array(library.decode(lists, num_threads=1), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def digests() -> list:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]
