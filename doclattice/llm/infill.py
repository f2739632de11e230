"""Fill-in-the-middle samples: texts cut at two word boundaries and put back in another order.

A text is cut into units: a word with the blanks before it, and blanks that end the text. Each block
of texts is laid out in fixed pieces of ``PIECE`` bytes (a text begins a new piece) and a Fenwick tree
over the pieces holds their numbers of units and of code points. A cut after k units is found by
binary lifting: the tree is descended from its highest power of two, keeping every step that leaves
units to go, and the code points passed are summed on the way. Only the piece that is reached is
looked at for the boundary. All cuts of a block descend together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.llm.hashing import BLOCK_BYTES, Block, blocks, encoded

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1024
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FIELDS = T.StructType([T.StructField(name, kind) for name, kind in (
    ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
    ("output", T.StringType()))])


class FenwickCounts:
    """Prefix sums of several counts per piece; ``descend`` follows the first of them."""

    def __init__(self, *counts: np.ndarray):
        self.size = len(counts[0])
        at = np.arange(1, self.size + 1)
        self.trees = []
        for own in counts:
            sums = np.concatenate([[0], np.cumsum(own)])
            tree = np.zeros(self.size + 1, np.int64)
            tree[1:] = sums[1:] - sums[at & (at - 1)]
            self.trees.append(tree)

    def before(self, pieces: np.ndarray) -> list[np.ndarray]:
        """The sums over all pieces before the given ones."""
        at, sums = pieces.astype(np.int64), [np.zeros(len(pieces), np.int64) for _ in self.trees]
        while at.any():
            for total, tree in zip(sums, self.trees):
                total += tree[at]
            at &= at - 1
        return sums

    def descend(self, ranks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The piece in which the first count reaches each rank (from 1), and all sums before it."""
        at = np.zeros(len(ranks), np.int64)
        sums = [np.zeros(len(ranks), np.int64) for _ in self.trees]
        step = 1 << max(self.size.bit_length() - 1, 0)
        while step:
            to = np.minimum(at + step, self.size)
            go = (at + step <= self.size) & (sums[0] + self.trees[0][to] < ranks)
            for total, tree in zip(sums, self.trees):
                total += np.where(go, tree[to], 0)
            at = np.where(go, to, at)
            step >>= 1
        return at, sums


class UnitIndex:
    """Units of a block of texts: how many each text has, and where the k-th one ends."""

    def __init__(self, texts: list[bytes], piece: int = PIECE):
        block = Block(texts)
        self.piece, self.start, self.length = piece, block.text_start, block.text_length
        full = self.length > 0
        last = (self.start + self.length - 1)[full]
        blank = _BLANK[block.data]
        self.ends = np.zeros(len(block.data), bool)
        self.ends[:-1] = ~blank[:-1] & blank[1:]
        self.ends[last] = True
        self.chars = (block.data & 0xC0) != 0x80
        between = (self.start[1:] - 1).astype(np.int64)
        self.ends[between] = self.chars[between] = False

        pieces = -(-self.length // piece)
        self.first = np.cumsum(pieces) - pieces
        rank = np.arange(pieces.sum()) - np.repeat(self.first, pieces)
        self.piece_start = np.repeat(self.start, pieces) + rank * piece
        count = lambda mask: np.add.reduceat(mask, self.piece_start, dtype=np.int64) if len(self.piece_start) else np.zeros(0, np.int64)
        self.tree = FenwickCounts(count(self.ends), count(self.chars))
        self.units_before, self.chars_before = self.tree.before(self.first)
        self.n_units = np.diff(np.append(self.units_before, self.tree.before(np.array([self.tree.size]))[0]))

    def cuts(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of text ``text[i]`` that its first ``units[i]`` units take."""
        size, chars = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        some = np.flatnonzero(units > 0)
        ranks = self.units_before[text[some]] + units[some]
        at, (units_passed, chars_passed) = self.tree.descend(ranks)
        for i, piece, left, passed in zip(some.tolist(), at.tolist(), (ranks - units_passed).tolist(), chars_passed.tolist()):
            begin = int(self.piece_start[piece])
            stop = begin + int(np.flatnonzero(self.ends[begin:begin + self.piece])[left - 1]) + 1
            own = text[i]
            size[i] = stop - self.start[own]
            chars[i] = passed + np.count_nonzero(self.chars[begin:stop]) - self.chars_before[own]
        return size, chars


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers from the hash of seed and id (no id: an empty one)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def _block_rows(ids: list, texts: list[bytes], rate: int, spm_rate: int, seed: int) -> dict[str, list]:
    index = UnitIndex(texts)
    n = index.n_units
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    form = ["plain"] * len(texts)
    who, lower, upper = [], [], []
    for i, (doc_id, text) in enumerate(zip(ids, texts)):
        a, b, share, order = draws(doc_id, seed)
        if not text or share % 100 >= rate or any(m in text for m in marks):
            continue
        form[i] = "spm" if order % 100 < spm_rate else "psm"
        places = sorted((a % (int(n[i]) + 1), b % (int(n[i]) + 1)))
        who.append(i)
        lower.append(places[0])
        upper.append(places[1])
    out = {"n": n, "form": form, "prefix_chars": [None] * len(texts), "middle_chars": [None] * len(texts), "output": list(texts)}
    text_of = np.array(who + who, np.int64)
    size, chars = index.cuts(text_of, np.array(lower + upper, np.int64))
    half = len(who)
    mark_p, mark_s, mark_m = marks
    for k, i in enumerate(who):
        a, b = int(size[k]), int(size[half + k])
        prefix, middle, suffix = texts[i][:a], texts[i][a:b], texts[i][b:]
        parts = (mark_p, prefix, mark_s, suffix) if form[i] == "psm" else (mark_s, suffix, mark_p, prefix)
        out["output"][i] = b"".join((*parts, mark_m, middle))
        out["prefix_chars"][i] = int(chars[k])
        out["middle_chars"][i] = int(chars[half + k] - chars[k])
    return out


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate`` per cent of the documents are rearranged, chosen by seed and id; ``spm_rate`` per cent of
    those with the suffix first. Texts without characters and texts that hold one of the marks stay
    plain: output is the text itself, prefix_chars and middle_chars are NULL. NULL text counts as
    empty. A NULL doc_id draws as an empty id; equal rows give equal rows. Texts of any length are cut
    whole. Columns of the input with one of the new names are replaced, all others are kept; an empty
    table gives an empty one.
    """
    docs = docs.drop(*_FIELDS.names)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(id_at).to_pylist(), encoded(batch.column(text_at).to_pylist())
            for begin, end in blocks(texts, BLOCK_BYTES):
                new = _block_rows(ids[begin:end], texts[begin:end], rate, spm_rate, seed)
                own = batch.slice(begin, end - begin)
                arrays = [pa.array(new[name], kind) for name, kind in zip(_FIELDS.names, kinds)]
                yield pa.RecordBatch.from_arrays([*own.columns, *arrays], [*own.schema.names, *_FIELDS.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_FIELDS.fields]))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The exact text back from an output and its form."""
    out = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form
    between = lambda a, b: F.substring_index(F.substring_index(out, b, 1), a, -1)
    middle = F.substring_index(out, MIDDLE, -1)
    return (
        F.when(kind == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(kind == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(out)
    )
