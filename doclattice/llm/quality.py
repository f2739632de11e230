"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on a bounded sample of labelled documents, on binned statistics, and flattened
into numpy arrays (feature, threshold, left, right, value), so scoring a batch is a few vector steps
per tree level. Chosen statistics are constrained: more symbols, repeated lines or repeated words
never raise a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.batches import labelled_sample, with_text_columns
from doclattice.llm.hashing import Block, mix, range_sums, sums_by, window_hashes

_U = np.uint64
SYMBOLS = b"#*$%&|<>"
#: Statistic -> direction: -1 never raises the score as it grows, +1 never lowers it, 0 is free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "upper_share": -1, "digit_share": -1, "bang_share": -1, "line_words": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts by name, and the feature matrix, for a block of texts."""
    block = Block(texts)
    block.split_words()
    data, begin, end = block.data, block.text_start, block.text_start + block.text_length
    continued = (data & 0xC0) == 0x80
    chars = sums_by(~continued, begin, end)
    in_words = sums_by(~continued, block.word_start, block.word_end)
    word_chars = np.bincount(block.word_text, in_words, block.n).astype(np.int64)
    symbols = sums_by(_table(SYMBOLS)[data], begin, end)
    upper = sums_by((data >= 65) & (data <= 90), begin, end)
    digits = sums_by((data >= 48) & (data <= 57), begin, end)
    bangs = sums_by(data == 33, begin, end)

    # Lines: pieces between line feeds; the feed that joins two texts is a border as well.
    feeds = np.flatnonzero(data == 10)
    line_start, line_end = np.append(0, feeds + 1), np.append(feeds, len(data))
    line_text = np.searchsorted(block.text_start, line_start, "right") - 1
    words_before = np.searchsorted(block.word_start, np.append(line_start, len(data)))
    spoken = words_before[1:] > words_before[:-1]
    line_start, line_end, line_text = line_start[spoken], line_end[spoken], line_text[spoken]
    lines = range_sums(block.byte_values(), line_start, line_end, 0) + (line_end - line_start).astype(_U)
    keyed = mix(mix(lines) + line_text.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    again = order[1:][keyed[order[1:]] == keyed[order[:-1]]]
    dup_lines = np.bincount(line_text[again], minlength=block.n)
    n_lines = np.bincount(line_text, minlength=block.n)

    # Words in 3-word windows that occur twice or more in their text.
    at = block.windows(3)
    covered = np.zeros(len(block.word_text) + 1, np.int64)
    if len(at):
        keyed = mix(window_hashes(block.word_hashes(), at, 3) + block.word_text[at].astype(_U) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(keyed)
        same = keyed[order[1:]] == keyed[order[:-1]]
        twice = at[order[np.append(same, False) | np.append(False, same)]]
        covered[twice] += 1
        np.add.at(covered, twice + 3, -1)
    repeat_words = np.bincount(block.word_text, np.cumsum(covered[:-1]) > 0, block.n).astype(np.int64)

    counts = dict(zip(BASE, (block.n_words, word_chars, symbols, dup_lines, repeat_words)))
    share = lambda a, b: a / np.maximum(b, 1)
    features = np.stack([
        np.log1p(block.n_words), share(word_chars, block.n_words), share(symbols, chars), share(dup_lines, n_lines),
        share(repeat_words, block.n_words), share(upper, chars), share(digits, chars), share(bangs, chars),
        np.log1p(share(block.n_words, n_lines)),
    ], axis=1)
    return counts, features


@dataclass
class Trees:
    """Flat trees: a node is (feature, threshold, left, right, value); leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                low = x[inner, self.feature[node]] <= self.threshold[node]
                at[inner] = np.where(low, self.left[node], self.right[node])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
         bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 label by second-order gains on binned features.

    A split on a constrained feature has to order its two values in the stated direction, and the
    middle of the two bounds every value below, so the whole tree is monotonic in that feature.
    """
    nodes: list[list] = []
    share = min(max(y.mean() if len(y) else 1.0, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1) if len(x) else x.astype(int)
    total, roots = np.full(len(y), base), []

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        G, H = g[rows].sum(), h[rows].sum()
        node = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(np.clip(-G / (H + ridge), low, high)) * rate])
        if level == depth or len(rows) < 2 * least:
            return node
        best = (1e-6, None)
        for f, way in enumerate(directions):
            n = len(edges[f]) + 1
            c = code[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (g[rows], h[rows], None))
            if not len(gs):
                continue
            lv, rv = np.clip(-gs / (hs + ridge), low, high), np.clip(-(G - gs) / (H - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
            gain[(ns < least) | (len(rows) - ns < least) | (way * (rv - lv) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, lv[k], rv[k], way))
        if best[1] is None:
            return node
        f, k, lv, rv, way = best[1]
        middle = (lv + rv) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[way]
        goes = code[rows, f] <= k
        nodes[node][:2] = [f, float(edges[f][k])]
        nodes[node][2] = build(rows[goes], g, h, level + 1, *bounds[0])
        nodes[node][3] = build(rows[~goes], g, h, level + 1, *bounds[1])
        return node

    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(root := build(np.arange(len(y)), g, h, 0, -np.inf, np.inf))
        one = _flat(nodes, [root], 0.0)
        total += np.log((s := one.score(x)) / (1 - s))
    return _flat(nodes, roots, base)


def _flat(nodes: list[list], roots: list[int], base: float) -> Trees:
    a = [np.array(c) for c in zip(*nodes)] if nodes else [np.zeros(0, int)] * 5
    return Trees(a[0].astype(int), a[1].astype(float), a[2].astype(int), a[3].astype(int), a[4].astype(float), np.array(roots, int), base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000) -> Trees:
    """Trees from at most ``sample`` labelled documents (a documented bound; chosen by id hash).
    Without labelled documents every text scores high."""

    def make():
        return lambda texts: {"_x": [r.tobytes() for r in statistics(texts)[1]]}

    rows = with_text_columns(labelled_sample(docs, labels, label, sample), {"_x": "binary"}, make).select("y", "_x").toPandas()
    x = np.frombuffer(b"".join(rows["_x"]), float).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy(float) if len(rows) else np.zeros(0)
    return grow(x, y, list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees, least_words: int = 50, most_repeated: int = 50, keep_at: float = 0.5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality_score, kept; one row per input row. Texts that are NULL or empty fail the base rules."""

    def make():
        def work(texts):
            counts, x = statistics(texts)
            failed = (counts["n_words"] < least_words) | (100 * counts["n_repeat_words"] > most_repeated * counts["n_words"])
            score = model.score(x)
            return counts | {"base_failed": failed, "quality_score": score, "kept": ~failed & (score >= keep_at)}

        return work

    fields = dict.fromkeys(BASE, "long") | {"base_failed": "boolean", "quality_score": "double", "kept": "boolean"}
    return with_text_columns(docs, fields, make)
