"""Toxic passages: maximum-scoring segments of token log-odds, calibrated as extreme values.

Token scores are log-odds between toxic and clean texts with an informative Dirichlet prior; a
token whose log-odds is not clearly positive costs a small drift. In one pass over a text all maximal
scoring segments are found (linear time). Chance maxima of n tokens follow an extreme-value law with
rate ``decay`` and size ``n``; what a segment scores above its level there is evidence, and the
evidence of all significant segments adds up to the score of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.batches import crc32_mod, labelled_sample, with_text_columns
from doclattice.llm.hashing import Block, Ranges, byte_table, mix
from doclattice.llm.tables import written

#: Most features a model holds (the clearest ones): its size is bounded, whatever the vocabulary.
FEATURES = 50_000
#: Log-odds below this are not evidence on their own (a factor of seven).
LEAST_ODDS = 2.0
#: A token counts as itself and as its first bytes, so that inflected forms share what is learned.
PREFIXES = (4, 5, 6)
_WORD = np.ones(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the features that are clearly toxic
    values: np.ndarray  # their log-odds
    drift: float = 0.05
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = -20.0

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Log-odds of each hash, 0 for those the model does not hold."""
        out = np.zeros(len(hashes))
        if len(self.keys):
            top = np.uint64(44)
            seen = np.zeros(1 << 20, bool)
            seen[self.keys >> top] = True
            at = np.flatnonzero(seen[hashes >> top])
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[place] == hashes[at]
            out[at[hit]] = self.values[place[hit]]
        return out


def tokens(texts: list[bytes]) -> tuple[Block, list[tuple[np.ndarray, np.ndarray | None]]]:
    """Runs of letters and digits, lower-cased (A-Z): the block, and per kind of feature its hashes
    with the places of the tokens that have it (None: all)."""
    block = Block(texts)
    block.split_words(_WORD)
    table = byte_table(0).copy()
    table[65:91] = table[97:123]
    hashed = Ranges(table[block.data], 0)
    out = [(mix(hashed(block.word_start, block.word_end)), None)]
    for n in PREFIXES:
        at = np.flatnonzero(block.word_end - block.word_start > n)
        begin = block.word_start[at]
        out.append((mix(hashed(begin, begin + n) ^ np.uint64(n * 0x51ED2701)), at))
    return block, out


def token_scores(texts: list[bytes], model: Model) -> tuple[Block, np.ndarray]:
    """The largest log-odds among a token's features, 0 if the model holds none of them."""
    block, kinds = tokens(texts)
    value = model.lookup(kinds[0][0])
    for hashes, at in kinds[1:]:
        value[at] = np.maximum(value[at], model.lookup(hashes))
    return block, value


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that has value - drift at the listed positions and
    -drift everywhere else: (first, last, score), from left to right."""
    out: list[tuple[float, float, int, int]] = []  # sum before, sum up to the end, first, last
    gained = 0.0
    for at, value in scores:
        if value <= drift:
            gained += value
            continue
        before = gained - drift * at
        gained += value
        left, right, first, last = before, gained - drift * (at + 1), at, at
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= left:
                j -= 1
            if j < 0 or out[j][1] >= right:
                out.append((left, right, first, last))
                break
            left, first = out[j][0], out[j][2]
            del out[j:]
    return [(first, last, right - left) for left, right, first, last in out]


def segments(texts: list[bytes], model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], Block]:
    """Tokens per text, the maximal segments of every text (token places), and the block."""
    block, value = token_scores(texts, model)
    hot = np.flatnonzero(value > 0)
    of = block.word_text[hot]
    cut = np.searchsorted(of, np.arange(block.n + 1))
    local = (hot - block.first[of]).tolist()
    values = value[hot].tolist()
    found = [maximal_segments(list(zip(local[a:b], values[a:b])), model.drift) if b > a else [] for a, b in zip(cut, cut[1:])]
    return block.n_words, found, block


def evidence(n: np.ndarray, found: list[list[tuple[int, int, float]]], model: Model) -> np.ndarray:
    """Sum over the significant segments of a text of what they score above chance, in nats."""
    level = np.log(model.scale * np.maximum(n, 1) + 1e-9)
    return np.array([sum(max(0.0, model.decay * s - at) for _, _, s in own) for own, at in zip(found, level)])


def feature_counts(rows: DataFrame) -> DataFrame:
    """(key, clean, toxic): how many texts of either label have each feature."""

    def count(batches):
        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in batch.column(0).to_pylist()]
            label = batch.column(1).to_numpy() > 0
            if not texts:
                continue
            block, kinds = tokens(texts)
            hashes = np.concatenate([h for h, _ in kinds])
            of = np.concatenate([block.word_text if at is None else block.word_text[at] for _, at in kinds])
            order = np.lexsort((of, hashes))
            hashes, of = hashes[order], of[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))[: len(hashes)]
            hashes, toxic = hashes[new], label[of[new]]
            start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, int)
            if not len(start):
                continue
            n, t = np.diff(np.append(start, len(hashes))), np.add.reduceat(toxic.astype(np.int64), start)
            arrays = [pa.array(hashes[start].view(np.int64)), pa.array(n - t), pa.array(t)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "clean", "toxic"])

    counted = rows.select("text", "y").mapInArrow(count, "key long, clean long, toxic long")
    return counted.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def clear_features(counts: DataFrame, clean_total: int, toxic_total: int, prior: float, least_z: float) -> DataFrame:
    """(key, odds, clean) of features whose log-odds, with a Dirichlet prior in proportion to their
    total counts, exceed zero by ``least_z`` standard deviations."""
    alpha = 0.5 + F.lit(prior / max(clean_total + toxic_total, 1)) * (F.col("clean") + F.col("toxic"))
    odds = lambda y, n: F.log((y + F.col("alpha")) / (n + prior - y - F.col("alpha")))
    return (
        counts.withColumn("alpha", alpha)
        .withColumn("odds", odds(F.col("toxic"), toxic_total) - odds(F.col("clean"), clean_total))
        .withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("toxic") + F.col("alpha")) + 1 / (F.col("clean") + F.col("alpha"))))
        .filter((F.col("z") >= least_z) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("z"), "key").limit(FEATURES).select("key", "odds", "clean")
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 20_000, prior: float = 2000.0,
        least_z: float = 3.0) -> Model:
    """Learn from at most ``sample`` labelled documents (a documented bound; chosen by id hash): word
    counts from two thirds, calibration from the rest; equal texts count once. Without both labels nothing is toxic."""
    rows = labelled_sample(docs, labels, label, sample).dropDuplicates(["text"]).withColumn("part", crc32_mod("doc_id", 9))
    counts = written(feature_counts(rows.filter("part < 6")), "toxic-features")
    totals = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    model = Model(np.zeros(0, np.uint64), np.zeros(0))
    if not (totals[0] and totals[1]):
        return model
    held = clear_features(counts, totals[0], totals[1], prior, least_z).toPandas()
    keys = held["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    clean = held["clean"].to_numpy(float)[order] / totals[0]
    model.keys, model.values = keys[order], held["odds"].to_numpy(float)[order]
    model.drift = max(0.02, 2 * float((model.values * clean).sum()))
    # The rate at which clean tokens make chance segments: the root of E[exp(rate * score)] = 1.
    p = np.append(clean + 1e-7, max(1 - clean.sum(), 0.5))
    x = np.append(model.values, 0.0) - model.drift
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if (p * np.exp(np.minimum(middle * x, 500))).sum() > p.sum() else (middle, high)
    model.decay = low

    held = model

    def make():
        def work(texts):
            n, found, _ = segments(texts, held)
            top = [max((s for _, _, s in own), default=0.0) for own in found]
            return {"_n": n, "_top": top, "_found": [np.array([s for _, _, s in own]).tobytes() for own in found]}

        return work

    fields = {"_n": "long", "_top": "double", "_found": "binary"}
    seen = with_text_columns(rows.filter("part >= 6").select("text", "y"), fields, make).drop("text").toPandas()
    y, n = seen["y"].to_numpy() > 0, seen["_n"].to_numpy()
    if not len(seen) or y.all() or not y.any():
        model.offset = -3.0
        return model
    # Size of the law from the clean half: the mean of a Gumbel maximum is (ln(scale * n) + 0.5772) / rate.
    calm = seen[~y]
    model.scale = float(np.exp(np.mean(model.decay * calm["_top"] - np.log(np.maximum(calm["_n"], 1))) - 0.5772))
    found = [[(0, 0, s) for s in np.frombuffer(b)] for b in seen["_found"]]
    e = evidence(n, found, model)
    # One-variable logistic calibration by Newton steps, with a little ridge.
    a, b = 1.0, -3.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * e + b, -30, 30)))
        w = q * (1 - q) + 1e-9
        g = np.array([((q - y) * e).sum() + 1e-2 * a, (q - y).sum() + 1e-2 * b])
        H = np.array([[(w * e * e).sum() + 1e-2, (w * e).sum()], [(w * e).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(H, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.slope, model.offset = max(float(a), 1e-3), float(b)
    return model


def score(docs: DataFrame, model: Model, spans: bool = False, column: str = "toxicity") -> DataFrame:
    """``docs`` with ``column`` (0 to 1; empty and NULL texts too) and, on request, the significant
    passages as ``toxic_spans`` ("first:last:score" of tokens). One row per input row."""

    def make():
        def work(texts):
            n, found, _ = segments(texts, model)
            e = evidence(n, found, model)
            out = {column: 1 / (1 + np.exp(-np.clip(model.slope * e + model.offset, -50, 50)))}
            if spans:
                level = np.log(model.scale * np.maximum(n, 1) + 1e-9)
                out["toxic_spans"] = [",".join(f"{a}:{b}:{s:.3f}" for a, b, s in own if model.decay * s > at) for own, at in zip(found, level)]
            return out

        return work

    return with_text_columns(docs, {column: "double"} | ({"toxic_spans": "string"} if spans else {}), make)


def without_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score less than ``at``."""
    column = "_toxicity_of_row"
    return score(docs, fit(docs, labels), column=column).filter(F.col(column) < at).select(*docs.columns)
