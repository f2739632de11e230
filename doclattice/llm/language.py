"""Language identification in two steps: family first, then pairwise machines within the family.

Texts are square roots of hashed byte 2- and 3-gram shares (letters A-Z lower-cased). One linear
support vector machine per family (against the rest) picks the family; within it every pair of
languages has its own machine, and the language that wins most pairs is taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.batches import with_text_columns

DIMENSIONS = 4096
# Language -> family. A language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
}
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[10, 13, 9]] = 32


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of gram shares and a constant."""
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    of = np.repeat(np.arange(len(texts)), np.diff(begin))
    out = np.zeros(len(texts) * DIMENSIONS, np.float32)
    base = of * DIMENSIONS
    for n in (2, 3):
        if len(data) >= n:
            h = data[: len(data) - n + 1] * np.uint32(0x9E3779B1)
            for k in range(1, n):
                h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            inside = of[: len(h)] == of[n - 1 :]
            at = base[: len(h)] + (h >> np.uint32(20)).astype(np.int64)
            out += np.bincount(at[inside], minlength=len(out))
    out = out.reshape(len(texts), DIMENSIONS)
    out = np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))
    return np.hstack([out, np.ones((len(texts), 1), np.float32)])


def support_machine(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights of a linear machine for y = +1 / -1 by accelerated descent on the squared hinge; both
    classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (2 * 2.0 + ridge)  # rows have norm sqrt(2)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (ridge * v - 2 * (weight * y * slack) @ x)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, sample: int = 3_000, keep: Column | None = None) -> Model:
    """Learn from about ``sample`` documents with text and lang at most (a documented bound, an even
    share for each language, chosen by id hash). ``keep`` restricts the rows learned from."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (keep if keep is not None else F.lit(True)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model()
    each = sample // len(counts)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    picked = rows.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) < share).select("lang", "text")

    def make():
        return lambda texts: {"_x": [r.tobytes() for r in features(texts)]}

    got = with_text_columns(picked, {"_x": "binary"}, make).select("lang", "_x").toPandas()
    x = np.frombuffer(b"".join(got["_x"]), np.float32).reshape(-1, DIMENSIONS + 1)
    lang = got["lang"].to_numpy()
    model = Model()
    for name in sorted(set(lang)):
        model.members.setdefault(FAMILIES.get(name, name), []).append(name)
    model.families = sorted(model.members)
    family = np.array([FAMILIES.get(v, v) for v in lang])
    one = lambda mask: support_machine(x[:], np.where(mask, 1, -1).astype(np.float32))
    model.family_weights = np.stack([one(family == f) for f in model.families], axis=1)
    for own in model.members.values():
        for a, b in combinations(own, 2):
            pick = (lang == a) | (lang == b)
            model.pair_weights[a, b] = support_machine(x[pick], np.where(lang[pick] == a, 1, -1).astype(np.float32))
    return model


def classify(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language and score (0 to 1) of every row."""
    margins = x @ model.family_weights
    family = margins.argmax(axis=1)
    squash = lambda m: 1 / (1 + np.exp(-3 * m))
    sure = squash(margins.max(axis=1))
    lang = np.empty(len(x), object)
    for k, name in enumerate(model.families):
        rows, own = np.flatnonzero(family == k), model.members[name]
        votes = np.zeros((len(rows), len(own)))
        least = np.ones((len(rows), len(own)))
        for (a, b), w in model.pair_weights.items():
            if a in own:
                m = x[rows] @ w
                for i, s in ((own.index(a), m), (own.index(b), -m)):
                    votes[:, i] += (s > 0) if i == own.index(a) else (s >= 0)
                    least[:, i] = np.minimum(least[:, i], squash(s))
        best = (votes + 1e-6 * least).argmax(axis=1)
        lang[rows] = np.array(own, object)[best]
        sure[rows] *= least[np.arange(len(rows)), best]
    return lang, sure.astype(float)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score, one row per input row. ``und`` with score 0 for a text
    that is NULL or has no letter, and for all texts if no language was learned."""

    def make():
        def work(texts):
            lang, sure = classify(features(texts), model) if model.families else (["und"] * len(texts), [0.0] * len(texts))
            return {"lang_pred": list(lang), "lang_score": sure}

        return work

    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = with_text_columns(docs, {"lang_pred": "string", "lang_score": "double"}, make, text)
    return out.withColumn("lang_pred", F.when(spoken, F.col("lang_pred")).otherwise("und")).withColumn(
        "lang_score", F.when(spoken, F.col("lang_score")).otherwise(0.0))
