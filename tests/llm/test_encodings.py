"""Fill-in-the-middle, SentencePiece round trips and whitening against plain versions."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from doclattice.llm import infill, pieces, queries, whitening
from tests.llm.common import by_id, make_docs, odd_texts, sha

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = [(700, "wörter " * 60_000 + " \n"), (701, " " * 300_000), (702, "日" * 200_000), (703, "a\n" * 100_000)]


def brute_infill(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or c % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    out = f"<S>{s}<P>{p}<M>{m}" if d % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if d % 100 < spm else "psm", len(p), len(m), out


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50)])
def test_infill(spark, rate, spm):
    rows = odd_texts(3) + LONG + [(None, "no id here"), (None, "no id here"), (-5, "<P> inside"), (800, "a<S b<"), (800, "a<S b<"), (801, "<"), (802, "<S"), (803, "  x ")]
    docs = make_docs(spark, rows).withColumnRenamed("score", "form")
    out = infill.fill_in_middle(docs, rate, spm).withColumn("back", infill.restored())
    got = sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=str)
    assert got == sorted(((i, *brute_infill(i, t, rate, spm), t or "") for i, t in rows), key=str)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    assert {"lang", "source", "n_chars", "text"} <= set(out.columns)


def test_fenwick_descent():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 64, 100):
        a, b = ([rng.randrange(0, 4) for _ in range(n)] for _ in range(2))
        tree = infill.FenwickCounts(np.array(a), np.array(b))
        total = sum(a)
        if not total:
            continue
        at, (units, chars) = tree.descend(np.arange(1, total + 1))
        for rank, (k, u, c) in enumerate(zip(at.tolist(), units.tolist(), chars.tolist()), 1):
            assert sum(a[:k]) == u < rank <= sum(a[:k + 1]) and c == sum(b[:k])


def test_cuts_at_every_unit_with_small_pieces():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aé日 \n𝕏") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    index = infill.UnitIndex([t.encode() for t in texts], piece=3)
    for i, text in enumerate(texts):
        units = UNIT.findall(text)
        assert index.n_units[i] == len(units)
        size, chars = index.cuts(np.full(len(units) + 1, i), np.arange(len(units) + 1))
        heads = ["".join(units[:k]) for k in range(len(units) + 1)]
        assert chars.tolist() == [len(h) for h in heads] and size.tolist() == [len(h.encode()) for h in heads]


def piece_texts(seed, n):
    rng = random.Random(seed)
    parts = list("abc eht  \n\t▁é日﷽𝕏<>0x1") + ["the", "</s>", "<s>", "<0x0A>", "́", "Ａ", "㍿", " ", "ﬁ", "\x00", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_pieces_equal_the_library(spark):
    model = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [t for _, t in odd_texts(7) + LONG] + piece_texts(8, 300)
    rows = [*enumerate(texts), (None, "no id"), (None, None), (5, "again"), (5, "again")]
    docs = make_docs(spark, rows).withColumnRenamed("score", "ids")
    out = pieces.encode(docs, model)
    want = []
    for i, t in rows:
        found = library.encode(t or "", return_type="proto").pieces
        want.append((i, [p.id for p in found], [p.begin for p in found], [p.end for p in found]))
    assert sorted(map(str, (tuple(r) for r in out.select("doc_id", "ids", "begins", "ends").collect()))) == sorted(map(str, want))
    back = pieces.decode(out, model).select("doc_id", "decoded", *pieces.digests())
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, library.decode(ids), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, want))
    assert pieces.decode(pieces.encode(docs.limit(0), model), model).count() == 0


def test_spans_cover_the_text():
    """Spans of pieces follow one another and leave out no byte."""
    model = pieces.PieceModel(queries.piece_model())
    texts = [t.encode() for t in piece_texts(9, 300)]
    ids, begin, end, cut = model.encode(texts)
    for i, text in enumerate(texts):
        own = slice(cut[i], cut[i + 1])
        assert begin[own].tolist()[:1] == [0] * bool(text) and end[own].tolist()[-1:] == [len(text)] * bool(text)
        assert begin[own].tolist()[1:] == end[own].tolist()[:-1]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("options", range(8))
def test_character_map_equals_the_library(rule, options):
    named = dict(zip(("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"), (bool(options >> k & 1) for k in range(3))))
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **named)
    own = pieces.Normalizer(dict(pieces._message(library.serialized_model_proto()))[3])
    texts = ["", " ", "  a  ", "▁", "a ▁ "] + piece_texts(10, 400)
    codes, origin, cut = own([t.encode() for t in texts])
    for i, text in enumerate(texts):
        want, offsets = library.normalize(text, with_offsets=True)
        assert codes[cut[i]:cut[i + 1]].tobytes().decode("utf-32-le") == want
        if want:
            data = text.encode()
            assert [len(data[:o].decode()) for o in origin[cut[i] + i:cut[i + 1] + i + 1].tolist()] == list(offsets)


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(sentencepiece.SentencePieceNormalizer(rule_name="identity").serialized_model_proto())


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions."""
    n = len(matrix)
    eye = [[Fraction(i == j) for j in range(n)] for i in range(n)]
    times = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(n)) for j in range(n)] for i in range(n)]
    c, m = [Fraction(1)], [[Fraction(0)] * n for _ in range(n)]
    for k in range(1, n + 1):
        m = [[x + c[-1] * e for x, e in zip(r, s)] for r, s in zip(times(matrix, m), eye)]
        am = times(matrix, m)
        c.append(-sum(am[i][i] for i in range(n)) / k)
    return [int(x) for x in reversed(c)]


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(3)
    cases = [rng.integers(-50, 50, (12, 5)), rng.integers(-10**6, 10**6, (9, 7)), np.ones((4, 3), int), np.diag([1, 0, 2, 0, 5]), np.array([[3, 4]])]
    for x in cases:
        matrix = (x.T.astype(object) @ x.astype(object)).astype(object)
        found = whitening.characteristic_polynomial(spark, matrix)
        assert found == exact_polynomial(matrix.tolist())
        roots = whitening.largest_roots(found, int(np.trace(matrix)), len(matrix))
        want = np.linalg.eigvalsh(matrix.astype(float))[::-1]
        mine = [float(r) for r, k in roots for _ in range(k)]
        assert np.allclose(mine, want[:len(mine)]) and np.allclose(want[len(mine):], 0, atol=1e-3)


def test_roots_with_multiplicity():
    polynomial = np.polynomial.polynomial.polyfromroots([2, 2, 2, 7, 7, 11, 0]).round().astype(int).tolist()
    found = whitening.largest_roots(polynomial, 31, 7)
    assert [(round(float(r), 9), k) for r, k in found] == [(11, 1), (7, 2), (2, 3)]
    assert whitening.largest_roots(polynomial, 31, 2)[-1][1] == 2  # a multiple root is never split


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, part int")


@pytest.mark.parametrize("n, d, copies", [(300, 12, 1), (60, 10, 4), (40, 5, 1)])
def test_whitening(spark, n, d, copies):
    rng = np.random.default_rng(n)
    data = (rng.standard_normal((n, d)) * np.linspace(1, 3, d) + 0.3).astype(np.float32)
    data[:, -1] = data[:, 0]  # a direction without variance
    good = [(i // copies, v.tolist(), "x", 1) for i, v in enumerate(np.repeat(data[:n // copies], copies, axis=0))]
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, "x", 1), (2, [nan] + [1.0] * (d - 1), "x", 1), (3, [1.0, None] + [1.0] * (d - 2), "x", 1), (4, [-inf] * d, "x", 1), (5, [], "x", 1), (6, [1.0] * (d + 1), "x", 1)]
    out = whitening.whiten(vectors(spark, good + bad)).collect()
    x = np.floor(1024 * np.array([v for _, v, *_ in good], np.float64)) + 100000
    m = len(x)
    assert len(out) == m and {r["n"] for r in out} == {m} and {r["part"] for r in out} == {1}
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / m)
    k = min(8, d - 1)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    sign = np.sign(np.array([r["whitened"] for r in out]).T @ np.array([(c @ v)[[g[0] for g in good].index(r["vec_id"])] for r in out])).diagonal()
    exact = x.astype(int).astype(object)
    total = exact.sum(axis=0)
    for i, row in enumerate(good):
        mine = [r for r in out if r["vec_id"] == row[0]]
        assert any(np.allclose(np.array(r["whitened"]) * sign, c[i] @ v / np.sqrt(e), atol=1e-8) for r in mine)
        assert any(int(r["deviation"]) == ((m * exact[i] - total) ** 2).sum() for r in mine)
    assert np.allclose(out[0]["explained"], e / np.trace(c.T @ c / m)) and out[0]["identity_error"] < 1e-9


def test_whitening_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, "x", 1)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], "x", 1)] * 3)).collect()
    assert [(r["whitened"], r["identity_error"], r["n"]) for r in one] == [([], None, 3)] * 3
    far = whitening.whiten(vectors(spark, [(i, [3e38 * (-1) ** i, float(i)], "x", 1) for i in range(6)])).collect()
    assert all(len(r["whitened"]) == 2 and np.isfinite(r["whitened"]).all() for r in far) and far[0]["identity_error"] < 1e-4


def test_near_equal_roots_are_told_apart(spark):
    """Eigenvalues that agree in more digits than doubles have still give orthonormal components."""
    matrix = np.array([[10**30, 1, 0], [1, 10**30, 0], [0, 0, 5]], object)
    polynomial = whitening.characteristic_polynomial(spark, matrix)
    roots = whitening.largest_roots(polynomial, int(np.trace(matrix)), 3)
    assert [r for r, _ in roots] == pytest.approx([10**30 + 1, 10**30 - 1, 5]) and roots[0][0] - roots[1][0] > 1
    a, b = (whitening.null_vectors(matrix, r, 1)[0] for r, _ in roots[:2])
    assert np.allclose(np.abs(a), [0.5**0.5, 0.5**0.5, 0]) and abs(a @ b) < 1e-12
