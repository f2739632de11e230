import itertools

import numpy as np
import pyarrow as pa
import pytest

from doclattice.llm import byte_dedup, near_dedup, window_dedup
from doclattice.llm.graph import components
from doclattice.llm.hashing import Block
from doclattice.llm.parts import documents, in_parts, shard_of, shard_runs
from tests.llm.common import LOWER, by_id, make_docs, odd_texts, sha, words


def brute_windows(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            key = tuple(w[a:a + width])
            if key in seen:
                gone[a:a + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("part_bytes", [None, 2000])
def test_window_dedup(spark, part_bytes):
    rows = odd_texts()
    got, n = by_id(window_dedup.remove_repeats(make_docs(spark, rows), part_bytes=part_bytes), "n_words", "n_removed", "kept_sha256")
    assert n == len(rows) and got == brute_windows(rows, 20)


def test_window_dedup_repeated_rows_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    out = window_dedup.remove_repeats(make_docs(spark, [(1, text), (1, text), (None, text)]), texts=True).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out if r.doc_id) == [(1, 30), (1, 30)]  # the NULL id comes first
    assert [r.n_removed for r in out if r.doc_id is None] == [0]
    assert window_dedup.remove_repeats(make_docs(spark, [])).count() == 0


def test_kept_words():
    block = Block([b" a bb  c", b"", b"dd"])
    block.split_words()
    assert [bytes(x) for x in window_dedup.keep_words(block, np.array([True, False, True, True]))] == [b"a c", b"", b"dd"]


def test_least_places():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 7, 11):
        v = rng.integers(0, 5, 50).astype(np.uint64)
        assert list(window_dedup.least_places(v, width)) == [i + int(np.argmin(v[i:i + width])) for i in range(50 - width + 1)]


def brute_bytes(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, t in texts:
        for a in range(len(t) - width + 1):
            count[t[a:a + width]] = count.get(t[a:a + width], 0) + 1
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - width + 1):
            if count[t[a:a + width]] > 1:
                gone[a:a + width] = True
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        out[i] = (len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("most,part_bytes", [(256, None), (2, None), (256, 3000), (1, 3000)])
def test_byte_dedup(spark, most, part_bytes):
    rows = odd_texts(2)
    out = byte_dedup.remove_repeats(make_docs(spark, rows), most=most, part_bytes=part_bytes)
    got, n = by_id(out, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert n == len(rows) and got == brute_bytes(rows, 200)


def test_byte_dedup_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(250))
    out = byte_dedup.remove_repeats(make_docs(spark, [(1, text), (1, text), (2, text[:199])])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 250), (1, 250), (2, 0)]
    assert byte_dedup.remove_repeats(make_docs(spark, [])).count() == 0


def test_backward_extension():
    rng = np.random.default_rng(1)
    for _ in range(150):
        width = int(rng.integers(2, 9))
        own = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(width, 50)).astype(np.uint8)) for _ in range(rng.integers(1, 5))]
        count = {}
        for c in own:
            for a in range(len(c) - width + 1):
                count[c[a:a + width]] = count.get(c[a:a + width], 0) + 1
        for c, found in zip(own, byte_dedup.repeated_in(own, width)):
            assert list(found) == [count[c[a:a + width]] > 1 for a in range(len(c) - width + 1)]


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(seed, groups, size, edits):
    """Groups of texts with words replaced at random: chains of links, and pairs on either side."""
    import random

    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}x{rng.randrange(400)}" for _ in range(120)]
        for k in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = f"e{g}.{k}.{rng.randrange(9)}"
            out.append(" ".join(own))
    return list(enumerate(out))


def test_near_duplicates(spark):
    for rows in (odd_texts(3), near_copies(1, 4, 40, 12)):
        got, n = by_id(near_dedup.near_duplicates(make_docs(spark, rows)), "n_shingles", "component_id", "kept")
        assert n == len(rows) and got == brute_components(rows)


def test_near_duplicates_kept_rows(spark):
    text = "a b c d e f g h"
    docs = make_docs(spark, [(4, text), (2, text), (2, text), (None, "p q r s t u"), (9, None), (8, "")])
    assert sorted(map(str, (r.doc_id for r in near_dedup.one_of_each(docs).collect()))) == ["2", "8", "9", "None"]
    assert near_dedup.one_of_each(docs).columns == docs.columns
    assert near_dedup.near_duplicates(make_docs(spark, [])).count() == 0


def test_near_duplicates_under_one_id(spark):
    near, other = "a b c d e f g h", "k l m n o p q r"
    docs = make_docs(spark, [(7, near), (3, near), (7, other), (7, "s t u v w x y z"), (9, other), (3, "e f g h i j k"), (None, near)])
    kept = near_dedup.one_of_each(docs).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [
        (3, near), (7, other), (7, "s t u v w x y z"), (3, "e f g h i j k"), (None, near)]))


def test_signature_misses():
    """Sets of similarity 0.71 stay on the right side of both thresholds."""
    rng = np.random.default_rng(5)
    least, most = 128, 0
    for _ in range(300):
        own = rng.integers(0, 2**63, 700).astype(np.uint64) * np.uint64(2)
        a, b = own[:600], own[100:]
        both = near_dedup.minima([np.sort(a), np.sort(b)])
        least = min(least, int((both[0, :128] == both[1, :128]).sum()))
        x, y = near_dedup.sketches(both).view(np.uint64)
        most = max(most, int(np.bitwise_count(x ^ y).sum()))
    assert least > near_dedup.MATCHES and most < near_dedup.MOST_APART


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 10), (30, 20), (7, 7)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 20: 10, 30: 10} | {100 + i: 100 for i in range(41)}
    assert components(links.limit(0)).count() == 0


def test_rows_of_one_id_spread_over_parts(spark):
    """Rows without id, or with one id, do not meet in one part; later ones lose what earlier ones hold."""
    rng = np.random.default_rng(8)
    shared = " ".join(f"s{k}" for k in range(70))
    texts = [f"{shared} {' '.join(f'u{rng.integers(10**6)}' for _ in range(30))} {i}" for i in range(120)]
    rows = [(None, t) for t in texts[:60]] + [(7, t) for t in texts[60:]]
    docs, parts = in_parts(make_docs(spark, rows), 1500)
    assert parts > 8 and docs.select("part").distinct().count() > 8
    out = window_dedup.remove_repeats(make_docs(spark, rows), part_bytes=1500).collect()
    assert sorted(r.n_removed for r in out) == [0] + [70] * 119  # one row of all keeps the passage
    assert [r.doc_id for r in out if not r.n_removed] == [None]
    out = byte_dedup.remove_repeats(make_docs(spark, rows), part_bytes=1500).collect()
    assert min(r.n_removed for r in out) >= len(shared)


def test_anchors_spread_evenly_over_shards():
    rng = np.random.default_rng(9)
    words_ = [b"w%d" % k for k in rng.integers(0, 3000, 60_000)]
    block = Block([b" ".join(words_)])
    block.split_words()
    _, _, found = window_dedup.anchors(block, block.word_hashes(), 20, 10)
    for hashes in (found, byte_dedup.anchors(block, 200, 100)[2]):
        counts = np.bincount(shard_of(hashes, 20), minlength=20)
        assert counts.max() < 2 * counts.mean() and counts.min() > counts.mean() / 2


def test_sketches_are_merged_and_never_too_small(spark):
    rows = odd_texts(5, n=30)
    docs, shards = in_parts(make_docs(spark, rows), 1000)
    marks = window_dedup.sketched(docs, shards, 20, 10).collect()
    assert {m.row for m in marks} == set(range(window_dedup.ROWS)) and len({m.shard for m in marks}) > 1
    hot = {}
    for m in marks:
        hot[m.part, m.row, m.shard] = np.unpackbits(np.frombuffer(m.bits, np.uint8)).astype(bool)
    count, seen = {}, []
    for part, group in itertools.groupby(sorted(docs.collect(), key=lambda r: (r.part, r.doc_id is not None, r.doc_id or 0)), lambda r: r.part):
        own = list(group)
        table = pa.table({"doc_id": pa.array([r.doc_id for r in own], pa.int64()), "text": [r.text for r in own]})
        block = Block(documents(table)[2])
        block.split_words()
        found = window_dedup.anchors(block, block.word_hashes(), 20, 10)[2]
        estimate = np.ones(len(found), bool)
        for row, (cells, _, which) in enumerate(window_dedup.partial_sketch(found, shards)):
            flags = np.concatenate([hot[part, row, s][:b - a] for s, a, b in shard_runs(cells // window_dedup.CELLS)]) if len(cells) else np.zeros(0, bool)
            estimate &= flags[which]
        seen.append((found, estimate))
        for value in found.tolist():
            count[value] = count.get(value, 0) + 1
    assert all(e for found, estimate in seen for v, e in zip(found.tolist(), estimate.tolist()) if count[v] > 1)
    extra = sum(e for found, estimate in seen for v, e in zip(found.tolist(), estimate.tolist()) if count[v] == 1)
    assert extra < 0.05 * len(count)
