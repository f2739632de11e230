"""Chunkers: known cases and plain-Python folds over the documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import chunking
from doclattice.operators.embedding import model_embedding, neighbour_similarities
from doclattice.plans.registry import Tables


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)],
                                 "doc_id long, page_number int, text string")


def chunks(df):
    return df.orderBy("page_number", "chunk_index").collect()


def test_short_and_empty(spark):
    got = chunks(chunking.fixed_size_chunks(pages(spark, "  one two ", "", " \n ")))
    assert [(r.page_number, r.content, r.token_count) for r in got] == [(1, "one two", 2)]


@pytest.mark.parametrize("n,size,overlap", [(100, 20, 0.15), (50, 20, 0.5), (400, 400, 0.15),
                                             (401, 400, 0.15), (21, 20, 0.0)])
def test_window_arithmetic(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    text = " ".join(words)
    got = chunks(chunking.fixed_size_chunks(pages(spark, text), size=size, overlap=overlap))
    step, want, start = size - int(size * overlap), [], 0
    while True:
        end = min(start + size, n)
        want.append(" ".join(words[start:end]))
        if end >= n:
            break
        start += step
    assert [r.content for r in got] == want
    assert [r.chunk_index for r in got] == list(range(len(want)))
    for r in got:
        assert text[r.char_start:r.char_end].strip() == r.content


def test_word_windows_equal_the_column_form(spark):
    """Windows of words come without a string for every word, and as the same pieces by column functions give them."""
    rng = random.Random(8)
    odd = ["a", "ü", "\U0001f600b", "\u200b", "\u180e", *tx.BLANK_CHARS, " ", " "]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 90))) for _ in range(200)] + [None, " x" * 12, "x " * 12]
    for size, overlap in ((5, 0.4), (12, 0.15), (1, 0.0)):
        fast = chunking.fixed_size_chunks(pages(spark, *texts), size=size, overlap=overlap)
        plain = chunking.fixed_size_chunks(pages(spark, *texts), size=size, overlap=overlap, pieces=lambda c: tx.word_pieces(c))
        assert "regexp_extract_all" not in fast._jdf.queryExecution().optimizedPlan().toString()
        assert fast.schema == plain.schema and chunks(fast) == chunks(plain)


def test_overlap_of_one_is_rejected(spark):
    with pytest.raises(ValueError):
        chunking.fixed_size_chunks(pages(spark, "a"), overlap=1.0)


def test_reindex_runs_over_pages(spark):
    text = " ".join(f"w{i}" for i in range(30))
    cut = chunking.fixed_size_chunks(pages(spark, text, text), size=20)
    got = chunks(chunking.reindex_chunks(cut))
    assert [(r.page_number, r.chunk_index) for r in got] == [(1, 0), (1, 1), (2, 2), (2, 3)]


def split(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]


def pack(sents, size, carry):
    out, cur, n = [], [], 0
    for s in sents:
        k = len(s.split())
        if n + k > size and cur:
            out.append(cur)
            cur = cur[-carry:] if carry and len(cur) > carry else []
            n = sum(len(x.split()) for x in cur)
        cur = cur + [s]
        n += k
    return out + [cur] if cur else out


def test_sentence_packing_equals_fold(spark, data):
    docs = Tables(spark, data).documents
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {}
    for r in chunking.sentence_chunks(docs, ("doc_id",), size=60).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for d, text in texts.items():
        if len(text.split()) <= 60:
            want = [text.strip()] if text.strip() else []
        else:
            want = [" ".join(g) for g in pack(split(text), 60, 2)]
        assert got.get(d, []) == want


def merge(groups, size, least):
    out = [groups[0]]
    for g in groups[1:]:
        joint = sum(len(s.split()) for s in out[-1] + g)
        if len(out[-1]) < least or joint <= size:
            out[-1] = out[-1] + g
        else:
            out.append(g)
    return out


def test_semantic_chunks_equal_fold(spark, data):
    docs = Tables(spark, data).documents
    sims = docs.select("doc_id", "text", neighbour_similarities()(
        __import__("doclattice.functions.text", fromlist=["x"]).sentences(F.col("text"))).alias("s"))
    rows = sims.collect()
    got = {}
    out = chunking.semantic_chunks(docs, neighbour_similarities(), ("doc_id",), size=60)
    for r in out.orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for r in rows:
        sents = split(r.text)
        if len(r.text.split()) <= 60 or len(sents) < 2:
            want = [r.text.strip()] if r.text.strip() else []
        else:
            assert len(r.s) == len(sents) - 1
            groups, cur = [], [sents[0]]
            for s, sim in zip(sents[1:], r.s):
                if sim < 0.5:
                    groups.append(cur)
                    cur = []
                cur.append(s)
            groups.append(cur)
            want = []
            for g in merge(groups, 60, 2):
                n = sum(len(s.split()) for s in g)
                want += [" ".join(x) for x in (pack(g, 60, 0) if n > 60 else [g])]
        assert got.get(r.doc_id, []) == want


def test_fallback_is_marked(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    got = chunking.semantic_chunks(pages(spark, text), None, size=50).collect()
    assert len(got) > 1 and {r.chunking_method for r in got} == {"semantic_fallback"}


def test_byte_pair_plugin(spark):
    """Any lossless tokenizer plugs in; here a byte-pair model trained on the spot."""
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.Split(" ", "merged_with_next")
    tok.train_from_iterator(["the quick brown fox"] * 5, trainers.BpeTrainer(vocab_size=60))
    blob = tok.to_str()

    @F.udf("array<string>")
    def pieces(text):
        from tokenizers import Tokenizer as T

        return [text[a:b] for a, b in T.from_str(blob).encode(text).offsets]

    text = "the quick brown fox the quick brown fox"
    got = chunks(chunking.fixed_size_chunks(pages(spark, text), size=4, overlap=0.0, pieces=pieces))
    assert "".join(text[r.char_start:r.char_end] for r in got) == text
    assert [r.chunk_index for r in got] == list(range(len(got)))


def test_model_embedding_plugin(spark):
    def factory():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("abc",), (None,)], "s string")
    got = [list(r[0]) for r in df.select(model_embedding(F.col("s"), factory, batch=1)).collect()]
    assert got == [[3.0, 1.0], [0.0, 1.0]]


def test_packing_time_follows_the_text(spark):
    """A text of many megabytes: groups are slices, not growing copies."""
    import time

    sentence = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. "

    def seconds(copies):
        page = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.repeat(F.lit(sentence), copies).alias("text"))
        begin = time.perf_counter()
        rows = chunking.sentence_chunks(page, size=40).agg(F.count("*"), F.sum("token_count"), F.max("token_count")).first()
        assert rows[2] <= 40 and rows[1] >= 10 * copies
        return time.perf_counter() - begin

    seconds(1000)
    small, large = seconds(4_000), seconds(40_000)  # 0.2 and 2.3 MB
    assert large < 20 * small + 5
