"""Operators without an SQL oracle, and edge cases, against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import (answers, classify, embedding, fields, lexical, metrics, samples,
                                  search, usage, vectors, workflows)
from doclattice.plans.registry import Tables


def vector_table(spark, name, n, seed, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>"), rows


def brute(q_rows, v_rows, k):
    out = {}
    for q, a in q_rows:
        a = np.array(a)
        scored = sorted((-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9), i)
                        for i, b in ((i, np.array(b)) for i, b in v_rows))
        out[q] = [i for _, i in scored[:k]]
    return out


def hits_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_exact_search_equals_brute_force(spark):
    q, q_rows = vector_table(spark, "query_id", 30, 1)
    v, v_rows = vector_table(spark, "item_id", 200, 2)
    want = brute(q_rows, v_rows, 5)
    assert hits_of(vectors.exact_top_k(q, v, 5)) == want
    # Blocks of 16 and 7 rows cut both sides.
    blocked = vectors._block_join(q, v, [], 5, block=16, query_block=7)
    assert hits_of(vectors.rank_per_query(blocked, 5)) == want


def test_hits_are_ranked_by_their_rounded_score(spark):
    """Scores that are equal to six digits go by id, at the border of the list too."""
    near = [(1, 1e-4), (2, 0.0), (3, 2e-4), (4, 0.5)]
    v = spark.createDataFrame([(i, [1.0, y]) for i, y in near], "item_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert hits_of(vectors.exact_top_k(q, v, 3)) == {0: [2, 1, 3]}
    assert hits_of(vectors.exact_top_k(q, v, 3, (6,))) == {0: [1, 2, 3]}
    assert hits_of(vectors.exact_top_k(q, v, 1, (6,))) == {0: [1]}
    found = search.semantic_search(q, v.withColumnRenamed("item_id", "chunk_id"), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in found] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    # Rounded once: what nine digits would make a half stays below it.
    low = 0.7630764996
    v = spark.createDataFrame([(1, [low, (1 - low * low) ** 0.5])], "item_id long, embedding array<double>")
    assert vectors.exact_top_k(q, v, 1, (6,)).first().score == 0.763076
    assert vectors.exact_top_k(q, v, 1, (9, 6)).first().score == 0.763077


def test_scores_on_a_half_round_as_in_sql():
    """Whole counts give cosines that are exactly half a unit of the sixth digit; the order of summing decides."""
    import pyarrow as pa

    asked = np.array([2, 1, 3, 1, 1, 3, 0, 1, 0, 1, 2, 1]) / 32**0.5
    counts = [[11, 7, 9, 2, 8, 4, 10, 5, 4, 4, 4, 2], [5, 0, 2, 11, 11, 9, 11, 1, 0, 6, 1, 1],
              [4, 10, 5, 2, 10, 0, 2, 3, 8, 9, 3, 10], [1, 11, 5, 11, 0, 10, 0, 1, 1, 6, 5, 9]]
    q = pa.table({"query_id": [0], "embedding": [asked.tolist()]})
    s = pa.table({"item_id": range(4), "embedding": (np.array(counts) / 512**0.5).tolist()})
    with duckdb.connect() as con:
        want = con.sql("""select item_id, round(list_inner_product(q.embedding, s.embedding), 6) as score
            from q, s order by score desc, item_id""").fetchall()
    got = vectors._best(q, s, 4, (6,))
    assert list(zip(got["item_id"].to_pylist(), got["score"].to_pylist())) == want


def test_filtered_search_equals_brute_force(spark):
    from datetime import datetime

    q, q_rows = vector_table(spark, "query_id", 12, 1)
    v, v_rows = vector_table(spark, "item_id", 90, 2)
    day = lambda n: datetime(2023, 1, 1 + n)
    docs = [(i, "en" if i % 2 else "de", day(i % 20)) for i in range(30)]
    asked = {0: ("en", None, None, None), 1: (None, [1, 2, 3], None, None), 2: ("de", None, day(3), day(9)), 3: (None, [], None, None)}
    filters = spark.createDataFrame([(k, *f) for k, f in asked.items()],
                                    "query_id long, document_type string, document_ids array<long>, date_from timestamp_ntz, date_to timestamp_ntz")
    documents = spark.createDataFrame(docs, "doc_id long, document_type string, created_at timestamp_ntz")
    chunk_vectors = v.selectExpr("item_id as chunk_id", "item_id % 30 as doc_id", "embedding")
    got = hits_of(search.semantic_search(*search.with_filters(q, chunk_vectors, filters, documents), 6).withColumnRenamed("chunk_id", "item_id"))

    def fits(query, item):
        kind, ids, low, high = asked.get(query, (None,) * 4)
        i, t, d = docs[item % 30]
        return (kind in (None, t)) and (ids is None or i in ids) and (low is None or d >= low) and (high is None or d <= high)

    everything = brute(q_rows, v_rows, 90)
    want = {k: [i for i in items if fits(k, i)][:6] for k, items in everything.items()}
    assert got == {k: items for k, items in want.items() if items}


def test_approximate_search(spark):
    v, v_rows = vector_table(spark, "item_id", 200, 3)
    q = v.withColumnRenamed("item_id", "query_id")
    got = hits_of(vectors.approximate_top_k(q, v, 5, dim=8, bands=12, bits=4))
    want = brute(v_rows, v_rows, 5)
    assert all(got[i][0] == i for i in want)  # a vector always shares its own buckets
    recall = sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want))
    assert recall > 0.8


def test_hot_bucket_of_copies(spark):
    """A third of the vectors are one copy: blocks keep the answer exact."""
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100 + i, [float(i), 1.0]) for i in range(200)]
    v = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    blocked = vectors._block_join(q, v, [], 3, block=7)
    assert hits_of(vectors.rank_per_query(blocked, 3)) == {0: [0, 1, 2]}


def test_zero_vectors_score_zero(spark):
    q = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, embedding array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "item_id long, embedding array<double>")
    assert [(r.item_id, r.score) for r in vectors.exact_top_k(q, v, 2).orderBy("rank").collect()] == [
        (1, 0.0), (2, 0.0)]


def small_corpus(spark):
    chunks = spark.createDataFrame(
        [(1, 1, 0, "red apple tree"), (2, 1, 1, "red car"), (3, 2, 0, "green apple"),
         (4, 3, 0, "red apple pie apple")],
        "chunk_id long, doc_id long, chunk_index int, content string")
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "x")],
                                 "doc_id long, name string, document_type string").withColumn(
        "created_at", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(doc_id as int))"))
    return chunks, docs


def test_keyword_search_needs_every_term(spark):
    chunks, docs = small_corpus(spark)
    index, stats = lexical.postings(chunks), lexical.corpus_statistics(chunks)
    q = spark.createDataFrame([(1, "the red apple"), (2, "apple zebra"), (3, "the"), (4, "car")],
                              "query_id long, query_text string")
    got = {(r.query_id, r.chunk_id) for r in lexical.keyword_search(q, index, stats, 10).collect()}
    assert got == {(1, 1), (1, 4), (4, 2)}
    filters = spark.createDataFrame(
        [(1, None, [3], None, None), (4, "y", None, None, None)],
        "query_id long, document_type string, document_ids array<long>, date_from timestamp_ntz, "
        "date_to timestamp_ntz")
    allowed = search.document_filter(filters, docs)
    got = {(r.query_id, r.chunk_id) for r in lexical.keyword_search(q, index, stats, 10, allowed).collect()}
    assert got == {(1, 4)}


def test_index_missing_and_stemming(spark):
    chunks, _ = small_corpus(spark)
    index = lexical.postings(chunks.filter("chunk_id < 3"))
    assert {r.chunk_id for r in lexical.index_missing(chunks, index).collect()} == {3, 4}
    q = spark.createDataFrame([(1, "apples")], "query_id long, query_text string")
    stemmed = lexical.postings(chunks, stem=tx.plural_stem)
    found = lexical.keyword_search(q, stemmed, lexical.corpus_statistics(chunks), 10, stem=tx.plural_stem)
    assert {r.chunk_id for r in found.collect()} == {1, 3, 4}


def test_fusion_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, rank int")
    one = search.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    two = search.reciprocal_rank_fusion([b, a]).orderBy("rank").collect()
    assert one == two and [r.chunk_id for r in one] == [11, 10, 12]
    assert one[0].score == round(1 / 61 + 1 / 62, 9)


def test_first_occurrences_keys_tables_by_text(spark):
    rows = [(1, 5, 1, None, "x", 0, 2), (1, 5, 1, None, "x", 1, 1), (1, None, 1, 1, "t", 0, 3),
            (1, None, 1, 1, "t", 0, 4), (1, None, 1, 2, "t", 0, 5)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, page_number int, "
                                       "content string, branch int, rank int")
    got = sorted((r.branch, r.rank) for r in search.first_occurrences(hits).collect())
    assert got == [(0, 2), (0, 3), (0, 5)]


def test_substring_matches_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab c.") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    queries = ["a", "b.", "abc", "a b", "zz", "", "C.A", "aa b"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query_text string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.query_id, r.doc_id) for r in search.substring_matches(q, t, ["doc_id"]).collect()}
    want = {(i, j) for i, x in enumerate(queries) for j, y in enumerate(texts) if x and x.lower() in y}
    assert got == want


def test_compression(spark):
    text = "A one. B two. C one two. D none. E one. F two. A one. Tail"
    df = spark.createDataFrame([(text, "one two"), ("Short. Text", "x")], "c string, q string")
    got = [r[0] for r in df.select(search.compress(F.col("c"), F.col("q"), 3)).collect()]
    # Overlaps count whole words, so "one." is not "one"; ties keep the earlier sentence.
    assert got == ["A one. B two. C one two. A one.", "Short. Text"]


def test_model_pair_score(spark):
    scorer = search.model_pair_score(lambda: lambda q, c: [len(x) - len(y) for x, y in zip(q, c)])
    df = spark.createDataFrame([("abcd", "ab")], "q string, c string")
    assert df.select(scorer("q", "c")).first()[0] == 2.0


def test_confidence_limits(spark):
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id long")
    hits = spark.createDataFrame([(0, 0.7), (1, 0.4), (2, 0.39), (3, 0.9), (3, 0.1)],
                                 "query_id long, score double")
    got = {r.query_id: r.confidence for r in answers.confidence(q, hits).collect()}
    assert got == {0: "high", 1: "medium", 2: "low", 3: "high", 4: "low"}


def test_cache_lookup_equals_brute_force(spark):
    rnd = random.Random(3)
    base = np.datetime64("2024-01-01T00:00:00")
    times = [rnd.randint(0, 20000) for _ in range(300)]
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", int(s), i % 2) for i, s in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, key string, s long, kind int").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(s as decimal(18,6)))"))
    req = df.filter("kind = 0").select(F.col("id").alias("request_id"), "key", "ts")
    ans = df.filter("kind = 1").select(F.col("id").alias("answer_id"), "key", "ts")
    got = {r.request_id: r.answer_id for r in answers.cache_lookup(req, ans).collect()}
    for i, key, s, kind in rows:
        if kind == 0:
            best = max(((t, j) for j, k, t, m in rows if m == 1 and k == key and t <= s), default=None)
            assert got[i] == (best[1] if best and s - best[0] < 3600 else None)
    assert any(v is not None for v in got.values())
    assert base is not None


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limits_equal_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("aaab"), rnd.randint(0, 1200)) for i in range(300)]
    df = spark.createDataFrame(rows, "request_id long, caller string, s long").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(s as decimal(18,6)))"))
    got = {r.request_id: r.allowed for r in usage.admitted_only_limit(df, 5, 60).collect()}
    window = {}
    for i, caller, s in sorted(rows, key=lambda r: (r[2], r[0])):
        w = [x for x in window.get(caller, []) if s - x < 60]
        ok = len(w) < 5
        window[caller] = w + [s] if ok else w
        assert got[i] == ok
    assert not all(got.values())
    counted = {r.request_id: r.in_window for r in usage.sliding_window_limit(df, 5, 60).collect()}
    for i, caller, s in rows:
        assert counted[i] == sum(1 for j, c, x in rows if c == caller and s - 60 < x <= s) - 1


def test_lcs_equals_table():
    def table(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    rnd = random.Random(9)
    for _ in range(200):
        a = [rnd.choice("abc") for _ in range(rnd.randint(0, 15))]
        b = [rnd.choice("abc") for _ in range(rnd.randint(0, 15))]
        assert metrics.lcs_length(a, b) == table(a, b)


def test_exact_match_never_beats_f1(spark):
    pairs = [("The cat", "cat"), ("a dog!", "dog cat"), ("", ""), ("", "x"), ("same same", "same")]
    df = spark.createDataFrame(pairs, "p string, r string")
    for r in df.select(metrics.exact_match(F.col("p"), F.col("r")).alias("em"),
                       metrics.token_f1(F.col("p"), F.col("r")).alias("f1")).collect():
        assert r.em <= r.f1


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 3 == 0, "hot").otherwise("rest"))
    rows = samples.shuffled_rank(df, "id", ("s",), "x", prefix=1).collect()
    for s in ("hot", "rest"):
        mine = [r for r in rows if r.s == s]
        assert sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1))
        assert {r.n for r in mine} == {len(mine)}


def test_mixture_target():
    assert samples.mixture_target(700, 0.7, 6) == (300, 50)
    assert samples.mixture_target(10, 0.7, 6)[1] == 10


def test_prompt_format(spark):
    df = spark.createDataFrame([("do", "in", "out"), ("do", "  ", "out"), ("do", None, "out")],
                               "i string, n string, o string")
    got = [r[0] for r in df.select(samples.prompt_text(F.col("i"), F.col("n"), F.col("o"))).collect()]
    assert got[0] == "### Instruction:\ndo\n\n### Input:\nin\n\n### Response:\nout"
    assert got[1] == got[2] == "### Instruction:\ndo\n\n### Response:\nout"


def test_json_recovery(spark):
    texts = ['{"a": 1}', 'well {"a": 1} ok', "none", '{"a": ', "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(fields.recover_json(F.col("s"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', None, None, "[1]"]


def test_bio_span_edge_cases(spark):
    forms = spark.createDataFrame(
        [(1, list("abcdef"), ["I-X", "B-X", "I-Y", "O", "I-X", "B-Y"], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]),
         (2, [], [], [])],
        "doc_id long, words array<string>, labels array<string>, confidences array<double>")
    a = [(r.field_name, r.field_value) for r in fields.spans_until_break(forms).orderBy("pos").collect()]
    assert a == [("x", "b c"), ("y", "f")]
    b = [(r.field_type, r.field_value, r.confidence)
         for r in fields.spans_by_type(forms).orderBy("pos").collect()]
    assert b == [("X", "b e", 0.5), ("Y", "f", 0.4)]


def test_routing_threshold(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    light = spark.createDataFrame([(1, "Invoice", 0.7), (2, "Invoice", 0.69)],
                                  "doc_id long, category string, confidence double")
    back = spark.createDataFrame([(1, "Letter", 0.9), (2, "Memo", 0.5)],
                                 "doc_id long, category string, confidence double")
    ok, review = classify.route_by_confidence(docs, light, back)
    assert {(r.doc_id, r.document_type, r.method) for r in ok.collect()} == {
        (1, "Invoice", classify.LIGHT_METHOD), (2, "Other", classify.FALLBACK_METHOD)}
    assert [r.doc_id for r in review.collect()] == [3]


def test_light_classifier_learns(spark, data):
    docs = Tables(spark, data).documents.select("doc_id", "text", F.col("lang").alias("document_type"))
    pred = classify.predict_light(classify.fit_light_classifier(docs, max_iter=5), docs)
    right = pred.join(docs, "doc_id").filter("category = document_type").count()
    assert right > 0.9 * docs.count()


def test_cost_and_tokens(spark):
    df = spark.createDataFrame([("",), ("x" * 400,)], "s string")
    assert [r[0] for r in df.select(usage.estimated_tokens(F.col("s"))).collect()] == [1, 100]
    cost = usage.call_cost(F.lit("gemini_api"), F.lit(1_000_000), F.lit(1_000_000))
    assert abs(df.select(cost).first()[0] - 0.375) < 1e-12
    assert df.select(usage.call_cost(F.lit("local_finetuned"), F.lit(5), F.lit(5))).first()[0] == 0.0


def test_assignment_rules(spark):
    df = spark.range(2000).withColumn("k", F.col("id").cast("string"))
    one = df.select(usage.assigned_provider(F.col("k"), F.lit("summarization"), 0.3, 0.7).alias("p"))
    share = one.filter(F.col("p") == usage.HOSTED).count() / 2000
    assert 0.25 < share < 0.35
    away = usage.assigned_provider(F.col("k"), F.lit("chat"), 0.0, 1.0)
    assert df.select(away.alias("p")).distinct().collect()[0].p == usage.HOSTED
    gone = usage.assigned_provider(F.col("k"), F.lit("extraction"), 0.0, 1.0,
                                   forced=F.lit(usage.LOCAL), local_available=F.lit(False))
    assert df.select(gone.alias("p")).distinct().collect()[0].p == usage.HOSTED


def test_missing_embedding_follows_content(spark):
    chunks = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "chunk_id long, doc_id long, content string")
    stored = embedding.embed_chunks(chunks)
    changed = chunks.withColumn("content", F.when(F.col("chunk_id") == 2, "c").otherwise(F.col("content")))
    left = embedding.missing_embeddings(changed, stored, embedding.HASH_MODEL)
    assert [r.chunk_id for r in left.collect()] == [2]


def test_unpacked_steps(spark):
    runs = spark.createDataFrame(
        [("r1", "w", [("reasoning", None, "x" * 3000, None, 1.0), ("tool_call", "t", "y", "z" * 900, 2.0)])],
        "run_id string, workflow string, steps array<struct<step_type:string,tool_name:string,"
        "content:string,tool_result:string,duration_ms:double>>")
    rows = usage.step_rows(usage.unpacked_steps(runs)).orderBy("step").collect()
    assert [(r.step, len(r.content), len(r.tool_result or "")) for r in rows] == [(0, 2000, 0), (1, 1, 500)]


def test_index_is_counted_in_arrow_batches(spark):
    """No word is sorted, hashed or counted by a lambda of its own; empty, missing and odd texts count as before."""
    texts = ["b a b. Ünï ünï the", "", None, "the of", "a1 ٣x a1 a1 " * 3]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").withColumn("doc_id", F.col("chunk_id"))
    index = lexical.postings(chunks)
    got = {(r.chunk_id, r.term): (r.doc_id, r.tf, r.dl) for r in index.collect()}
    assert got == {(0, "b"): (0, 2, 4), (0, "ünï"): (0, 2, 4), (4, "a1"): (4, 9, 12), (4, "٣x"): (4, 3, 12)}
    assert [str(f.dataType) for f in index.schema] == ["LongType()", "LongType()", "StringType()", "IntegerType()", "IntegerType()"]
    for some in (chunks.filter("chunk_id <> 2"), chunks.filter("chunk_id in (1, 3)"), chunks.filter("false")):
        assert lexical.index_statistics(lexical.postings(some), some).first() == lexical.corpus_statistics(some).first()
    for plan in (index, embedding.embed_chunks(chunks)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "array_sort" not in text and "md5" not in text
    words = tx.lexemes(F.coalesce("content", F.lit("")), stop_words=())
    for r in chunks.select(embedding.hashed_embedding(F.col("content")).alias("e"), embedding.text_buckets(F.col("content")).alias("b"), words.alias("w")).collect():
        counts = np.bincount(r.b or [], minlength=embedding.DIM).astype(float)
        assert np.allclose(r.e, counts / (np.linalg.norm(counts) or 1.0))


def test_postings_stay_where_they_are_for_few_candidates(spark, monkeypatch):
    texts = ["red fox runs", "red fox", "blue fox runs red", "fox", "red runs"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").withColumn("doc_id", F.col("chunk_id"))
    asked = spark.createDataFrame([(0, "red fox"), (1, "runs"), (2, "green fox"), (3, "red runs red")], "query_id long, query_text string")
    index = lexical.postings(chunks).localCheckpoint()
    counts, found = lexical.index_statistics(index, chunks), []
    for most, reads in ((lexical.SENT_CANDIDATES, True), (0, False)):
        monkeypatch.setattr(lexical, "SENT_CANDIDATES", most)
        hits = lexical.keyword_matches(lexical.query_terms(asked), index, counts, frequencies=lexical.term_table(index))
        assert ("strategy=broadcast" in hits._jdf.queryExecution().analyzed().toString()) == reads
        found.append(sorted(map(tuple, hits.collect())))
    assert found[0] == found[1] and [(q, c) for q, c, *_ in found[0]] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (1, 4), (3, 0), (3, 2), (3, 4)]


def test_words_beside_chunks_find_the_same_without_a_shuffle_of_postings(spark, monkeypatch):
    """Building and matching shuffle nothing; scores are those of the long postings, also of more queries than travel."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("red fox runs blue green the a owl".split(), k=rng.randint(0, 9))) for _ in range(300)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").withColumn("doc_id", F.col("chunk_id") % 7)
    asked = spark.createDataFrame(
        [(i, " ".join(rng.choices("red fox runs blue green owl".split(), k=rng.randint(1, 4)))) for i in range(40)]
        + [(40, "absent fox"), (41, ""), (42, None)], "query_id long, query_text string")
    terms = lexical.query_terms(asked)
    index, packed = lexical.postings(chunks).localCheckpoint(), lexical.chunk_words(chunks)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, lexical.postings_of_words(packed).select(index.columns).collect())) == sorted(map(tuple, index.collect()))
    stats = lexical.index_statistics(packed, chunks)
    assert stats.first() == lexical.index_statistics(index, chunks).first()
    packed = packed.localCheckpoint().repartition(5)
    even = lambda c: c.filter("doc_id % 2 = 0")
    same = lambda df: sorted(map(tuple, df.collect()))
    for allowed in (None, even):
        wanted = same(lexical.keyword_matches(terms, index, stats, allowed))
        for most in (lexical.SENT_TERMS, 3):
            monkeypatch.setattr(lexical, "SENT_TERMS", most)
            assert same(lexical.keyword_matches(terms, packed, stats, allowed)) == wanted and wanted
        monkeypatch.undo()
    assert not same(lexical.keyword_matches(lexical.query_terms(asked.filter("query_id > 39")), packed, stats))
    assert not same(lexical.keyword_matches(terms, packed.filter("false"), stats))


def test_few_hits_travel_to_the_texts_of_chunks(spark, monkeypatch):
    """Contents and neighbours are fetched without a shuffle of all texts; more hits than travel give the same."""
    chunks = spark.range(60).select(
        F.col("id").alias("chunk_id"), F.floor(F.col("id") / 4).alias("doc_id"), (F.col("id") % 4).cast("int").alias("chunk_index"),
        F.concat(F.lit("text "), "id").alias("content")).localCheckpoint()
    docs = chunks.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("name")).distinct()
    hits = spark.createDataFrame([(q, c, 0.5, 1) for q, c in ((1, 0), (1, 59), (2, 5), (2, 0))], "query_id long, chunk_id long, score double, rank int")
    monkeypatch.setattr(search, "SENT_HITS", 12)
    found = []
    for most in (4, 13, None):
        shaped = search.attach_chunks(hits, chunks, docs, most)
        wide = search.expand_to_neighbours(shaped.localCheckpoint(), chunks, most_hits=most)
        for df in (shaped, wide):
            assert ("strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()) == (most == 4)
        found.append(sorted(tuple(r[c] for c in sorted(wide.columns)) for r in wide.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4
    assert {r.content for r in wide.filter("chunk_id = 5").collect()} == {"text 4\ntext 5\ntext 6"}


def test_words_of_arrow_batches_are_those_of_the_column_expression(spark):
    """Chunks, postings and queries take or leave every code point alike, and up to U+052F as the column expression."""
    texts = ["".join(f"a{chr(c)}b " for c in range(at, at + 256) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 256)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, "", " .", "the The", None])], "chunk_id long, content string")
    df = df.withColumn("doc_id", F.col("chunk_id")).repartition(8).localCheckpoint()
    words = {r.chunk_id: (r.words.split() if r.words else [], r.dl) for r in lexical.chunk_words(df).collect()}
    for r in df.select("chunk_id", tx.lexemes("content").alias("w")).filter(f"chunk_id < 5 or chunk_id >= {len(texts)}").collect():
        assert words[r.chunk_id] == (r.w or [], len(r.w or []))
    own = lambda df, key: {tuple(r) for r in df.select(key, "term").collect()}
    pairs = {(i, w) for i, (ws, _) in words.items() for w in ws}
    assert own(lexical.postings(df), "chunk_id") == pairs
    assert own(lexical.query_terms(df.withColumnsRenamed({"chunk_id": "query_id", "content": "query_text"})), "query_id") == pairs
    stemmed = lexical.chunk_words(df, stem=tx.plural_stem)
    assert own(lexical.postings_of_words(stemmed), "chunk_id") == own(lexical.postings(df, stem=tx.plural_stem), "chunk_id")


def test_stored_index_is_pruned_and_not_recounted(spark, data):
    """A search opens only the folders of its terms, and takes document frequencies from their table."""
    from doclattice.plans import load_all
    from doclattice.plans import search_queries as sq
    from doclattice.plans.registry import Tables

    load_all()
    t = Tables(spark, data)
    content = sq.v.chunks_v(t).filter("chunk_index = 0 and doc_id < 4")
    few = content.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", F.slice(F.split("content", " "), 1, 3)).alias("query_text"))
    found = lexical.keyword_search(few, sq.index_v(t), sq.stats_v(t), 10, frequencies=sq.terms_v(t))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line and "tf#" in line or "Scan parquet" in line and "chunk_id#" in line]
    assert scans and all("dynamicpruning" in line for line in scans)
    plain = lexical.keyword_search(few, sq.index_v(t).drop("part"), sq.stats_v(t), 10)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(found) == same(plain) and found.count()


def test_substring_paths_agree(spark, monkeypatch):
    rng = random.Random(12)
    texts = [(i, i % 3, "".join(rng.choice("abÄ c\n") for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(200, 0, None), (201, 0, "")]
    queries = [(i, "".join(rng.choice("abä c") for _ in range(rng.randrange(0, 5)))) for i in range(40)] + [(90, None), (91, "AB"), (92, "ab")]
    q = spark.createDataFrame(queries, "query_id long, query_text string")
    d = spark.createDataFrame(texts, "doc_id long, page_number int, text string")
    want = sorted((i, a, b) for i, p in queries for a, b, text in texts if p and text and p.lower() in text.lower())
    ids = ["doc_id", "page_number"]
    assert sorted(map(tuple, search.substring_matches(q, d, ids).collect())) == want
    monkeypatch.setattr(search, "PATTERN_CHARS", 0)  # the way for more queries than tasks are sent
    assert sorted(map(tuple, search.substring_matches(q, d, ids).collect())) == want
    assert search.substring_matches(q.limit(0), d, ids).count() == 0


def test_table_hits_fetch_their_texts_without_moving_them(spark):
    queries = spark.createDataFrame([(1, "red"), (2, "pie")], "query_id long, query_text string")
    tables = spark.createDataFrame([(i, 0, 0, "a Red pie" if i % 2 else "none") for i in range(20)],
                                   "doc_id long, page_number long, table_index long, text string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        hits = search.table_search(queries, tables, 2)
        assert "SortMergeJoin" not in hits._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r["rank"], r.doc_id, r.content) for r in hits.collect()) == [
            (q, n, d, "a Red pie") for q in (1, 2) for n, d in ((1, 1), (2, 3))]
    finally:
        spark.conf.set(limit, before)


def field_texts(spark, n=1500):
    rng = random.Random(25)
    parts = ["a.b%c", "@", "x.org", "mail-me", "+1", "1", "(555)", " 555", "-", ".", " ", "\n", "0199", "123", "12", "1999", "/", "Jan",
             "sEPt", "december", ",", "$", "USD", "EUR", "GBP", " EUR", "https://", "é", "Supplier#", "INVOICE ", "net "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_java_forms_of_field_patterns_find_the_same(spark):
    df = field_texts(spark)
    for pattern, form in fields._JAVA_FORMS.items():
        plain, fast = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (pattern, form))
        assert df.filter(F.size(plain) > 0).count() > 5 and df.filter(plain != fast).count() == 0


def test_amounts_do_not_grow_with_the_cube_of_a_number(spark):
    import time

    df = spark.createDataFrame([(1, "7" * 4000 + " $5")], "doc_id long, text string")
    start = time.time()
    found = fields.extract_patterns(df, patterns={"amount": fields.FIELD_PATTERNS["amount"]})
    assert [r.field_value for r in found.collect()] == ["$5"] and time.time() - start < 20


def test_merged_values_read_the_text_once(spark):
    df = field_texts(spark, 600)
    merged = fields.merged_values(df)
    parts = fields.merge_extractions(fields.extract_patterns(df), fields.entity_fields(fields.tag_entities(df)))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, parts.collect())) and parts.count() > 300
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_summaries_move_no_words(spark):
    """Sentences of all kinds against a plain count, and a plan without any shuffle."""
    from collections import Counter

    rng = random.Random(22)
    words = ["Apple", "pie", "the", "Tree", "house", "Über", "x1", "--"]
    texts = ["", None, "...", "No end"] + [
        ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(7))).capitalize() for _ in range(rng.randrange(14)))
        for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = docs.select("doc_id", F.transform(tx.sentences(F.col("text")), lambda s: F.struct(
        s.alias("s"), tx.lexemes(s).alias("w"))).alias("l")).collect()
    want = {}
    for doc, sents in lists:
        tf = Counter(w for s in sents or [] for w in s["w"])
        best = sorted((-round(sum(tf[w] for w in set(s["w"])) / len(set(s["w"])), 6) if s["w"] else 0.0, i) for i, s in enumerate(sents or []))
        for name, n in workflows.SUMMARY_SENTENCES.items():
            if best:
                kept = sorted(i for _, i in best[:n])
                want[doc, name] = (" ".join(sents[i]["s"] for i in kept), len(kept))
    found = workflows.extractive_summaries(docs)
    assert {(r.doc_id, r.level): (r.summary, r.n_sentences) for r in found.collect()} == want and len(want) > 300
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    scores = workflows.sentence_scores(docs)
    assert scores.columns == ["doc_id", "pos", "sentence", "score"] and scores.count() == sum(len(s or []) for _, s in lists)
