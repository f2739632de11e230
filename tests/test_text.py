"""Cleaning and sentence rules against plain-Python models of the described behaviour."""

import re

from pyspark.sql import functions as F

from doclattice.functions import text as tx

SAMPLES = [
    "", "   ", "Page 3 of 10\nHello", "Hello\n- 5 -\nWorld", "a\n5/10\nb", "Pg. 7\nx",
    "CONFIDENTIAL report\nbody", "Confidential: keep\nbody", "copyright COPYing sample",
    "© 2024 Acme Inc. All Rights Reserved\ntext", "Printed on 1/2/2024 by me\nx",
    "a______b-----c=====d.....e____f", "x\n\n\n\n\ny  \nz\t\n", "\f\fpage \n 12 \nend",
    "tail \r\n\n 3\n", "12\n7\nreal text\n99\n5", "1\n2\n3",
]


def python_clean(text):
    numbers = [r"(?im)^\s*(?:Page|Pg\.?)\s*\d+\s*(?:of\s*\d+)?\s*$", r"(?m)^\s*-?\s*\d+\s*-?\s*$",
               r"(?m)^\s*\d+\s*/\s*\d+\s*$"]
    marks = [r"(?i)(?:CONFIDENTIAL|DRAFT|SAMPLE|COPY|DO NOT DISTRIBUTE|INTERNAL USE ONLY)",
             r"(?i)(?:WATERMARK|PRIVILEGED|NOT FOR DISTRIBUTION)"]
    heads = [r"(?im)^\s*(?:Confidential|Proprietary|Internal).*$",
             r"(?im)^\s*©\s*\d{4}.*(?:All Rights Reserved|Inc\.|LLC|Ltd).*$",
             r"(?im)^\s*(?:Printed|Generated)\s+(?:on|at)\s+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}.*$"]
    for p in [*numbers, *marks, *heads, r"\f", r"_{5,}", r"-{5,}", r"={5,}", r"\.{5,}"]:
        text = re.sub(p, "", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return re.sub(r"(?m)[ \t]+$", "", text).strip()


def test_clean_text_matches_model(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", tx.clean_text(F.col("s")).alias("c")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == python_clean(s), s


def test_null_text_passes_through(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(tx.clean_text(F.col("s"))).first()[0] is None


def test_page_edges(spark):
    df = spark.createDataFrame(
        [("12\n7\nbody\n99\n5", 1, 1), ("12\nbody\n99", 1, 2), ("12\nbody\n99", 2, 2), ("1\n2", 1, 3),
         ("12345\nbody", 1, 1)], "s string, p int, n int")
    got = [r[0] for r in df.select(tx.trim_page_edges(F.col("s"), F.col("p"), F.col("n"))).collect()]
    assert got == ["body", "body\n99", "12\nbody", "", "12345\nbody"]


def test_sentences(spark):
    texts = ["One. Two! Three? four. Five", "No break.here. \n\nYes", "  A. B. C.  ", "Äh. Öl. Up."]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(tx.sentences(F.col("s"))).collect()]
    want = [[x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t) if x.strip()] for t in texts]
    assert got == want


def test_word_pieces_are_lossless(spark):
    texts = ["a b", "  lead and trail  ", "x", "tab\tand wide \n"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", tx.word_pieces(F.col("s")).alias("p"), tx.word_count(F.col("s")).alias("n"))
    for r in rows.collect():
        assert "".join(r.p) == r.s and len(r.p) == r.n == len(r.s.split())


def test_blank_chars_equal_blank_class(spark):
    chars = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert set(chars) == set(tx.BLANK_CHARS)
    df = spark.createDataFrame([(c,) for c in chars], "s string")
    assert df.filter(tx.is_blank(F.col("s")) & (tx.strip(F.col("s")) == "")).count() == len(chars)


def test_multiset_overlap(spark):
    from collections import Counter

    pairs = [("a a b", "a b b"), ("", "a"), ("x y z", "z y x"), ("a a a", "a a"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(
        tx.multiset_overlap(tx.words(F.col("a")), tx.words(F.col("b")))).collect()]
    assert got == [sum((Counter(a.split()) & Counter(b.split())).values()) for a, b in pairs]


def test_plural_stem(spark):
    words = {"flies": "fly", "dishes": "dishe", "cats": "cat", "class": "class", "bus": "bus",
             "shoes": "shoe", "trees": "tree"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", tx.plural_stem(F.col("w")).alias("s")).collect()}
    assert got["flies"] == "fly" and got["cats"] == "cat" and got["class"] == "class"
    assert got["bus"] == "bus"


def test_java_forms_match_what_the_patterns_match(spark):
    """Random texts out of the parts that the patterns are about: the faster forms leave the same text."""
    import random

    rng = random.Random(24)
    parts = ["\n", "\n\n\n", " ", "\t", "-", "12", "7", "/", "Page", "pg.", " of ", "DRAFT", "copy", "Do Not Distribute", "sAMPLE",
             "INTERNAL USE ONLY", "confidential", "privileged", "Watermark", "not for distribution", "____", "__", "---", "--",
             "===", "==", "....", "..", "\f", " ", "é", "©", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    groups = (tx.PAGE_NUMBER_PATTERNS, tx.WATERMARK_PATTERNS, tx.NOISE_PATTERNS)
    for patterns in groups:
        plain = F.col("text")
        for p in patterns:
            plain = F.regexp_replace(plain, "(?d)" + p, "")
        assert df.filter(tx.remove_all(F.col("text"), patterns) != plain).count() == 0


def test_cleaning_does_not_grow_with_the_cube_of_blank_lines(spark):
    import time

    df = spark.createDataFrame([("a\n" + " \n" * 2500 + "b",)], "text string")
    start = time.time()
    assert df.select(tx.remove_page_numbers(F.col("text"))).first()[0] == "a\n" + " \n" * 2500 + "b"
    assert time.time() - start < 20
