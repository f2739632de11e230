"""Small tables with every odd case, and brute-force versions of what the operators compute."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def make_docs(spark, rows, extra=""):
    """rows: (doc_id, text). Columns of documents, and ones whose names the operators use."""
    full = [(i, t, "en", f"src{(i or 0) % 5}", None if t is None else len(t), 7) for i, t in rows]
    return spark.createDataFrame(full, DOCS + ", score long")


def odd_texts(seed=1, n=40, vocabulary=60, length=120):
    """Random texts with shared passages, exact and near copies, and NULL, empty, blank, long ones."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(vocabulary)] + ["Über", "naïve", "日本", "a", "A"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = text(60), text(30)
    out = []
    for i in range(n):
        body = [text(rng.randrange(5, length)), passage if i % 4 == 0 else "", line if i % 3 == 0 else "", text(rng.randrange(3, 40))]
        out.append("\n".join(b for b in body if b))
    out += [out[3], out[3], out[5] + " tail", out[5].replace("w1 ", "w2 ", 1)]
    out += [None, "", "   \n\t ", "one", "one", "two words", "x " * 300, "z" * 900, text(4000), passage, "é" * 300]
    return list(enumerate(out))


def by_id(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    return {r[0]: tuple(r)[1:] for r in rows}, len(rows)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
