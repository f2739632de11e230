"""The whole pipeline on a small folder with every odd case."""

import random

import pytest

import corpus_pipeline

CLEAN = ["river", "stone", "garden", "window", "paper", "music", "table", "morning", "forest", "bridge", "letter", "winter"]
BAD = ["vilegrub", "scumfoul", "rotslur", "hatemuck"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, shard string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    text = lambda n, words: " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))
    rows = {i: text(80, CLEAN) for i in [*range(120), *range(2000, 2500)]}
    toxic = set(range(1000, 1350))
    rows |= {i: text(12, CLEAN) + " " + " ".join(rng.choice(BAD) for _ in range(25)) + " " + text(8, CLEAN) for i in toxic}
    passage = " ".join(f"q{k}" for k in range(40))
    rows |= {300: text(30, CLEAN) + " " + passage + " " + text(30, CLEAN)}
    near = rows[5].split()
    rows |= {310: rows[4], 311: " ".join([*near[:40], "changed", *near[41:]])}
    rows |= {320: rows[7] + " password: hunter2secretvalue", 330: "", 331: None, 332: "word " * 3000}
    listed = [*rows.items(), (None, text(60, CLEAN)), (None, text(60, CLEAN)), (7, text(70, CLEAN)), (330, "")]
    path = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, "en", f"src{(i or 0) % 4}", None if t is None else len(t), 5, "x") for i, t in listed]
    spark.createDataFrame(full, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in [*range(120), *range(2000, 2500), *toxic]] + [(None, 1, 1), (5, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, listed, toxic


def test_stages_follow_one_another(spark, folder):
    path, listed, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path), name.replace(" ", "-"))
        assert docs.columns == columns
        kept[name] = docs.select("doc_id", "text").collect()
    ids = lambda name: [r.doc_id for r in kept[name]]
    after = ids("toxicity")
    gone = toxic - set(after)
    assert len(after) == len(listed) - len(gone) and len(gone) >= 0.8 * len(toxic), len(gone)  # toxic ones go, no clean one
    after = ids("near duplicates")
    assert {310, 311}.isdisjoint(after) and {4, 5, 300, 331, 332} <= set(after)
    assert after.count(7) == 2 and after.count(None) == 2  # different texts under one id, and without one
    after = ids("decontamination")
    assert 300 not in after and len(after) == len(ids("near duplicates")) - 1
    assert len(ids("secret scans")) == len(after)
    assert not any("hunter2secretvalue" in (r.text or "") for r in kept["secret scans"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == set(after)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
    assert sorted(map(str, corpus_pipeline.run(spark, path).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        str(r) for r in spark.createDataFrame([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed], "doc_id long, piece int, length long, ids_crc32 long").collect())


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
