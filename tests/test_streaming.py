"""Streams over several batches against one-pass versions of what they compute."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from doclattice.operators import fields
from doclattice.sources import files
from doclattice.streaming import ingest, limiter, usage

START = datetime(2024, 1, 1)


def run_batches(spark, folder, schema, batches, build):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
             .format("parquet").option("path", f"{folder}/out").outputMode("append").start())
    query.awaitTermination()
    assert len(query.recentProgress) >= len(batches)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def brute_limit(rows, limit, seconds, count_rejected):
    times, out = {}, {}
    for i, caller, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [x for x in times.get(caller, []) if ts - x < timedelta(seconds=seconds)]
        ok = len(own) < limit
        out[i] = (len(own), ok)
        times[caller] = own + [ts] * (ok or count_rejected)
    return out


@pytest.mark.parametrize("count_rejected", [True, False])
def test_rate_limit_waits_for_late_rows(spark, tmp_path, count_rejected):
    rng = random.Random(4)
    rows = [(i, rng.randrange(5), START + timedelta(seconds=rng.randrange(3600))) for i in range(400)]
    rows.sort(key=lambda r: r[2])
    pieces = [rows[k * 100:(k + 1) * 100] for k in range(4)]
    # The second piece arrives before the first, and some rows of the third with the fourth.
    late = [r for r in pieces[2] if r[0] % 5 == 0]
    batches = [pieces[1], pieces[0], [r for r in pieces[2] if r not in late], pieces[3] + late,
               [(-1, 99, START + timedelta(days=30))]]
    schema = "request_id long, caller long, ts timestamp"
    out = run_batches(spark, str(tmp_path), schema, batches,
                      lambda s: limiter.rate_limit(s, 3, 60, count_rejected, "2 hours"))
    assert {r.request_id: (r.in_window, r.allowed) for r in out if r.request_id >= 0} == brute_limit(rows, 3, 60, count_rejected)


def test_cached_answers_gives_each_request_its_newest_answer(spark, tmp_path, monkeypatch):
    """One row a request, however many answers its key has; late rows, equal times and missing keys included."""
    monkeypatch.setattr(limiter, "CALLER_STATES", 2)
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", None]), START + timedelta(seconds=rng.randrange(900) * 4), rng.random() < 0.5)
            for i in range(600)]
    rows.sort(key=lambda r: r[2])
    pieces = [rows[k * 150:(k + 1) * 150] for k in range(4)]
    late = [r for r in pieces[2] if r[0] % 5 == 0]
    batches = [pieces[1], pieces[0], [r for r in pieces[2] if r not in late], pieces[3] + late,
               [(-1, None, START + timedelta(days=30), None)]]

    def build(s):
        asked, given = s.filter("asked or asked is null"), s.filter("not asked or asked is null")
        return limiter.cached_answers(asked.withColumnRenamed("id", "request_id"),
                                      given.withColumnRenamed("id", "answer_id"), 300, "2 hours")

    out = run_batches(spark, str(tmp_path), "id long, key string, ts timestamp, asked boolean", batches, build)
    want = {}
    for i, key, ts, asked in rows:
        held = [(t, n) for n, k, t, question in rows if not question and key is not None and k == key
                and t <= ts < t + timedelta(seconds=300)]
        if asked and held:
            want[i] = (key, ts, max(held)[1], max(held)[0])
    assert len(out) == len(want) and len(want) > 100
    assert {r.request_id: (r.key, r.ts, r.answer_id, r.answer_ts) for r in out} == want


def test_rate_limit_shares_states(spark, tmp_path, monkeypatch):
    """Callers in few states get the verdicts of their own; a missing caller and long numbers are callers too."""
    monkeypatch.setattr(limiter, "CALLER_STATES", 2)
    rng = random.Random(8)
    who = [None, 2**60, 2**60 + 1, 1, 2, 3, 4]
    rows = [(i, rng.choice(who), START + timedelta(seconds=rng.randrange(1200))) for i in range(400)]
    rows.sort(key=lambda r: r[2])
    out = run_batches(spark, str(tmp_path), "request_id long, caller long, ts timestamp",
                      [rows[:200], rows[200:], [(-1, 99, START + timedelta(days=30))]],
                      lambda s: limiter.rate_limit(s, 3, 60, True, "2 hours"))
    found = [r for r in out if r.request_id >= 0]
    assert {r.request_id: (r.in_window, r.allowed) for r in found} == brute_limit(rows, 3, 60, True)
    assert {r.request_id: r.caller for r in found} == {i: c for i, c, _ in rows}


def test_first_arrivals_over_batches(spark, tmp_path):
    batches = [[(k % 7, "a" if k % 2 else "b") for k in range(n, n + 10)] for n in (0, 3, 11)]
    out = run_batches(spark, str(tmp_path), "user_id long, event_type string", batches,
                      lambda s: usage.first_arrivals(s, ["user_id", "event_type"]))
    assert sorted(map(tuple, out)) == sorted({r for b in batches for r in b})


@pytest.fixture
def rocksdb(spark):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(store, before)


def test_alarm_stream_over_batches(spark, tmp_path, rocksdb):
    """Consecutive breaches across batches, two alarms, a gap between periods, and late rows."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), START + timedelta(seconds=60 * p + rng.randrange(60)), 1.0) for p in list(range(25)) + list(range(28, 50)) for _ in range(rng.randrange(1, 9))]
    rows.sort(key=lambda r: r[1])
    late = [r for k, r in enumerate(rows[:150]) if k % 10 == 0]
    batches = [[r for k, r in enumerate(rows[:150]) if k % 10], rows[150:] + late, [("end", START + timedelta(days=3), 1.0)]]
    out = run_batches(spark, str(tmp_path), "alarm string, ts timestamp, value double", batches,
                      lambda s: usage.alarm_stream(s, "sum", ">", 2.0, 60, 3, "1 hour"))
    want, first = {}, int(START.replace(tzinfo=timezone.utc).timestamp()) // 60
    for alarm, ts, value in rows:
        key = (alarm, first + int((ts - START).total_seconds()) // 60)
        want[key] = want.get(key, 0) + value
    breach = lambda a, p: want.get((a, p), 0) > 2
    got = {(r.alarm, r.period): (r.value, r.breach, r.in_alarm) for r in out if r.alarm != "end"}
    assert got == {(a, p): (n, breach(a, p), all(breach(a, p - k) for k in range(3))) for (a, p), n in want.items()}
    assert sum(v[2] for v in got.values())


def test_new_keys_and_counts_stand_in_tables(spark, tmp_path):
    """First arrivals over batches with keys that stay away for long, NULL keys, and a repeated batch."""
    batches = [[(1, "a"), (1, "a"), (None, "a"), (2, "b")], [(3, "c")], [(3, "c"), (1, "a")], [(None, "a"), (4, None)]]
    path = str(tmp_path / "keys")
    for n in (0, 1, 2, 2, 3, 1):  # two batches come again
        usage.keep_new(spark.createDataFrame(batches[n], "user_id long, event_type string"), n, path, ["user_id", "event_type"])
    got = [(r.user_id, r.event_type) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == sorted({r for b in batches for r in b}, key=str)
    path = str(tmp_path / "counts")
    for n in (0, 1, 2, 2, 3, 1):
        usage.count_batch(spark.createDataFrame(batches[n], "doc_id long, event_type string"), n, path)
    rows = [r[0] for b in batches for r in b]
    assert {r.doc_id: r.access_count for r in usage.counted(spark, path).collect()} == {k: rows.count(k) for k in set(rows)}


def test_fan_out_retries_and_dead_letters(spark, tmp_path):
    root = str(tmp_path)
    pages = spark.createDataFrame([("d1", "p1", "mail me@example.org"), ("d2", "p2", "nothing")], "doc_id string, path string, text string")
    calls = []

    def flaky(rows):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("busy")
        return rows.select("doc_id")

    def broken(rows):
        return rows.select(F.raise_error(F.lit("no model")).cast("string").alias("doc_id"))

    sinks = {"fields": fields.extract_patterns, "types": flaky, "scores": broken}
    ingest.fan_out(pages, 0, root, sinks)
    tries = {r.sink: (r.tries, r.error is None) for r in spark.read.parquet(f"{root}/attempts").collect()}
    assert tries == {"fields": (1, True), "types": (3, True), "scores": (3, False)}
    assert [r.field_value for r in spark.read.parquet(f"{root}/fields").collect()] == ["me@example.org"]
    letters = spark.read.parquet(f"{root}/dead_letters")
    assert sorted((r.doc_id, r.sink, r.tries) for r in letters.collect()) == [("d1", "scores", 3), ("d2", "scores", 3)]
    ingest.fan_out(pages, 0, root, sinks)  # the batch again: the same tables
    assert spark.read.parquet(f"{root}/fields").count() == 1 and spark.read.parquet(f"{root}/types").count() == 2
    assert spark.read.parquet(f"{root}/dead_letters").count() == 2


def test_ingest_batches_read_their_own_folders(spark, tmp_path):
    """A first batch without any page, later ones beside a batch whose files cannot be read any more."""
    inbox, root = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    for n, (name, body) in enumerate([("a.exe", "MZ"), ("b.txt", "one two"), ("c.txt", "three")]):
        (inbox / name).write_text(body)
        batch = spark.read.format("binaryFile").load(str(inbox / name))
        ingest.ingest_batch(batch, n, root, sinks={"fields": fields.extract_patterns})
        if n == 1:
            for file in (tmp_path / "out" / "files" / "batch_id=1").glob("*.parquet"):
                file.write_bytes(b"no table")
    assert [r.reason for r in spark.read.parquet(f"{root}/rejected").collect()] == [
        "Unsupported file type: application/octet-stream"]
    assert sorted((r.batch_id, r.text) for r in spark.read.parquet(f"{root}/pages").collect()) == [(1, "one two"), (2, "three")]
    assert sorted(r.content for r in spark.read.parquet(f"{root}/chunks").collect()) == ["one two", "three"]
    assert spark.read.parquet(f"{root}/embeddings").count() == 2


def test_list_new_lists_as_spark_does(spark, tmp_path, monkeypatch):
    """Nested folders, hidden names, files without bytes, odd names; a second call adds what is new."""
    monkeypatch.setattr(ingest, "PART_FILES", 2)
    inbox, root = tmp_path / "in box", str(tmp_path / "out")
    bodies = {"a.txt": b"one", "x/b.txt": b"two \xff", "x/y/c %20.csv": b"a,b\n1,2", "x/y/\u00e4.txt": b"f\xc3\xbcnf", "x/empty.txt": b"",
              "x/.hidden": b"h", "_tmp/d.txt": b"d", "k=1/_e=2.txt": b"e", "_metadata_x/f.txt": b"f", "x/g.txt._COPYING_": b"g"}
    for name, body in bodies.items():
        (inbox / name).parent.mkdir(parents=True, exist_ok=True)
        (inbox / name).write_bytes(body)
    (inbox / "nothing").mkdir()

    def listed():
        ingest.list_new(spark, str(inbox), root)
        return spark.read.parquet(f"{root}/listed").drop("day")

    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(inbox))
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, files.read_listed(listed()).collect())) == want and len(want) == 6
    assert sorted(map(tuple, listed().collect())) == [row[:3] for row in want]  # nothing is new
    (inbox / "x" / "y" / "late.txt").write_bytes(b"late")
    (inbox / "a.txt").write_bytes(b"changed")
    assert listed().count() == 7 and listed().select("path").distinct().count() == 7
    parts = listed().groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in parts) <= 2
    with pytest.raises(Exception, match="No such file"):
        ingest.list_new(spark, str(tmp_path / "no inbox"), root)


def test_listed_files_in_batches(spark, tmp_path, monkeypatch):
    """Batches of whole parts over two runs; an inbox without files is no batch."""
    monkeypatch.setattr(ingest, "PART_FILES", 2)
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    (inbox / "f").mkdir(parents=True)

    def run():
        ingest.list_new(spark, f"file://{inbox}", root)
        stream = ingest.listed_files(spark, root, files_per_batch=4)
        ingest.start_ingest(stream, root, f"{root}/state", available_now=True).awaitTermination()

    run()
    for n in range(11):
        (inbox / "f" / f"{n}.txt").write_text(f"text {n}")
    run()
    (inbox / "last.txt").write_text("text 11")
    run()
    run()
    pages = spark.read.parquet(f"{root}/pages")
    assert sorted(r.text for r in pages.collect()) == sorted(f"text {n}" for n in range(12))
    sizes = [r["count"] for r in pages.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert max(sizes) <= 4 and len(sizes) >= 4 and sizes[-1] == 1


def test_inbox_is_listed_in_tasks(spark, data, tmp_path, monkeypatch):
    """What the stream keeps on the driver are parts of a listing, and no folder of the inbox grows with the documents."""
    import json

    import __spark_entry__

    query = __spark_entry__.queries()["str_01_incremental_ingest"]
    from doclattice.plans import source_queries

    monkeypatch.setattr(source_queries, "FILE_DOCUMENTS", 20)
    monkeypatch.setattr(source_queries, "fresh_folder", lambda t, name: str(tmp_path / name))
    done = sum(r.files for r in query(spark, data).collect() if r.kind == "txt")
    documents = spark.read.parquet(f"{data}/documents.parquet").count()
    assert done == documents >= 200
    folders = [len([x for x in folder.iterdir() if x.is_file()]) for folder in (tmp_path / "inbox").rglob("*") if folder.is_dir()]
    assert sum(folders) > documents and max(folders) <= 60
    kept = [json.loads(line) for log in (tmp_path / "ingested" / "state" / "sources" / "0").glob("[0-9]*")
            for line in log.read_text().splitlines()[1:]]
    assert 0 < len(kept) <= 20
