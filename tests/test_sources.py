"""File sources, sinks and the ingest stream on small files."""

import json

from pyspark.sql import functions as F

from doclattice.operators import chunking
from doclattice.sources import adapters, files, tabular, writers
from doclattice.streaming import ingest


def test_text_pages_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "good.txt").write_text("Grüße\nTwo", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"ok \xff end")
    (tmp_path / "empty.txt").write_bytes(b"")
    pages = files.text_pages(files.read_blobs(spark, str(tmp_path), "*.txt"))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in pages.collect()}
    assert got["good.txt"] == ("Grüße\nTwo", "utf-8")
    assert got["bad.txt"] == ("ok � end", "utf-8/replaced")
    assert "empty.txt" not in got  # no bytes, no row


def test_csv_pages_and_dead_letters(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("name,email,age\nAnn,a@x.org,31\nBob,b@x.org,old\nCid,,40\n")
    schema = spark.createDataFrame([], "name string, email string, age int").schema
    good, dead = tabular.read_csv(spark, str(path), schema)
    assert [r.line for r in dead.select("line", "name").collect()] == ["Bob,b@x.org,old"]
    rows = tabular.as_cells(good, ["name", "email", "age"])
    page = tabular.tabular_pages(rows, ("name", "email", "age")).collect()
    assert [r.text for r in page] == [
        "Columns: name | email | age\n\nAnn | a@x.org | 31\nCid | nan | 40"]
    head = tabular.table_heads(rows, ("name", "email", "age"), 1).select("table.*").first()
    assert head.total_rows == 2 and head.total_columns == 3 and len(head.rows) == 1


def test_routing_and_validation(spark):
    df = spark.createDataFrame(
        [(1, "application/pdf", 10), (2, "text/csv", 60 * 2**20), (3, "image/png", 1), (4, None, 1)],
        "file_id long, mime_type string, size_bytes long")
    routed, rejected = files.route_by_mime(df)
    assert {(r.file_id, r.extractor) for r in routed.collect()} == {(1, "pdf"), (2, "csv")}
    assert {r.file_id for r in rejected.collect()} == {3, 4}
    ok, errors = files.validate_uploads(df)
    assert {r.file_id for r in ok.collect()} == {1} and errors.count() == 3


def test_writing_a_batch_twice(spark, tmp_path):
    df = spark.range(10).withColumn("batch_id", F.col("id") % 2)
    writers.write_table(df, str(tmp_path / "t"))
    writers.write_table(df.filter("batch_id = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_ingest_in_two_runs_equals_batch(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    long_text = " ".join(f"word{i}" for i in range(900))
    (inbox / "a.txt").write_text(long_text)
    (inbox / "blank.txt").write_text("  \n ")

    def run():
        stream = ingest.new_files(spark, str(inbox))
        ingest.start_ingest(stream, root, str(tmp_path / "state"), available_now=True).awaitTermination()

    run()
    (inbox / "b.txt").write_text("short one")
    run()
    chunks = spark.read.parquet(f"{root}/chunks")
    page = spark.createDataFrame([(1, 1, long_text)], "doc_id long, page_number int, text string")
    want = chunking.fixed_size_chunks(page).count() + 1
    assert chunks.count() == want == spark.read.parquet(f"{root}/embeddings").count()
    assert spark.read.parquet(f"{root}/rejected").select("reason").collect()[0].reason == "no text"
    assert spark.read.parquet(f"{root}/postings").select("chunk_id").distinct().count() == want


def test_csv_text_in_a_value(spark):
    rows = [("a,b\n1,\"x, \"\"y\"\"\"\n\n2,\n",), ("",), ("only",), (None,)]
    out = spark.createDataFrame(rows, "t string").select(tabular.csv_text(F.col("t")).alias("p")).collect()
    assert [r.p for r in out] == ['Columns: a | b\n\n1 | x, "y"\n2 | nan', None, "Columns: only\n\n", None]


def test_text_files_are_bounded(spark, data, monkeypatch):
    import __spark_entry__

    assert "src_01_text_files" in __spark_entry__.queries()  # loads the queries in their order
    from doclattice.plans import source_queries
    from doclattice.plans.registry import Tables

    monkeypatch.setattr(source_queries, "FILE_DOCUMENTS", 3, raising=False)
    tables = Tables(spark, data)
    heads = spark.read.text(source_queries.text_files(tables, "bounded")).select(F.input_file_name().alias("path"), "value")
    heads = heads.filter(F.col("value").rlike("^# [0-9]+$"))
    assert heads.count() == tables.documents.filter("text is not null").count()
    assert heads.groupBy("path").count().agg(F.max("count")).first()[0] <= 3


def test_parts_of_a_folder_are_numbered_in_small_blocks(spark, tmp_path, monkeypatch):
    """Part files of a folder are one file in the order of their names, whatever blocks their lines are cut into."""
    monkeypatch.setattr(tabular, "BLOCK_ROWS", 3)
    folder = tmp_path / "table"
    folder.mkdir()
    lines = [f"r{i}" for i in range(23)]
    for n, (low, high) in enumerate([(0, 10), (10, 12), (12, 23)]):
        (folder / f"part-0000{n}.csv").write_text("\n".join(["a", *lines[low:high]]) + "\n")
    good, _ = tabular.read_csv(spark, str(folder))
    cells = tabular.folder_parts(tabular.as_cells(good, ["a"]))
    assert cells.groupBy("file", "block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 3
    pages = {r.page_number: r.text for r in tabular.tabular_pages(cells, ("a",), 8).collect()}
    assert pages == {k + 1: "Columns: a\n\n" + "\n".join(lines[k * 8:k * 8 + 8]) for k in range(3)}


def test_receipts_are_parsed_once(spark):
    """Every text is parsed once and every list read once; odd groups and values give the rows they gave."""
    from doclattice.operators import samples

    texts = ['{"gt_parse": {"menu": [{"nm": " a ", "n": 1}, "x", null, {"nm": "", "p": "b"}], "t": {"q\\"": "c\\td"}, "z": null}}',
             '{"m": {"k": "v"}}', "[1]", "broken", "{}", None]
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id long, ground_truth string")
    fields = adapters.receipt_fields(raw)
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "size(" not in plan
    got = {(r.doc_id, r.group, r.item, r.field_name, r.field_value) for r in fields.collect()}
    assert got == {(0, "menu", 0, "menu.nm", "a"), (0, "menu", 3, "menu.p", "b"), (0, "t", 0, 't.q"', "c\td"), (1, "m", 0, "m.k", "v")}
    records = adapters.receipt_records(fields).select("doc_id", samples.fields_as_json("fields").alias("j"))
    assert {r.doc_id: json.loads(r.j) for r in records.collect()} == {
        0: {"menu.nm": "a", "menu.p": "b", 't.q"': "c\td"}, 1: {"m.k": "v"}}
