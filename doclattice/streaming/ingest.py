"""Incremental ingest: new files to pages, chunks, postings and vectors, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclattice.functions import text as tx
from doclattice.operators import chunking, embedding, lexical
from doclattice.sources import files, tabular, writers


def new_files(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """Stream of files that appear under ``path``. The driver lists and remembers every file: for large
    inboxes :func:`list_new` and :func:`listed_files`."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


#: Most files of a part of a listing; batches read whole parts.
PART_FILES = 1000


def list_new(spark: SparkSession, path: str, root: str) -> None:
    """Add the files below ``path`` that no earlier call has listed to the table ``root``/listed.

    Folders are listed level by level in tasks, so the driver holds neither files nor folders. A folder
    is listed by one task: a large inbox should spread its files over folders. As in a file stream of
    Spark, a path is new once, hidden names and files without bytes are left out. A call that broke off
    is made again: what it had added counts as listed.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, levels = spark.createDataFrame([(files.spark_path(path),)], "path string"), []
    while not levels or not folders.isEmpty():
        # As in Spark's listing, a folder may go meanwhile, but the inbox has to be there.
        entries = files.folder_entries(folders.repartition(tasks), may_be_gone=bool(levels))
        levels.append(f"{root}/walk/{len(levels)}")
        entries.write.mode("overwrite").parquet(levels[-1])
        folders = spark.read.parquet(levels[-1]).filter("folder").select("path")
    found = spark.read.parquet(*levels).filter("not folder and length > 0").drop("folder")
    try:
        known = spark.read.schema(files.LISTED).parquet(f"{root}/listed")
        found = found.join(known, "path", "left_anti")
    except AnalysisException as missing:  # the first call
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    # By day, as tasks without rows then write no part, which would be an empty batch.
    found.withColumn("day", F.current_date()).write.mode("append").option(
        "maxRecordsPerFile", PART_FILES).partitionBy("day").parquet(f"{root}/listed")


def listed_files(spark: SparkSession, root: str, files_per_batch: int = 100_000) -> DataFrame:
    """Stream of the files that :func:`list_new` adds. The driver sees parts of the listing, not files."""
    listed = (
        spark.readStream.schema(f"{files.LISTED}, day date")
        .option("maxFilesPerTrigger", max(1, files_per_batch // PART_FILES))
        .parquet(f"{root}/listed")
    )
    return files.read_listed(listed)


#: Extractors that work on bytes alone; the others need an engine this package does not bring.
READABLE = ("txt", "csv")


def routed(batch: DataFrame) -> DataFrame:
    """Files with mime_type (by leading bytes, then by extension) and extractor (NULL: none)."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in files.EXTENSIONS.items() for x in pair])
    lead = F.hex(F.substring("content", 1, 4))
    mime = (
        F.when(lead == "25504446", "application/pdf")
        .when((lead == "504B0304") & ~extension.isin("docx", "xlsx"), "application/zip")
        .otherwise(F.coalesce(known[extension], F.lit("application/octet-stream")))
    )
    typed = batch.withColumn("mime_type", mime)
    return typed.withColumn("extractor", files.extractor_of(F.col("mime_type")))


#: How often the work on a batch's pages is tried before they become dead letters.
TRIES = 3
Sink = Callable[[DataFrame], DataFrame]


def fan_out(pages: DataFrame, batch_id: int, root: str, sinks: dict[str, Sink], tries: int = TRIES) -> None:
    """Hand the pages of one batch to every sink, a function from pages to rows (classifications,
    fields, ...), and write its rows as the batch's partition of the table of its name.

    A sink that fails is tried again, ``tries`` times in all, without touching the others; ``attempts``
    says how often each was tried. What still fails leaves its documents in ``dead_letters`` with the
    reason. Doing a batch again replaces its partitions, so a repeat changes nothing; ``attempts`` then
    tells the last outcome, old dead letters stay as a record.
    """
    spark, mark = pages.sparkSession, F.lit(batch_id).alias("batch_id")
    log = []
    for name, sink in sinks.items():
        error = None
        for attempt in range(1, tries + 1):
            try:
                writers.write_table(sink(pages).select("*", mark), f"{root}/{name}")
                error = None
                break
            except Exception as failure:  # whatever a sink raises: retried here, recorded below
                error = f"{type(failure).__name__}: {failure}".splitlines()[0][:200]
        log.append((name, attempt, error))
    writers.write_table(spark.createDataFrame(log, "sink string, tries int, error string").select("*", mark), f"{root}/attempts")
    failed = [row for row in log if row[2] is not None]
    if failed:
        lost = F.explode(F.array(*[F.struct(F.lit(n).alias("sink"), F.lit(k).alias("tries"), F.lit(e).alias("error")) for n, k, e in failed]))
        letters = pages.select("doc_id", "path", lost.alias("_l")).select("doc_id", "path", "_l.*", mark)
        writers.write_table(letters, f"{root}/dead_letters")


def redeliver(spark: SparkSession, root: str, batch_id: int, sinks: dict[str, Sink]) -> None:
    """Give the pages of a batch to the sinks once more, as when a failing model is back."""
    pages = spark.read.parquet(f"{root}/pages").filter(F.col("batch_id") == batch_id).drop("batch_id")
    fan_out(pages, batch_id, root, sinks)


def ingest_batch(batch: DataFrame, batch_id: int, root: str, max_mb: int = files.MAX_UPLOAD_MB,
                 sinks: dict[str, Sink] | None = None) -> None:
    """Write one batch below ``root``; a repeated batch overwrites its own partition only.

    Every file is read once, into ``files``: its page text, or why it has none (type, size, no
    text). ``pages``, ``rejected``, ``status``, ``chunks``, ``postings`` and ``embeddings`` follow from
    written tables; ``sinks`` then get the pages (:func:`fan_out`). Ids are 128-bit digests of the path,
    chunk ids add the chunk's number, so they stay the same and do not collide.
    """
    mark = F.lit(batch_id).alias("batch_id")
    spark = batch.sparkSession
    doc_id = F.md5("path").alias("doc_id")
    typed = routed(batch)
    reason = (
        F.when(F.col("extractor").isNull(), F.concat(F.lit("Unsupported file type: "), "mime_type"))
        .when(~F.col("extractor").isin(*READABLE), F.concat(F.lit("No engine for: "), "extractor"))
        .when(F.col("length") > max_mb * 1024 * 1024, f"File exceeds max size of {max_mb}MB")
    )
    raw = F.col("content").cast("string")
    text = F.when(F.col("extractor") == "csv", tabular.csv_text(F.make_valid_utf8(raw))).otherwise(F.make_valid_utf8(raw))
    read = typed.select(
        doc_id, "path", "mime_type", "extractor", reason.alias("reason"),
        F.when(reason.isNull(), tx.clean_text(text)).alias("text"),
        F.when(F.is_valid_utf8(raw), "utf-8").otherwise("utf-8/replaced").alias("encoding"), mark,
    ).withColumn("reason", F.coalesce("reason", F.when(tx.is_blank(F.col("text")), "no text")))
    writers.write_table(read, f"{root}/files")

    def own(name: str) -> DataFrame:
        # The batch's folder alone: the whole table would be listed again by every batch.
        return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch_id={batch_id}")

    kept = own("files")
    writers.write_table(kept.filter("reason is not null").select("doc_id", "path", "mime_type", "reason", mark), f"{root}/rejected")
    pages = kept.filter("reason is null").select(
        "doc_id", "path", F.lit(1).alias("page_number"), "text",
        F.when(F.col("extractor") == "csv", "tabular").otherwise("plain_text").alias("extraction_method"),
        F.lit(1.0).alias("confidence"), "encoding", mark)
    writers.write_table(pages, f"{root}/pages")
    steps = F.when(F.col("reason").isNull(), F.array(*map(F.lit, ("processing", "completed")))).otherwise(
        F.array(*map(F.lit, ("processing", "failed"))))
    writers.write_table(kept.select(
        "doc_id", F.posexplode(steps).alias("step", "status"), F.col("reason").alias("error"), mark), f"{root}/status")
    if kept.filter("reason is null").isEmpty():
        return
    chunks = chunking.reindex_chunks(chunking.fixed_size_chunks(own("pages"))).withColumn(
        "chunk_id", F.concat_ws("-", "doc_id", F.col("chunk_index").cast("string")))
    writers.write_table(chunks.select("*", mark), f"{root}/chunks")
    # The index and the vectors start from the written chunks: nothing is cut twice.
    writers.write_table(lexical.postings(own("chunks")).select("*", mark), f"{root}/postings")
    writers.write_table(embedding.embed_chunks(own("chunks")).select("*", mark), f"{root}/embeddings")
    if sinks:
        fan_out(own("pages").drop("batch_id"), batch_id, root, sinks)


#: Inboxes hold many small files: a task reads, or looks up, many of them instead of a few or one.
MANY_FILES = {
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """The session with MANY_FILES, which a file stream reads batch by batch while it runs."""
    before = {key: spark.conf.get(key) for key in MANY_FILES}
    try:
        for key, value in MANY_FILES.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def start_ingest(
    files_stream: DataFrame, root: str, checkpoint: str, available_now: bool = False,
    sinks: dict[str, Sink] | None = None,
) -> StreamingQuery:
    """Run the ingest; the checkpoint takes the place of queue acknowledgements."""
    writer = files_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, n: ingest_batch(df, n, root, sinks=sinks)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
