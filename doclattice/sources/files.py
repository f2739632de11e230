"""File sources: blobs, plain text, MIME routing, upload checks, JSON lines, JDBC."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# MIME type -> extractor, and the upload limit.
EXTRACTORS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
    "text/csv": "csv",
    "application/vnd.ms-excel": "csv",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "csv",
}
MAX_UPLOAD_MB = 50
# File extension -> MIME type.
EXTENSIONS = {
    "pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv", "xls": "application/vnd.ms-excel",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}

# Columns of a listing, and bytes of files that a task hands on at once (one file more at most).
LISTED = "path string, modificationTime timestamp, length long"
READ_BYTES = 16 * 2**20


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Raw objects by path (path, modificationTime, length, content) from any Hadoop file system.

    Leave ``content`` unselected and only the listing is read. Spark lists no files without bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def spark_path(path: str) -> str:
    """An absolute path or URI as Spark has it in the paths of files: file:/a/b, hdfs://host/a/b."""
    if found := re.fullmatch("(?:file:(?://)?)?(/.*)", path, re.DOTALL):
        store, inside = "file:", found[1]
    elif found := re.fullmatch(r"(\w[\w.+-]*://[^/]+)(/.*)?", path, re.DOTALL):
        store, inside = found[1], found[2] or "/"
    else:
        raise ValueError(f"neither an absolute path nor a URI: {path}")
    return store + (re.sub("/+", "/", inside).rstrip("/") or "/")


def _located(paths: DataFrame, *columns: str) -> DataFrame:
    """store and inside, the two parts of a path as :func:`spark_path` has it."""
    store = F.regexp_extract("path", r"^(file:|\w[\w.+-]*://[^/]+)", 1)
    return paths.select(store.alias("store"), F.substr("path", F.length(store) + 1).alias("inside"), *columns)


def _opener():
    """store -> (pyarrow's file system, where its paths begin), once a task; travels by value."""
    opened = {}

    def open_store(store):
        from pyarrow import fs

        if store not in opened:
            target, base = (fs.LocalFileSystem(), "") if store == "file:" else fs.FileSystem.from_uri(f"{store}/")
            opened[store] = target, base.rstrip("/")
        return opened[store]

    return open_store


def folder_entries(folders: DataFrame, may_be_gone: bool = False) -> DataFrame:
    """Files and folders that stand in the folders (path), listed by the tasks that hold the rows. Names
    that Spark's own listing leaves out are left out."""
    open_store = _opener()

    def entries(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]
        names = ["path", "modificationTime", "length", "folder"]
        for store, inside in (x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in (0, 1)))):
            target, base = open_store(store)
            found = target.get_file_info(fs.FileSelector(base + inside, allow_not_found=may_be_gone))
            for k in range(0, len(found), 10_000):
                rows = [(store + x.path[len(base):], x.mtime_ns and x.mtime_ns // 1_000_000 * 1000, x.size,
                         x.type == fs.FileType.Directory) for x in found[k:k + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    name = F.substring_index("path", "/", -1)
    hidden = name.rlike(r"^\.|^_(?!.*=)|\._COPYING_$") & ~name.rlike("^(_metadata|_common_metadata)")
    return _located(folders).mapInArrow(entries, f"{LISTED}, folder boolean").filter(~hidden)


def read_listed(listed: DataFrame) -> DataFrame:
    """Listed files with their bytes, in the form of :func:`read_blobs`, read by the tasks that hold the
    rows. Paths are those of pyarrow's file systems (local, HDFS, S3, GCS)."""
    open_store, most = _opener(), READ_BYTES

    def contents(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
        names = ["path", "modificationTime", "length", "content"]

        def together(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        rows, size = [], 0
        for store, inside, time in (x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(3)))):
            target, base = open_store(store)
            with target.open_input_stream(base + inside) as file:
                content = file.read()
            rows.append((store + inside, time, len(content), content))
            size += len(content)
            if size >= most or len(rows) >= 10_000:
                yield together(rows)
                rows, size = [], 0
        if rows:
            yield together(rows)

    return _located(listed, "modificationTime").mapInArrow(contents, f"{LISTED}, content binary")


def text_pages(blobs: DataFrame) -> DataFrame:
    """One page per text file; bytes that are not UTF-8 are replaced and flagged."""
    raw = F.col("content").cast("string")
    return blobs.select(
        "path", F.lit(1).alias("page_number"), F.make_valid_utf8(raw).alias("text"),
        F.lit("plain_text").alias("extraction_method"), F.lit(1.0).alias("confidence"),
        F.when(F.is_valid_utf8(raw), "utf-8").otherwise("utf-8/replaced").alias("encoding"),
    )


def extractor_of(mime: Column) -> Column:
    routes = F.create_map(*[F.lit(x) for pair in EXTRACTORS.items() for x in pair])
    return routes[mime]


def route_by_mime(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their extractor, files no extractor takes). The route table is a constant map."""
    routed = files.withColumn("extractor", extractor_of(F.col("mime_type")))
    return routed.filter("extractor is not null"), routed.filter("extractor is null").drop("extractor")


def validate_uploads(
    files: DataFrame, max_mb: int = MAX_UPLOAD_MB
) -> tuple[DataFrame, DataFrame]:
    """(accepted files, errors): one bad file never rejects the batch."""
    error = (
        F.when(extractor_of(F.col("mime_type")).isNull(),
               F.concat(F.lit("Unsupported file type: "), F.coalesce("mime_type", F.lit("unknown"))))
        .when(F.col("size_bytes") > max_mb * 1024 * 1024, f"File exceeds max size of {max_mb}MB")
    )
    checked = files.withColumn("error", error)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema. Blank lines are skipped; bad ones stop the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
    partitions: int, **options: str,
) -> DataFrame:
    """Relational table read in parallel ranges of a numeric key; filters and columns push down."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
                 upperBound=str(upper), numPartitions=str(partitions), fetchsize="10000", **options)
        .load()
    )
