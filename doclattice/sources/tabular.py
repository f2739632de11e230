"""Tables as documents: delimited files to page text and stored table heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

STORED_ROWS = 100
PAGE_ROWS = 10_000
BLOCK_ROWS = 1 << 16
SEPARATOR = " | "


def read_csv(
    spark: SparkSession, path: str, schema: StructType | None = None, header: bool = True, escape: str = "\\",
) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). Broken rows keep their text instead of failing the read.

    Dead letters carry ``file``, ``line`` and whatever columns could be parsed; Spark wants at
    least one of those read along with the line.
    """
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE").option("escape", escape)
    if schema is None:
        schema = reader.option("inferSchema", "true").csv(path).schema
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    rows = (
        reader.option("columnNameOfCorruptRecord", "_corrupt").schema(full).csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("block", F.col("_metadata.file_block_start"))
        .withColumn("pos", F.struct("block", F.monotonically_increasing_id().alias("id")))
    )
    # The scan converts only the columns a plan uses and so finds only those broken. This test is
    # always true but names every column, so a row is judged as a whole whatever is selected later.
    whole = F.length(F.concat_ws("", *[F.col(f.name).cast("string") for f in schema.fields])) >= 0
    rows = rows.filter(whole)
    good = rows.filter("_corrupt is null").drop("_corrupt")
    return good, rows.filter("_corrupt is not null").drop("pos").withColumnRenamed(
        "_corrupt", "line")


def as_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(file, block, pos, cells) from typed rows; NULL cells read ``nan`` as in the page text. A split is cut
    into blocks of at most ``BLOCK_ROWS`` lines, so that no task has to sort a whole split."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])
    block = F.struct(F.col("block").alias("split"), F.floor(F.col("pos.id") / BLOCK_ROWS).alias("slice"))
    return rows.select("file", block.alias("block"), "pos", cells.alias("cells"))


def folder_parts(rows: DataFrame) -> DataFrame:
    """Rows of :func:`as_cells` with a folder as their file: its part files, in the order of their names,
    and the blocks of each come one after the other."""
    return rows.select(
        F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("file"),
        F.struct(F.col("file").alias("part"), F.col("block").alias("start")).alias("block"), "pos", "cells")


def _row_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit("nan"))), SEPARATOR)


def csv_text(text: Column) -> Column:
    """Page text of one delimited file held in a value: the header line, then its rows.

    Fields may be quoted and hold commas and doubled quotes, but no line breaks; empty ones read
    ``nan``. Blank lines are skipped.
    """
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    field = F.lit('(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))')

    def cells(line: Column) -> Column:
        quoted, plain = (F.regexp_extract_all(line, field, F.lit(g)) for g in (1, 2))
        both = F.zip_with(quoted, plain, lambda q, p: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p))
        return F.transform(both, lambda c: F.when(c == "", "nan").otherwise(c))

    rows = F.transform(lines, lambda x: F.array_join(cells(x), SEPARATOR))
    head = F.concat(F.lit("Columns: "), F.get(rows, F.lit(0)))
    return F.when(F.size(lines) > 0, F.concat(
        head, F.lit("\n\n"), F.array_join(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), "\n")))


def tabular_pages(
    rows: DataFrame, headers: tuple[str, ...], rows_per_page: int = PAGE_ROWS
) -> DataFrame:
    """Page text of each file: a ``Columns:`` line, a blank line, the rows joined by a pipe.

    A file up to ``rows_per_page`` rows is one page; larger ones go on, so that no text grows
    without bound. ``rows(file, block, pos, cells)``: blocks are pieces of a file, in the order
    of ``pos``. Rows are numbered inside their block and moved by the sizes of the blocks before
    it, so even one huge file is numbered in parallel.
    """
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("pos")) - 1
    return (
        rows.select("file", "block", "pos", _row_text(F.col("cells")).alias("_t"))
        .withColumn("_r", inside)
        .join(offsets, ["file", "block"])
        .withColumn("_n", F.col("_o") + F.col("_r"))
        .withColumn("page_number", (F.floor(F.col("_n") / rows_per_page) + 1).cast("int"))
        .groupBy("file", "page_number")
        .agg(F.expr("listagg(_t, '\\n') within group (order by _n)").alias("_body"))
        .select("file", "page_number",
                F.concat(F.lit(f"Columns: {SEPARATOR.join(headers)}\n\n"), "_body").alias("text"))
    )


def table_heads(
    rows: DataFrame, headers: tuple[str, ...], head_rows: int = STORED_ROWS
) -> DataFrame:
    """Stored table of each file: its first rows (the limit runs before the shuffle) and totals."""
    order = Window.partitionBy("file").orderBy("pos")
    head = (
        rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= head_rows)
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "cells"))).alias("_r"))
    )
    totals = rows.groupBy("file").agg(F.count("*").alias("_total"))
    return head.join(totals, "file").select(
        "file",
        F.struct(
            F.lit(0).alias("table_index"),
            F.array(*[F.lit(h) for h in headers]).alias("headers"),
            F.transform("_r", lambda r: r["cells"]).alias("rows"),
            F.col("_total").alias("total_rows"),
            F.lit(len(headers)).alias("total_columns"),
        ).alias("table"),
    )
