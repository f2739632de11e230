"""Round trips through file sources and sinks (SRC, STR-1), over tables written from the data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from doclattice.operators import classify, fields
from doclattice.plans import sample_queries as sm
from doclattice.plans import views as v
from doclattice.plans.ingest_queries import _sql_clean
from doclattice.plans.registry import Tables, query, store_root
from doclattice.plans.search_queries import ids
from doclattice.plans.views import with_ctes
from doclattice.sources import files, tabular, writers
from doclattice.streaming import ingest


def fresh_folder(t: Tables, name: str) -> str:
    root = store_root(t.spark)
    if root is None:
        raise ValueError("file round trips need a shared folder in spark.checkpoint.dir")
    return f"{root}/doclattice/files/{name}-{uuid.uuid4().hex}"


#: Most documents of a text file, so that no file grows with its collection.
FILE_DOCUMENTS = 1000


def text_files(t: Tables, name: str) -> str:
    """The documents of each collection as text files in one folder per collection."""
    path = fresh_folder(t, name)
    docs = t.documents.select("source", F.concat(F.lit("# "), F.col("doc_id").cast("string"),
                                                 F.lit("\n"), "text").alias("value"))
    # Every task writes what it has of a collection: no task holds a whole one.
    docs.write.partitionBy("source").option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)
    return path


def written_files(rows, path: str, folders: int = 1) -> None:
    """(kind, name, value) as files ``name.kind``: each row is a file of its own, a name always in the
    same of ``folders`` folders of its kind."""

    def save(batches):
        import pyarrow as pa
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        made = set()
        for batch in batches:
            for kind, name, value, folder in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (kind, folder) not in made:
                    target.create_dir(f"{base}/{kind}/{folder}")
                    made.add((kind, folder))
                with target.open_output_stream(f"{base}/{kind}/{folder}/{name}.{kind}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    folder = F.crc32(F.coalesce("name", F.lit(""))) % folders
    rows.select("kind", "name", "value", folder.alias("folder")).mapInArrow(save, "n long").agg(F.sum("n")).collect()


@query("src_01_text_files", """
    select source, count(*) as files, sum(chars)::bigint as chars, true as clean from (
      select source, sum(length('# ' || doc_id || chr(10) || text) + 1) as chars from documents group by 1)
    group by 1""")
def _(t: Tables):
    pages = files.text_pages(files.read_blobs(t.spark, text_files(t, "text"), "*.txt"))
    texts = pages.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(
        F.sum(F.length("text").cast("bigint")).alias("chars"), F.bool_and(F.col("encoding") == "utf-8").alias("clean"))
    # A collection counts once, as in the SQL, over however many files it is spread.
    return texts.groupBy("source").agg(
        F.count("*").alias("files"), F.sum("chars").alias("chars"), F.bool_and("clean").alias("clean"))


@query("src_03_dead_letters", """
    select case when event_type = 'error' then 'dead' else 'good' end as kind, count(*) as n,
      coalesce(round(sum(value) filter (event_type <> 'error'), 2), 0) as total
    from events group by 1""")
def _(t: Tables):
    path = fresh_folder(t, "csv")
    line = F.when(F.col("event_type") == "error",
                  F.concat(F.lit("broken "), F.col("event_id").cast("string"), F.lit(",x,y"))).otherwise(
        F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string")))
    t.events.select(line.alias("value")).write.text(path)
    schema = t.events.select("event_id", "value").schema
    # Headerless lines: every row counts, so the header option is off for this read.
    good, dead = tabular.read_csv(t.spark, path, schema, header=False)
    good = good.select(F.lit("good").alias("kind"), "value")
    dead = dead.select(F.lit("dead").alias("kind"), "value")
    return good.unionByName(dead).groupBy("kind").agg(
        F.count("*").alias("n"), F.coalesce(F.round(F.sum("value"), 2), F.lit(0.0)).alias("total"))


@query("src_06_object_listing")
def _(t: Tables):
    blobs = files.read_blobs(t.spark, t.folder, "*.parquet")
    return blobs.select(F.regexp_extract("path", "([^/]+)$", 1).alias("key"), "length")


@query("src_07_corpus_tables", with_ctes(["pages_v", "chunks_v"], """
    select 'pages' as name, lang as batch_id, count(*) as n from pages_v join documents using (doc_id)
      group by 2
    union all select 'chunks', lang, count(*) from chunks_v group by 2
    union all select 'embeddings', lang, count(*) from chunks_v group by 2"""))
def _(t: Tables):
    from doclattice.operators.embedding import embed_chunks

    root = fresh_folder(t, "corpus")
    lang = t.documents.select("doc_id", F.col("lang").alias("batch_id"))
    parts = [v.pages_v(t).join(lang, "doc_id"), v.chunks_v(t).withColumn("batch_id", F.col("lang")),
             embed_chunks(v.chunks_v(t)).join(lang, "doc_id")]
    writers.write_corpus(*parts, root)
    # One batch again: it replaces its own partition and leaves the others alone.
    writers.write_table(parts[1].filter("batch_id = 'en'"), f"{root}/chunks")
    counts = [
        t.spark.read.parquet(f"{root}/{n}").groupBy("batch_id").agg(F.count("*").alias("n"))
        .select(F.lit(n).alias("name"), "batch_id", "n") for n in ("pages", "chunks", "embeddings")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("src_09_json_splits", with_ctes(["samples_v"], sm._sql_split(
    "task_type", "sample_id", "samples_v", "sample_id, task_type, input, output")))
def _(t: Tables):
    from doclattice.operators import samples

    path = fresh_folder(t, "splits")
    split = samples.shuffled_split(sm.samples_v(t), "sample_id", ("task_type",))
    writers.write_splits(split.select("sample_id", "task_type", "input", "output", "split"), path)
    return files.read_json_lines(
        t.spark, path, "sample_id long, task_type string, input string, output string, split string")


@query("src_08_json_lines", """
    select conv_id, turn, role, text from conversations""")
def _(t: Tables):
    path = fresh_folder(t, "jsonl")
    # Blank lines between the records, as hand-edited files have them.
    lines = t.conversations.select(F.concat(F.to_json(F.struct("conv_id", "turn", "role", "text")),
                                            F.lit("\n")).alias("value"))
    lines.write.text(path)
    return files.read_json_lines(t.spark, path, "conv_id long, turn long, role string, text string")


@query("src_02_csv_files", f"""
    select file, (n - 1) // {tabular.PAGE_ROWS} + 1 as page_number, 'Columns: order | line | price | note' || chr(10) || chr(10)
      || string_agg(l_orderkey || ' | ' || l_linenumber || ' | ' || printf('%.2f', l_extendedprice) || ' | ' || note, chr(10) order by n) as text
    from (select *, l_orderkey % 16 as file, case when l_linenumber % 2 = 0 then 'a, "b"' else 'nan' end as note,
        row_number() over (partition by l_orderkey % 16 order by l_orderkey, l_linenumber, printf('%.2f', l_extendedprice)) as n from lineitem)
    group by 1, 2""")
def _(t: Tables):
    """Order lines written as delimited files with quoted fields and empty cells, and read back as pages.

    A file is a folder of parts in the order of their names, cut by range, so that no task sorts a whole one."""
    path, names = fresh_folder(t, "csv"), ("order", "line", "price", "note")
    lines = t.lineitem.select(
        (F.col("l_orderkey") % 16).alias("file"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"),
        F.format_string("%.2f", F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, 'a, "b"').alias("note"))
    order = ["file", "order", "line", "price"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("file").option(
        "header", True).option("escape", '"').csv(path)
    schema = StructType([StructField(n, StringType()) for n in names])
    good, _ = tabular.read_csv(t.spark, path, schema, escape='"')
    parts = tabular.folder_parts(tabular.as_cells(good, list(names)))
    pages = tabular.tabular_pages(parts, names)
    return pages.select(F.regexp_extract("file", r"file=(\d+)$", 1).cast("bigint").alias("file"),
                        F.col("page_number").cast("bigint").alias("page_number"), "text")


# A model that needs no weights: six scores hashed from the file's name.
_SCORES = "[" + ", ".join(f"round({v.sql_hash_unit(v.sql_str('light'), 'name', str(i))}, 4)" for i in range(6)) + "]"
_TYPES = "[" + ", ".join(v.sql_str(x) for x in classify.DOCUMENT_TYPES) + "]"


def inbox_sinks() -> dict[str, ingest.Sink]:
    """What every ingested page is handed to: classification and field extraction."""
    name = F.regexp_extract("path", r"([a-z]\d+)\.[a-z]+$", 1)

    def classified(pages: DataFrame) -> DataFrame:
        scores = F.array(*[F.round(v.hash_unit(F.lit("light"), name, F.lit(i)), 4) for i in range(6)])
        rows = pages.select("doc_id", scores.alias("p"))
        return rows.select("doc_id", *[c.alias(n) for n, c in classify.label_scores(F.col("p")).items() if n != "scores"])

    return {"classifications": classified, "fields": fields.extract_patterns}


# The inbox: every document as a text file of its own, nations as CSV files by region, and files of
# types nothing here can read. One row per type, outcome and reason, and one for each document type
# and field that the pages were handed on to.
@query("str_01_incremental_ingest", f"""
    with f as (
      select 'txt' as kind, 'completed' as status, null as reason from documents
      union all select 'csv', 'completed', null from (select distinct n_regionkey from nation)
      union all select 'exe', 'failed', 'Unsupported file type: application/octet-stream' from region
      union all select 'pdf', 'failed', 'No engine for: pdf' from region),
    n as (select 'd' || doc_id as name from documents union all select distinct 'n' || n_regionkey from nation),
    c as (select {_TYPES}[list_position(p, list_max(p))] as t from (select {_SCORES} as p from n)),
    x as (select doc_id, {_sql_clean("'# ' || doc_id || chr(10) || coalesce(text, '')")} as text from documents),
    e as ({" union all ".join(f"select distinct doc_id, {v.sql_str(n)} as field, unnest(regexp_extract_all(text, {v.sql_str(p)})) as value from x" for n, p in fields.FIELD_PATTERNS.items())})
    select kind, status, reason, count(*) as files from f group by 1, 2, 3
    union all select 'classification', t, null, count(*) from c group by 2
    union all select 'field', field, null, count(*) from e group by 2""")
def _(t: Tables):
    inbox, root = fresh_folder(t, "inbox"), fresh_folder(t, "ingested")
    docs = t.documents.select(
        F.lit("txt").alias("kind"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    lines = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit(', land"')))
    csv = t.nation.groupBy(F.lit("csv").alias("kind"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("name")).agg(
        F.concat(F.lit("key,name\n"), F.array_join(F.array_sort(F.collect_list(lines)), "\n")).alias("value"))
    odd = t.region.select(F.explode(F.array(F.lit("exe"), F.lit("pdf"))).alias("kind"), F.col("r_regionkey").alias("k")).select(
        "kind", F.concat(F.lit("r"), F.col("k").cast("string")).alias("name"),
        F.when(F.col("kind") == "pdf", "%PDF-1.7 body").otherwise("MZ body").alias("value"))
    # As many folders as keep each to some FILE_DOCUMENTS files, as one task lists a folder.
    written_files(docs.unionByName(csv).unionByName(odd), inbox, 1 + t.documents.count() // FILE_DOCUMENTS)
    ingest.list_new(t.spark, inbox, root)
    stream = ingest.listed_files(t.spark, root)
    ingest.start_ingest(stream, root, f"{root}/state", available_now=True, sinks=inbox_sinks()).awaitTermination()
    done = t.spark.read.parquet(f"{root}/status").filter("step = 1")
    kind = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    files_of = done.join(t.spark.read.parquet(f"{root}/files").select("doc_id", kind.alias("kind")), "doc_id").groupBy(
        "kind", "status", F.col("error").alias("reason")).agg(F.count("*").alias("files"))

    def handed_on(name: str, table: str, column: str) -> DataFrame:
        return t.spark.read.parquet(f"{root}/{table}").groupBy(F.lit(name).alias("kind"), F.col(column).alias("status")).agg(
            F.count("*").alias("files")).select("kind", "status", F.lit(None).cast("string").alias("reason"), "files")

    return files_of.unionByName(handed_on("classification", "classifications", "category")).unionByName(
        handed_on("field", "fields", "field_name"))
