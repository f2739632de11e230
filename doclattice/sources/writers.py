"""Sinks: partitioned tables that a repeated batch overwrites, and split JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str = "batch_id") -> None:
    """Overwrite only the partitions in ``df``: writing a batch again leaves the same table."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )


def write_corpus(pages: DataFrame, chunks: DataFrame, embeddings: DataFrame, root: str) -> None:
    """Page, chunk and embedding tables of one or more batches below ``root``."""
    for name, df in (("pages", pages), ("chunks", chunks), ("embeddings", embeddings)):
        write_table(df, f"{root}/{name}")


def write_splits(samples: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in one folder per split."""
    samples.write.mode("overwrite").partitionBy(split).json(path)


def write_corrections(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").json(path)


def manifest(samples: DataFrame, *dimensions: str) -> DataFrame:
    """Counts in total and per value of each dimension, in long form, from one aggregation."""
    sets = [[], *[[d] for d in dimensions]]
    counted = samples.groupingSets(sets, *dimensions).agg(
        F.count("*").alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    section, label = F.lit("total"), F.lit("all")
    for d in dimensions:
        inside = F.col(f"_g_{d}") == 0
        section = F.when(inside, F.lit(d)).otherwise(section)
        label = F.when(inside, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))).otherwise(label)
    return counted.select(section.alias("section"), label.alias("label"), F.col("n").alias("value"))
