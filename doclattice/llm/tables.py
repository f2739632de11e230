"""Intermediate tables in the shared folder, and small helpers for columns of any input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.session import shared_dir

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. In local mode, where nothing is named
    and driver and tasks share a disk (tests), a temporary folder of this application."""
    default = None
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        app = spark.sparkContext.applicationId
        if not spark.conf.get("spark.checkpoint.dir", None) and app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="doclattice-llm-")
        default = _LOCAL.get(app)
    return f"{shared_dir(spark, default)}/doclattice-llm/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and every later use
    reads the same rows, whichever executors are lost. The folders go with the application's."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
