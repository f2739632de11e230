"""Registry of named queries: a Spark plan each and, where SQL can say it, an oracle statement."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclattice.session import plain_unions

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Tables whose rows are costly to process, with the key to spread them by.
HEAVY = {"documents": "doc_id", "lineitem": "l_orderkey", "orders": "o_orderkey"}

_STORED: dict[tuple[str, str, str], str] = {}
_LOCAL_ROOT: dict[str, str] = {}


def store_root(spark: SparkSession) -> str | None:
    """Folder for built indexes: the cluster's shared one, or a fresh temporary one in local mode.

    None on a cluster that names no shared folder; the views are then computed in the query.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOT:
            _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="doclattice-")
        return _LOCAL_ROOT[app]
    return None


class Tables:
    """The given tables of one folder, read lazily by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = plain_unions(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return self._spread(df, HEAVY[name]) if name in HEAVY else df
        raise AttributeError(name)

    def _spread(self, df: DataFrame, key: str) -> DataFrame:
        """In local mode a test table is one file of one row group, a single split: share it out. On
        a cluster tables are read as they are; split sizes are the session's."""
        context = self.spark.sparkContext
        return df.repartition(context.defaultParallelism, key) if context.master.startswith("local[") else df

    def stored(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """An index table built once per session and folder, then read column by column; ``by`` names
        a column whose values become folders, so that a search reads only those it needs.

        Search runs against built chunk, postings and vector tables, as any deployment would,
        instead of cutting and tokenizing the corpus again for every use in a plan.
        """
        root = store_root(self.spark)
        if root is None:
            return build()
        app = self.spark.sparkContext.applicationId
        key = (app, self.folder, name)
        if key not in _STORED:
            folder_id = hashlib.md5(self.folder.encode()).hexdigest()[:12]
            path = f"{root}/doclattice/{app}/{folder_id}/{name}"
            writer = build().write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle statement."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
