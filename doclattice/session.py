"""Session settings used by the tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "doclattice", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return plain_unions(builder.getOrCreate())


def plain_unions(spark: SparkSession) -> SparkSession:
    """Turn off partition-preserving unions.

    Spark 4.1 lets a union of equally partitioned inputs skip the next shuffle; when adaptive
    execution later changes one input, a join above it stops with "Can't zip RDDs". Plans here
    that fuse ranked lists and join the result need the plain union.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_dir(spark: SparkSession, default: str | None = None) -> str:
    """Shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests) may the
    caller supply a default; there is no silent fall-back to a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if default is None:
        raise ValueError("spark.checkpoint.dir is not set and no default folder was given")
    return default
