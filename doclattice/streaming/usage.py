"""Streaming usage counters, popularity, request dedupe and alarm periods."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from doclattice.operators.usage import in_a_row
from doclattice.sources import writers

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def instant(ts: Column) -> Column:
    """Zone-less time as an instant in UTC: watermarks need TIMESTAMP columns."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts))


def wall_time(ts: Column) -> Column:
    """Back from the instant to zone-less UTC time, whatever the session zone."""
    seconds = (F.unix_micros(ts) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(secs=seconds)


def rolling_counters(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Per window and kind: events, latency sum and mean, confidence counts.

    Windows close once the watermark passes them; later events are dropped by it.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "kind")
        .agg(
            F.count("*").alias("n"), F.sum("latency_ms").alias("latency_sum"),
            F.avg("latency_ms").alias("latency_avg"),
            *[F.count_if(F.col("confidence") == c).alias(f"n_{c}") for c in ("high", "medium", "low")],
        )
        .select(F.col("w.start").alias("window_start"), "kind", "n", "latency_sum", "latency_avg",
                "n_high", "n_medium", "n_low")
    )


def popularity(accesses: DataFrame) -> DataFrame:
    """Running access counts per document (complete or update mode)."""
    return accesses.groupBy("doc_id").agg(F.count("*").alias("access_count"))


def count_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Access counts of one batch, for ``foreachBatch``: written as a partition of its own, which a
    repeated batch replaces. The stream keeps no state and never writes old counts again."""
    writers.write_table(popularity(batch).withColumn("batch_id", F.lit(batch_id)), path)


def counted(spark: SparkSession, path: str) -> DataFrame:
    """Totals of :func:`count_batch`'s partitions."""
    return spark.read.schema("doc_id long, access_count long, batch_id long").parquet(path).groupBy("doc_id").agg(
        F.sum("access_count").alias("access_count"))


def first_arrivals(requests: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival of each key, once and for all: the state holds one entry for a key."""
    return requests.dropDuplicates(keys)


def keep_new(batch: DataFrame, batch_id: int, path: str, keys: list[str]) -> None:
    """The keys of one batch that no earlier batch had, for ``foreachBatch``: written as a partition of
    its own. First for ever, like :func:`first_arrivals`, but the keys stand in the table, not in the
    memory of the stream; a repeated batch is compared with earlier ones only and writes the same."""
    spark = batch.sparkSession
    fresh = batch.select(*keys).distinct()
    stored = spark.read.schema(fresh.withColumn("batch_id", F.lit(0).cast("long")).schema)
    if batch_id > 0:
        seen = stored.parquet(path).filter(F.col("batch_id") < batch_id)
        same = [fresh[k].eqNullSafe(seen[k]) for k in keys]
        fresh = fresh.join(seen, same, "left_anti")
    writers.write_table(fresh.withColumn("batch_id", F.lit(batch_id).cast("long")), path)


def alarm_periods(
    samples: DataFrame, statistic: str, seconds: int, lateness: str = "10 minutes"
) -> DataFrame:
    """One value per closed period; feed each batch to ``usage.alarm_states``-style checks.

    p95 is approximate here (a bounded sketch per period), exact in the batch operator.
    """
    value = {
        "sum": F.sum("value"), "avg": F.avg("value"), "max": F.max("value"),
        "p95": F.percentile_approx("value", 0.95, 10_000),
    }[statistic]
    return (
        samples.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(value.alias("value"))
        .select(F.col("w.start").alias("period_start"), "value")
    )


def consecutive_breaches(
    periods: DataFrame, comparison: str, threshold: float, seconds: int, in_row: int
) -> DataFrame:
    """Alarm state of stored closed periods (period_start, value), for use in ``foreachBatch``."""
    breach = F.col("value") > threshold if comparison == ">" else F.col("value") < threshold
    number = F.floor(F.unix_seconds("period_start") / seconds)
    return in_a_row(periods.withColumn("period", number).withColumn("breach", breach), in_row)


class _InARow(StatefulProcessor):
    """Alarm state of the closed periods of one alarm; the state is the last period and how many
    breached up to it without a gap."""

    def __init__(self, comparison: str, threshold: float, seconds: int, in_row: int):
        self.comparison, self.threshold, self.seconds, self.in_row = comparison, threshold, seconds, in_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "period long, length long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, length = self.run.get() or (None, 0)
        for start, value in sorted((r["period_start"].timestamp(), r["value"]) for r in rows):
            period = int(start // self.seconds)
            breach = value > self.threshold if self.comparison == ">" else value < self.threshold
            length = (length + 1 if last == period - 1 else 1) if breach else 0
            last = period
            yield Row(alarm=key[0], period=period, value=value, breach=breach, in_alarm=length >= self.in_row)
        if last is not None:
            self.run.update((last, length))

    def close(self) -> None:
        pass


def alarm_stream(
    samples: DataFrame, statistic: str, comparison: str, threshold: float, seconds: int, in_row: int,
    lateness: str = "10 minutes",
) -> DataFrame:
    """(alarm, period, value, breach, in_alarm) of each period as it closes, in append mode.

    ``samples(alarm, ts, value)``. Periods close with the watermark, so they reach the processor in
    order; it keeps two numbers per alarm. Needs the RocksDB state store.
    """
    value = {"sum": F.sum("value"), "avg": F.avg("value"), "max": F.max("value")}[statistic]
    closed = (
        samples.withWatermark("ts", lateness)
        .groupBy("alarm", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(value.alias("value"))
        .select("alarm", F.col("w.start").alias("period_start"), "value")
    )
    return closed.groupBy("alarm").transformWithState(
        _InARow(comparison, threshold, seconds, in_row),
        "alarm string, period long, value double, breach boolean, in_alarm boolean", "Append", "None")
