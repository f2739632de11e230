"""Usage analytics, model cost, rate limits and alarms over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT, RECENT, SHOWN = 1000, 50, 10
QUERY_CHARS = 200
STEP_CHARS, RESULT_CHARS = 2000, 500
CONFIDENCES = ("high", "medium", "low")

# USD per million tokens (input, output) of each provider.
PRICES = {"gemini_api": (0.075, 0.30), "local_finetuned": (0.0, 0.0)}
HOSTED, LOCAL = tuple(PRICES)
# Tasks that may go to the local model; tools that need approval.
ROUTED_TASKS = ("summarization", "extraction", "classification")
APPROVAL_TOOLS = ("compare_documents", "generate_with_llm")

# Alarm rules (statistic, comparison, threshold, period, periods in a row).
ALARMS = {
    "backend_5xx": ("sum", ">", 10.0, 300, 2),
    "backend_latency": ("p95", ">", 2.0, 300, 3),
    "unhealthy_targets": ("max", ">", 0.0, 60, 2),
    "db_cpu": ("avg", ">", 80.0, 300, 3),
    "db_storage": ("avg", "<", 5368709120.0, 300, 1),
}


def usage_events(raw: DataFrame) -> DataFrame:
    """Log rows as they are appended: query cut to 200 characters, latency to one decimal."""
    return raw.select(
        "event_id", "kind", F.substring("query", 1, QUERY_CHARS).alias("query"), "mode",
        "result_count", F.round("latency_ms", 1).alias("latency_ms"),
        F.coalesce("confidence", F.lit("low")).alias("confidence"), "ts",
    )


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """Newest n rows per kind; the limit also runs before the shuffle."""
    w = Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def usage_stats(events: DataFrame) -> DataFrame:
    """Per kind: total, size and mean latency of the newest 50 of the kept 1000, confidence counts."""
    total = events.groupBy("kind").agg(F.count("*").alias("total"))
    last = recent_events(recent_events(events, KEPT).drop("recency"), RECENT)
    stats = last.groupBy("kind").agg(
        F.count("*").alias("recent_count"), F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
        *[F.count_if(F.col("confidence") == c).alias(f"n_{c}") for c in CONFIDENCES],
    )
    return total.join(stats, "kind", "left")


def shown_queries(events: DataFrame) -> DataFrame:
    return recent_events(events, SHOWN)


def popular_documents(accesses: DataFrame, k: int = 10) -> DataFrame:
    return (
        accesses.groupBy("doc_id").agg(F.count("*").alias("access_count"))
        .orderBy(F.desc("access_count"), "doc_id").limit(k)
    )


def snapshot(events: DataFrame, accesses: DataFrame, k: int = 10) -> DataFrame:
    """Stats per kind and popular documents as (section, metric, value)."""
    metrics = ("total", "recent_count", "avg_latency_ms", *[f"n_{c}" for c in CONFIDENCES])
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    stats = usage_stats(events).select(
        F.col("kind").alias("section"), F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)")
    )
    top = popular_documents(accesses, k).select(
        F.lit("popular_documents").alias("section"), F.col("doc_id").cast("string").alias("metric"),
        F.col("access_count").cast("double").alias("value"),
    )
    return stats.unionByName(top)


# -- model calls ------------------------------------------------------------------------------

def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def call_cost(provider: Column, tokens_in: Column, tokens_out: Column) -> Column:
    def rate(i: int) -> Column:
        return F.create_map(*[F.lit(x) for p, r in PRICES.items() for x in (p, r[i])])[provider]

    return (tokens_in * rate(0) + tokens_out * rate(1)) / F.lit(1_000_000.0)


def cost_report(calls: DataFrame) -> DataFrame:
    """Per provider and in total: requests, cost, latency and token sums, averages."""
    return calls.rollup("provider").agg(
        F.count("*").alias("requests"), F.round(F.sum("cost_usd"), 6).alias("total_cost"),
        F.round(F.sum("latency_ms"), 2).alias("total_latency_ms"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.round(F.avg("cost_usd"), 6).alias("avg_cost_usd"),
        F.grouping("provider").alias("_g"),
    ).withColumn("provider", F.when(F.col("_g") == 1, "all").otherwise(F.col("provider"))).drop("_g")


def assigned_provider(
    key: Column, task: Column, hosted_weight: float = 1.0, local_weight: float = 0.0,
    forced: Column | None = None, local_available: Column | None = None,
) -> Column:
    """A/B arm of a request: forced, else by hash of its key and the weights for routed tasks, with
    the hosted model standing in for an unavailable local one."""
    u = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("bigint") / F.lit(268435456.0)
    share = hosted_weight / (hosted_weight + local_weight)
    available = F.lit(True) if local_available is None else local_available
    drawn = F.when(u < share, HOSTED).otherwise(LOCAL)
    chosen = F.when(task.isin(*ROUTED_TASKS) & available, drawn).otherwise(HOSTED)
    if forced is not None:
        chosen = F.coalesce(forced, chosen)
    return F.when((chosen == LOCAL) & ~available, HOSTED).otherwise(chosen)


# -- rate limits ------------------------------------------------------------------------------

def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def _slotted(requests: DataFrame, seconds: int) -> DataFrame:
    """Rows with ``_us`` and time slots of one window length; each row also enters the next slot as
    context (``_own`` false). A window over (caller, slot) then sees all it needs, and a caller
    with very many requests is spread over the slots."""
    width = seconds * 1_000_000
    slot = F.floor(F.col("_us") / F.lit(width))
    return requests.withColumn("_us", _micros(F.col("ts"))).withColumn(
        "_slots", F.array(slot, slot + 1)
    ).select("*", F.posexplode("_slots").alias("_next", "_slot")).withColumn(
        "_own", F.col("_next") == 0
    ).drop("_slots", "_next")


def sliding_window_limit(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Requests already in the caller's window, rejected ones included, and the verdict.

    ``requests(request_id, caller, ts)``. The window holds what is younger than ``seconds``.
    """
    w = Window.partitionBy("caller", "_slot").orderBy("_us").rangeBetween(
        -(seconds * 1_000_000 - 1), 0
    )
    return (
        _slotted(requests, seconds)
        .withColumn("in_window", F.count("*").over(w) - 1)
        .filter("_own")
        .select("request_id", "caller", "ts", "in_window",
                (F.col("in_window") < limit).alias("allowed"))
    )


def admitted_only_limit(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Variant in which rejected requests do not fill the window.

    The verdict depends on earlier verdicts, so it is a fold in time order. After a pause of a
    whole window a caller starts afresh, so the folds run over the stretches between pauses; the
    stretch of a request comes from windows over (caller, slot) and the slot summaries. Each task
    streams its sorted rows and keeps at most ``limit`` times per stretch.
    """
    slots = _slotted(requests, seconds)
    w = Window.partitionBy("caller", "_slot").orderBy("_us", "request_id")
    gap = F.col("_us") - F.lag("_us").over(w)
    marked = slots.withColumn(
        "_opens", F.when(F.coalesce(gap >= seconds * 1_000_000, F.lit(True)), F.col("_us"))
    ).filter("_own")
    inside = marked.withColumn(
        "_in_slot", F.max("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    summary = marked.groupBy("caller", "_slot").agg(F.max("_opens").alias("_last"))
    before = summary.withColumn("_carried", F.max("_last").over(
        Window.partitionBy("caller").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    )).drop("_last")
    stretches = inside.join(before, ["caller", "_slot"]).select(
        "request_id", "caller", "ts", "_us",
        F.coalesce("_in_slot", "_carried").alias("_stretch"),
    )
    return _fold_admissions(stretches, limit, seconds)


def _fold_admissions(stretches: DataFrame, limit: int, seconds: int) -> DataFrame:
    from collections import deque

    width = seconds * 1_000_000

    def fold(batches):
        current, window = None, deque()
        for pdf in batches:
            allowed, filled = [], []
            for caller, stretch, us in zip(pdf["caller"], pdf["_stretch"], pdf["_us"]):
                if current != (caller, stretch):
                    current, window = (caller, stretch), deque()
                while window and us - window[0] >= width:
                    window.popleft()
                filled.append(len(window))
                ok = len(window) < limit
                allowed.append(ok)
                if ok:
                    window.append(us)
            yield pdf[["request_id", "caller", "ts"]].assign(in_window=filled, allowed=allowed)

    kind = stretches.schema["caller"].dataType.simpleString()
    ordered = stretches.repartition("caller", "_stretch").sortWithinPartitions(
        "caller", "_stretch", "_us", "request_id"
    )
    return ordered.mapInPandas(
        fold, f"request_id long, caller {kind}, ts timestamp_ntz, in_window long, allowed boolean"
    )


# -- alarms -----------------------------------------------------------------------------------

def period_values(samples: DataFrame, statistic: str, seconds: int) -> DataFrame:
    """One value per period: sum, avg, max, or exact p95 over pre-counted values."""
    period = F.floor(_micros(F.col("ts")) / F.lit(seconds * 1_000_000)).alias("period")
    if statistic == "p95":
        # Equal values are counted first, so the percentile merges value counts, not rows.
        counted = samples.groupBy(period, "value").agg(F.count("*").alias("_n"))
        return counted.groupBy("period").agg(F.expr("percentile(value, 0.95, _n)").alias("value"))
    aggregate = {"sum": F.sum, "avg": F.avg, "max": F.max}[statistic]
    return samples.groupBy(period).agg(aggregate("value").alias("value"))


def alarm_states(
    samples: DataFrame, statistic: str, comparison: str, threshold: float, seconds: int, in_row: int
) -> DataFrame:
    """Periods with their value and whether the alarm is on: the threshold is breached in this and
    the periods right before it, ``in_row`` in all. Only period rows reach the window."""
    per = period_values(samples, statistic, seconds)
    breach = F.col("value") > threshold if comparison == ">" else F.col("value") < threshold
    marked = per.withColumn("breach", breach)
    return in_a_row(marked, in_row)


def in_a_row(marked: DataFrame, in_row: int) -> DataFrame:
    """``alarm``: this and the periods right before it breach, ``in_row`` in all. Every breach counts
    for the periods it can reach, so periods are summed by key and never sorted in one task."""
    reach = marked.filter("breach").select(
        F.explode(F.sequence(F.col("period"), F.col("period") + (in_row - 1))).alias("period"))
    counted = reach.groupBy("period").agg(F.count(F.lit(1)).alias("_n"))
    return (
        marked.join(counted, "period", "left")
        .withColumn("alarm", F.coalesce(F.col("_n"), F.lit(0)) >= in_row).drop("_n")
    )


def request_log(raw: DataFrame) -> DataFrame:
    """Request lines ``[id] METHOD path -> status (n ms)`` from request events."""
    return raw.select(
        "request_id",
        F.format_string("[%s] %s %s → %d (%.0fms)", F.col("request_id").cast("string"), "method",
                        "path", "status", "duration_ms").alias("line"),
    )


# -- agent traces -----------------------------------------------------------------------------

def unpacked_steps(runs: DataFrame) -> DataFrame:
    """Step rows of runs that carry their steps as an array of structs."""
    return runs.select("run_id", "workflow", F.posexplode("steps").alias("step", "_s")).select(
        "run_id", "workflow", "step", "_s.*"
    )


def step_rows(steps: DataFrame) -> DataFrame:
    """One trace row per step, texts cut to their limits."""
    return steps.select(
        "run_id", "workflow", "step", "step_type", "tool_name",
        F.substring("content", 1, STEP_CHARS).alias("content"),
        F.substring("tool_result", 1, RESULT_CHARS).alias("tool_result"), "duration_ms",
    )


def tool_statistics(steps: DataFrame) -> DataFrame:
    return steps.filter("tool_name is not null").groupBy("tool_name").agg(
        F.count("*").alias("n"), F.round(F.avg("duration_ms"), 3).alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.count_if(F.col("step_type") == "error").alias("errors"),
    )


def needs_approval(tool: Column) -> Column:
    return F.coalesce(tool.isin(*APPROVAL_TOOLS), F.lit(False))


def approval_queue(steps: DataFrame, approvals: DataFrame) -> DataFrame:
    """Calls of guarded tools nobody has approved yet."""
    return steps.filter(needs_approval(F.col("tool_name"))).join(
        approvals.select("run_id", "step"), ["run_id", "step"], "left_anti"
    )
