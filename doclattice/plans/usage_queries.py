"""Usage, cost, limits and alarms (ANA)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.operators import usage
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.search_queries import ids
from doclattice.plans.views import CTE, with_ctes

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# Events as usage logs: the type is the kind, props the query, value the latency.
def usage_v(t: Tables) -> DataFrame:
    u = v.hash_unit(F.lit("conf"), F.col("event_id"))
    return usage.usage_events(t.events.select(
        "event_id", F.col("event_type").alias("kind"), F.col("props").alias("query"),
        F.lit("hybrid").alias("mode"), (F.col("user_id") % 10).alias("result_count"),
        F.col("value").alias("latency_ms"),
        F.when(u < 0.3, "high").when(u < 0.6, "medium").alias("confidence"), "ts",
    ))


CTE["usage_v"] = ((), f"""
  select event_id, event_type as kind, substr(props, 1, 200) as query, 'hybrid' as mode,
    user_id % 10 as result_count, round(value, 1) as latency_ms,
    case when u < 0.3 then 'high' when u < 0.6 then 'medium' else 'low' end as confidence, ts
  from (select *, {v.sql_hash_unit("'conf'", 'event_id')} as u from events)""")
CTE["recent_v"] = (("usage_v",), """
  select *, row_number() over (partition by kind order by ts desc, event_id desc) as recency
  from usage_v""")
CTE["usage_stats_v"] = (("recent_v",), """
  select kind, count(*) as total, count(*) filter (recency <= 50) as recent_count,
    round(avg(latency_ms) filter (recency <= 50), 1) as avg_latency_ms,
    count(*) filter (recency <= 50 and confidence = 'high') as n_high,
    count(*) filter (recency <= 50 and confidence = 'medium') as n_medium,
    count(*) filter (recency <= 50 and confidence = 'low') as n_low
  from recent_v group by 1""")


@query("ana_01_usage_events", with_ctes(["usage_v"], """
    select * replace (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts) from usage_v"""))
def _(t: Tables):
    return usage_v(t).withColumn("ts", F.date_format("ts", MICROS))


@query("ana_02_recent_queries", with_ctes(["recent_v"], """
    select kind, recency, event_id, query, latency_ms from recent_v where recency <= 10"""))
def _(t: Tables):
    return ids(usage.shown_queries(usage_v(t)), "kind", "recency", "event_id", "query", "latency_ms")


@query("ana_03_usage_stats", with_ctes(["usage_stats_v"], "select * from usage_stats_v"))
def _(t: Tables):
    return ids(usage.usage_stats(usage_v(t)))


def accesses_v(t: Tables) -> DataFrame:
    return t.events.select(F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"))


CTE["popular_v"] = ((), """
  select cast(json_extract_string(props, '$.k') as bigint) as doc_id, count(*) as access_count
  from events group by 1 order by 2 desc, 1 limit 10""")


@query("ana_04_popular_documents", with_ctes(["popular_v"], "select * from popular_v"))
def _(t: Tables):
    return usage.popular_documents(accesses_v(t))


@query("ana_05_snapshot", with_ctes(["usage_stats_v", "popular_v"], """
    select kind as section, unnest(['total', 'recent_count', 'avg_latency_ms', 'n_high', 'n_medium',
        'n_low']) as metric, unnest([total, recent_count, avg_latency_ms, n_high, n_medium, n_low])
        ::double as value from usage_stats_v
    union all select 'popular_documents', cast(doc_id as varchar), access_count from popular_v"""))
def _(t: Tables):
    return usage.snapshot(usage_v(t), accesses_v(t))


# Model calls: one per dialogue turn, the arm drawn by hash, the text as prompt, the next turn as answer.
def calls_v(t: Tables) -> DataFrame:
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    task = F.when(F.col("turn") % 2 == 0, "summarization").otherwise("chat")
    calls = t.conversations.select(
        key.alias("request_id"),
        usage.assigned_provider(key, task, 0.5, 0.5).alias("provider"),
        usage.estimated_tokens(F.col("text")).alias("input_tokens"),
        usage.estimated_tokens(F.coalesce(F.lead("text").over(
            Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))).alias("output_tokens"),
        (F.length("text") * 1.5).cast("double").alias("latency_ms"),
    )
    return calls.withColumn("cost_usd", usage.call_cost(
        F.col("provider"), F.col("input_tokens"), F.col("output_tokens")))


CTE["calls_v"] = ((), """
  select *, case provider when 'gemini_api' then (input_tokens * 0.075::double
      + output_tokens * 0.30::double) / 1000000.0::double else 0.0::double end as cost_usd
  from (select conv_id || '/' || turn as request_id, case when turn % 2 = 0 and
        cast('0x' || substr(md5(conv_id || '/' || turn), 1, 7) as bigint) / 268435456.0::double >= 0.5
      then 'local_finetuned' else 'gemini_api' end as provider,
    greatest(1, length(text) // 4) as input_tokens,
    greatest(1, length(coalesce(lead(text) over (partition by conv_id order by turn), '')) // 4) as output_tokens,
    (length(text) * 1.5)::double as latency_ms from conversations)""")


@query("ana_06_call_costs", with_ctes(["calls_v"], """
    select request_id, provider, input_tokens, output_tokens, latency_ms, round(cost_usd, 9) as cost_usd
    from calls_v"""))
def _(t: Tables):
    return calls_v(t).withColumn("cost_usd", F.round("cost_usd", 9))


@query("ana_07_cost_report", with_ctes(["calls_v"], """
    select case when grouping(provider) = 1 then 'all' else provider end as provider,
      count(*) as requests, round(sum(cost_usd), 6) as total_cost,
      round(sum(latency_ms), 2) as total_latency_ms, sum(input_tokens)::bigint as total_input_tokens,
      sum(output_tokens)::bigint as total_output_tokens, round(avg(latency_ms), 2) as avg_latency_ms,
      round(avg(cost_usd), 6) as avg_cost_usd from calls_v group by rollup(provider)"""))
def _(t: Tables):
    return usage.cost_report(calls_v(t))


@query("ana_08_arm_comparison", f"""
    select arm, count(*) as n, round(avg(value), 4) as avg_value from (select value, case
      when event_type = 'error' then 'local_finetuned' when event_type in ('view', 'click') and
        {v.sql_hash_unit('event_id')} >= 0.25 then 'local_finetuned' else 'gemini_api' end as arm
      from (select event_id, value, event_type from events where event_id is not null)
      ) group by 1""")
def _(t: Tables):
    kind = F.col("event_type")
    task = F.when(kind.isin("view", "click"), "extraction").otherwise("chat")
    forced = F.when(kind == "error", usage.LOCAL)
    arm = usage.assigned_provider(F.col("event_id"), task, 0.25, 0.75, forced)
    return t.events.select(arm.alias("arm"), "value").groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


# Limits of 3 requests per caller in 24 hours: the events are too sparse for minutes.
LIMIT, SECONDS = 3, 86400


def requests_v(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("caller"), "ts")


@query("ana_09_sliding_limit", f"""
    select event_id as request_id, user_id as caller, n - 1 as in_window, n - 1 < {LIMIT} as allowed
    from (select *, count(*) over (partition by user_id order by ts range between
      interval '{SECONDS - 1} seconds 999999 microseconds' preceding and current row) as n from events)""")
def _(t: Tables):
    return usage.sliding_window_limit(requests_v(t), LIMIT, SECONDS).drop("ts")


# Each verdict needs the one before: one recursion step per request of a caller.
ADMITTED_SQL = f"""
    with recursive e as (select user_id as caller, event_id, epoch_us(ts) as us,
        row_number() over (partition by user_id order by ts, event_id) as rn from events),
    r as (
      select caller, rn, event_id, [us] as times, 0::bigint as in_window, true as allowed from e where rn = 1
      union all
      select caller, rn, event_id, case when len(l) < {LIMIT} then list_append(l, us) else l end,
        len(l)::bigint, len(l) < {LIMIT}
      from (select e.*, list_filter(r.times, lambda x: e.us - x < {SECONDS * 1_000_000}) as l
            from r join e on e.caller = r.caller and e.rn = r.rn + 1))
    select event_id as request_id, caller, in_window, allowed from r"""


@query("ana_09_admitted_only_limit", ADMITTED_SQL)
def _(t: Tables):
    return usage.admitted_only_limit(requests_v(t), LIMIT, SECONDS).drop("ts")


# Alarm rules keep their shape; period and thresholds fit the spacing and values of the events.
_ALARM_SQL = """
    , p as (select epoch_us(ts) // {us} as period, {agg} as value from {src} group by 1)
    select '{name}' as alarm_name, period, round(value, 6) as value, value {cmp} {limit} as breach,
      (select count(*) from p q where q.period between p.period - {n} + 1 and p.period
        and q.value {cmp} {limit}) >= {n} as alarm from p"""
_PERIOD = 21600
_LIMITS = {"backend_5xx": 10.0, "backend_latency": 140.0, "unhealthy_targets": 250.0, "db_cpu": 48.0, "db_storage": 45.0}
_SQL_STATISTIC = {"p95": "quantile_cont(value, 0.95)"}
_RULES = tuple(
    (name, statistic, _SQL_STATISTIC.get(statistic, f"{statistic}(value)"), comparison, _LIMITS[name], in_row)
    for name, (statistic, comparison, _, _, in_row) in usage.ALARMS.items()
)
CTE["errors_v"] = ((), "select ts, 1.0::double as value from events where event_type = 'error'")
CTE["loads_v"] = ((), "select ts, value from events")


def _alarm(rule, t: Tables) -> DataFrame:
    name, statistic, _, comparison, limit, in_row = rule
    src = t.events.select("ts", "value")
    if name == "backend_5xx":
        src = t.events.filter("event_type = 'error'").select("ts", F.lit(1.0).alias("value"))
    states = usage.alarm_states(src, statistic, comparison, limit, _PERIOD, in_row)
    return states.select(F.lit(name).alias("alarm_name"), "period", F.round("value", 6).alias("value"),
                         "breach", "alarm")


for _rule in _RULES:
    _src = "errors_v" if _rule[0] == "backend_5xx" else "loads_v"

    @query(f"ana_10_alarm_{_rule[0]}", with_ctes([_src], _ALARM_SQL.format(
        us=_PERIOD * 1_000_000, agg=_rule[2], src=_src, name=_rule[0], cmp=_rule[3], limit=_rule[4],
        n=_rule[5]).replace("\n    , p", ", p", 1)))
    def _(t: Tables, rule=_rule):
        return _alarm(rule, t)


@query("ana_11_request_log", """
    select event_id as request_id, '[' || event_id || '] GET /' || event_type || ' → ' ||
      case when event_type = 'error' then 500 else 200 end || ' (' || user_id || 'ms)' as line
    from events""")
def _(t: Tables):
    return usage.request_log(t.events.select(
        F.col("event_id").alias("request_id"), F.lit("GET").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("user_id").cast("double").alias("duration_ms"),
    ))


# Agent traces: a conversation is a run, its turns the steps.
def steps_v(t: Tables) -> DataFrame:
    tool = F.when(F.col("role") == "assistant", F.element_at(
        F.array(*map(F.lit, ("search_documents", "compare_documents", "generate_with_llm"))),
        (F.col("conv_id") % 3 + 1).cast("int")))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return usage.step_rows(t.conversations.select(
        F.col("conv_id").alias("run_id"), F.lit("research").alias("workflow"), number.alias("step"),
        F.when(F.col("role") == "user", "reasoning").otherwise("tool_call").alias("step_type"),
        tool.alias("tool_name"), F.col("text").alias("content"), F.col("text").alias("tool_result"),
        F.length("text").cast("double").alias("duration_ms"),
    ))


CTE["steps_v"] = ((), """
  select conv_id as run_id, 'research' as workflow, row_number() over (partition by conv_id
      order by turn) - 1 as step, case role when 'user' then 'reasoning' else 'tool_call' end as
    step_type, case role when 'assistant' then ['search_documents', 'compare_documents',
      'generate_with_llm'][conv_id % 3 + 1] end as tool_name, substr(text, 1, 2000) as content,
    substr(text, 1, 500) as tool_result, length(text)::double as duration_ms from conversations""")


@query("ana_12_agent_steps", with_ctes(["steps_v"], "select * from steps_v"))
def _(t: Tables):
    return ids(steps_v(t))


@query("ana_12_tool_statistics", with_ctes(["steps_v"], """
    select tool_name, count(*) as n, round(avg(duration_ms), 3) as avg_ms, max(duration_ms) as max_ms,
      count(*) filter (step_type = 'error') as errors from steps_v where tool_name is not null group by 1"""))
def _(t: Tables):
    return usage.tool_statistics(steps_v(t))


@query("wrk_05_approval_queue", with_ctes(["steps_v"], """
    select run_id, step, tool_name from steps_v where tool_name in ('compare_documents',
      'generate_with_llm') and run_id not in (select doc_id from labels where quality = 1)"""))
def _(t: Tables):
    steps = steps_v(t)
    granted = steps.join(t.labels.filter("quality = 1").select(F.col("doc_id").alias("run_id")),
                         "run_id", "left_semi")
    return ids(usage.approval_queue(steps, granted), "run_id", "step", "tool_name")
