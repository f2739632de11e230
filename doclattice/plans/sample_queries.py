"""Dataset preparation (PRP, SRC-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import samples
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.search_queries import ids
from doclattice.plans.views import CTE, with_ctes
from doclattice.sources import adapters, writers

# Dialogue turns as samples: a user turn is the input, the next assistant turn the output.
TASKS = ("question_answering", "summarization", "extraction")


def samples_v(t: Tables) -> DataFrame:
    c = t.conversations
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    reply = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    sample_id = F.col("conv_id") * 100 + F.col("turn")
    return user.join(reply, ["conv_id", "turn"]).select(
        sample_id.alias("sample_id"),
        F.element_at(F.array(*map(F.lit, TASKS)), (sample_id % 3 + 1).cast("int")).alias("task_type"),
        F.when(F.col("turn") == 0, "first").otherwise("later").alias("source"),
        "input", "output",
    )


CTE["samples_v"] = ((), f"""
  select u.conv_id * 100 + u.turn as sample_id,
    [{', '.join(map(v.sql_str, TASKS))}][(u.conv_id * 100 + u.turn) % 3 + 1] as task_type,
    case when u.turn = 0 then 'first' else 'later' end as source, u.text as input, a.text as output
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'""")


def scans_v(t: Tables) -> DataFrame:
    return adapters.scan_records(
        t.documents.select("doc_id", "text", (F.col("n_chars") % 16).cast("int").alias("label"))
    )


_SCAN = "(values " + ", ".join(
    f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(adapters.SCAN_CATEGORIES.items())
) + ") m(i, class_name, category)"
CTE["scans_v"] = ((), f"""
  select doc_id, text, class_name, category from documents join {_SCAN} on i = n_chars % 16""")


@query("prp_01_label_remap", with_ctes(["scans_v"], "select doc_id, class_name, category from scans_v"))
def _(t: Tables):
    return scans_v(t).select("doc_id", "class_name", "category")


@query("prp_02_balanced_sample", with_ctes(["scans_v"], """
    select doc_id, category from (select *, row_number() over (partition by category
      order by doc_id) as n from scans_v where length(text) >= 50) where n <= 120 // 6"""))
def _(t: Tables):
    return samples.balanced_sample(scans_v(t), "category", "doc_id", 120, 6).select(
        "doc_id", "category")


_WORDS_IN = f"len({v.sql_words('input')})"
CTE["judged_v"] = (("samples_v",), f"""
  select *, case when {_WORDS_IN} < 20 then 'input_too_short'
    when len({v.sql_words('output')}) < 5 then 'output_too_short'
    when {_WORDS_IN} > 3000 then 'input_too_long'
    when contains(lower(input), '[insert') or contains(lower(input), 'lorem ipsum')
      then 'placeholder_text'
    when {v.sql_strip('input')} = {v.sql_strip('output')} then 'input_equals_output'
    when task_type = 'extraction' and not contains(output, '{{') and not contains(output, '[')
      then 'extraction_missing_json' else 'ok' end as reason from samples_v""")


@query("prp_03_quality_filter", with_ctes(["judged_v"], """
    select sample_id, task_type, reason from judged_v"""))
def _(t: Tables):
    return samples.quality_filter(samples_v(t)).select("sample_id", "task_type", "reason")


_KEY = v.sql_strip("lower(substr(output, 1, 200))")


@query("prp_04_deduplicate", with_ctes(["samples_v"], f"""
    , one as (select * from (select *, row_number() over (partition by task_type, {_KEY}
        order by sample_id) as n from samples_v) where n = 1)
    select sample_id, task_type from (select *, row_number() over (partition by {_KEY}
        order by sample_id) as n2 from one) where n2 = 1""".replace("\n    , one", ", one", 1)))
def _(t: Tables):
    return samples.deduplicate_twice(samples_v(t), "sample_id").select("sample_id", "task_type")


def _sql_split(strata: str, key: str, source: str, cols: str) -> str:
    return f"""select {cols}, case when r <= floor(n * 0.8::double) then 'train'
        when r <= floor(n * 0.9::double) then 'val' else 'test' end as split
      from (select *, row_number() over (partition by {strata} order by md5(cast({key} as varchar)),
              {key}) as r, count(*) over (partition by {strata}) as n from {source})"""


@query("prp_05_stratified_split", with_ctes(["samples_v"], _sql_split(
    "task_type", "sample_id", "samples_v", "sample_id, task_type")))
def _(t: Tables):
    return samples.shuffled_split(
        samples_v(t).select("sample_id", "task_type"), "sample_id", ("task_type",))


@query("prp_05_document_split", _sql_split("1", "doc_id", "documents", "doc_id"))
def _(t: Tables):
    return samples.shuffled_split(t.documents.select("doc_id"), "doc_id")


def records_v(t: Tables) -> DataFrame:
    """Question records: the reply's first words are the answer, a third have none."""
    words = tx.words(F.col("output"))
    return samples_v(t).select(
        F.col("sample_id").alias("record_id"), F.col("input").alias("question"),
        F.when(F.col("source") == "first", F.lit(None)).otherwise(F.col("output")).alias("context"),
        F.when(F.col("task_type") == "summarization", F.array().cast("array<string>"))
        .otherwise(F.array(F.array_join(F.slice(words, 1, 3), " "))).alias("answers"),
    )


CTE["records_v"] = (("samples_v",), f"""
  select sample_id as record_id, input as question,
    case when source = 'first' then null else output end as context,
    case when task_type = 'summarization' then null
      else array_to_string({v.sql_words('output')}[1:3], ' ') end as answer from samples_v""")


@query("prp_06_answerable_mix", with_ctes(["records_v"], """
    select record_id, answerable from (select *, row_number() over (partition by answerable
        order by md5('mix' || record_id), record_id) as r
      from (select *, answer is not null as answerable from records_v
            where coalesce(context, '') <> '' and coalesce(question, '') <> ''))
    where r <= case when answerable then 40 else 10 end"""))
def _(t: Tables):
    return samples.answerable_mix(records_v(t), 50).select("record_id", "answerable")


@query("prp_07_question_records", with_ctes(["records_v"], """
    select record_id, question, answer, coalesce(nullif(context, ''),
      '[Document context for question: ' || question || ']') as context
    from records_v where coalesce(question, '') <> '' and coalesce(answer, '') <> ''"""))
def _(t: Tables):
    return adapters.question_records(records_v(t)).select(
        "record_id", "question", "answer", "context")


_FLAT = "string_split(replace(replace(context, '! ', '.' || chr(10)), '? ', '.' || chr(10)), '. ')"
_LEAD = v.sql_strip(f"array_to_string({_FLAT}[1:2], '. ')")


@query("prp_08_lead_summaries", f"""
    select doc_id, case when ends_with(lead, '.') then lead else lead || '.' end as output from (
      select min(doc_id) as doc_id, any_value({_LEAD}) as lead
      from (select doc_id, text as context from documents)
      where len({v.sql_words('context')}) > 50 group by context)""")
def _(t: Tables):
    contexts = t.documents.select("doc_id", F.col("text").alias("context"))
    return samples.summary_samples(contexts, "doc_id").select("doc_id", "output")


def _sql_pick(options, key: str, seed: str) -> str:
    listed = ", ".join(v.sql_str(o) for o in options)
    return (f"[{listed}][cast('0x' || substr(md5('{seed}' || {key}), 1, 7) as bigint)"
            f" % {len(options)} + 1]")


CTE["qa_samples_v"] = (("records_v",), f"""
  select record_id, {_sql_pick(samples.QA_INSTRUCTIONS, 'record_id', 'i')} || chr(10) || chr(10)
      || 'Question: ' || question as instruction, context as input,
    coalesce(answer, {_sql_pick(samples.UNANSWERABLE_RESPONSES, 'record_id', 'u')}) as output
  from records_v""")


@query("prp_09_instruction_choice", with_ctes(["qa_samples_v"], "select * from qa_samples_v"))
def _(t: Tables):
    return samples.answer_samples(records_v(t), "dialogue", "article").select(
        "record_id", "instruction", "input", "output")


@query("prp_10_source_mixture", with_ctes(["samples_v"], """
    , q as (select greatest(10, floor(floor(count(*) * 0.3::double / 0.7::double) / 3)) as quota
      from samples_v where source = 'first')
    select sample_id, task_type, source from samples_v where source = 'first'
    union all select sample_id, task_type, source from (select *, row_number() over
        (partition by task_type order by md5('mix' || sample_id), sample_id) as r
      from samples_v where source = 'later'), q where r <= quota""".replace("\n    , q", ", q", 1)))
def _(t: Tables):
    s = samples_v(t).select("sample_id", "task_type", "source")
    return samples.mix_sources(s.filter("source = 'first'"), s.filter("source = 'later'"), 0.7, 3)


@query("prp_11_prompt_format", with_ctes(["qa_samples_v"], f"""
    select record_id, case when input is null or not regexp_matches(input, '[^{v.B}]') then
      '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10)
        || output
      else '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10)
        || input || chr(10) || chr(10) || '### Response:' || chr(10) || output end as prompt
    from qa_samples_v"""))
def _(t: Tables):
    s = samples.answer_samples(records_v(t), "dialogue", "article")
    return s.select("record_id", samples.prompt_text(
        F.col("instruction"), F.col("input"), F.col("output")).alias("prompt"))


# -- receipts: orders as nested ground truth ---------------------------------------------------

def receipts_v(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.concat(F.lit('{"nm": "part '), F.col("l_partkey").cast("string"), F.lit('", "price": "'),
                 F.format_string("%.2f", F.col("l_extendedprice")), F.lit('", "cnt": 1}')).alias("j"),
    )
    menu = lines.groupBy("l_orderkey").agg(F.expr(
        "listagg(j, ', ') within group (order by l_linenumber, l_partkey, l_extendedprice)").alias("menu"))
    return t.orders.join(menu, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit('{"gt_parse": {"menu": ['), "menu", F.lit('], "total": {"total_price": " '),
                 F.format_string("%.2f", F.col("o_totalprice")),
                 F.lit(' ", "cashprice": ""}, "note": "x"}}')).alias("ground_truth"),
    )


CTE["receipt_fields_v"] = ((), """
  select l_orderkey as doc_id, 'menu' as "group", 'menu.nm' as field_name,
    'part ' || l_partkey as field_value, row_number() over (partition by l_orderkey order by
      l_linenumber, l_partkey, l_extendedprice) - 1 as item from lineitem semi join orders
      on o_orderkey = l_orderkey
  union all select l_orderkey, 'menu', 'menu.price', printf('%.2f', l_extendedprice),
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) - 1
    from lineitem semi join orders on o_orderkey = l_orderkey
  union all select o_orderkey, 'total', 'total.total_price', printf('%.2f', o_totalprice), 0
    from orders semi join lineitem on l_orderkey = o_orderkey""")


def receipt_fields_v(t: Tables) -> DataFrame:
    return adapters.receipt_fields(receipts_v(t))


@query("prp_17_receipt_fields", with_ctes(["receipt_fields_v"], """
    select doc_id, "group", item, field_name, field_value from receipt_fields_v"""))
def _(t: Tables):
    return ids(receipt_fields_v(t))


CTE["receipt_records_v"] = (("receipt_fields_v",), """
  select doc_id, string_agg(field_name || ': ' || field_value, chr(10)
      order by "group", item, field_name, field_value) as text, count(*) as field_count
  from receipt_fields_v group by 1""")


@query("prp_18_receipt_records", with_ctes(["receipt_records_v"], """
    select *, 'menu,total' as groups from receipt_records_v"""))
def _(t: Tables):
    r = adapters.receipt_records(receipt_fields_v(t))
    return ids(r.select("doc_id", "text", "field_count", F.array_join("groups", ",").alias("groups")))


@query("prp_12_fields_as_json", with_ctes(["receipt_fields_v"], """
    , e as (select doc_id, field_name, '  "' || field_name || '": ' || case when count(*) = 1 then
          '"' || any_value(field_value) || '"' else '[' || chr(10) || '    "' ||
          string_agg(field_value, '",' || chr(10) || '    "' order by item, field_value) || '"' ||
          chr(10) || '  ]' end as j from receipt_fields_v group by 1, 2)
    select doc_id, '{' || chr(10) || string_agg(j, ',' || chr(10) order by field_name) || chr(10)
      || '}' as output from e group by 1""".replace("\n    , e", ", e", 1)))
def _(t: Tables):
    r = adapters.receipt_records(receipt_fields_v(t)).select(
        "doc_id", "text", "fields", F.lit("receipt").alias("doc_type"), F.lit("orders").alias("source"))
    return samples.extraction_samples(r).select("doc_id", "output")


@query("prp_13_split_resolution", """
    select o_orderkey as doc_id, case when s = 'none' then
        case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.9::double)
          then 'validation' else 'test' end
      when s = 'train' and r <= greatest(1, floor(n * 0.1::double)) then 'validation' else s end as split
    from (select *, row_number() over (partition by s order by md5('split' || o_orderkey), o_orderkey)
            as r, count(*) over (partition by s) as n
      from (select o_orderkey, case o_orderstatus when 'O' then 'train' when 'F' then 'test'
              else 'none' end as s from orders))""")
def _(t: Tables):
    given = t.orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "O", "training").when(F.col("o_orderstatus") == "F", "testing")
        .alias("split"))
    return samples.resolve_splits(given, "doc_id")


@query("prp_14_scaled_boxes", """
    select event_id, 1000 * (event_id % 700) // 700 as x0, case when user_id > 0 then
      1000 * (event_id % 31) // user_id else 0 end as y0 from events""")
def _(t: Tables):
    box = F.array((F.col("event_id") % 700).cast("int"), (F.col("event_id") % 31).cast("int"))
    scaled = adapters.scaled_box(box, F.lit(700), F.col("user_id"))
    return ids(t.events.select("event_id", F.get(scaled, F.lit(0)).alias("x0"),
                               F.get(scaled, F.lit(1)).alias("y0")))


@query("prp_15_tag_labels", f"""
    select event_id, coalesce([{', '.join(map(v.sql_str, adapters.FORM_LABELS))}]
        [cast(user_id % 9 as integer) + 1], 'O') as label, 'O' as named from events""")
def _(t: Tables):
    return t.events.select("event_id", adapters.form_label((F.col("user_id") % 9).cast("int")).alias("label"),
                           adapters.known_label(F.col("event_type")).alias("named"))


CTE["receipt_labels_v"] = (("receipt_fields_v",), """
  select doc_id, item, case item % 3 when 0 then 'B-' when 1 then 'I-' else '' end || case
      when item % 5 = 3 and field_name = 'menu.nm' then 'sub_total.tax_price'
      when item % 5 = 4 and field_name = 'menu.nm' then 'sub_total.etc'
      when item % 5 = 3 then 'total.cashprice' when item % 5 = 4 then 'void_menu.nm'
      else field_name end as label from receipt_fields_v""")


@query("prp_16_receipt_labels", with_ctes(["receipt_labels_v"], """
    select doc_id, item, label, case when f in ('menu.nm', 'menu.sub_nm') then p || 'MENU_ITEM'
      when f in ('menu.price', 'menu.unitprice', 'menu.itemsubtotal', 'menu.sub_price',
        'menu.sub_unitprice') then p || 'MENU_PRICE'
      when f like 'sub!_total%' escape '!' and f like '%tax%' then p || 'TAX'
      when f like 'sub!_total%' escape '!' then p || 'SUBTOTAL'
      when f like 'total.total%' then p || 'TOTAL' when f like 'total%' then p || 'OTHER'
      when p <> '' then p || 'OTHER' else 'O' end as coarse
    from (select *, regexp_extract(label, '^([BI]-)', 1) as p, regexp_replace(label, '^[BI]-', '') as f
          from receipt_labels_v)"""))
def _(t: Tables):
    i, name = F.col("item"), F.col("field_name")
    fine = F.concat(
        F.when(i % 3 == 0, "B-").when(i % 3 == 1, "I-").otherwise(""),
        F.when((i % 5 == 3) & (name == "menu.nm"), "sub_total.tax_price")
        .when((i % 5 == 4) & (name == "menu.nm"), "sub_total.etc")
        .when(i % 5 == 3, "total.cashprice").when(i % 5 == 4, "void_menu.nm").otherwise(name))
    return ids(receipt_fields_v(t).select("doc_id", "item", fine.alias("label")).withColumn(
        "coarse", adapters.receipt_label(F.col("label"))))


@query("prp_19_label_distribution", with_ctes(["tokens_v"], """
    select label, count(*) as n, round(count(*) / (select count(*) from tokens_v)::double, 6) as share
    from tokens_v group by 1"""))
def _(t: Tables):
    from doclattice.plans.field_queries import forms_v

    return samples.value_distribution(forms_v(t), "labels")


@query("src_10_manifest", with_ctes(["judged_v"], """
    select 'total' as section, 'all' as label, count(*) as value from judged_v
    union all select 'task_type', task_type, count(*) from judged_v group by 2
    union all select 'source', source, count(*) from judged_v group by 2
    union all select 'reason', reason, count(*) from judged_v group by 2"""))
def _(t: Tables):
    return writers.manifest(samples.quality_filter(samples_v(t)), "task_type", "source", "reason")
