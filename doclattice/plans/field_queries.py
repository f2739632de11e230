"""Classification and fields (CLS, FLD)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.operators import classify, fields
from doclattice.plans import views as v
from doclattice.plans.registry import Tables, query
from doclattice.plans.search_queries import ids
from doclattice.plans.views import CTE, with_ctes

# Predictions: six hashed scores per document and model, rounded so that both engines agree.
_PROBS = "[" + ", ".join(
    f"round({v.sql_hash_unit('{m}', 'doc_id', str(i))}, 4)" for i in range(6)) + "]"
_NAMES = "[" + ", ".join(v.sql_str(x) for x in classify.DOCUMENT_TYPES) + "]"
CTE["light_v"] = ((), f"""
  select doc_id, p, list_max(p) as confidence, {_NAMES}[list_position(p, list_max(p))] as category
  from (select doc_id, {_PROBS.replace('{m}', "'light'")} as p from documents)""")
CTE["fallback_v"] = ((), f"""
  select doc_id, case when u < 0.05 then null when u < 0.2 then 'Memo' else
      {_NAMES}[1 + cast(floor(u * 6) as integer)] end as category, round(u, 3) as confidence
  from (select doc_id, {v.sql_hash_unit("'fallback'", 'doc_id')} as u from documents)""")
CTE["routed_v"] = (("light_v", "fallback_v"), f"""
  select l.doc_id, case when l.confidence >= 0.9 then l.category when f.category is null then null
      when f.category in (select unnest({_NAMES})) then f.category else 'Other' end as document_type,
    case when l.confidence >= 0.9 then l.confidence else f.confidence end as confidence,
    case when l.confidence >= 0.9 then 'lightweight_classifier' else 'zero_shot' end as method
  from light_v l join fallback_v f using (doc_id)""")


def light_v(t: Tables) -> DataFrame:
    probs = F.array(*[
        F.round(v.hash_unit(F.lit("light"), F.col("doc_id"), F.lit(i)), 4) for i in range(6)
    ])
    scored = t.documents.select("doc_id", probs.alias("p"))
    return scored.select(
        "doc_id", *[c.alias(n) for n, c in classify.label_scores(F.col("p")).items()]
    )


def fallback_v(t: Tables) -> DataFrame:
    u = v.hash_unit(F.lit("fallback"), F.col("doc_id"))
    names = F.array(*[F.lit(x) for x in classify.DOCUMENT_TYPES])
    return t.documents.select(
        "doc_id",
        F.when(u < 0.05, None).when(u < 0.2, "Memo")
        .otherwise(F.get(names, F.floor(u * 6).cast("int"))).alias("category"),
        F.round(u, 3).alias("confidence"),
    )


def routed_v(t: Tables) -> tuple[DataFrame, DataFrame]:
    return classify.route_by_confidence(t.documents, light_v(t), fallback_v(t), threshold=0.9)


@query("cls_01_confidence_routing", with_ctes(["routed_v"], "select * from routed_v"))
def _(t: Tables):
    classified, review = routed_v(t)
    left = review.join(fallback_v(t).select("doc_id", "confidence"), "doc_id").select(
        "doc_id", F.lit(None).cast("string").alias("document_type"), "confidence",
        F.lit(classify.FALLBACK_METHOD).alias("method"),
    )
    return classified.unionByName(left)


@query("cls_02_label_scores", with_ctes(["light_v"], f"""
    select doc_id, category, confidence, unnest({_NAMES}) as label, unnest(p) as score from light_v"""))
def _(t: Tables):
    return light_v(t).select(
        "doc_id", "category", "confidence", F.explode("scores").alias("label", "score")
    )


@query("cls_03_light_classifier")
def _(t: Tables):
    labelled = t.documents.select("doc_id", "text", F.col("lang").alias("document_type"))
    model = classify.fit_light_classifier(labelled, max_iter=5)
    return classify.predict_light(model, labelled).select("doc_id", "category", "confidence")


@query("cls_03_held_out_labels", """
    select doc_id, true as known_label, true as sure from documents
    where cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 7) as bigint) % 3 = 1""")
def _(t: Tables):
    """Learned from two thirds of the documents, told by a hash of the id; the rest is labelled."""
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("bigint") % 3
    labelled = t.documents.select("doc_id", "text", F.col("lang").alias("document_type"), part.alias("part"))
    model = classify.fit_light_classifier(labelled.filter("part <> 1"), max_iter=5)
    found = classify.predict_light(model, labelled.filter("part = 1"))
    return found.select("doc_id", F.col("category").isin(*model.stages[0].labels).alias("known_label"),
                        F.col("confidence").between(0.0, 1.0).alias("sure"))


@query("cls_04_known_category", with_ctes(["fallback_v"], f"""
    select doc_id, case when category in (select unnest({_NAMES})) then category else 'Other' end as
      category, confidence from fallback_v where category is not null"""))
def _(t: Tables):
    return classify.valid_result(fallback_v(t))


@query("cls_05_upsert", with_ctes(["routed_v"], """
    select coalesce(s.doc_id, f.doc_id) as doc_id,
      case when f.doc_id is not null then f.document_type else s.document_type end as document_type,
      case when f.doc_id is not null then f.confidence else s.confidence end as confidence,
      case when f.doc_id is not null then f.method else 'human' end as method,
      coalesce(s.is_corrected, false) as is_corrected
    from (select doc_id, 'Letter' as document_type, quality::double as confidence,
            toxic = 1 as is_corrected from labels) s
    full join (select * from routed_v where document_type is not null) f on f.doc_id = s.doc_id"""))
def _(t: Tables):
    stored = t.labels.select(
        "doc_id", F.lit("Letter").alias("document_type"),
        F.col("quality").cast("double").alias("confidence"), F.lit("human").alias("method"),
        (F.col("toxic") == 1).alias("is_corrected"),
    )
    return classify.upsert_classifications(stored, routed_v(t)[0])


@query("cls_06_batch_classify", with_ctes(["routed_v"], """
    select * from routed_v where document_type is not null and doc_id in (select doc_id from labels)"""))
def _(t: Tables):
    wanted = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return classify.route_by_confidence(wanted, light_v(t), fallback_v(t), threshold=0.9)[0]


# -- fields -----------------------------------------------------------------------------------

CTE["texts_v"] = (("invoice_text_v",), """
  select doc_id, text from invoice_text_v union all select doc_id + 1000000000, text from documents""")


def texts_v(t: Tables) -> DataFrame:
    return v.invoice_text_v(t).unionByName(
        t.documents.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    )


CTE["regex_fields_v"] = (("texts_v",), "\n  union all ".join(
    f"select distinct doc_id, '{n}' as field_name, unnest(regexp_extract_all(text, {v.sql_str(p)}))"
    " as field_value from texts_v" for n, p in fields.FIELD_PATTERNS.items()))


@query("fld_01_regex_fields", with_ctes(["regex_fields_v"], "select * from regex_fields_v"))
def _(t: Tables):
    return fields.extract_patterns(texts_v(t))


# Oracle of the entities: cut at every match and add up the lengths before it.
CTE["entities_v"] = (("texts_v",), "\n  union all ".join(f"""
  select doc_id, '{n}' as label, m[i] as value,
    cast(list_sum(list_transform(g[1:i], lambda x: length(x))) +
    coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as start
  from (select *, unnest(range(1, len(m) + 1)) as i from (
    select doc_id, regexp_extract_all(text, '{p}') as m, regexp_split_to_array(text, '{p}') as g
    from texts_v))""" for n, p in fields.TAGGER_PATTERNS.items()))
_MAP = "case label " + " ".join(
    f"when '{k}' then '{f}'" for k, f in fields.ENTITY_FIELDS.items()) + " end"
CTE["entity_fields_v"] = (("entities_v",), f"""
  select doc_id, field_name, value as field_value, min(start) as start from (
    select doc_id, {_MAP} as field_name, value, start from entities_v)
  where field_name is not null group by 1, 2, 3""")


@query("fld_02_entity_fields", with_ctes(["entity_fields_v"], """
    select *, start + length(field_value) as "end", 0.85::double as confidence from entity_fields_v"""))
def _(t: Tables):
    found = fields.entity_fields(fields.tag_entities(texts_v(t)))
    return ids(found, "doc_id", "field_name", "field_value", "start", "end", "confidence")


@query("fld_03_merged_extractions", with_ctes(["regex_fields_v", "entity_fields_v"], """
    select doc_id, field_name, field_value from regex_fields_v
    union select doc_id, field_name, field_value from entity_fields_v"""))
def _(t: Tables):
    return fields.merged_values(texts_v(t))


CTE["stored_fields_v"] = (("invoice_fields_v",), """
  select doc_id, field_name, field_value, 'str' as field_type, 0.8::double as confidence,
    'model' as extraction_method from invoice_fields_v""")


def stored_fields_v(t: Tables) -> DataFrame:
    return v.invoice_fields_v(t).select(
        "doc_id", "field_name", "field_value", F.lit("str").alias("field_type"),
        F.lit(0.8).alias("confidence"), F.lit("model").alias("extraction_method"),
    )


CTE["invoice_types_v"] = ((), """
  select o_orderkey as doc_id, case o_orderstatus when 'O' then 'Invoice' when 'F' then 'Letter'
    else 'Other' end as document_type from orders""")


def invoice_types_v(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "O", "Invoice").when(F.col("o_orderstatus") == "F", "Letter")
        .otherwise("Other").alias("document_type"),
    )


_SCHEMA_ROWS = ", ".join(
    f"('{t}', '{n}')" for t, names in fields.FIELD_SCHEMAS.items() for n in names)


@query("fld_04_missing_fields", with_ctes(["invoice_types_v", "invoice_fields_v"], f"""
    select doc_id, document_type, field_name from invoice_types_v
    join (values {_SCHEMA_ROWS}) s(document_type, field_name) using (document_type)
    where not exists (select 1 from invoice_fields_v f where f.doc_id = invoice_types_v.doc_id
                      and f.field_name = s.field_name)"""))
def _(t: Tables):
    return fields.missing_fields(invoice_types_v(t), v.invoice_fields_v(t))


def results_v(t: Tables) -> DataFrame:
    """Model results as JSON text, one object per invoice."""
    return v.invoices_v(t).select(
        "doc_id", "status",
        F.concat(
            F.lit('{"vendor_name": "'), F.coalesce("vendor", F.lit("")), F.lit('", "n_lines": '),
            F.coalesce(F.col("n_lines").cast("string"), F.lit("null")),
            F.lit(', "paid": true, "ratio": 0.25, "currency": null, "line_items": ["a","b"]}'),
        ).alias("result"),
    )


CTE["results_v"] = (("invoices_v",), """
  select doc_id, status, '{"vendor_name": "' || coalesce(vendor, '') || '", "n_lines": '
    || coalesce(cast(n_lines as varchar), 'null')
    || ', "paid": true, "ratio": 0.25, "currency": null, "line_items": ["a","b"]}' as result
  from invoices_v""")


@query("fld_05_json_fields", with_ctes(["results_v"], """
    select doc_id, k as field_name, nullif(json_extract_string(result, '$.' || k), '') as field_value,
      case when coalesce(json_extract_string(result, '$.' || k), '') = '' then 'string'
        else case json_type(result, '$.' || k) when 'VARCHAR' then 'str' when 'UBIGINT' then 'int'
          when 'BOOLEAN' then 'bool' when 'ARRAY' then 'list' else 'float' end end as field_type,
      0.9::double as confidence
    from (select doc_id, result, unnest(json_keys(result)) as k from results_v)"""))
def _(t: Tables):
    return fields.json_fields(results_v(t).withColumn("confidence", F.lit(0.9)))


@query("fld_06_json_recovery", with_ctes(["results_v"], """
    select doc_id, case status when 'P' then null else
      coalesce(json_extract_string(result, '$.n_lines'), 'null') end as n_lines from results_v"""))
def _(t: Tables):
    # Open ones answer plainly, finished ones with prose around it, pending ones without JSON.
    answer = (
        F.when(F.col("status") == "O", F.col("result"))
        .when(F.col("status") == "F", F.concat(F.lit("Sure, here it is:\n"), "result", F.lit("\nDone.")))
        .otherwise("I could not find any field.")
    )
    found = fields.recover_json(F.col("_a"))
    n = F.expr("variant_get(try_parse_json(_j), '$.n_lines', 'string')")
    return results_v(t).select("doc_id", answer.alias("_a")).select(
        "doc_id", found.alias("_j")
    ).select("doc_id", F.when(F.col("_j").isNotNull(), F.coalesce(n, F.lit("null"))).alias("n_lines"))


@query("fld_07_corrections", with_ctes(["stored_fields_v", "invoices_v"], """
    , c as (select doc_id, 'total_amount' as field_name, printf('%.2f', amount - 1) as v
        from invoices_v where status = 'F'
      union all select doc_id, 'currency', 'USD' from invoices_v where status = 'O')
    select coalesce(f.doc_id, c.doc_id) as doc_id, coalesce(f.field_name, c.field_name) as field_name,
      case when c.doc_id is not null then c.v else f.field_value end as field_value,
      coalesce(f.field_type, 'string') as field_type,
      case when f.doc_id is null then 1.0::double else f.confidence end as confidence,
      case when c.doc_id is not null then 'manual' else f.extraction_method end as extraction_method,
      c.doc_id is not null as is_corrected,
      case when c.doc_id is not null then f.field_value end as original_value
    from stored_fields_v f full join c on c.doc_id = f.doc_id and c.field_name = f.field_name
    """.replace("\n    , c as", ", c as", 1)))
def _(t: Tables):
    inv = v.invoices_v(t)
    fixes = inv.filter("status = 'F'").select(
        "doc_id", F.lit("total_amount").alias("field_name"),
        F.format_string("%.2f", F.col("amount") - 1).alias("field_value"),
    ).unionByName(inv.filter("status = 'O'").select(
        "doc_id", F.lit("currency").alias("field_name"), F.lit("USD").alias("field_value")))
    return fields.apply_corrections(stored_fields_v(t), fixes)


@query("fld_08_fields_with_type", with_ctes(["stored_fields_v", "invoice_types_v"], """
    select f.*, document_type from stored_fields_v f left join (select * from invoice_types_v
      where document_type <> 'Other') using (doc_id)"""))
def _(t: Tables):
    typed = invoice_types_v(t).filter("document_type <> 'Other'")
    return fields.fields_with_type(stored_fields_v(t), typed)


def forms_v(t: Tables) -> DataFrame:
    """Documents as labelled forms: BIO tags and confidences hashed from document, place and word."""
    w = tx.words(F.col("text"))
    u = F.transform(w, lambda x, i: v.hash_unit(F.col("doc_id"), i, x))
    return t.documents.select("doc_id", w.alias("words"), u.alias("_u")).select(
        "doc_id", "words",
        F.transform("_u", lambda x: F.when(x < 0.1, "B-QUESTION").when(x < 0.15, "B-ANSWER")
                    .when(x < 0.35, "I-QUESTION").when(x < 0.5, "I-ANSWER").otherwise("O"))
        .alias("labels"),
        F.transform("_u", lambda x: F.round(x, 3)).alias("confidences"),
    )


CTE["tokens_v"] = ((), f"""
  select *, round(u, 3) as conf, case when u < 0.1 then 'B-QUESTION' when u < 0.15 then 'B-ANSWER'
      when u < 0.35 then 'I-QUESTION' when u < 0.5 then 'I-ANSWER' else 'O' end as label
  from (select doc_id, pos, word, {v.sql_hash_unit('doc_id', 'pos', 'word')} as u from (
    select doc_id, unnest(range(len(ws))) as pos, unnest(ws) as word from (
      select doc_id, {v.sql_words('text')} as ws from documents)))""")


@query("fld_09_spans_until_break", with_ctes(["tokens_v"], """
    select doc_id, row_number() over (partition by doc_id order by g) - 1 as pos,
      lower(substr(min_by(label, pos), 3)) as field_name,
      string_agg(word, ' ' order by pos) as field_value
    from (select *, sum(case when label not like 'I-%' then 1 else 0 end) over
            (partition by doc_id order by pos) as g from tokens_v)
    group by doc_id, g having min_by(label, pos) like 'B-%'"""))
def _(t: Tables):
    return ids(fields.spans_until_break(forms_v(t).select("doc_id", "words", "labels")))


@query("fld_10_spans_by_type", with_ctes(["tokens_v"], """
    select doc_id, row_number() over (partition by doc_id order by g) - 1 as pos,
      substr(kind, 3) as field_type, string_agg(word, ' ' order by pos) as field_value,
      min(conf) as confidence
    from (select *, first_value(label) over (partition by doc_id, g order by pos) as kind
      from (select *, sum(case when label like 'B-%' then 1 else 0 end) over
              (partition by doc_id order by pos) as g from tokens_v where label <> 'O'))
    where g > 0 and (label like 'B-%' or substr(label, 3) = substr(kind, 3))
    group by doc_id, g, kind"""))
def _(t: Tables):
    return ids(fields.spans_by_type(forms_v(t)))


@query("fld_11_validation", with_ctes(["invoices_v", "invoice_fields_v"], """
    select doc_id, 'due_date' as field_name, 'before_date' as rule,
      cast(due_date as varchar) as field_value from invoices_v where due_date < invoice_date
    union all select doc_id, 'tax_amount', 'above_total', printf('%.2f', tax) from invoices_v
      where cast(printf('%.2f', tax) as double) > cast(printf('%.2f', amount) as double)
    union all select o_orderkey, 'email', 'bad_email', o_orderpriority from orders
    union all select o_orderkey, 'contract_value', 'not_an_amount', o_orderpriority from orders
    union all select o_orderkey, 'effective_date', 'not_a_date', o_orderpriority from orders"""))
def _(t: Tables):
    wrong = t.orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.explode(F.array(*map(F.lit, ("email", "contract_value", "effective_date"))))
        .alias("field_name"), F.col("o_orderpriority").alias("field_value"),
    )
    return fields.validation_errors(v.invoice_fields_v(t).unionByName(wrong))
