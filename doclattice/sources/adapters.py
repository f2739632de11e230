"""Schema adapters for public dataset shapes: forms, receipts, scanned pages, question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.functions.rows import unnest

# ---------------------------------------------------------------------------------------------
# Label lists and label maps of the public datasets.
FORM_LABELS = ("O", "B-HEADER", "I-HEADER", "B-QUESTION", "I-QUESTION", "B-ANSWER", "I-ANSWER")
SCAN_CATEGORIES = {
    "letter": "Letter", "form": "Other", "email": "Letter", "handwritten": "Other",
    "advertisement": "Other", "scientific_report": "Report", "scientific_publication": "Report",
    "specification": "Other", "file_folder": "Other", "news_article": "Report", "budget": "Other",
    "invoice": "Invoice", "questionnaire": "Other", "resume": "Resume", "memo": "Letter",
    "presentation": "Other",
}
MENU_NAMES = ("menu.nm", "menu.sub_nm")
MENU_PRICES = ("menu.price", "menu.unitprice", "menu.itemsubtotal", "menu.sub_price",
               "menu.sub_unitprice")
# ---------------------------------------------------------------------------------------------

BOX_SCALE = 1000


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """Box coordinates as whole thousandths of the page; 0 for a page without extent."""
    def scaled(v: Column, extent: Column) -> Column:
        return F.when(extent > 0, F.floor(BOX_SCALE * v / extent).cast("int")).otherwise(0)

    return F.transform(
        box, lambda x, i: F.when(i % 2 == 0, scaled(x, width)).otherwise(scaled(x, height))
    )


def form_label(tag: Column) -> Column:
    """Label of an integer tag; anything out of range is ``O``."""
    names = F.array(*[F.lit(x) for x in FORM_LABELS])
    return F.coalesce(F.when(tag >= 0, F.get(names, tag)), F.lit("O"))


def known_label(name: Column) -> Column:
    return F.when(name.isin(*FORM_LABELS), name).otherwise("O")


def form_records(raw: DataFrame) -> DataFrame:
    """Labelled forms: scaled boxes and label names; forms without words are dropped."""
    return raw.filter(F.size("words") > 0).select(
        *[c for c in raw.columns if c not in ("bboxes", "ner_tags")],
        F.transform("bboxes", lambda b: scaled_box(b, F.col("width"), F.col("height"))).alias("bboxes"),
        F.transform("ner_tags", form_label).alias("ner_labels"),
    )


def receipt_label(label: Column) -> Column:
    """Coarse label of a fine receipt label, with the B-/I- prefix kept."""
    prefix = F.regexp_extract(label, "^([BI]-)", 1)
    field = F.regexp_replace(label, "^[BI]-", "")
    coarse = (
        F.when(field.isin(*MENU_NAMES), "MENU_ITEM")
        .when(field.isin(*MENU_PRICES), "MENU_PRICE")
        .when(field.startswith("sub_total") & field.contains("tax"), "TAX")
        .when(field.startswith("sub_total"), "SUBTOTAL")
        .when(field.startswith("total.total"), "TOTAL")
        .when(field.startswith("total") | (prefix != ""), "OTHER")
    )
    blank = label.isNull() | label.isin("", "O")
    return F.when(blank | coarse.isNull(), "O").otherwise(F.concat(prefix, coarse))


def receipt_fields(receipts: DataFrame) -> DataFrame:
    """(receipt, group, field, value) from nested JSON: groups hold an object or a list of objects;
    only non-empty strings count. Broken JSON gives no rows."""
    root = F.expr("try_parse_json(ground_truth)")
    # Outer forms with a filter above, as in ``rows.unnest``: plain ones compute each array and map three
    # times, and a filter below them parses every text twice.
    groups = F.expr(
        "case when schema_of_variant(_v) like 'OBJECT%' then"
        " cast(coalesce(try_variant_get(_v, '$.gt_parse', 'variant'), _v) as map<string, variant>) end"
    )
    as_list = F.expr(
        "coalesce(try_variant_get(_g, '$', 'array<variant>'), array(_g))"
    )
    return (
        unnest(
            receipts.select("doc_id", root.alias("_v"))
            .select("doc_id", F.explode_outer(groups).alias("group", "_g")).filter("`group` is not null"),
            ["doc_id", "group"], as_list, "item", "_i")
        .select("doc_id", "group", "item",
                F.explode_outer(F.expr("try_variant_get(_i, '$', 'map<string, variant>')"))
                .alias("key", "_x"))
        .filter("key is not null and schema_of_variant(_x) = 'STRING'")
        .select("doc_id", "group", "item",
                F.concat("group", F.lit("."), "key").alias("field_name"),
                F.expr("cast(_x as string)").alias("field_value"))
        .filter("field_value <> ''")
        .withColumn("field_value", F.trim("field_value"))
    )


def receipt_records(fields: DataFrame) -> DataFrame:
    """Flattened text and field structs per receipt, in group, item and field order."""
    packed = F.array_sort(F.collect_list(F.struct("group", "item", "field_name", "field_value")))
    return fields.groupBy("doc_id").agg(packed.alias("_f")).select(
        "doc_id",
        F.array_join(F.transform("_f", lambda f: F.concat(
            f["field_name"], F.lit(": "), f["field_value"])), "\n").alias("text"),
        F.transform("_f", lambda f: F.struct(
            f["field_name"].alias("field_name"), f["field_value"].alias("field_value"),
            F.lit("string").alias("field_type"), F.lit(1.0).alias("confidence"))).alias("fields"),
        F.size("_f").alias("field_count"),
        F.array_sort(F.array_distinct(F.transform("_f", lambda f: f["group"]))).alias("groups"),
    )


def scan_category(class_name: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in SCAN_CATEGORIES.items() for x in pair])
    return mapping[class_name]


def scan_records(raw: DataFrame) -> DataFrame:
    """Scanned pages: class index to class name to category."""
    names = F.array(*[F.lit(x) for x in SCAN_CATEGORIES])
    named = raw.withColumn("class_name", F.get(names, F.col("label")))
    return named.withColumn("category", scan_category(F.col("class_name")))


def question_records(raw: DataFrame) -> DataFrame:
    """Question answering: first answer, a context from the question where none is given; records
    without question or answer are dropped. ``raw(question, context, answers)``."""
    return (
        raw.withColumn("answer", F.get("answers", F.lit(0)))
        .filter("coalesce(question, '') <> '' and coalesce(answer, '') <> ''")
        .withColumn("context", F.coalesce(
            F.nullif("context", F.lit("")),
            F.concat(F.lit("[Document context for question: "), "question", F.lit("]"))))
    )
