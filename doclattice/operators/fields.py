"""Field extraction: patterns, entities, token spans, schemas, merges and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.functions import text as tx
from doclattice.functions.rows import unnest

# ---------------------------------------------------------------------------------------------
# Field patterns.
FIELD_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "date": (
        r"(?i)\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|"
        r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
    ),
    "amount": r"\$[\d,]+\.?\d*|\d+\.?\d*\s*(?:USD|EUR|GBP)",
    "url": r"https?://[^\s<>\"']+",
}
# Entity label -> field name.
ENTITY_FIELDS = {
    "PERSON": "person_name", "ORG": "organization", "GPE": "location", "LOC": "location",
    "DATE": "date", "MONEY": "amount", "CARDINAL": "number", "ORDINAL": "number",
    "FAC": "facility", "PRODUCT": "product", "EVENT": "event", "LAW": "legal_reference",
    "WORK_OF_ART": "title", "PERCENT": "percentage",
}
ENTITY_CONFIDENCE = 0.85
# Fields requested per document type (none for Other).
FIELD_SCHEMAS = {
    "Invoice": ("vendor_name", "invoice_number", "date", "due_date", "total_amount", "tax_amount",
                "line_items", "currency"),
    "Contract": ("parties", "effective_date", "termination_date", "key_terms", "governing_law",
                 "contract_value"),
    "Report": ("title", "author", "date", "summary", "key_findings", "organization"),
    "Resume": ("name", "email", "phone", "education", "experience", "skills", "location"),
    "Letter": ("sender", "recipient", "date", "subject", "key_points"),
}
# ---------------------------------------------------------------------------------------------

# Some of these patterns as Java's engine finds them faster, with the same matches: a class of the first
# characters ahead, parts that never need to give anything back, letters of either case where letters are.
# A number in a run of digits is tried from the run's start only.
_JAVA_FORMS = {
    FIELD_PATTERNS["phone"]: r"(?=[+(\d])" + FIELD_PATTERNS["phone"],
    FIELD_PATTERNS["date"]: (
        r"(?=[\dJFMASONDjfmasond])\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|"
        r"(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[A-Za-z]*\s+\d{1,2},?\s+\d{4})\b"
    ),
    FIELD_PATTERNS["amount"]: r"(?=[$\d])(?:\$[\d,]++\.?+\d*+|(?<!\d)\d++(?:\.\d*+)?+\s*+(?:USD|EUR|GBP))",
}

# Default offline tagger: a pattern per entity label; any tagger may supply such rows instead.
TAGGER_PATTERNS = {
    "DATE": r"\d{4}-\d{2}-\d{2}",
    "MONEY": r"\$[\d,]+\.?\d*",
    "ORG": r"Supplier#\d+",
    "PRODUCT": r"INVOICE \d+",
    "LANGUAGE": r"net \d+",
}


def _matches(text_col: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text_col), F.lit(_JAVA_FORMS.get(pattern, pattern)), F.lit(0))


def extract_patterns(
    documents: DataFrame, text_col: str = "text", patterns: dict[str, str] = FIELD_PATTERNS
) -> DataFrame:
    """(doc, field, value): the distinct matches of each pattern, found and unnested in the row."""
    per_field = F.array(*[
        F.struct(
            F.lit(name).alias("field_name"),
            F.array_distinct(_matches(text_col, p)).alias("v"),
        )
        for name, p in patterns.items()
    ])
    matched = unnest(documents, ["doc_id"], per_field, "_n", "_f")
    return unnest(matched, ["doc_id", "_f.field_name"], "_f.v", "_n", "field_value").drop("_n")


def pattern_spans(text: Column, pattern: str, label: str) -> Column:
    """Matches of a pattern with their character offsets, as an array of entity structs."""
    kind = "array<struct<label:string,value:string,start:int,end:int>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), lambda g: F.length(g))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    step = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def merge(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.coalesce(x["g"], F.lit(0))
        end = at + F.coalesce(F.length(x["m"]), F.lit(0))
        entity = F.struct(F.lit(label).alias("label"), x["m"].alias("value"), at.alias("start"),
                          end.alias("end"))
        return F.struct(
            end.alias("pos"),
            F.when(x["m"].isNotNull(), F.concat(acc["out"], F.array(entity)))
            .otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(step, start, merge, lambda acc: acc["out"])


def tag_entities(
    documents: DataFrame, text_col: str = "text", patterns: dict[str, str] = TAGGER_PATTERNS
) -> DataFrame:
    """Entity rows (doc, label, value, start, end) by the default pattern tagger."""
    spans = F.concat(*[pattern_spans(F.col(text_col), p, n) for n, p in patterns.items()])
    return unnest(documents, ["doc_id"], spans, "_n", "_e").select("doc_id", "_e.*")


def entity_fields(entities: DataFrame) -> DataFrame:
    """Map labels to fields, drop the others, keep the first of equal values per document field."""
    mapping = F.create_map(*[F.lit(x) for pair in ENTITY_FIELDS.items() for x in pair])
    named = entities.withColumn("field_name", mapping[F.col("label")]).filter(
        "field_name is not null"
    ).withColumn("value", tx.strip(F.col("value")))
    first = F.min(F.struct("start", "end", "label"))
    return named.groupBy("doc_id", "field_name", F.col("value").alias("field_value")).agg(
        first.alias("_f")
    ).select("doc_id", "field_name", "field_value", "_f.*",
             F.lit(ENTITY_CONFIDENCE).alias("confidence"))


def merged_values(
    documents: DataFrame, text_col: str = "text", patterns: dict[str, str] = FIELD_PATTERNS,
    tags: dict[str, str] = TAGGER_PATTERNS,
) -> DataFrame:
    """Set union of what :func:`extract_patterns` and :func:`entity_fields` of :func:`tag_entities` give
    per document and field, found in one reading of the text. Places of the entities are not asked for,
    so the text is not split, and equal values of a field meet in the row."""
    found = {name: [_matches(text_col, p)] for name, p in patterns.items()}
    for label, p in tags.items():
        if label in ENTITY_FIELDS:
            values = F.transform(_matches(text_col, p), tx.strip)
            found.setdefault(ENTITY_FIELDS[label], []).append(values)
    per_field = F.array(*[
        F.struct(F.lit(name).alias("field_name"),
                 F.array_distinct(F.concat(*v) if len(v) > 1 else v[0]).alias("v"))
        for name, v in found.items()
    ])
    matched = unnest(documents, ["doc_id"], per_field, "_n", "_f")
    values = unnest(matched, ["doc_id", "_f.field_name"], "_f.v", "_n", "field_value")
    return merge_extractions(values)


def merge_extractions(*tables: DataFrame) -> DataFrame:
    """Set union of extracted values per document and field."""
    cols = ["doc_id", "field_name", "field_value"]
    merged = tables[0].select(cols)
    for other in tables[1:]:
        merged = merged.unionByName(other.select(cols))
    return merged.distinct()


def schema_grid(classifications: DataFrame) -> DataFrame:
    """Expected (document, field) rows by type; the schema is a constant map, not a join."""
    schemas = F.create_map(*[
        x for t, names in FIELD_SCHEMAS.items() for x in (F.lit(t), F.array(*map(F.lit, names)))
    ])
    return classifications.select(
        "doc_id", "document_type", F.explode(schemas[F.col("document_type")]).alias("field_name")
    )


def missing_fields(classifications: DataFrame, fields: DataFrame) -> DataFrame:
    have = fields.filter("field_value is not null").select("doc_id", "field_name")
    return schema_grid(classifications).join(have, ["doc_id", "field_name"], "left_anti")


def json_fields(results: DataFrame) -> DataFrame:
    """Rows of a flat JSON result: empty values become NULL, with the JSON type as field type.

    ``results(doc_id, result, confidence)``.
    """
    exploded = results.select(
        "doc_id", "confidence",
        F.explode(F.expr("cast(try_parse_json(result) as map<string, variant>)")).alias("key", "value"),
    )
    text = F.expr("cast(value as string)")
    kind = F.expr("schema_of_variant(value)")
    type_name = (
        F.when(kind == "STRING", "str").when(kind == "BIGINT", "int")
        .when(kind == "BOOLEAN", "bool").when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict").when(kind == "VOID", "string").otherwise("float")
    )
    value = F.nullif(text, F.lit(""))
    return exploded.select(
        "doc_id", F.col("key").alias("field_name"), value.alias("field_value"),
        F.when(value.isNull(), "string").otherwise(type_name).alias("field_type"), "confidence",
    )


def recover_json(text: Column) -> Column:
    """The text if it parses as JSON, else the part from the first ``{`` to the last ``}`` if that
    does, else NULL."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(
        F.when(F.try_parse_json(text).isNotNull(), text),
        F.when(F.try_parse_json(inner).isNotNull(), inner),
    )


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected rows keep the old value; corrections of absent fields become new rows."""
    key = ["doc_id", "field_name"]
    f = fields.select(*key, F.struct(
        "field_value", "field_type", "confidence", "extraction_method").alias("f"))
    c = corrections.select(*key, F.struct(F.col("field_value").alias("v")).alias("c"))
    corrected = F.col("c").isNotNull()
    return f.join(c, key, "full_outer").select(
        *key,
        F.when(corrected, F.col("c.v")).otherwise(F.col("f.field_value")).alias("field_value"),
        F.when(F.col("f").isNull(), "string").otherwise(F.col("f.field_type")).alias("field_type"),
        F.when(F.col("f").isNull(), 1.0).otherwise(F.col("f.confidence")).alias("confidence"),
        F.when(corrected, "manual").otherwise(F.col("f.extraction_method")).alias("extraction_method"),
        corrected.alias("is_corrected"),
        F.when(corrected, F.col("f.field_value")).alias("original_value"),
    )


def corrections_export(fields: DataFrame) -> DataFrame:
    """Human corrections for retraining, ordered by field name."""
    return (
        fields.filter("is_corrected")
        .select("doc_id", "field_name", "original_value",
                F.col("field_value").alias("corrected_value"), "extraction_method")
        .orderBy("field_name", "doc_id")
    )


def fields_with_type(fields: DataFrame, classifications: DataFrame) -> DataFrame:
    return fields.join(
        classifications.select("doc_id", "document_type"), "doc_id", "left"
    ).orderBy("doc_id", "field_name")


# -- token spans ------------------------------------------------------------------------------

def _positions(labels: Column, test) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: test(F.get(labels, i)))


def spans_until_break(forms: DataFrame) -> DataFrame:
    """Spans from ``B-`` over following ``I-`` of any type; anything else ends them.

    ``forms(doc_id, words, labels)``: parallel arrays, handled inside the row.
    """
    labels, words, n = F.col("labels"), F.col("words"), F.size("labels")
    stops = F.col("_stops")
    spans = F.transform(
        stops, lambda p, j: F.struct(p.alias("p"), F.coalesce(F.get(stops, j + 1), n).alias("e"))
    )
    spans = F.filter(spans, lambda s: F.startswith(F.get(labels, s["p"]), F.lit("B-")))
    rows = F.transform(spans, lambda s: F.struct(
        F.lower(F.substr(F.get(labels, s["p"]), F.lit(3))).alias("field_name"),
        F.array_join(F.slice(words, s["p"] + 1, s["e"] - s["p"]), " ").alias("field_value"),
    ))
    marked = forms.withColumn(
        "_stops", F.when(n > 0, _positions(labels, lambda x: ~F.startswith(x, F.lit("I-"))))
    )
    return unnest(marked, ["doc_id"], rows, "pos", "_s").select("doc_id", "pos", "_s.*")


def spans_by_type(forms: DataFrame) -> DataFrame:
    """Spans from ``B-`` to the next ``B-``, of the ``I-`` tokens with the same type; the lowest
    token confidence counts. ``forms`` also has ``confidences``."""
    labels, words, conf, n = F.col("labels"), F.col("words"), F.col("confidences"), F.size("labels")
    starts = F.col("_starts")

    def row(p: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), n)
        kind = F.substr(F.get(labels, p), F.lit(3))
        members = F.filter(
            F.sequence(p, end - 1),
            lambda i: (i == p) | (F.get(labels, i) == F.concat(F.lit("I-"), kind)),
        )
        return F.struct(
            kind.alias("field_type"),
            F.array_join(F.transform(members, lambda i: F.get(words, i)), " ").alias("field_value"),
            F.array_min(F.transform(members, lambda i: F.get(conf, i))).alias("confidence"),
        )

    marked = forms.withColumn(
        "_starts", F.when(n > 0, _positions(labels, lambda x: F.startswith(x, F.lit("B-"))))
    )
    return unnest(marked, ["doc_id"], F.transform(starts, row), "pos", "_s").select(
        "doc_id", "pos", "_s.*"
    )


# -- validation -------------------------------------------------------------------------------

DATE_FIELDS = ("date", "due_date", "effective_date", "termination_date")
AMOUNT_FIELDS = ("total_amount", "tax_amount", "contract_value")
DATE_ORDER = (("date", "due_date"), ("effective_date", "termination_date"))


def validation_errors(fields: DataFrame) -> DataFrame:
    """Type, format and cross-field violations as long rows (doc, field, rule, value)."""
    value = F.col("field_value")
    amount = F.regexp_replace(value, r"[$,]", "").try_cast("double")
    checks = F.filter(F.array(
        F.when(F.col("field_name").isin(*DATE_FIELDS) & F.expr(
            "try_to_date(field_value, 'yyyy-MM-dd')").isNull(), "not_a_date"),
        F.when(F.col("field_name").isin(*AMOUNT_FIELDS) & amount.isNull(), "not_an_amount"),
        F.when(F.col("field_name").isin(*AMOUNT_FIELDS) & (amount < 0), "negative_amount"),
        F.when((F.col("field_name") == "email") & ~value.rlike(r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"),
               "bad_email"),
    ), lambda x: x.isNotNull())
    single = fields.select("doc_id", "field_name", F.explode(checks).alias("rule"), "field_value")

    used = sorted({f for pair in DATE_ORDER for f in pair} | {"total_amount", "tax_amount"})
    wide = fields.filter(F.col("field_name").isin(*used)).groupBy("doc_id").agg(*[
        F.max(F.when(F.col("field_name") == f, value)).alias(f) for f in used
    ])

    def day(c: str) -> Column:
        return F.expr(f"try_to_date({c}, 'yyyy-MM-dd')")

    def number(c: str) -> Column:
        return F.regexp_replace(c, r"[$,]", "").try_cast("double")

    cross = F.filter(F.array(
        *[F.when(day(b) < day(a), F.struct(F.lit(b).alias("field_name"),
                                           F.lit(f"before_{a}").alias("rule"),
                                           F.col(b).alias("field_value"))) for a, b in DATE_ORDER],
        F.when(number("tax_amount") > number("total_amount"),
               F.struct(F.lit("tax_amount").alias("field_name"),
                        F.lit("above_total").alias("rule"),
                        F.col("tax_amount").alias("field_value"))),
    ), lambda x: x.isNotNull())
    return single.unionByName(wide.select("doc_id", F.explode(cross).alias("_c")).select(
        "doc_id", "_c.*"))
