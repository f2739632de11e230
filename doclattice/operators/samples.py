"""Training-set preparation: balance, filter, dedupe, split, mix, format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions import text as tx

MIN_INPUT_WORDS, MIN_OUTPUT_WORDS, MAX_INPUT_WORDS = 20, 5, 3000
MIN_SCAN_CHARS = 50
DEDUPE_CHARS = 200
TRAIN_SHARE, VAL_SHARE = 0.8, 0.9
MIN_SUMMARY_WORDS = 50

# ---------------------------------------------------------------------------------------------
# Texts that become part of the samples.
QA_INSTRUCTIONS = (
    "Answer the following question based on the provided document context.",
    "Based on the document below, answer the question. If the answer is not in the document, say so.",
    "Using only the information in the provided text, answer this question.",
    "Read the document and answer the question with specific details from the text.",
)
UNANSWERABLE_RESPONSES = (
    "The document does not contain enough information to answer this question.",
    "Based on the provided document, this question cannot be answered.",
    "The answer to this question is not found in the given text.",
)
SUMMARY_INSTRUCTIONS = (
    "Summarize the following document in 2-3 sentences.",
    "Provide a brief summary of the key points in this text.",
    "What are the main ideas presented in this passage?",
)
WITH_INPUT = "### Instruction:\n%s\n\n### Input:\n%s\n\n### Response:\n%s"
WITHOUT_INPUT = "### Instruction:\n%s\n\n### Response:\n%s"
SPLIT_ALIASES = {
    "train": "train", "training": "train", "test": "test", "testing": "test",
    "validation": "validation", "val": "validation",
}
# ---------------------------------------------------------------------------------------------


def shuffle_key(key: Column, seed: str = "") -> Column:
    """Reproducible shuffle order: md5 of the key (and a seed)."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def shuffled_rank(
    df: DataFrame, key: str, strata: tuple[str, ...] = (), seed: str = "", prefix: int = 4
) -> DataFrame:
    """Add ``rank`` (1..n in md5 order of the key) and ``n`` per stratum, exactly and in parallel.

    A plain row_number over a stratum would sort it in one task. Here rows are counted per hash
    prefix, the small count table gives each prefix its offset, and only rows of one prefix are
    sorted together, so a stratum of any size is spread over all prefixes.
    """
    hashed = df.withColumn("_h", shuffle_key(F.col(key), seed)).withColumn(
        "_b", F.substring("_h", 1, prefix)
    )
    counts = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    per = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    offsets = counts.withColumn(
        "_before", F.sum("_c").over(per.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("n", F.sum("_c").over(per)).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    return (
        hashed.withColumn("_r", inside)
        .join(offsets, [*strata, "_b"])
        .withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def split_name(rank: Column, n: Column) -> Column:
    """80/10/10 by position: the cuts are whole-number parts of the size."""
    return (
        F.when(rank <= F.floor(n * TRAIN_SHARE), "train")
        .when(rank <= F.floor(n * VAL_SHARE), "val")
        .otherwise("test")
    )


def shuffled_split(df: DataFrame, key: str, strata: tuple[str, ...] = (), seed: str = "") -> DataFrame:
    ranked = shuffled_rank(df, key, strata, seed)
    return ranked.withColumn("split", split_name(F.col("rank"), F.col("n"))).drop("rank", "n")


def balanced_sample(df: DataFrame, category: str, order: str, max_samples: int, n_categories: int,
                    text_col: str = "text", min_chars: int = MIN_SCAN_CHARS) -> DataFrame:
    """First ``max_samples // n_categories`` long enough rows per category, in stream order."""
    w = Window.partitionBy(category).orderBy(order)
    return (
        df.filter(F.length(text_col) >= min_chars)
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= max_samples // n_categories)
        .drop("_n")
    )


def rejection_reason(inp: Column, out: Column, task: Column) -> Column:
    """First failing quality rule, or ``ok``."""
    low = F.lower(inp)
    words_in, words_out = tx.word_count(inp), tx.word_count(out)
    return (
        F.when(words_in < MIN_INPUT_WORDS, "input_too_short")
        .when(words_out < MIN_OUTPUT_WORDS, "output_too_short")
        .when(words_in > MAX_INPUT_WORDS, "input_too_long")
        .when(low.contains("[insert") | low.contains("lorem ipsum"), "placeholder_text")
        .when(tx.strip(inp) == tx.strip(out), "input_equals_output")
        .when((task == "extraction") & ~out.contains("{") & ~out.contains("["),
              "extraction_missing_json")
        .otherwise("ok")
    )


def quality_filter(samples: DataFrame) -> DataFrame:
    return samples.withColumn(
        "reason",
        rejection_reason(F.coalesce("input", F.lit("")), F.coalesce("output", F.lit("")),
                         F.coalesce("task_type", F.lit(""))),
    )


def output_key(out: Column) -> Column:
    return F.md5(tx.strip(F.lower(F.substring(F.coalesce(out, F.lit("")), 1, DEDUPE_CHARS))))


def deduplicate(samples: DataFrame, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """First sample of each output key (per task if given). Each task keeps one row per key before
    the shuffle, so a key shared by many samples does not pile up."""
    w = Window.partitionBy(*within, "_k").orderBy(order)
    return (
        samples.withColumn("_k", output_key(F.col("output")))
        .withColumn("_n", F.row_number().over(w))
        .filter("_n = 1")
        .drop("_k", "_n")
    )


def deduplicate_twice(samples: DataFrame, order: str) -> DataFrame:
    """Per task first, then over all tasks in task order."""
    return deduplicate(deduplicate(samples, order, ("task_type",)), order)


def pick(options: tuple[str, ...], key: Column, seed: str = "") -> Column:
    """One of the options, chosen by the md5 of the key."""
    number = F.conv(F.substring(shuffle_key(key, seed), 1, 7), 16, 10).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), number % len(options) + 1)


def with_question(instruction: Column, question: Column) -> Column:
    return F.concat(instruction, F.lit("\n\nQuestion: "), question)


def answer_samples(records: DataFrame, source: str, doc_type: str) -> DataFrame:
    """Question-answering samples; records without answer get a refusal.

    ``records(record_id, question, context, answers)``, see ``adapters.question_records``.
    """
    key = F.col("record_id")
    answer = F.get("answers", F.lit(0))
    return records.select(
        "record_id",
        with_question(pick(QA_INSTRUCTIONS, key, "i"), F.col("question")).alias("instruction"),
        F.col("context").alias("input"),
        F.coalesce(answer, pick(UNANSWERABLE_RESPONSES, key, "u")).alias("output"),
        F.lit("question_answering").alias("task_type"), F.lit(doc_type).alias("doc_type"),
        F.lit(source).alias("source"),
    )


def answerable_mix(records: DataFrame, max_samples: int, share: float = 0.8) -> DataFrame:
    """Quota of answerable and unanswerable records, each in shuffled order."""
    n_yes = int(max_samples * share)
    quota = F.when(F.col("answerable"), n_yes).otherwise(max_samples - n_yes)
    marked = records.filter("coalesce(context, '') <> '' and coalesce(question, '') <> ''").withColumn(
        "answerable", F.coalesce(F.size("answers") > 0, F.lit(False))
    )
    ranked = shuffled_rank(marked, "record_id", ("answerable",), "mix")
    return ranked.filter(F.col("rank") <= quota).drop("rank", "n")


def lead_summary(context: Column) -> Column:
    """First two sentences, cut at period and blank after other enders became periods."""
    flat = F.replace(F.replace(context, F.lit("! "), F.lit(".\n")), F.lit("? "), F.lit(".\n"))
    lead = tx.strip(F.array_join(F.slice(F.split(flat, r"\. "), 1, 2), ". "))
    return F.when(lead.endswith("."), lead).otherwise(F.concat(lead, F.lit(".")))


def summary_samples(contexts: DataFrame, order: str, max_samples: int | None = None) -> DataFrame:
    """Distinct contexts of more than 50 words with their lead as summary.

    ``contexts(context, <order>)``; the first of equal contexts counts, found by content hash.
    """
    long_ones = contexts.filter(tx.word_count(F.col("context")) > MIN_SUMMARY_WORDS)
    w = Window.partitionBy(F.sha2("context", 256)).orderBy(order)
    unique = long_ones.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    if max_samples is not None:
        unique = unique.orderBy(order).limit(max_samples)
    return unique.select(
        order, pick(SUMMARY_INSTRUCTIONS, F.col(order), "s").alias("instruction"),
        F.col("context").alias("input"), lead_summary(F.col("context")).alias("output"),
        F.lit("summarization").alias("task_type"), F.lit("article").alias("doc_type"),
        F.lit("summarization").alias("source"),
    )


def mixture_target(n_real: int, real_ratio: float, n_tasks: int) -> tuple[int, int]:
    """Synthetic samples wanted for a real share, in total and per task (at least 10)."""
    total = int(n_real * (1 - real_ratio) / real_ratio)
    return total, max(10, total // n_tasks)


def mix_sources(real: DataFrame, synthetic: DataFrame, real_ratio: float, n_tasks: int,
                key: str = "sample_id") -> DataFrame:
    """All real samples and, per task, as many synthetic ones as the ratio asks for.

    The target is a scalar of the plan, so nothing is counted on the driver.
    """
    n_real = real.agg(F.count("*")).scalar()
    total = F.floor(n_real * F.lit(1 - real_ratio) / F.lit(real_ratio))
    quota = F.greatest(F.lit(10), F.floor(total / n_tasks))
    ranked = shuffled_rank(synthetic, key, ("task_type",), "mix")
    return real.unionByName(ranked.filter(F.col("rank") <= quota).drop("rank", "n"))


def prompt_text(instruction: Column, inp: Column, out: Column) -> Column:
    return F.when(
        tx.is_blank(inp), F.format_string(WITHOUT_INPUT, instruction, out)
    ).otherwise(F.format_string(WITH_INPUT, instruction, inp, out))


def _json_string(s: Column) -> Column:
    quoted = F.to_json(F.array(s))
    # Most strings have nothing to escape; a JSON writer is started for the others only.
    odd = s.rlike(r'[\x00-\x1f"\\]')
    return F.when(~odd, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def fields_as_json(fields: Column) -> Column:
    """Field structs as an indented JSON object; a repeated name holds an array of its values."""
    def entry(name: Column) -> Column:
        values = F.transform(F.filter(fields, lambda f: f["field_name"] == name),
                             lambda f: _json_string(f["field_value"]))
        many = F.concat(F.lit("[\n    "), F.array_join(values, ",\n    "), F.lit("\n  ]"))
        return F.concat(F.lit("  "), _json_string(name), F.lit(": "),
                        F.when(F.size(values) > 1, many).otherwise(F.get(values, F.lit(0))))

    names = F.array_distinct(F.transform(fields, lambda f: f["field_name"]))
    return F.when(F.size(fields) > 0, F.concat(
        F.lit("{\n"), F.array_join(F.transform(names, entry), ",\n"), F.lit("\n}"))).otherwise("{}")


def extraction_samples(records: DataFrame) -> DataFrame:
    """Extraction samples from texts with field lists (doc_id, text, fields, doc_type, source)."""
    return records.select(
        "doc_id",
        F.concat(F.lit("Extract all key fields from this "), "doc_type",
                 F.lit(" as structured JSON.")).alias("instruction"),
        F.col("text").alias("input"), fields_as_json(F.col("fields")).alias("output"),
        F.lit("extraction").alias("task_type"), "doc_type", "source",
    )


def resolve_splits(samples: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Given splits by alias; a tenth of train (at least one) becomes validation where none was
    given; rows without a known split are spread 80/10/10."""
    names = F.create_map(*[F.lit(x) for pair in SPLIT_ALIASES.items() for x in pair])
    known = samples.withColumn("_s", F.coalesce(names[F.col(split)], F.lit("none")))
    has_validation = known.agg(F.max((F.col("_s") == "validation").cast("int"))).scalar()
    ranked = shuffled_rank(known, key, ("_s",), "split")
    carve = F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))
    spread = (
        F.when(F.col("rank") <= F.floor(F.col("n") * TRAIN_SHARE), "train")
        .when(F.col("rank") <= F.floor(F.col("n") * VAL_SHARE), "validation").otherwise("test")
    )
    return ranked.withColumn(
        split,
        F.when(F.col("_s") == "none", spread)
        .when((F.col("_s") == "train") & (F.coalesce(has_validation, F.lit(0)) == 0)
              & (F.col("rank") <= carve), "validation")
        .otherwise(F.col("_s")),
    ).drop("_s", "rank", "n")


def value_distribution(df: DataFrame, array_col: str, name: str = "label") -> DataFrame:
    """Counts and share of the values of an array column."""
    counted = df.select(F.explode(array_col).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("share", F.round(F.col("n") / total, 6)).orderBy(F.desc("n"), name)
