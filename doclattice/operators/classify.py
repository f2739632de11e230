"""Document classification: probability vectors, confidence routing, upserts, a fitted model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The document types.
DOCUMENT_TYPES = ("Invoice", "Contract", "Report", "Resume", "Letter", "Other")
CONFIDENCE_THRESHOLD = 0.7
LIGHT_METHOD, FALLBACK_METHOD = "lightweight_classifier", "zero_shot"


def label_scores(probs: Column, labels: tuple[str, ...] = DOCUMENT_TYPES) -> dict[str, Column]:
    """Argmax label (first of equals), its probability, and the label -> score map."""
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_max(probs)
    return {
        "category": F.element_at(names, F.array_position(probs, best).cast("int")),
        "confidence": best,
        "scores": F.map_from_arrays(names, probs),
    }


def known_category(category: Column) -> Column:
    return F.when(category.isin(*DOCUMENT_TYPES), category).otherwise("Other")


def valid_result(result: DataFrame) -> DataFrame:
    """Drop results without category or confidence; unknown categories become Other."""
    return result.filter("category is not null and confidence is not null").withColumn(
        "category", known_category(F.col("category"))
    )


def route_by_confidence(
    documents: DataFrame, light: DataFrame, fallback: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(classified, for review): the light model where sure enough, else the fallback model.

    Both prediction tables carry ``doc_id, category, confidence``.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", F.struct("category", "confidence").alias(name))

    sure = F.coalesce(F.col("l.confidence") >= threshold, F.lit(False))
    chosen = (
        documents.select("doc_id")
        .join(side(light, "l"), "doc_id", "left")
        .join(side(valid_result(fallback), "f"), "doc_id", "left")
        .select(
            "doc_id",
            F.when(sure, F.col("l.category")).otherwise(F.col("f.category")).alias("document_type"),
            F.when(sure, F.col("l.confidence")).otherwise(F.col("f.confidence")).alias("confidence"),
            F.when(sure, LIGHT_METHOD).otherwise(FALLBACK_METHOD).alias("method"),
        )
    )
    return (
        chosen.filter("document_type is not null"),
        chosen.filter("document_type is null").select("doc_id"),
    )


def upsert_classifications(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per document: fresh values win; the correction flag of a stored row is kept."""
    cols = ["document_type", "confidence", "method"]
    s = stored.select("doc_id", F.struct(*cols, "is_corrected").alias("s"))
    f = fresh.select("doc_id", F.struct(*cols).alias("f"))
    return s.join(f, "doc_id", "full_outer").select(
        "doc_id",
        *[F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
          for c in cols],
        F.coalesce("s.is_corrected", F.lit(False)).alias("is_corrected"),
    )


def fit_light_classifier(
    labelled: DataFrame, text_col: str = "text", label_col: str = "document_type",
    features: int = 1 << 14, max_iter: int = 20,
) -> PipelineModel:
    """Hashed tf-idf and logistic regression over whole texts."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label_col, outputCol="label", handleInvalid="skip"),
        RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(maxIter=max_iter, regParam=0.01),
    ]).fit(labelled)


def predict_light(model: PipelineModel, documents: DataFrame) -> DataFrame:
    labels = tuple(model.stages[0].labels)
    steps = PipelineModel(model.stages[1:])
    probs = steps.transform(documents).select(
        "doc_id", vector_to_array("probability").alias("_p")
    )
    return probs.select("doc_id", *[c.alias(n) for n, c in label_scores(F.col("_p"), labels).items()])
