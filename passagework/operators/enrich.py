"""What is added to a hit after it was found: one narrow projection per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.config import BOOST_RULES, STORED_METADATA_KEYS
from passagework.functions import text
from passagework.operators.topk import topk_per_query

# Result column -> metadata key.
POSITIONS = {
    "start_line": "startLine",
    "end_line": "endLine",
    "start_column": "startColumn",
    "end_column": "endColumn",
}


def query_context(queries: DataFrame) -> DataFrame:
    """Add ``search_text``: the query and its context; ``query`` itself stays as it is."""
    context = F.col("context") if "context" in queries.columns else F.lit(None).cast("string")
    return queries.withColumn("search_text", text.query_text(F.col("query"), context))


def result_projection(hits: DataFrame) -> DataFrame:
    """Only content, score and source of every hit."""
    return hits.select("query_id", "rank", "chunk_id", "content", "score", "source")


def score_boost(results: DataFrame, rules=BOOST_RULES, resort: bool = False) -> DataFrame:
    """Set the score of sources that contain a rule's text (case matters, first rule wins).

    The rank stays that of the raw score unless ``resort`` is asked for.
    """
    score = None
    for part, value in rules:
        hit = F.contains(F.col("source"), F.lit(part))
        score = F.when(hit, F.lit(float(value))) if score is None else score.when(hit, F.lit(float(value)))
    boosted = results if score is None else results.withColumn("score", score.otherwise(F.col("score")))
    return topk_per_query(boosted, 2**31 - 1) if resort else boosted


def metadata_positions(results: DataFrame) -> DataFrame:
    """Lines and columns that the metadata give; what is no number becomes NULL."""
    return results.withColumns(
        {name: F.try_element_at("metadata", F.lit(key)).try_cast("int") for name, key in POSITIONS.items()}
    )


def line_span(results: DataFrame) -> DataFrame:
    """Where the metadata give no start line, count lines and columns from the content.

    Positions are relative to the chunk; an end line or column from the metadata is
    replaced.  A start line that is there but no number is left alone.
    """
    given = F.try_element_at("metadata", F.lit("startLine")).isNotNull()
    infer = ~F.coalesce(given, F.lit(False)) & (F.length("content") > 0)
    content = F.col("content")
    inferred = {
        "start_line": F.lit(1),
        "end_line": text.line_count(content),
        "start_column": F.lit(1),
        "end_column": F.length(text.first_line(content)),
    }
    return results.withColumns(
        {name: F.when(infer, value).otherwise(F.col(name)) for name, value in inferred.items()}
    )


def with_document_type(results: DataFrame) -> DataFrame:
    return results.withColumn("document_type", text.document_type(F.col("source")))


def metadata_keys(results: DataFrame, keys=STORED_METADATA_KEYS) -> DataFrame:
    """Keep only the named metadata."""
    wanted = F.array(*[F.lit(k) for k in keys])
    return results.withColumn("metadata", F.map_filter("metadata", lambda k, v: F.array_contains(wanted, k)))


def include_metadata(results: DataFrame, include: bool = False) -> DataFrame:
    """The metadata if asked for, NULL otherwise."""
    return results.withColumn("metadata", F.when(F.lit(include), F.col("metadata")))


def with_summary(results: DataFrame, include: bool = True) -> DataFrame:
    return results.withColumn("summary", F.when(F.lit(include), text.summary(F.col("content"))))


def with_keywords(results: DataFrame, include: bool = True) -> DataFrame:
    return results.withColumn("keywords", F.when(F.lit(include), text.keywords(F.col("content"))))


def with_relevance(results: DataFrame, include: bool = True) -> DataFrame:
    return results.withColumn("relevance", F.when(F.lit(include), text.relevance(F.col("query"), F.col("score"))))
