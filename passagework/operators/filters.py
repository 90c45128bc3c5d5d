"""Filters of results and validation of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.config import DEFAULT_THRESHOLD

# Why a request is refused.
INVALID_ARGUMENTS = "Invalid arguments"
INCLUDES = ("metadata", "summary", "keywords", "relevance")
QUERY_REQUIRED = "Query parameter is required and must be a string"


def threshold_filter(hits: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Keep scores of at least ``threshold``."""
    return hits.filter(F.col("score") >= F.lit(threshold))


def filter_document_types(results: DataFrame, types) -> DataFrame:
    """Keep the listed types (exact case); no list, no filter."""
    return results.filter(F.col("document_type").isin(list(types))) if types else results


def filter_source_pattern(results: DataFrame, pattern: str | None) -> DataFrame:
    """Keep sources in which ``pattern`` is found; no pattern, no filter.

    ``*`` stands for any text, everything else is a regular expression that may
    match anywhere: ``*.md`` also finds ``x.mdx`` and ``amd/x``.
    """
    return results.filter(F.col("source").rlike(pattern.replace("*", ".*"))) if pattern else results


def filter_date_range(results: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Keep documents last changed between the two dates, both inclusive and optional."""
    if date_from:
        results = results.filter(F.col("modified_at") >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        results = results.filter(F.col("modified_at") <= F.to_timestamp(F.lit(date_to)))
    return results


def whole_number(value: Column) -> Column:
    """A limit from a number of any size: cut to an integer, from 0 to the largest one."""
    cut = F.least(F.greatest(value, F.lit(0.0)), F.lit(float(2**31 - 1)))
    return F.when(value.isNotNull(), cut.cast("int"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Read ``requests(query_id, arguments)``, ``arguments`` being a JSON text.

    Gives ``query_id, query, context, limit, use_hybrid, alpha``, the request's own filters
    and includes, and ``error``.  A request that is no object, has no non-empty text as
    ``query`` or a source pattern that is no regular expression gets an ``error``; the other
    arguments count only if they have the right type and are NULL otherwise.  A limit
    below 0 is 0, and one too large for an integer is the largest integer.
    """
    parsed = requests.withColumn("v", F.try_parse_json("arguments"))

    def kind(path: str):
        return F.schema_of_variant(F.try_variant_get("v", path, "variant"))

    def typed(path: str, kinds: str, target: str):
        return F.when(kind(path).rlike(kinds), F.try_variant_get("v", path, target))

    text, number, flag = "^STRING$", "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "^BOOLEAN$"
    is_object = F.coalesce(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"), F.lit(False))
    read = parsed.select(
        "query_id",
        is_object.alias("is_object"),
        typed("$.query", text, "string").alias("query"),
        typed("$.context", text, "string").alias("context"),
        whole_number(typed("$.limit", number, "double")).alias("limit"),
        typed("$.useHybridSearch", flag, "boolean").alias("use_hybrid"),
        typed("$.hybridAlpha", number, "double").alias("alpha"),
        typed("$.filter.documentTypes", "^ARRAY<(STRING|VOID)>", "array<string>").alias("document_types"),
        typed("$.filter.sourcePattern", text, "string").alias("source_pattern"),
        F.try_to_timestamp(typed("$.filter.dateRange.from", text, "string")).alias("date_from"),
        F.try_to_timestamp(typed("$.filter.dateRange.to", text, "string")).alias("date_to"),
        *[typed(f"$.include.{name}", flag, "boolean").alias(f"include_{name}") for name in INCLUDES],
    )
    # what the pattern compiles to, NULL if it does not compile
    compiled = F.expr("try_reflect('java.util.regex.Pattern', 'compile', replace(coalesce(source_pattern, ''), '*', '.*'))")
    error = F.when(~F.col("is_object"), INVALID_ARGUMENTS).when(
        F.coalesce("query", F.lit("")) == "", QUERY_REQUIRED
    ).when(compiled.isNull(), INVALID_ARGUMENTS)
    return read.withColumn("error", error).drop("is_object")


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted queries and the refused ones."""
    accepted = validated.filter(F.col("error").isNull()).drop("error")
    return accepted, validated.filter(F.col("error").isNotNull()).select("query_id", "error")
