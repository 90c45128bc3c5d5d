"""The given tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators.chunk import chunk_fixed
from passagework.operators.embed import embed_hash
from passagework.sources.files import documents_from_table
from passagework.sources.scratch import scratch_path as scratch

SPREAD = 4  # parts that a split of 128 MB (``spark.sql.files.maxPartitionBytes``) is dealt over
SUFFIXES = (".md", ".mdx", ".txt", ".ts", ".js", ".json", ".py")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over the cores when a table lies in fewer files than there are cores.

    A table of many files is read by as many tasks anyway and is left as it is.  A large table gets
    ``SPREAD`` parts for each split that Spark reads of it, so that a part does not grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores if splits <= cores else SPREAD * splits)


def source_path() -> Column:
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 7 + 1).cast("int"))
    return F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), suffix)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The document table, with a path that has an extension as its source."""
    return documents_from_table(spread(table(spark, sf, "documents")), source=source_path())


def dated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the time of the event of the same number as their date."""
    dates = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("ts").alias("at"))
    joined = documents(spark, sf).drop("modified_at").join(dates, "doc_id", "left")
    return joined.withColumn("modified_at", F.col("at").cast("timestamp")).drop("at")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as if it were a search result, with a score between 0 and 1."""
    scored = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("query_id"),
        F.lit(1).alias("rank"),
        F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"),
        F.col("text").alias("content"),
        (F.col("n_chars") % 101 / 100.0).cast("double").alias("score"),
        source_path().alias("source"),
        metadata().alias("metadata"),
    )
    return scored


def metadata() -> Column:
    """Metadata as files would have it: positions are there, missing, or no number."""
    number = F.col("doc_id")
    start = F.when(number % 4 == 0, F.lit("n/a")).when(number % 4 == 1, (F.col("n_chars") % 50).cast("string"))
    end = F.when(number % 3 != 0, (F.col("n_chars") % 70).cast("string"))
    pairs = {"source": source_path(), "lang": F.col("lang"), "startLine": start, "endLine": end}
    everything = F.create_map(*[part for key, value in pairs.items() for part in (F.lit(key), value)])
    return F.map_filter(everything, lambda k, v: v.isNotNull())


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_fixed(documents(spark, sf))


def index(spark: SparkSession, sf: str) -> DataFrame:
    return embed_hash(chunks(spark, sf), "content")


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )


def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("chunk_id"), "embedding")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a raw request with its own filters and includes; some are broken in different ways."""
    turns = table(spark, sf, "conversations")
    n = F.col("conv_id") + F.col("turn")
    query = F.when(n % 7 == 0, F.lit("")).otherwise(F.col("text"))
    limit = F.when(n % 101 == 9, F.lit(1e12)).when(n % 13 == 8, F.lit(-3.0)).when(n % 3 != 0, (F.col("turn") + 1).cast("double"))
    types = F.when(n % 6 == 0, F.array(F.lit("markdown"), F.lit("code"))).when(n % 6 == 1, F.array().cast("array<string>"))
    pattern = F.when(n % 17 == 10, F.lit("src(")).when(n % 8 == 0, F.lit("src1*.md")).when(n % 8 == 1, F.lit(""))
    dates = F.struct(
        F.when(n % 9 == 0, F.lit("2024-01-05 12:00:00")).when(n % 9 == 1, F.lit("no date")).alias("from"),
        F.when(n % 10 == 0, F.lit("2024-03-01")).alias("to"),
    )
    good = F.to_json(
        F.struct(
            query.alias("query"),
            limit.alias("limit"),
            F.when(n % 4 == 0, F.lit(True)).alias("useHybridSearch"),
            F.when(n % 5 == 0, F.lit(0.25)).alias("hybridAlpha"),
            F.struct(types.alias("documentTypes"), pattern.alias("sourcePattern"), dates.alias("dateRange")).alias("filter"),
            F.struct(
                F.when(n % 2 == 0, F.lit(True)).alias("summary"), F.when(n % 5 == 1, F.lit(True)).when(n % 5 == 2, F.lit(False)).alias("keywords")
            ).alias("include"),
        )
    )
    odd = F.to_json(
        F.struct(
            F.col("text").alias("query"), F.lit("ten").alias("limit"), F.lit(1).alias("useHybridSearch"),
            F.struct(F.lit("markdown").alias("documentTypes"), F.lit(7).alias("sourcePattern"), F.lit("2024").alias("dateRange")).alias("filter"),
            F.struct(F.lit("yes").alias("summary")).alias("include"),
        )
    )
    arguments = (
        F.when(n % 11 == 1, odd)
        .when(n % 11 == 2, F.lit("null"))
        .when(n % 11 == 3, F.lit('{"query": 5}'))
        .when(n % 11 == 4, F.lit("not json"))
        .when(n % 11 == 5, F.lit('["query"]'))
        .otherwise(good)
    )
    return turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        arguments.alias("arguments"),
    )


def filtered_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text with filters of its own; a third is searched by words too."""
    n = F.col("query_id")
    since = F.date_format(F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(query_id AS INT))"), "yyyy-MM-dd HH:mm:ss")
    return benchmark_queries(spark, sf).select(
        "query_id",
        "query",
        F.when(n % 3 == 0, F.array(F.lit("markdown"), F.lit("text"))).alias("document_types"),
        F.when(n % 5 != 0, F.concat(F.lit("docs/src"), (n % 5).cast("string"), F.lit("*.(md|txt|js)"))).alias("source_pattern"),
        F.when(n % 4 == 1, since).cast("timestamp").alias("date_from"),
        F.when(n % 4 == 2, F.lit("2024-01-20")).cast("timestamp").alias("date_to"),
        (n % 3 == 1).alias("use_hybrid"),
    )
