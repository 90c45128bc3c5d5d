"""Answering a table of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.config import BROADCAST_ROWS, SEARCHERS, SearchConfig
from passagework.operators import enrich, filters
from passagework.operators.embed import embed_hash
from passagework.operators.graph import ann_graph
from passagework.operators.hybrid import exact_fusion
from passagework.operators.respond import error_rows, no_result_fallback
from passagework.operators.vector import ann_ivf, ann_lsh, cosine_only, knn_exact, knn_filtered, knn_pruned
from passagework.sources.scratch import written
from passagework.sources.store import load_centroids, load_graph, load_radii

LARGE_LIMIT = 1_000  # queries that want more are searched apart
FEW_QUERIES = 20_000  # as many, with their vectors, are held by the driver

RESULT_COLUMNS = (
    "query_id",
    "rank",
    "chunk_id",
    "content",
    "score",
    "source",
    "start_line",
    "end_line",
    "start_column",
    "end_column",
    "document_type",
    "summary",
    "keywords",
    "relevance",
    "metadata",
)
RESULTS = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        *[T.StructField(name, T.IntegerType()) for name in enrich.POSITIONS],
        T.StructField("document_type", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("relevance", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


# What a query may ask for itself, and the setting that holds where it does not.
OWN_FILTERS = {"document_types": "array<string>", "source_pattern": "string", "date_from": "timestamp", "date_to": "timestamp"}
OWN_INCLUDES = ("include_metadata", "include_summary", "include_keywords", "include_relevance")


def normalise_queries(queries: DataFrame, config: SearchConfig) -> DataFrame:
    """``query_id, query, search_text, limit, use_hybrid, alpha``, filters, includes (and ``query_vec`` if given)."""

    def given(name: str, default, kind: str):
        default = F.lit(default).cast(kind)
        return F.coalesce(F.col(name).cast(kind), default) if name in queries.columns else default

    extra = ["query_vec"] if "query_vec" in queries.columns else []
    limit = F.try_divide(given("limit", config.limit, "double"), F.lit(1.0))
    return enrich.query_context(queries).select(
        "query_id",
        "query",
        "search_text",
        filters.whole_number(limit).alias("limit"),
        given("use_hybrid", config.hybrid, "boolean").alias("use_hybrid"),
        given("alpha", config.alpha, "double").alias("alpha"),
        *[given(name, getattr(config, name), "boolean").alias(name) for name in OWN_INCLUDES],
        given("document_types", list(config.document_types), "array<string>").alias("document_types"),
        *[given(n, getattr(config, n) or None, OWN_FILTERS[n]).alias(n) for n in list(OWN_FILTERS)[1:]],
        *extra,
    )


def meets_filters(types, pattern, since, until):
    """Whether a row with ``document_type``, ``source`` and ``modified_at`` passes; an absent filter lets all pass."""
    none = F.lit(True)
    return (
        F.when(F.coalesce(F.size(types), F.lit(0)) > 0, F.array_contains(types, F.col("document_type"))).otherwise(none)
        & F.when(F.coalesce(pattern, F.lit("")) != "", F.rlike("source", F.replace(pattern, F.lit("*"), F.lit(".*")))).otherwise(none)
        & F.when(since.isNotNull(), F.col("modified_at") >= since).otherwise(none)
        & F.when(until.isNotNull(), F.col("modified_at") <= until).otherwise(none)
    )


def searcher(name: str = "exact", centroids=None, radii=None, graph=None, **options) -> Callable[..., DataFrame]:
    """A search by name for the ``knn`` of :func:`search`.

    ``exact`` and ``lsh`` need nothing else, ``ivf`` the centroids of the index, ``pruned`` also the
    radii of its buckets, ``graph`` its graph.  :func:`saved_searcher` reads them from a saved index.
    """
    if name not in SEARCHERS:
        raise ValueError(f"Unsupported searcher: {name}")
    if name == "exact":
        return partial(knn_exact, **options)
    if name == "lsh":
        return lambda q, v, k, metric: ann_lsh(q, v, k, metric, **options)
    if name == "graph":
        if graph is None:
            raise ValueError("searcher 'graph' needs the graph of the index")
        return lambda q, v, k, metric: ann_graph(q, graph, k, metric, **options)
    if centroids is None:
        raise ValueError(f"searcher '{name}' needs the centroids of the index")
    if name == "ivf":
        return lambda q, v, k, metric: ann_ivf(q, v, centroids, k, metric=metric, **options)
    if radii is None:
        raise ValueError("searcher 'pruned' needs the radii of the buckets")

    def pruned(q, v, k, metric):
        cosine_only(metric)
        return knn_pruned(q, v, centroids, radii, k, **options)

    return pruned


def saved_searcher(spark: SparkSession, path: str, name: str = "exact", **options) -> Callable[..., DataFrame]:
    """As :func:`searcher`, with what was saved beside the index at ``path``."""
    if name in ("ivf", "pruned"):
        options["centroids"] = load_centroids(spark, path)
    if name == "pruned":
        options["radii"] = load_radii(spark, path)
    if name == "graph":
        options["graph"] = load_graph(spark, path)
    return searcher(name, **options)


def find(
    queries: DataFrame, index: DataFrame, config: SearchConfig, knn: Callable[..., DataFrame], postings: DataFrame | None = None
) -> DataFrame:
    """The best hits of every query that reach the threshold, as many as its limit.

    Queries with a large limit are searched apart, so that they do not raise what
    tasks keep for the others.  With ``filter_mode="pre"`` each query is answered among the
    rows that pass its filters, always by the exact search.
    """
    knn = knn_filtered if config.filter_mode == "pre" else knn
    if knn in (knn_exact, knn_filtered):  # what is below the threshold is not even moved
        knn = partial(knn, least=config.threshold)
    parts = []
    for own in (F.col("limit").between(1, LARGE_LIMIT), F.col("limit") > LARGE_LIMIT):
        some = queries.filter(own)
        asked = some.agg(
            F.max("limit").alias("k"), F.bool_or("use_hybrid").alias("hybrid"), F.bool_or(~F.col("use_hybrid")).alias("plain")
        ).first()
        if asked["plain"]:
            parts.append(knn(some.filter(~F.col("use_hybrid")), index, asked["k"], config.metric))
        if asked["hybrid"]:
            own_filters = list(OWN_FILTERS) if config.filter_mode == "pre" else []
            wanted = some.filter("use_hybrid").select("query_id", F.col("search_text").alias("query"), "query_vec", "alpha", *own_filters)
            parts.append(exact_fusion(wanted, index, asked["k"], config.metric, postings=postings, least=config.threshold))
    if not parts:
        return queries.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    hits = reduce(DataFrame.unionByName, parts)
    hits = hits.join(queries.select("query_id", "limit"), "query_id").filter(F.col("rank") <= F.col("limit"))
    return filters.threshold_filter(hits, config.threshold).drop("limit")


def search(
    queries: DataFrame,
    index: DataFrame | None,
    config: SearchConfig = SearchConfig(),
    embed: Callable[[DataFrame, str, str], DataFrame] | None = None,
    knn: Callable[..., DataFrame] | str = knn_exact,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Results of ``queries(query_id, query[, context, limit, use_hybrid, alpha, query_vec])``.

    A query may also carry its own ``document_types``, ``source_pattern``, ``date_from``,
    ``date_to`` and ``include_metadata``, ``_summary``, ``_keywords``, ``_relevance``; where a column
    is absent or NULL, ``config`` holds.  ``embed(df, text_col, out_col)`` must be the model
    that embedded the index; ``knn`` is a :func:`searcher` or its name.  With the ``postings`` saved
    with the index, hybrid queries need not count words first.
    """
    if index is None:
        empty = T.StructType([queries.schema["query_id"], *RESULTS.fields])
        return queries.sparkSession.createDataFrame([], empty)
    knn = searcher(knn) if isinstance(knn, str) else knn
    q = normalise_queries(queries, config)
    if "query_vec" not in q.columns:
        q = embed(q, "search_text", "query_vec") if embed else embed_hash(q, "search_text", config.dim, "query_vec")
    q, n = computed_once(q)
    hits = find(q, index, config, knn, postings)
    # Ids and scores, limit rows for each query at most, come back for their content; if they
    # are counted to be few, they go to the index instead of the index being shuffled to them.
    k, *shows = q.agg(F.coalesce(F.sum("limit"), F.lit(0)), F.bool_or("include_summary"), F.bool_or("include_keywords")).first()
    stored = index.select("chunk_id", "content", "source", "modified_at", "metadata")
    own_texts = [enrich.with_summary, enrich.with_keywords]
    if n is not None and k <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    else:  # a chunk may be in very many results: what depends on it alone is made once, if anyone asks for it
        for make, show in zip(own_texts, shows):
            stored = make(stored, bool(show))
        own_texts = []
    results = stored.join(hits, "chunk_id")

    results = enrich.score_boost(results, config.boost_rules, config.resort)
    results = enrich.line_span(enrich.metadata_positions(results))
    results = enrich.with_document_type(results)
    if config.metadata_keys:
        results = enrich.metadata_keys(results, config.metadata_keys)
    own = q.select("query_id", F.struct("query", *OWN_FILTERS, *OWN_INCLUDES).alias("own"))
    results = results.join(F.broadcast(own) if n is not None else own, "query_id")
    if config.filter_mode == "post":
        results = results.filter(meets_filters(*[F.col(f"own.{name}") for name in OWN_FILTERS]))
    for make in own_texts:
        results = make(results, True)
    results = enrich.with_relevance(results.withColumn("query", F.col("own.query")), True)
    shown = {name.removeprefix("include_"): F.col(f"own.{name}") for name in OWN_INCLUDES}
    return results.select(
        *[F.when(shown[c], F.col(c)).alias(c) if c in shown else F.col(c) for c in RESULT_COLUMNS]
    )


def computed_once(q: DataFrame) -> tuple[DataFrame, int | None]:
    """The queries written to the shared folder, so that no model runs twice on them; their number, or None for many.

    Few queries are held by the driver from then on.
    """
    q = written(q, "queries")
    n = q.count()
    if n > FEW_QUERIES:
        return q, None
    return q.sparkSession.createDataFrame(q.toArrow(), q.schema), n


def answer(requests: DataFrame, index: DataFrame | None, config: SearchConfig = SearchConfig(), **options) -> DataFrame:
    """Responses to raw ``requests(query_id, arguments)``: results, stand-ins and error rows."""
    accepted, rejected = filters.split_requests(filters.validate_requests(requests))
    results = search(accepted, index, config, **options)
    answered = no_result_fallback(accepted, results)
    return answered.unionByName(error_rows(rejected), allowMissingColumns=True)


def search_one(
    spark: SparkSession, query: str, index: DataFrame | None, config: SearchConfig = SearchConfig(), **options
) -> DataFrame:
    """Results of a single query text."""
    queries = spark.createDataFrame([(0, query)], "query_id bigint, query string")
    return search(queries, index, config, **options)
