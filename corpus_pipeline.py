"""Clean a corpus for training: five stages over ``documents``.

Each stage works on all rows that the one before has kept, written as Parquet to the
shared folder of the cluster and read back, so a lost executor costs no finished stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import bpe_tree, decontaminate, langid, line_windows, odd_sketch
from passagework.llm.common import stored, table

MIN_LANGUAGE_SCORE = 0.2  # share of a text's n-grams that its language must contain


def own_columns(docs: DataFrame) -> list:
    return [docs[f"`{c}`"] for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that hardly have an n-gram of any language.

    The filters are learned from the documents that have a language; if none has one,
    only texts without letters go.
    """
    filters = langid.train(docs)
    whole = docs.select(F.struct(*own_columns(docs)).alias("row"), docs["text"].alias("text"))
    predicted = langid.predict(whole, filters, keep_text=False)
    clear = (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("lang_pred") != langid.UNKNOWN)
    lettered = F.col("row.text").rlike(r"\p{L}")
    return predicted.where(clear if filters.languages else lettered).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out repeated line windows; a document of which no line is left goes.

    ``n_chars`` is set to the new length where a text has changed.
    """
    whole = docs.select(F.struct(*own_columns(docs)).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    cut = line_windows.remove_repeated_windows(whole).where(
        (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    )
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(
        *[
            F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col("row")[c]).alias(c)
            if c in changed
            else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )


def dedup_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one with the smallest id.

    Rows that share an id are judged one by one: each belongs to the group of its own
    text.  If several rows of a group have its smallest id, one text is kept, and one row
    of those that repeat it.  Rows without an id or without a word are kept.
    """
    rows = stored(odd_sketch.grouped_rows(docs).where(F.col("label").isNotNull()), "groups")
    is_first = F.col("doc_id") == F.col("component_id")
    heads = rows.where(is_first).select("label", "doc_id", "text_key").distinct()
    chosen = heads.groupBy("label").agg(F.min("text_key").alias("chosen"))
    others = heads.join(chosen, "label").where(F.col("text_key") != F.col("chosen"))
    key = [F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text")]
    dropped = rows.where(~is_first).select(*key).unionAll(others.select(*key)).distinct()
    same = (docs["doc_id"] == F.col("key_id")) & (F.xxhash64(docs["text"]) == F.col("key_text"))
    left = docs.join(dropped, same, "left_anti")
    repeated = rows.where(is_first).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key_id", "key_text")
    if repeated.limit(1).count() == 0:
        return left
    return left.join(repeated, same, "left_anti").unionAll(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe_tree.encode(docs.select("doc_id", "text"), path, keep_text=False)
    decoded = bpe_tree.decode(encoded, path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_duplicates),
    ("decontamination", remove_benchmark),
    ("bpe", encode_bpe),
]

# Languages are learned and tokens come from a vocabulary file: SQL cannot express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
