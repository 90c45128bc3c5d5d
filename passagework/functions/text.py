"""Text expressions: tokens, keywords, summaries, positions, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript regular expressions beyond the ASCII
# characters that Java's \s already covers.
UNICODE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Suffix of the lower-cased source -> document type.
DOCUMENT_TYPES = (
    ((".md", ".mdx"), "markdown"),
    ((".txt",), "text"),
    ((".js", ".ts"), "code"),
    ((".json",), "json"),
)
# The sentence that explains a hit.
RELEVANCE_HEAD = "このドキュメントは検索クエリ \""
RELEVANCE_TAIL = "\" に関連する情報を含んでいます。類似度スコア: "

KEYWORD_MIN_LENGTH = 4
KEYWORD_COUNT = 5
SUMMARY_LENGTH = 100


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks, digits and underscores, in text order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), "")


def query_text(query: Column, context: Column) -> Column:
    """The text that is searched for: the query, followed by the context if there is one."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws(" ", query, context)).otherwise(query)


def document_type(source: Column) -> Column:
    low = F.lower(source)
    out = None
    for suffixes, name in DOCUMENT_TYPES:
        hit = F.endswith(low, F.lit(suffixes[0]))
        for suffix in suffixes[1:]:
            hit = hit | F.endswith(low, F.lit(suffix))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def first_line(content: Column) -> Column:
    return F.substring_index(content, "\n", 1)


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def summary(content: Column) -> Column:
    line = first_line(content)
    return F.when(
        F.length(line) > SUMMARY_LENGTH, F.concat(F.left(line, F.lit(SUMMARY_LENGTH)), F.lit("..."))
    ).otherwise(line)


def keywords(content: Column) -> Column:
    """The first five distinct ASCII words of more than three characters.

    All white space is made ASCII first: the regular expressions then need only the
    predefined classes, which are several times faster than a list of ranges.
    """
    plain = F.translate(F.lower(content), UNICODE_SPACES, " " * len(UNICODE_SPACES))
    words = F.split(F.regexp_replace(plain, r"[^\w\s]", ""), r"\s+")
    long_words = F.filter(words, lambda w: F.length(w) >= KEYWORD_MIN_LENGTH)
    return F.slice(F.array_distinct(long_words), 1, KEYWORD_COUNT)


def two_decimals(number: Column) -> Column:
    """``number`` as text with two decimals, halves rounded away from zero.

    Integer arithmetic, because the formatting functions of different engines
    disagree on how to round halves.
    """
    cents = F.floor(F.abs(number) * 100 + F.lit(0.5)).cast("bigint")
    sign = F.when((number < 0) & (cents > 0), "-").otherwise("")
    whole = F.floor(cents / 100).cast("bigint").cast("string")
    return F.concat(sign, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def relevance(query: Column, score: Column) -> Column:
    return F.concat(F.lit(RELEVANCE_HEAD), query, F.lit(RELEVANCE_TAIL), two_decimals(score))
