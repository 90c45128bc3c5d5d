"""Line dedup by overlapping windows of three lines.

Three consecutive lines are hashed together; where the same three lines start
earlier in the collection, the later ones go.  Overlapping windows are merged: a
line that any removed window covers is removed once.

Only DataFrame functions are used.  Two 64-bit hashes with different seeds identify
a window.  A window that is repeated everywhere is counted with a partial
aggregation, and the join that finds its later occurrences is an ordinary one that
adaptive execution splits, so no task has to hold a group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import without

WINDOW = 3
RESULTS = ["n_lines", "n_removed"]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def window_hashes(lines: Column, size: int, blank: bool = False) -> Column:
    """``array<struct<pos, a, b>>`` of the windows; without ``blank``, of those that have a line with more than white space."""
    marks = F.transform(
        lines,
        lambda line: F.struct(
            F.xxhash64(line).alias("a"),
            F.xxhash64(F.lit(size), line).alias("b"),
            (F.trim(F.translate(line, "\t\r\f\v", "    ")) != "").alias("full"),
        ),
    )

    def window(marked: Column) -> Column:
        def at(i: Column) -> Column:
            part = F.slice(marked, i + 1, size)
            return F.struct(
                i.alias("pos"),
                F.xxhash64(F.transform(part, lambda m: m["a"])).alias("a"),
                F.xxhash64(F.transform(part, lambda m: m["b"])).alias("b"),
                F.exists(part, lambda m: m["full"]).alias("full"),
            )

        starts = F.when(F.size(marked) >= size, F.sequence(F.lit(0), F.size(marked) - size))
        found = F.transform(F.coalesce(starts, F.array().cast("array<int>")), at)
        return found if blank else F.filter(found, lambda w: w["full"])

    # element_at(transform(array(x), f), 1) evaluates x once for the whole lambda
    return F.element_at(F.transform(F.array(marks), window), 1)


def remove_repeated_windows(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", blank: bool = False
) -> DataFrame:
    """``docs`` with the later occurrences of repeated windows cut out of ``text``.

    Adds ``n_lines`` and ``n_removed`` (columns of these names are replaced).  A window
    is later if the same lines start in a smaller ``doc_id`` (NULL is the smallest),
    or, with the same id, in a text with a smaller hash, or in the same text further
    up; rows that repeat both id and text count as one document and keep the same
    lines.  Windows are judged on the input, not on what is left.  Lines are compared
    unchanged; windows of blank lines alone are left alone unless ``blank`` is true, and
    so are texts with fewer lines than a window.  A NULL text stays NULL with 0 lines; an empty one has
    one empty line.
    """
    rest = without(docs, RESULTS)
    keyed = rest.select(
        F.struct(*[rest[f"`{c}`"] for c in rest.columns]).alias("row"),
        rest[f"`{id_col}`"].alias("id"),
        F.xxhash64(rest[f"`{text_col}`"]).alias("body"),
    )
    windows = keyed.select(
        "id", "body", F.inline(window_hashes(lines_of(F.col("row")[text_col]), window, blank))
    ).select(F.struct("id", "body", "pos").alias("start"), "a", "b")
    first = windows.groupBy("a", "b").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    repeated = first.where(F.col("last") > F.col("first")).select("a", "b", "first")
    later = windows.join(repeated, ["a", "b"]).where(F.col("start") > F.col("first")).select("start.*")
    covered = later.groupBy("id", "body").agg(F.collect_set("pos").alias("starts"))
    covered = covered.select(
        F.col("id").alias("cut_id"),
        F.col("body").alias("cut_body"),
        F.array_distinct(
            F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1))))
        ).alias("cut"),
    )
    joined = keyed.join(
        covered, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("body") == F.col("cut_body")), "left"
    )
    text = F.col("row")[text_col]
    lines = lines_of(text)

    def kept_text(all_lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("cut"))
        return F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")

    kept = F.when(F.col("cut").isNull(), text).otherwise(
        F.element_at(F.transform(F.array(lines), kept_text), 1)
    )
    return joined.select(
        *[(kept if c == text_col else F.col("row")[c]).alias(c) for c in rest.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"),
    )
