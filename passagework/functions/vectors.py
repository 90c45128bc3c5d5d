"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.text import tokens


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    Without this the optimizer may copy an expensive expression into a lambda and
    so evaluate it for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def token_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token: the first eight hex digits of its MD5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def token_buckets(text: Column, dim: int) -> Column:
    """The bucket of every token of ``text``, in text order."""
    return F.transform(tokens(text), lambda t: token_bucket(t, dim))


def run_lengths(ordered: Column, item: str, count: str) -> Column:
    """``array<struct<item, count>>`` of the runs of equal values in a sorted array.

    A run starts where a value differs from the one before it, and ends where the
    next run starts: one linear pass, no shuffle and no Python.
    """

    def runs(values: Column) -> Column:
        marks = F.transform(
            values, lambda v, i: F.when((i == 0) | (F.get(values, i - 1) != v), i)
        )
        return bind(
            F.concat(F.array_compact(marks), F.array(F.size(values))),
            lambda starts: F.transform(
                F.slice(starts, F.lit(1), F.size(starts) - 1),
                lambda start, j: F.struct(
                    F.get(values, start).alias(item), (F.get(starts, j + 1) - start).alias(count)
                ),
            ),
        )

    return bind(ordered, runs)


def hash_counts(text: Column, dim: int) -> Column:
    """Sparse term-frequency vector: ``array<struct<bucket int, cnt int>>`` by bucket."""
    return run_lengths(F.sort_array(token_buckets(text, dim)), "bucket", "cnt")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column) -> Column:
    """``vector`` scaled to length one; a zero vector stays zero."""
    return bind(
        vector,
        lambda v: bind(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))),
    )
