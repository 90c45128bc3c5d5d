"""Language identification with bit-sliced Bloom filters over character n-grams.

A slot of the filter holds one bit per language.  An n-gram is set in the slots that
its hash names, with the bits of the languages that it is typical of; the AND of
those slots then gives all languages containing an n-gram in one look-up.  A text
gets, per language, the number of its n-grams with that bit, less those expected
by chance from how full the language's slice is.

The n-grams are counted, compared between languages and turned into slots by Spark;
only the filter, whose size is fixed, comes to the driver and goes to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, stored

SIZES = (3, 4)  # characters of an n-gram, the white space around a word included
SLOT_BITS = 21  # slots per filter; three fields of a 63-bit hash name the slots of an n-gram
HASHES = 3
TRAIN_DOCS = 20_000  # documents of a language that the filters are built from, at most about
MIN_COUNT = 2
TYPICAL = 1 / 8  # share in a language, against the language that has most of an n-gram
UNKNOWN = "und"
STRETCH = 1 << 19  # characters that a task handles at once
WORD_LANGUAGES = 63

_letters: list[np.ndarray] = []
NO_LETTER = re.compile(r"[\W\d_]")


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def stretches(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of text pieces of bounded size with the number of the text of each.

    A text is cut only where there is no letter, so no n-gram of a word is lost.
    """
    pieces, owners, held = [], [], 0
    for number, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = min(len(text), at + STRETCH)
            if end < len(text):
                cut = NO_LETTER.search(text, end)
                end = cut.start() if cut else len(text)
            if held and held + end - at > STRETCH:
                yield pieces, owners
                pieces, owners, held = [], [], 0
            pieces.append(text[at:end].lower())
            owners.append(number)
            held += end - at
            at = end
    if pieces:
        yield pieces, owners


def ngrams(pieces: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams, the text each is from, and the texts that have a letter."""
    code = np.frombuffer("\0".join(["", *pieces, ""]).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.array(owners), [len(p) + 1 for p in pieces])
    owner = np.concatenate([[owners[0]], owner])
    letter = letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each word
    keep[0] = True
    code, owner = np.where(letter, code, 0)[keep].astype(np.uint64), owner[keep]
    inside = code > 0
    hashes, of = [], []
    for size in SIZES:
        n = len(code) - size + 1
        if n <= 0:
            continue
        whole = np.ones(n, bool)
        key = np.full(n, size, np.uint64)
        for i in range(size):
            if 0 < i < size - 1:
                whole &= inside[i : n + i]
            key = key * np.uint64(0x9E3779B97F4A7C15) + code[i : n + i]
        key = key[whole]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
        hashes.append(key >> np.uint64(1))
        of.append(owner[1 : n + 1][whole])
    return (
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.concatenate(of) if of else np.zeros(0, int),
        np.unique(owner[inside]),
    )


class Filters(NamedTuple):
    languages: list[str]
    masks: np.ndarray  # per word of WORD_LANGUAGES languages and slot: a bit per language
    chance: np.ndarray  # per language: probability that an unknown n-gram seems to belong to it
    usual: int  # number of the most frequent language


def count_ngrams(docs: DataFrame, languages: list[str]) -> DataFrame:
    """``(language, gram, n)`` with a row per task for each n-gram that it has seen."""
    code = {name: i for i, name in enumerate(languages)}
    schema = T.StructType(
        [T.StructField("language", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]
    )

    def work(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def settle(language):
            keys = np.concatenate([k for k, _ in held[language]])
            counts = np.concatenate([c for _, c in held[language]])
            unique, inverse = np.unique(keys, return_inverse=True)
            return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)

        def rows():
            for language in held:
                keys, counts = settle(language)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), language, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts)],
                    ["language", "gram", "n"],
                )

        for batch in batches:
            names = np.array([code[x] for x in batch.column(0).to_pylist()])
            for pieces, owners in stretches(batch.column(1).to_pylist()):
                key, owner, _ = ngrams(pieces, owners)
                for language in np.unique(names[owner]):
                    found = np.unique(key[names[owner] == language], return_counts=True)
                    held.setdefault(int(language), []).append(found)
                    waiting += len(found[0])
                if waiting > 2_000_000:
                    yield from rows()
                    held, waiting = {}, 0
        yield from rows()

    return docs.select("language", "text").mapInArrow(work, schema)


def train(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_docs: int = TRAIN_DOCS
) -> Filters:
    """Filters from the rows whose language and text are not NULL.

    Of a language with more than ``max_docs`` documents, a sample of about that many
    is taken by a hash of the id; the texts taken are read whole.  An n-gram belongs
    to a language if it occurs at least ``MIN_COUNT`` times in it and is at least
    ``TYPICAL`` times as common as in the language that has most of it, so stray
    foreign words do not count.  Without rows there are no languages.
    """
    labelled = docs.select(
        docs[f"`{lang_col}`"].alias("language"), docs[f"`{text_col}`"].alias("text"), docs[f"`{id_col}`"].alias("id")
    ).where(F.col("language").isNotNull() & F.col("text").isNotNull())
    sizes = {r["language"]: r["count"] for r in labelled.groupBy("language").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((0, 1 << SLOT_BITS), np.uint8), np.zeros(0), 0)
    million = 1_000_000
    large = {name: max_docs * million // n for name, n in sizes.items() if n > max_docs}
    limit = looked_up(F.col("language"), large, million)
    taken = labelled.where(F.pmod(F.xxhash64("id"), F.lit(million)) < limit)
    counts = stored(count_ngrams(taken, languages).groupBy("language", "gram").agg(F.sum("n").alias("n")), "ngrams")
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    total = looked_up(F.col("language"), totals, 1)
    grams = (
        counts.where(F.col("n") >= MIN_COUNT)
        .select("gram", "language", (F.col("n") / total).alias("share"))
        .groupBy("gram")
        .agg(F.max("share").alias("most"), F.collect_list(F.struct("language", "share")).alias("has"))
    )
    words = range(-(-len(languages) // WORD_LANGUAGES))
    if len(words) > 1:
        grams = stored(grams, "ngrams")  # read for each word
    fields = F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * i) for i in range(HASHES)])
    width = min(len(languages), WORD_LANGUAGES)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if width <= 8 * np.dtype(k).itemsize)
    masks = np.zeros((len(words), 1 << SLOT_BITS), kind)
    for word in words:
        first = word * WORD_LANGUAGES
        mask = F.aggregate(
            F.filter("has", lambda x: (x["share"] >= F.col("most") * TYPICAL) & x["language"].between(first, first + WORD_LANGUAGES - 1)),
            F.lit(0).cast("long"),
            lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["language"] - first)),
        )
        slots = (
            grams.select(F.explode(F.transform(fields, lambda h: h % (1 << SLOT_BITS))).alias("slot"), mask.alias("mask"))
            .where("mask <> 0")
            .groupBy("slot")
            .agg(F.bit_or("mask").alias("mask"))
            .toArrow()  # at most one row for each of the 2^SLOT_BITS slots
        )
        masks[word][slots["slot"].to_numpy()] = slots["mask"].to_numpy().astype(kind)
    fill = np.array([np.count_nonzero(bit_of(masks[i // WORD_LANGUAGES], i)) / (1 << SLOT_BITS) for i in range(len(languages))])
    return Filters(languages, masks, fill**HASHES, max(range(len(languages)), key=lambda i: sizes[languages[i]]))


def looked_up(key: Column, values: dict, default: int) -> Column:
    if not values:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def bit_of(masks: np.ndarray, language: int) -> np.ndarray:
    kind = masks.dtype.type
    return masks >> kind(language % WORD_LANGUAGES) & kind(1)


def look_up(masks: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Per n-gram, a bit for each language of the word ``masks`` that contains it."""
    low = np.uint64((1 << SLOT_BITS) - 1)
    found = masks[grams & low]
    for i in range(1, HASHES):
        found = found & masks[grams >> np.uint64(SLOT_BITS * i) & low]
    return found


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``score`` is the share of the text's n-grams that the language contains, less
    those expected by chance.  A text that is NULL or has no letter, and any text
    if no language was learned, is ``und`` with score 0.  A text of letters without
    a known n-gram is given the most frequent language, with score 0.  Of equal
    languages the first by name is taken.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def work(slices):
        known = sent.value
        n = len(known.languages)
        for batch in slices:
            rows = batch.num_rows
            counts, total, has = np.zeros((rows, n)), np.zeros(rows), np.zeros(rows, bool)
            for pieces, owners in stretches(batch.column(batch.schema.names.index(text_col)).to_pylist()):
                grams, owner, lettered = ngrams(pieces, owners)
                has[lettered] = True
                total += np.bincount(owner, minlength=rows)
                for i in range(n):
                    if i % WORD_LANGUAGES == 0:
                        found = look_up(known.masks[i // WORD_LANGUAGES], grams)
                    counts[:, i] += np.bincount(owner, bit_of(found, i), rows)
            if n == 0:
                yield [pa.array([UNKNOWN] * rows), pa.array(np.zeros(rows))]
                continue
            true = np.clip((counts - total[:, None] * known.chance) / np.maximum(1 - known.chance, 1e-9), 0, None)
            best = np.where(true.max(axis=1) > 0, true.argmax(axis=1), known.usual)
            score = np.where(has, true[np.arange(rows), best] / np.maximum(total, 1), 0.0)
            names = [known.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
            yield [pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))]

    return add_columns(docs, new, work, leave_out=() if keep_text else (text_col,), slice_bytes=4 << 20)
