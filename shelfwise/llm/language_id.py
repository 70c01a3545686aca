"""Language identification by rank-order n-gram profiles (operator 2).

A profile is the ``size`` most frequent n-grams (one to three characters) of a
language's sample, in order. A document's own profile is made alike from its
whole text; the out-of-place distance adds up how far each of its n-grams
stands from its place in the language's profile, or the largest distance where
it is absent. The language with the least distance wins; the score is one less
the distance's share of the largest possible one.

Text is lower-cased; everything but letters becomes a single space, so that
n-grams see word edges. Ties among n-grams go by code point, ties among
languages by name.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as
is every text when nothing can be learned; a null language is not learned
from; each row is judged alone, so repeated rows and null ids are fine; an
empty table gives an empty result; only id, text and, for learning, lang are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import held_out, stage
from shelfwise.session import ship_package

UNKNOWN = "und"
_BITS = np.int64(21)  # a code point's width; three fit into an int64
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def n_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, ascending, and how often each occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(letter, codes, _SPACE).astype(np.int64)
    codes = np.concatenate([[_SPACE], codes, [_SPACE]])
    space = codes == _SPACE
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    two = (codes[:-1] << _BITS) | codes[1:]
    three = (two[:-1] << _BITS) | codes[2:]
    return np.unique(np.concatenate([codes[codes != _SPACE], two, three]), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by code point."""
    if len(counts) > size:
        least = np.partition(counts, -size)[-size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, summed within each batch."""
    for batch in batches:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found.setdefault(lang, []).append(n_grams(text.as_py()))
        for lang, parts in found.items():
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.zeros(len(grams), np.int64)
            np.add.at(counts, place, np.concatenate([n for _, n in parts]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                ["lang", "gram", "n"],
            )


def learn_profiles(
    docs: DataFrame,
    size: int = 400,
    rows_per_language: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, list[int]]:
    """Language -> its n-grams in order, from a sample of labelled rows.

    The sample is the share of the rows that are not held out, by a hash of the
    id, which holds about ``rows_per_language`` rows of each language (all of
    them where there are fewer); its texts are used whole. What reaches the
    driver is ``size`` numbers a language.
    """
    ship_package(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    rows = stage(labelled.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    drawn = F.xxhash64("id") / F.lit(float(1 << 64)) + 0.5
    sample = (
        labelled.join(rows, "lang")
        .filter(drawn * F.col("rows") < rows_per_language)
        .select("lang", "text")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = (
        sample.mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= size)
    )
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Profiles:
    """Profiles laid out for looking up many n-grams at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.size, self.langs, self.tables = size, sorted(profiles), []
        for lang in self.langs:
            grams = np.array(profiles[lang], np.int64)
            order = np.argsort(grams)
            self.tables.append((grams[order], order))

    def classify(self, text: str | None) -> tuple[str, float]:
        grams, counts = n_grams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        own = top(grams, counts, self.size)
        rank = np.arange(len(own))
        distances = []
        for known, order in self.tables:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            apart = np.where(known[at] == own, np.abs(order[at] - rank), self.size)
            distances.append(int(apart.sum()))
        best = min(range(len(distances)), key=distances.__getitem__)
        return self.langs[best], 1.0 - distances[best] / (self.size * len(own))


def _classify(
    batches: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], size: int
) -> Iterator[pa.RecordBatch]:
    model = Profiles(profiles, size)
    for batch in batches:
        found = [model.classify(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([x for x, _ in found], pa.string()),
                pa.array([x for _, x in found], pa.float64()),
            ],
            ["id", "lang_pred", "score"],
        )


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    size: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, lang_pred, score)`` of every document, in one pass without a shuffle."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(
        lambda it: _classify(it, profiles, size), "id long, lang_pred string, score double"
    ).withColumnRenamed("id", id_col)
