"""Quality by compression (operator 7).

Two zstandard dictionaries are built from labelled text, one good, one bad. A
text is compressed with each; the difference of the two sizes over their sum
says which it resembles, and a logistic curve, fitted on other labelled rows,
turns that number into the probability of label 1. The whole text is
compressed, in blocks of 512 bytes, so that a long text leans on the
dictionaries as much as a short one instead of on its own beginning. A word
equal to the one before it is written as a ditto mark first: runs of any word
then look alike.

Edge cases: a null or empty text has difference 0, as has every text when a
class has no sample; the curve then gives the share of label 1; labels that are
null, repeated (the lowest counts) or of unknown documents are fine; each row
is judged alone, so repeated rows and null ids are fine (a null id is never
learned from); an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import held_out, stage
from shelfwise.session import ship_package

LEVEL = 6
BLOCK = 512
DITTO = "\u3003"


@dataclass(frozen=True)
class Model:
    """Dictionary bytes of each class and the logistic curve over the difference."""

    bad: bytes
    good: bytes
    slope: float
    shift: float

    def score(self, difference: float) -> float:
        z = max(-60.0, min(60.0, self.slope * difference + self.shift))
        return 1.0 / (1.0 + math.exp(-z))


class Sizer:
    """Compresses texts with the dictionary of each class."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.pair = [self._compressor(d) for d in (bad, good) if d]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def difference(self, text: str | None) -> float:
        """(bad - good) / (bad + good) of the compressed sizes; over 0: like good text."""
        if not text or len(self.pair) < 2:
            return 0.0
        raw = marked(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.pair)
        return (bad - good) / (bad + good)


def marked(text: str) -> bytes:
    """UTF-8 of the text with ditto marks for words that repeat the one before."""
    words = text.split(" ")
    pairs = zip(words, words[1:])  # noqa: B905 - one shorter on purpose
    return " ".join([words[0], *(DITTO if a == b else b for a, b in pairs)]).encode()


def _dictionary(texts: list[str], size: int) -> bytes:
    """Raw dictionary content: an equal share of it from the middle of each sample text."""
    if not texts:
        return b""
    share = max(200, size // len(texts))
    out, room = [], size
    for raw in map(marked, texts):
        middle = max(0, (len(raw) - share) // 2)
        out.append(raw[middle : middle + min(share, room)])
        room -= len(out[-1])
        if room <= 0:
            break
    return b"\n".join(out)


def _fit(differences: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve, by damped Newton steps."""
    positive = float(np.average(labels, weights=weight)) if len(labels) else 0.5
    prior = min(max(positive, 1e-3), 1 - 1e-3)
    start = math.log(prior / (1 - prior))
    if positive in (0.0, 1.0) or not differences.any():
        return 0.0, start
    weight = weight * (len(labels) / weight.sum())
    scale = float(differences.std()) or 1.0
    x = np.stack([differences / scale, np.ones_like(differences)], axis=1)
    w = np.array([0.0, start])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + 1e-3 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]) / scale, float(w[1])


def _differences(
    batches: Iterator[pa.RecordBatch], bad: bytes, good: bytes
) -> Iterator[pa.RecordBatch]:
    sizer = Sizer(bad, good)
    for batch in batches:
        found = [sizer.difference(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), batch.column("rows"), pa.array(found, pa.float64())],
            ["y", "rows", "difference"],
        )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    dictionary_bytes: int = 256 * 1024,
    rows_per_class: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    By a hash of the id, about ``rows_per_class`` rows of each class give the
    dictionaries (``dictionary_bytes`` each) and as many others the curve.
    """
    ship_package(docs.sparkSession)
    marks = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("labelled"))
        .agg(F.min(label_col).alias("y"))
    )
    rows = marks.groupBy(F.col("y").alias("of")).agg(F.count("*").alias("rows"))
    drawn = (F.xxhash64("labelled") / F.lit(float(1 << 64)) + 0.5) * F.col("rows")
    chosen = stage(
        marks.join(rows, F.col("y") == F.col("of"))
        .filter(drawn < 2 * rows_per_class)
        .select(
            "labelled",
            "y",
            "rows",
            (drawn < F.least(F.lit(float(rows_per_class)), F.col("rows") / 2)).alias("for_dictionary"),
        ),
        "chosen",
    )
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    texts = stage(narrow.join(chosen, F.col("id") == F.col("labelled")).drop("id"), "sample")
    # Bounded by the parameters: a slice of each text of the dictionary's sample,
    # wide enough for its share, then two numbers a row.
    width = 8 * max(200, dictionary_bytes // rows_per_class)
    begin = F.greatest(F.lit(1), ((F.length("text") - width) / 2).cast("int") + 1)
    slices = (
        texts.filter("for_dictionary")
        .select("y", "labelled", F.col("text").substr(begin, F.lit(width)).alias("part"))
        .orderBy("y", "labelled")
        .collect()
    )
    bad, good = (
        _dictionary([r.part for r in slices if r.y == y], dictionary_bytes) for y in (0, 1)
    )
    fitted = (
        texts.filter("not for_dictionary")
        .select("y", "rows", "text")
        .mapInArrow(lambda it: _differences(it, bad, good), "y int, rows long, difference double")
        .collect()
    )
    y = np.array([r.y for r in fitted], float)
    # Each class weighs as much as its labelled rows, whatever its sample.
    weight = np.array([r.rows / max(1, (y == r.y).sum()) for r in fitted], float)
    slope, shift = _fit(np.array([r.difference for r in fitted], float), y, weight)
    return Model(bad, good, slope, shift)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    sizer = Sizer(model.bad, model.good)
    for batch in batches:
        scores = [model.score(sizer.difference(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"]
        )


def score_quality(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, score)`` of every document, in one pass without a shuffle."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(lambda it: _score(it, model), "id long, score double").withColumnRenamed(
        "id", id_col
    )
