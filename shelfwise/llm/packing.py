"""Sequence packing by bounded-space online best-fit (operator 9).

Each document becomes its token ids and the closing id 0. One longer than the
capacity is cut into full pieces after a first piece that takes the rest; no
other is cut. Pieces are dealt to packing tasks by a hash of their row number, sorted
there from long to short, and placed one after another: a piece goes into the
open bin with the least free space that still holds it. Open bins are found by
a bitset keyed by free space, and there are at most ``max_open`` of them: when
one more is needed, the fullest closes first. A piece opens a bin only if it
fits in none, so any two bins of a task hold more than one capacity together and
a task of ``max_open * capacity / 2`` tokens makes about ``max_open`` at most; tasks
are made no larger, so that no bin closes before the small pieces have come.

Edge cases: a null or empty text is the closing id alone (one piece of length
1); repeated rows and rows with a null id are packed like any other; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stage
from shelfwise.llm.tokens import Encoder
from shelfwise.session import ship_package

PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
END_ID = bytes(4)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    start, length = 0, n % capacity or min(n, capacity)
    while start < n:
        yield start, length
        start, length = start + length, capacity


def encode_pieces(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int
) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path)
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
            doc_id, packed = doc_id.as_py(), encoder.ids(text.as_py()).tobytes() + END_ID
            for piece, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                crc = zlib.crc32(packed[4 * start : 4 * (start + length)])
                for column, value in zip(out, (doc_id, piece, start, length, crc), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            ["id", "piece", "start", "length", "ids_crc32"],
        )


class OpenBins:
    """At most ``max_open`` open bins, found by free space through a bitset."""

    def __init__(self, capacity: int, max_open: int) -> None:
        self.capacity, self.max_open = capacity, max_open
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin number, offset in it) for a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.max_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        rest = free - length
        if rest:
            self.by_free.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def pack_partition(
    batches: Iterator[pa.RecordBatch], capacity: int, max_open: int
) -> Iterator[pa.RecordBatch]:
    bins = OpenBins(capacity, max_open)
    base = TaskContext.get().partitionId() << 40
    for batch in batches:
        placed = [bins.place(n) for n in batch.column("length").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array([base + b for b, _ in placed], pa.int64()),
                pa.array([o for _, o in placed], pa.int64()),
            ],
            [*batch.schema.names, "sequence_id", "offset"],
        )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    max_open: int = 4096,
    pieces_per_task: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece with its sequence and its place there.

    The documents are encoded once, when called; the pieces (numbers only) lie
    in the checkpoint folder. ``pieces_per_task`` sets how many packing tasks
    there are, in proportion to the pieces, and ``max_open`` in proportion to
    the tokens; each leaves its last bins partly filled, so fewer tasks waste
    less.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    pieces = stage(
        texts.mapInArrow(lambda it: encode_pieces(it, tokenizer_path, capacity), PIECES).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    size = pieces.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    tasks = 1 + max(size.n // pieces_per_task, 2 * size.tokens // (max_open * capacity))
    # The staged row number tells repeated rows apart, so they spread like others.
    dealt = (
        pieces.repartition(tasks, "row")
        .sortWithinPartitions(F.desc("length"), "id", "piece", "ids_crc32")
        .drop("row")
    )
    return dealt.mapInArrow(
        lambda it: pack_partition(it, capacity, max_open), PACKED
    ).withColumnRenamed("id", id_col)
