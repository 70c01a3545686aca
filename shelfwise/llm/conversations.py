"""Conversation structure repair (operator 11).

A conversation's rows, taken by turn, are edited at the least cost until their
role initials read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1),
Delete (2, the only choice for blank and duplicate rows) and Insert of an empty
user or assistant row (5); a truncated row that is not deleted adds 5. Of the
cheapest lists of edits the ASCII-least one, by initials, is taken.

Both wishes are one number: a weight holds the cost in its high digits and the
audit letters below, one digit a letter in positions counted from the left,
empty positions zero at the end (so a list sorts before its continuations). The
least weight from each state (nothing yet, after system, after user, after
assistant) to the end follows row by row, from the last to the first, by the
plain minimum of integers: putting an edit in front adds its cost and shifts
the letters by one position. A letter leads from a state to one other state
only, so the letters tell the whole repair.

Rows are taken in blocks of ``BLOCK`` so that the numbers have a fixed width
however long a conversation is; a block starts from the costs behind it. Two
lists of one block that cost the same differ at a letter inside it, as each
ends with the letter of the block's last row, so the blocks' minima give the
minimum of the whole.

Work: rows without texts (digest, initial, faults) are shuffled by conversation
and weighed; the audits then meet the texts, which are shuffled once and
streamed through SHA-256 in order. A conversation is one chain in both steps (a
digest of its text cannot be made in parts), but a task holds only a few bytes
for each of its rows and one Arrow batch of texts, never its texts.

Edge cases: null roles and texts read as one space, so null texts are blank;
null turns come first and a null ``conv_id`` is a conversation of its own; rows
of one turn come by role, then by SHA-256 of the text; repeated rows are
duplicates; a span of turns beyond a long gives the greatest long; very long
texts and conversations are taken whole; an empty table gives an empty result;
only the four columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfwise.llm.common import WHITE_SPACE, stage
from shelfwise.session import ship_package

BLOCK = 64
MAX_LONG = (1 << 63) - 1

# What each edit costs, and what a truncated row that stays adds.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# Audit letters in ASCII order; digit 0 is the padding.
LETTERS = " DIKR"
D, I, K, R = 1, 2, 3, 4
# States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. The next
# user or assistant row leads to:
ALTERNATE = (2, 2, 3, 2)
USER = 2
ROLE_OF = {2: "user", 3: "assistant"}
# Costs from each state to the end: insert what is missing, a row at a time.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def _after_keep(state: int, initial: str) -> int | None:
    """The state after a row of this initial; None where it may not stand."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial not in ("u", "a"):
        return None
    following = ALTERNATE[state]
    return following if (initial == "u") == (following == USER) else None


class Weights:
    """The least weights of one conversation, fed from its last row to its first."""

    def __init__(self, block: int = BLOCK) -> None:
        self.size = block
        self.width = 3 * block + 2  # at most two inserts before a row and at the end
        self.costs = [cost for cost, _ in CLOSING]
        self.blocks: list[list[tuple[str, int]]] = []  # per state: letters, state after
        self.rows: list[tuple[str, bool, bool]] = []
        shift = 3 * self.width
        self.now = [
            (cost << shift) | self._digits(letters) for cost, letters in CLOSING
        ]

    def _digits(self, letters: str) -> int:
        value = 0
        for at, letter in enumerate(letters, 1):
            value |= LETTERS.index(letter) << 3 * (self.width - at)
        return value

    def _front(self, letter: int, cost: int, weight: int) -> int:
        """The weight with one more edit in front."""
        low = 3 * self.width
        high, letters = weight >> low, weight & ((1 << low) - 1)
        return (high + cost) << low | letter << (low - 3) | letters >> 3

    def add(self, initial: str, must_go: bool, truncated: bool) -> None:
        after, stays = self.now, TRUNCATED if truncated else 0
        least = []
        for state in range(4):
            best = self._front(D, DELETE, after[state])
            if not must_go:
                best = min(best, self._front(R, REROLE + stays, after[ALTERNATE[state]]))
                kept = _after_keep(state, initial)
                if kept is not None:
                    best = min(best, self._front(K, stays, after[kept]))
            least.append(best)
        # A third insert in a row would lead back to where the first one led.
        for _ in range(2):
            least = [min(w, self._front(I, INSERT, least[ALTERNATE[s]])) for s, w in enumerate(least)]
        self.now = least
        self.rows.append((initial, must_go, truncated))
        if len(self.rows) == self.size:
            self._close()

    def _close(self) -> None:
        low = 3 * self.width
        rows = self.rows[::-1]
        found = []
        for state, weight in enumerate(self.now):
            digits = format(weight & ((1 << low) - 1), f"0{self.width}o").rstrip("0")
            letters = "".join(LETTERS[int(d)] for d in digits)
            found.append((letters, walk(letters, (r[0] for r in rows), state)))
        self.blocks.append(found)
        self.costs = [w >> low for w in self.now]
        self.now = [cost << low for cost in self.costs]
        self.rows = []

    def result(self) -> tuple[int, str]:
        """Cost and audit from nothing on."""
        if self.rows or not self.blocks:
            self._close()
        state, parts = 0, []
        for block in reversed(self.blocks):
            letters, state = block[state]
            parts.append(letters)
        return self.costs[0], "".join(parts)


def walk(letters: str, initials: Iterator[str], state: int) -> int:
    """The state after the edits; the initials are those of the rows they use up."""
    for letter in letters:
        if letter == "K":
            state = _after_keep(state, next(initials))
        elif letter == "D":
            next(initials)
        elif letter == "R":
            next(initials)
            state = ALTERNATE[state]
        else:
            state = ALTERNATE[state]
    return state


WEIGHED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summary(c: dict) -> tuple:
    cost, audit = c["weights"].result() if c["rows"] else (0, "")
    gaps = c["high"] - c["low"] + 1 - c["turns"] if c["turns"] else 0
    return min(gaps, MAX_LONG), *c["faults"], c["illegal"], cost, audit


def weigh(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a conversation; its rows come from the last to the first, and
    one with no fault (null) only says that the conversation exists."""
    key, current = None, None
    for batch in batches:
        done = []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "fault"))
        for conv, turn, initial, fault in zip(*columns, strict=True):
            if current is None or conv != key:
                if current is not None:
                    done.append((key, *_summary(current)))
                key = conv
                current = {
                    "weights": Weights(), "rows": 0, "faults": [0, 0, 0], "illegal": 0,
                    "later": None, "turns": 0, "low": None, "high": None,
                }
            if fault is None:
                continue
            c = current
            if turn is not None and (not c["turns"] or turn != c["low"]):
                c["turns"] += 1
                c["low"] = turn
                c["high"] = turn if c["high"] is None else c["high"]
            if fault:
                c["faults"][fault - 1] += 1
            if c["rows"] and initial + c["later"] not in ("su", "ua", "au"):
                c["illegal"] += 1
            c["later"] = initial
            c["rows"] += 1
            c["weights"].add(initial, fault in (1, 2), fault == 3)
        if done:
            yield _batch(done, schema)
    if current is not None:
        yield _batch([(key, *_summary(current))], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class Repair:
    """Feeds the repaired rows of one conversation to SHA-256."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0
        self.hash, self.first = hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        if not self.first:
            self.hash.update(b"\n")
        self.first = False
        self.hash.update(role.encode())
        self.hash.update(b":")
        self.hash.update(text.encode())

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = ALTERNATE[self.state]
            self._line(ROLE_OF[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _after_keep(self.state, role[:1])
            self._line(role, text)
        elif letter == "R":
            self.state = ALTERNATE[self.state]
            self._line(ROLE_OF[self.state], text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def digest_repairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The summary rows with the digest of the repaired text; each is followed
    by the rows of its conversation in order."""
    names = [f.name for f in schema][:-1]
    summary, repair = None, None
    for batch in batches:
        done = []
        audits = batch.column("audit").to_pylist()
        for i, audit in enumerate(audits):
            if audit is not None:
                if repair is not None:
                    done.append((*summary, repair.digest()))
                summary = tuple(batch.column(n)[i].as_py() for n in names)
                repair = Repair(audit)
            else:
                repair.row(batch.column("role")[i].as_py(), batch.column("text")[i].as_py())
        if done:
            yield _batch(done, schema)
    if repair is not None:
        yield _batch([(*summary, repair.digest())], schema)


def damage(rows: DataFrame) -> DataFrame:
    """Planted faults by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row
    (``dropped`` is true), 1 empties the text, 2 takes out ``[.!?]``, 3 repeats
    the row, 4 makes it a user's. Null values read as one space."""
    space = F.lit(" ")
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    )
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def repair_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)`` of each conversation of ``rows (conv_id, turn, role,
    text)``. A boolean column ``dropped`` may mark rows that are no longer
    there; their conversations appear all the same."""
    spark = rows.sparkSession
    ship_package(spark)
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    space = F.lit(" ")
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        "dropped",
    )
    kind = rows.schema["conv_id"].dataType
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))

    # Equal rows of a conversation are numbered in its order; the shuffle by
    # conversation serves the numbers and the weighing.
    equal = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy("turn")
    words = F.btrim("text", F.lit(WHITE_SPACE))
    slim = rows.select(
        "conv_id",
        "turn",
        "dropped",
        F.when(~F.col("dropped"), F.col("role")).alias("role"),
        F.when(~F.col("dropped"), digest).alias("digest"),
        (words == "").alias("blank"),
        (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    ).repartition("conv_id")
    faults = slim.withColumn("nth", F.row_number().over(equal)).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "nth",
        F.left("role", F.lit(1)).alias("initial"),
        F.when(F.col("dropped"), None)
        .when(F.col("blank"), 1)
        .when(F.col("nth") > 1, 2)
        .when(F.col("truncated"), 3)
        .otherwise(0)
        .alias("fault"),
    )
    backwards = faults.sortWithinPartitions(
        "conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"), F.desc("nth")
    ).select("conv_id", "turn", "initial", "fault")
    weighed_type = f"conv_id {kind.simpleString()}, {WEIGHED}"
    weighed_schema = to_arrow_schema(StructType.fromDDL(weighed_type))
    weighed = stage(
        backwards.mapInArrow(lambda it: weigh(it, weighed_schema), weighed_type), "audits"
    )

    there = rows.filter("not dropped").select("conv_id", "turn", "role", digest.alias("digest"), "text")
    together = (
        weighed.unionByName(there, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", "digest")
        .drop("turn", "digest")
    )
    result_type = f"{weighed_type}, repaired_sha256 string"
    result_schema = to_arrow_schema(StructType.fromDDL(result_type))
    return together.mapInArrow(lambda it: digest_repairs(it, result_schema), result_type)
