"""Document fingerprints: Merkle trees over sections and paragraphs (operator 13).

A text is cut, without losing a character, into sections (after blank lines),
paragraphs (after line ends) and leaves (after the first sentence end past 64
code points, at the latest after 256). A leaf's node is SHA-256 of its text, and
every node above is SHA-256 of its children's; the root stands for the whole
text, so equal roots mean equal texts. Each leaf is also kept as one long, 52
bits of hash over 12 bits of length, in the shape of the tree: where two roots
differ, the leaves tell which branches do and how many code points they hold.

As a string, a fingerprint is the root, ``:``, and the leaves in hex with ``.``
between leaves, ``,`` between paragraphs and ``/`` between sections. Its length
is about an eighth of the text's.

``likeness`` of two trees is 1 for equal roots; else twice the code points in
leaves that both hold (a leaf that stands n times counts n times), over those
of both, and under 1. ``changed_span`` is the range of the first text between the
leaves that both share at the front and at the end.

``edits_by_next`` compares each document with an edited text (its last quarter
replaced by the start of the next document, by ascending id) and with that next
document. Documents are numbered by range partitioning on (id, digest of the
text), never in one task. Texts are shuffled once, to their key, and each sends
to its predecessor its tree and the start that is asked for, at most a quarter
of the predecessor's length.

Edge cases: a null text is empty; an empty text has no leaves, and two of them
are alike at 1; rows of one id come by SHA-256 of the text; repeated rows are
each followed by their like, the last by the next document, and are worked out
once and written out in pieces; null ids come first; the last document is
followed by the first, which for a single one is itself; texts of any length
are taken whole (leaves and hashes take time in proportion to it); an empty
table gives an empty result; only id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bind, stage

SECTION = r"(?<=\n\n)(?!\n|\z)"
PARAGRAPH = r"(?<=\n)(?!\n|\z)"
LEAF = r"(?s).{64,255}?[.!?][\x20\x09-\x0D]{1,16}|.{1,256}"
LENGTH_BITS = 12
PIECE = 4096
_ROW_BITS = 33


def _joined_hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, "").cast("binary"), 256)


def _leaf(text: Column) -> Column:
    return F.shiftleft(F.xxhash64(text), LENGTH_BITS).bitwiseOR(F.length(text).cast("long"))


def fingerprint(text: Column) -> Column:
    """``struct(root, leaves)`` of a text; leaves by section and paragraph."""
    pieces = F.transform(
        F.split(F.coalesce(text, F.lit("")), SECTION, -1),
        lambda section: F.transform(
            F.split(section, PARAGRAPH, -1),
            lambda paragraph: F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)),
        ),
    )

    def tree(sections: Column) -> Column:
        def node(paragraph: Column) -> Column:
            return _joined_hash(F.transform(paragraph, lambda t: F.sha2(t.cast("binary"), 256)))

        root = _joined_hash(F.transform(sections, lambda s: _joined_hash(F.transform(s, node))))
        leaves = F.transform(sections, lambda s: F.transform(s, lambda p: F.transform(p, _leaf)))
        return F.struct(root.alias("root"), leaves.alias("leaves"))

    return bind(pieces, tree)


def fingerprint_text(tree: Column) -> Column:
    def paragraph(leaves: Column) -> Column:
        return F.array_join(F.transform(leaves, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ".")

    sections = F.transform(tree["leaves"], lambda s: F.array_join(F.transform(s, paragraph), ","))
    return F.concat_ws(":", tree["root"], F.array_join(sections, "/"))


def _flat(tree: Column) -> Column:
    return F.flatten(F.flatten(tree["leaves"]))


def _length(leaves: Column) -> Column:
    """Code points in these leaves."""
    mask = F.lit((1 << LENGTH_BITS) - 1).cast("long")
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda sum_, x: sum_ + x.bitwiseAND(mask))


def _numbered(leaves: Column) -> Column:
    """The leaves with the second, third ... of the same kind told apart, lengths kept."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)))

        def marked(starts: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                after = F.coalesce(F.get(starts, k + 1), n)
                nth = F.sequence(F.lit(1), after - start)
                mark = lambda j: F.when(j > 1, F.shiftleft(F.xxhash64(j), LENGTH_BITS)).otherwise(F.lit(0).cast("long"))
                return F.transform(nth, lambda j: F.get(ordered, start).bitwiseXOR(mark(j)))

            return F.flatten(F.transform(starts, run))

        return bind(starts, marked)

    return bind(F.array_sort(leaves), runs)


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts is in leaves that both hold, from 0 to 1."""

    def compared(flat: Column) -> Column:
        x, y = flat["x"], flat["y"]
        total = _length(x) + _length(y)
        both = _length(F.array_intersect(_numbered(x), _numbered(y))) * 2
        return F.when(total == 0, 1.0).otherwise(F.least(both, total - 1) / total)

    return F.when(a["root"] == b["root"], 1.0).otherwise(
        bind(F.struct(_flat(a).alias("x"), _flat(b).alias("y")), compared)
    )


def changed_span(a: Column, b: Column) -> Column:
    """``struct(start, end)`` of the code points of the first text outside the
    leaves that both share at its front and its end; null for equal texts."""

    def shared(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(first == 0, F.size(x)).otherwise((first - 1).cast("int"))

    def span(flat: Column) -> Column:
        x, y = flat["x"], flat["y"]

        def ends(front: Column) -> Column:
            back = F.least(
                shared(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - front
            )
            return F.struct(
                _length(F.slice(x, F.lit(1), front)).alias("start"),
                _length(F.slice(x, F.lit(1), F.size(x) - back)).alias("end"),
            )

        return bind(shared(x, y), ends)

    return F.when(
        a["root"] != b["root"], bind(F.struct(_flat(a).alias("x"), _flat(b).alias("y")), span)
    )


def _in_order(keys: DataFrame) -> tuple[DataFrame, int]:
    """``keys`` with their place by (id, key), from 0, and how many there are.

    Ranges are sorted in their tasks and staged, which pins them; the driver
    sees one count for each range.
    """
    numbered = stage(
        keys.repartitionByRange(F.asc_nulls_first("id"), "key")
        .sortWithinPartitions(F.asc_nulls_first("id"), "key")
        .withColumn("number", F.monotonically_increasing_id()),
        "in-order",
    ).withColumn("range", F.shiftright("number", _ROW_BITS))
    counts = numbered.groupBy("range").count().orderBy("range").collect()
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["range"], total))
        total += r["count"]
    starts = keys.sparkSession.createDataFrame(offsets, "range long, before long")
    place = F.col("before") + F.col("number").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.join(F.broadcast(starts), "range").withColumn("place", place).drop("range", "number", "before"),
        total,
    )


def _links(keyed: DataFrame) -> DataFrame:
    """Each different (id, text) by key: its copies and length, and how many
    code points of its start the document before it (``for_key``) wants."""
    keys = keyed.groupBy("key").agg(
        F.first("id").alias("id"), F.count("*").alias("copies"), F.first(F.length("text").cast("long")).alias("n")
    )
    placed, total = _in_order(keys)
    before = placed.select(
        ((F.col("place") + 1) % max(total, 1)).alias("place"),
        F.col("key").alias("for_key"),
        _quarter().alias("need"),
    )
    return stage(placed.join(before, "place").drop("place"), "links")


def _quarter() -> Column:
    return F.expr("cast(n div 4 as int)")


def _compared(rows: DataFrame) -> DataFrame:
    """The result columns from ``(id, n, text, start, next_tree)``."""
    edited = F.expr("concat(left(text, cast(n - n div 4 as int)), start)")
    trees = (
        rows.withColumns({"tree": fingerprint(F.col("text")), "edited": edited})
        .drop("text", "start")
        .withColumn("edited_tree", fingerprint(F.col("edited")))
    )
    return trees.select(
        "id",
        F.col("n").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("tree")).alias("fingerprint"),
        fingerprint_text(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        F.coalesce(likeness(F.col("tree"), F.col("next_tree")), F.lit(1.0)).alias("near_next"),
        changed_span(F.col("tree"), F.col("edited_tree")).alias("changed"),
        *(c for c in ("times",) if c in rows.columns),
    ).select(
        "*", F.col("changed.start").alias("changed_from"), F.col("changed.end").alias("changed_to")
    ).drop("changed")


def edits_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, changed_from, changed_to)`` of every document.

    The last two give the code points of the document's own text that lie in
    branches changed by the edit. The order is found and staged when called.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The digest has a fixed length, so no two pairs of id and text share a key.
    key = F.concat(
        F.coalesce(F.concat(F.lit("#"), F.col(id_col).cast("string")), F.lit("")).cast("binary"),
        F.unhex(F.sha2(text.cast("binary"), 256)),
    )
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))
    links = _links(keyed)
    # One text for each key, however often its row stands in the table. All
    # that follows is dealt by this key, so texts move once.
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    starts = texts.join(links.select("key", "for_key", "need"), "key").select(
        F.col("for_key").alias("key"),
        F.expr("left(text, need)").alias("start"),
        fingerprint(F.col("text")).alias("next_tree"),
    )
    once = texts.join(links.select("key", "id", "n"), "key").join(starts, "key").drop("key")
    done = _compared(once)
    repeated = links.filter("copies > 1").select("key", "id", "n", (F.col("copies") - 1).alias("times"))
    if not repeated.isEmpty():
        done = done.unionByName(_repeated(texts.join(repeated, "key")))
    return done.withColumnRenamed("id", id_col)


def _repeated(rows: DataFrame) -> DataFrame:
    """Repeated rows that are followed by their like: worked out once for each
    key, then written out by pieces over all tasks."""
    alike = rows.select(
        "id", "n", "times", "text",
        F.expr("left(text, cast(n div 4 as int))").alias("start"),
        F.lit(None).cast("struct<root:string,leaves:array<array<array<bigint>>>>").alias("next_tree"),
    )
    pieces = stage(_compared(alike), "repeated").withColumn(
        "piece", F.explode(F.expr(f"sequence(0L, (times - 1) div {PIECE})"))
    )
    return (
        pieces.repartition("id", "edited_sha256", "piece")
        .withColumn("_nth", F.explode(F.expr(f"sequence(1L, least({PIECE}L, times - piece * {PIECE}))")))
        .drop("_nth", "piece", "times")
    )
