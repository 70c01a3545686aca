"""Near-duplicate documents by circulant MinHash (operator 1).

A document's set holds its distinct five-word shingles (A-Z lower-cased words
``[^\\x20\\x09-\\x0D]+``; fewer words are one shingle; no words, an empty set).
Signature: shingles fall on ``2**20`` places; one permutation shuffles the
places, and coordinate k is the least value that a second permutation, shifted
circularly by k, gives to the set's places. All ``bands * rows`` coordinates
come from these two permutations, so a shingle's values are one contiguous
slice of a table.

Documents with equal sets form a class with its least id as representative.
Representatives that share a band are candidates, and no link among them may
be lost, yet a large group of copies must not cost all its pairs. So first
each is compared with one hub: of the members it shares bands with, the one
that shares most bands with others, which is where a group's original lies.
Links found are contracted to components. Buckets that still hold several
components are then searched exactly, by prefix filtering: a set's shingles are
ordered from rare to common, two sets that are alike must meet within their
first few, and their places there bound what they can share. Copies that were
edited too much to be alike differ in that prefix and never meet; copies that
are alike to their hub are one component already. Every link is confirmed on
the full sets of 64-bit shingle hashes. A pair at the threshold misses all 40
bands of 5 rows with probability 7e-11 at 0.85 and 1e-7 at 0.8.

Edge cases: null and wordless texts have an empty set and link with nothing;
rows that share a doc_id are one document; rows with a null doc_id are
returned as they are, unlinked, component null and kept true; ties go to the
least id; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stage
from shelfwise.llm.components import components
from shelfwise.session import ship_package

PLACES = 1 << 20
SHINGLE = 5
# Ids (8 bytes each, some 50 in a hash table) that are sent to every executor.
BROADCAST_ROWS = 1_000_000
_CHUNK = 256
_WORDS_KEPT = 150_000


class _WordHashes(dict):
    """Word -> 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII rules
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : n - width + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(h)


@cache
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second's circular windows."""
    rng = np.random.Generator(np.random.PCG64(20_240_501))
    first = rng.permutation(PLACES).astype(np.uint32)
    second = rng.permutation(PLACES).astype(np.uint32)
    around = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    first, windows = _permutations(coordinates)
    places = first[(shingles >> np.uint64(44)).astype(np.intp)]
    least = windows[places[:_CHUNK]].min(axis=0)
    for i in range(_CHUNK, len(places), _CHUNK):
        np.minimum(least, windows[places[i : i + _CHUNK]].min(axis=0), out=least)
    return least


def _sign(
    batches: Iterator[pa.RecordBatch], bands: int, rows: int
) -> Iterator[pa.RecordBatch]:
    """One row a document: set size, a 128-bit digest of the set, band keys."""
    for batch in batches:
        sizes, digests, keys = [], [], []
        for text in batch.column("text"):
            shingles = shingle_set(text.as_py())
            sizes.append(len(shingles))
            if not len(shingles):
                digests.append(None)
                keys.append(None)
                continue
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            raw = signature(shingles, bands * rows).tobytes()
            keys.append(
                [
                    xxhash.xxh3_64_intdigest(raw[4 * rows * b : 4 * rows * (b + 1)], b) - (1 << 63)
                    for b in range(bands)
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["id", "n_shingles", "digest", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"]
        )


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are alike: 100 * intersection >= percent * union."""
    for batch in batches:
        linked = []
        for a, b in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (a, b))
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * common >= percent * (len(x) + len(y) - common))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"]
        )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, rows: int | None = None) -> DataFrame:
    """The linked ones of the pairs (u, v); ``rows`` bounds the pairs."""
    return stage(
        pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a_set")), "u")
        .join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b_set")), "v")
        .mapInArrow(lambda it: _confirm(it, percent), "u long, v long"),
        "links",
        rows,
    )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each set."""
    for batch in batches:
        for rep, raw in zip(batch.column("rep"), batch.column("shingles"), strict=True):
            shingles = np.frombuffer(raw.as_py(), np.int64)
            reps = np.full(len(shingles), rep.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(shingles)], ["rep", "shingle"])


def _hub_pairs(shared: DataFrame, rows: int) -> DataFrame:
    """Each representative with the most central member of its buckets: (u, v)."""
    central = shared.groupBy("rep").agg(F.sum("n").alias("central"))
    ranked = stage(shared.join(central, "rep"), "ranked", rows)
    hub = F.struct("central", (-F.col("rep")).alias("order"), F.col("rep").alias("id"))
    hubs = ranked.groupBy("key").agg(F.max(hub).alias("hub"))
    best = (
        ranked.join(hubs, "key")
        .filter(F.col("rep") != F.col("hub.id"))
        .groupBy("rep")
        .agg(F.max("hub").alias("hub"))
    )
    return best.select(F.least("rep", "hub.id").alias("u"), F.greatest("rep", "hub.id").alias("v")).distinct()


def _prefix_pairs(sets: DataFrame, component: DataFrame, percent: int, rows: int) -> DataFrame:
    """Pairs (u, v) of sets in different components that may be alike; exact.

    ``component`` lists the sets to compare, ``(rep, component)``; there are at
    most ``rows`` of them.
    """
    own = stage(sets.join(component, "rep"), "apart", rows)
    tokens = own.mapInArrow(_tokens, "rep long, shingle long")
    # A shingle of one set only leads nowhere; it just takes its place in front.
    common = tokens.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1")
    shared = (
        tokens.join(common, "shingle")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("ordered"))
    )
    sized = shared.join(
        own.select(
            F.col("rep").alias("r"),
            "component",
            (F.octet_length("shingles") / 8).cast("int").alias("size"),
        ),
        F.col("rep") == F.col("r"),
    )
    alone = F.col("size") - F.size("ordered")
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1
    front = stage(
        sized.filter(prefix > alone).select(
            "rep",
            "component",
            "size",
            alone.alias("alone"),
            F.posexplode(F.slice("ordered", F.lit(1), prefix - alone)).alias("at", "token"),
        ).select(
            "rep", "component", "size", (F.col("alone") + F.col("at")).alias("at"), "token.shingle"
        ),
        "prefixes",
    )
    left = front.toDF("u", "cu", "su", "iu", "shingle")
    right = front.toDF("v", "cv", "sv", "iv", "shingle")
    most = F.least(F.col("su") - F.col("iu"), F.col("sv") - F.col("iv"))
    may_be_alike = (100 + percent) * most >= percent * (F.col("su") + F.col("sv"))
    return (
        left.join(right, "shingle")
        .filter((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & may_be_alike)
        .select("u", "v")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    bands: int = 40,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every document.

    ``percent`` is the Jaccard threshold in percent.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stage(
        texts.mapInArrow(
            lambda it: _sign(it, bands, rows),
            "id long, n_shingles long, digest binary, keys array<long>",
        ),
        "signatures",
    )
    usable = signed.filter("n_shingles > 0 and id is not null")
    classes = stage(
        usable.groupBy("digest").agg(
            F.min("id").alias("rep"), F.max("n_shingles").alias("size"), F.first("keys").alias("keys")
        ),
        "classes",
        signed.count(),
    )
    members = classes.select("rep", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(members.join(buckets, "key"), "buckets")
    pairs = shared.count()  # of representatives and buckets; at least as many as representatives

    # The sets of all candidates, made once. As long as their ids fit a task's
    # memory by count they go to the texts; else the texts are dealt by id, where
    # hashing the few ids spares sorting the texts.
    needed = shared.select(F.col("rep").alias("needed")).distinct()
    needed = F.broadcast(needed) if pairs <= BROADCAST_ROWS else needed.hint("shuffle_hash")
    sets = stage(
        texts.join(needed, F.col("id") == F.col("needed"), "left_semi")
        .mapInArrow(_sets, "id long, shingles binary")
        .withColumnRenamed("id", "rep"),
        "sets",
    )
    groups = components(_confirmed(_hub_pairs(shared, pairs), sets, percent, pairs))

    placed = shared.join(groups, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low != high")
        .select("key")
    )
    apart = placed.join(mixed, "key", "left_semi").select("rep", "component").distinct()
    more = _confirmed(_prefix_pairs(sets, apart, percent, pairs), sets, percent)
    if not more.isEmpty():
        spans = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
        groups = components(spans.union(more))

    named = classes.drop("keys").join(groups, F.col("rep") == F.col("node"), "left").select(
        F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component_id")
    )
    component = F.coalesce("component_id", "id")
    return (
        signed.drop("keys")
        .join(named, F.col("digest") == F.col("d"), "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.when(F.col("id").isNotNull(), component).alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
    )


def keep_one_of_each(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns as they are.

    The documents that go are listed in the checkpoint folder and taken out by
    an anti-join on the id; rows with a null id stay.
    """
    found = near_duplicates(docs, percent, id_col=id_col, text_col=text_col, **how)
    gone = stage(found.filter("not kept").select(F.col(id_col).alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def oracle_sql(percent: int) -> str:
    """DuckDB SQL for ``near_duplicates`` over table ``documents``: all pairs
    that share a shingle, and everything that can be reached from a document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE
           WHEN len(w) = 0 THEN []
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
  WHERE 100 * c >= {percent} * (nu.n + nv.n - c)
), e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.reach = e.u
), c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
