"""How the sources of a language differ in their vocabulary (operator 12).

Terms are the runs of ASCII letters and non-ASCII characters of a text, A-Z
lower-cased; a language keeps the terms that at least ``min_docs`` of its
documents hold. Each (language, source) group and each language as a whole
gives a kept term ``p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))``. Two parts
come out: ``pair``, the sum of ``|p - q|`` over all kept terms for each other
source of the language, and ``term``, the 50 terms that a group uses most above
its language.

Pairs work on run-length columns. A language's vocabulary is put in the order of
its counts in the ``LEADING`` largest sources, one after the other, then of its
total count, so that equal counts of a group stand together. The ordered
vocabulary is cut into blocks; in a block each group's column is a list of runs
(end, p). For two groups the runs' ends are merged, and each piece adds its
length times ``|p - q|``. Blocks are worked on apart and their sums added, so a
language's vocabulary is spread over tasks; a block is no longer than keeps
(groups x terms) under ``CELLS``, and a task compares ``SLICE`` of the groups with
all of a block. Pairs themselves are the result asked for and grow with the square
of the sources of a language.

Counting: each task counts whole documents in a table that is emitted when it
holds ``KEPT_COUNTS`` terms, so partial counts are shuffled, never words, and a hot
source or term is summed before it meets others. Counts and p are exact: p comes
from decimals, sums are longs.

Edge cases: null text, language and source read as ''; each row is a document,
also a repeated one or one with a null id; groups without kept terms and
languages with none still have their rows (p of a zero count; value 0 where V is
0); a language of one source has no pairs; ties go by UTF-8 order of the item;
texts of any length are read whole; an empty table gives an empty result; only
the three columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stage
from shelfwise.session import ship_package

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
SMOOTHING = 5
KEPT_COUNTS = 300_000
LEADING = 8
CELLS = 1 << 18
SLICE = 64
COUNTS = "lang string, source string, term string, n long, docs long"

_TERMS = re.compile(TERM)


def terms_of(text: str) -> list[str]:
    return _TERMS.findall(text.encode().lower().decode())  # bytes: A-Z only


def _emit(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    # Both counters met each term for the first time in the same order.
    columns = [
        (
            pa.repeat(lang, len(words)),
            pa.repeat(source, len(words)),
            pa.array(words.keys(), pa.string(), size=len(words)),
            pa.array(words.values(), pa.int64(), size=len(words)),
            pa.array(docs.values(), pa.int64(), size=len(words)),
        )
        for (lang, source), (words, docs) in counts.items()
    ]
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(c) for c in zip(*columns, strict=True)], ["lang", "source", "term", "n", "docs"]
    )


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: occurrences and documents of each term of each group."""
    counts: dict = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(n) for n in ("lang", "source", "text")), strict=True):
            words, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            found = terms_of(text.as_py())
            before = len(words)
            words.update(found)
            docs.update(iter(dict.fromkeys(found)))
            held += len(words) - before
            if held >= KEPT_COUNTS:
                yield _emit(counts)
                counts, held = {}, 0
    if held:
        yield _emit(counts)


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * kept)), exact at any size."""
    wide = "decimal(38,0)"
    return (
        F.call_function(
            "div",
            F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)"),
            (total.cast("decimal(28,0)") + (kept * SMOOTHING).cast("decimal(28,0)")).cast(wide),
        )
        + 1
    )


def runs(at: np.ndarray, p: np.ndarray, zero: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The run-length column (ends, values) of a block of ``length`` terms where
    term ``at[i]`` has value ``p[i]`` and every other has ``zero``."""
    column = np.full(length, zero, np.int64)
    column[at] = p
    ends = np.append(np.flatnonzero(column[1:] != column[:-1]) + 1, length)
    return ends, column[ends - 1]


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum of |p - q| over a block, from the runs of both columns."""
    ends = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], ends)]
    q = b[1][np.searchsorted(b[0], ends)]
    return int(np.dot(np.abs(p - q), np.diff(ends, prepend=0)))


def _compare(part: pd.DataFrame) -> pd.DataFrame:
    """Pairs (source, item) of one block whose first source is of this slice."""
    lang, length, own = part["lang"].iloc[0], int(part["length"].iloc[0]), part["part"].iloc[0]
    part = part.sort_values("source", key=lambda s: s.map(str.encode))
    columns = []
    for at, p, zero in zip(part["at"], part["p"], part["zero"], strict=True):
        if length and at is not None and len(at):
            columns.append(runs(np.asarray(at, np.int64), np.asarray(p, np.int64), int(zero), length))
        else:
            columns.append((np.array([length]), np.array([0 if not length else int(zero)], np.int64)))
    sources, slices = part["source"].tolist(), part["slice"].tolist()
    out = [
        (lang, sources[i], sources[j], distance(columns[i], columns[j]) if length else 0)
        for i in range(len(sources))
        if slices[i] == own
        for j in range(i + 1, len(sources))
    ]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _in_order(kept: DataFrame, groups: DataFrame, languages: DataFrame) -> DataFrame:
    """``(lang, term, block, at, length)``: each kept term's place in the blocks.

    Terms are range-partitioned and sorted by the counts of the largest
    sources, then numbered and staged, which pins the ranges. Numbers of
    different tasks leave gaps, so a block never crosses tasks.
    """
    largest = Window.partitionBy("lang").orderBy(F.desc("total"), "source")
    leading = (
        groups.withColumn("rank", F.row_number().over(largest))
        .filter(F.col("rank") <= LEADING)
        .select(F.col("lang").alias("l"), F.col("source").alias("s"), "rank")
    )
    by_term = (
        kept.join(leading, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
        .groupBy("lang", "term")
        .agg(
            *(
                F.coalesce(F.sum(F.when(F.col("rank") == k, F.col("n"))), F.lit(0)).alias(f"c{k}")
                for k in range(1, LEADING + 1)
            ),
            F.sum("n").alias("all"),
        )
    )
    order = ["lang", *(f"c{k}" for k in range(1, LEADING + 1)), "all", "term"]
    numbered = stage(
        by_term.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("lang", "term", F.monotonically_increasing_id().alias("number")),
        "vocabulary",
    )
    size = languages.select(F.col("lang").alias("l"), F.greatest(F.lit(64), F.lit(CELLS).cast("long") / F.col("sources")).cast("long").alias("size"))
    placed = numbered.join(size, F.col("lang") == F.col("l")).select(
        "lang", "term", "number", F.expr("number div size").alias("block")
    )
    bounds = placed.groupBy(F.col("lang").alias("l"), F.col("block").alias("b")).agg(
        F.min("number").alias("first"), F.count("*").alias("length")
    )
    return placed.join(bounds, (F.col("lang") == F.col("l")) & (F.col("block") == F.col("b"))).select(
        "lang", "term", "block", (F.col("number") - F.col("first")).alias("at"), "length"
    )


def _pairs(kept: DataFrame, groups: DataFrame, languages: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language, both ways."""
    order = stage(_in_order(kept, groups, languages), "places")
    cells = (
        kept.join(order.select("lang", "term", "block", "at"), ["lang", "term"])
        .join(groups.select("lang", "source", "total", "vocabulary"), ["lang", "source"])
        .groupBy("lang", "block", "source")
        .agg(F.collect_list(F.struct("at", _p(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"))).alias("cells"))
    )
    # Every group has a column in every block of its language; a language
    # without terms has one empty block.
    blocks = order.select("lang", "block", "length").distinct().unionByName(
        languages.filter("vocabulary = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("length"))
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    sliced = groups.withColumn("slice", ((nth - 1) / SLICE).cast("int"))
    zero = F.when(F.col("vocabulary") > 0, _p(F.lit(0).cast("long"), F.col("total"), F.col("vocabulary")))
    columns = (
        blocks.join(sliced, "lang")
        .join(cells, ["lang", "block", "source"], "left")
        .select(
            "lang", "block", "source", "slice", "length",
            F.coalesce(zero, F.lit(0)).alias("zero"),
            F.col("cells.at").alias("at"),
            F.col("cells.p").alias("p"),
            F.explode(F.sequence(F.lit(0), ((F.col("sources") - 1) / SLICE).cast("int"))).alias("part"),
        )
        # Pairs are made once, by the slice of the source that comes first.
        .filter("slice >= part")
    )
    sums = (
        columns.groupBy("lang", "block", "part")
        .applyInPandas(_compare, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    both = F.explode(
        F.array(
            F.struct(F.col("source").alias("a"), F.col("item").alias("b")),
            F.struct(F.col("item").alias("a"), F.col("source").alias("b")),
        )
    )
    return sums.select("lang", "value", both.alias("ends")).select(
        "lang", F.col("ends.a").alias("source"), F.col("ends.b").alias("item"), "value"
    )


def _terms(kept: DataFrame, groups: DataFrame, languages: DataFrame, most: int) -> DataFrame:
    """The ``most`` terms that each group uses above its language."""
    whole = kept.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    totals = languages.select("lang", F.col("total").alias("lang_total"))
    above = (
        kept.join(whole, ["lang", "term"])
        .join(groups.select("lang", "source", "total", "vocabulary"), ["lang", "source"])
        .join(totals, "lang")
        .select(
            "lang",
            "source",
            F.col("term").alias("item"),
            (
                _p(F.col("n"), F.col("total"), F.col("vocabulary"))
                - _p(F.col("in_lang"), F.col("lang_total"), F.col("vocabulary"))
            ).alias("value"),
        )
        .filter("value > 0")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= most)


def audit_sources(docs: DataFrame, min_docs: int = 30, most: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every group of ``docs``.

    Counts and vocabulary are made, and staged, when called.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source", "text")))
    counts = stage(
        rows.mapInArrow(count_terms, COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "term-counts",
    )
    vocabulary = (
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("d")).filter(F.col("d") >= min_docs).drop("d")
    )
    kept = stage(counts.drop("docs").join(vocabulary, ["lang", "term"]), "kept-terms")
    sizes = kept.groupBy("lang").agg(
        F.count_distinct("term").alias("vocabulary"), F.sum("n").alias("total")
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    there = rows.groupBy("lang", "source").agg(F.lit(1).alias("there")).drop("there")
    zero = F.lit(0).cast("long")
    languages = stage(
        there.groupBy("lang")
        .agg(F.count("*").alias("sources"))
        .join(sizes, "lang", "left")
        .select("lang", "sources", F.coalesce("vocabulary", zero).alias("vocabulary"), F.coalesce("total", zero).alias("total")),
        "languages",
    )
    groups = stage(
        there.join(totals, ["lang", "source"], "left")
        .join(languages.select("lang", "sources", "vocabulary"), "lang")
        .select("lang", "source", "sources", "vocabulary", F.coalesce("total", zero).alias("total")),
        "groups",
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups, languages).withColumn("rank", F.row_number().over(by_value))
    terms = _terms(kept, groups, languages, most)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns)
    )


def oracle_sql(min_docs: int = 30, most: int = 50) -> str:
    """DuckDB SQL for ``audit_sources`` over table ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def p(n: str, total: str) -> str:
        return (
            f"(1 + ({SCALE}::HUGEINT * ({n} + {SMOOTHING})) // ({total}::HUGEINT + {SMOOTHING} * v.v))::BIGINT"
        )

    return f"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {min_docs}),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k ON k.lang = g.lang GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
       FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
gp AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, {p('coalesce(c.n, 0)', 'gn.total')} AS p
       FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang
       LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
lp AS (SELECT lc.lang, lc.term, {p('lc.n', 'ln.total')} AS q
       FROM lc JOIN ln ON ln.lang = lc.lang JOIN v ON v.lang = lc.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM gp a JOIN gp b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, (gp.p - lp.q)::BIGINT AS value
          FROM gp JOIN lp ON lp.lang = gp.lang AND lp.term = gp.term WHERE gp.n > 0 AND gp.p > lp.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {most}"""
