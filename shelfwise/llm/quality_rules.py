"""Quality rules: text statistics and learned decision lists (operator 5).

Statistics are native array expressions over whole texts. The decision list is
learned by sequential covering over the labelled documents' statistics: a rule
grows by the threshold condition with the largest information gain, is pruned
on rows held back for it, and the rows that it covers leave before the next
rule grows. Learning runs as small Spark aggregations over binned statistics;
the driver sees histograms of a fixed number of features and bins only. The
list is applied as one ordered Spark conditional expression.

Edge cases: a null or empty text has no words, fails the base rule and is
rejected; labels that are null, repeated (the lowest counts) or of unknown
documents are fine; without labels, or without one class, the list is empty
and the base rule alone decides; rows are judged one by one, so repeated rows
and null ids are kept or rejected like any other; an empty table gives an
empty result. ``kept_documents`` returns the input's columns under their names,
whatever these are; the report reads only the id and the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bind, stage, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# Labelled ids (8 bytes each, some 50 in a hash table) that are sent to every executor.
BROADCAST_ROWS = 1_000_000
LOW, KEEP = 0, 1


def _repeated(words: Column, n: Column) -> Column:
    """Words in five-word windows that the text holds twice or more.

    Hashes tell whether any window can repeat; only then the windows
    themselves are sorted and compared, so the count is exact.
    """
    starts = F.sequence(F.lit(0), n - WINDOW)

    def window(i: Column) -> list[Column]:
        return [words[i + k] for k in range(WINDOW)]

    def covered(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def twins(ordered: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            same = [F.coalesce(F.get(ordered, j)["w"] == x["w"], F.lit(False)) for j in (k - 1, k + 1)]
            return same[0] | same[1]

        return bind(
            F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"])), covered
        )

    exact = bind(
        F.array_sort(
            F.transform(
                starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))
            )
        ),
        twins,
    )
    hashes = F.transform(starts, lambda i: F.xxhash64(*window(i)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(
        bind(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact),
        )
    )


def text_statistics(text: Column) -> Column:
    """One struct of counts for a text, each over the whole of it."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated(words, n).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        bind(words_of(text), of_words).alias("w"),
        bind(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}+")).cast("long").alias("n_upper_runs"),
        F.regexp_count(text, F.lit(r"[!?]+")).cast("long").alias("n_marks"),
    )


STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_distinct_words", "n_lines", "n_upper_runs", "n_marks",
)


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the statistics of its text."""
    s = F.col("_stats")
    found = {
        **{c: s["w"][c] for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct_words")},
        **{c: s["l"][c] for c in ("n_lines", "n_dup_lines")},
        **{c: s[c] for c in ("n_symbols", "n_upper_runs", "n_marks")},
    }
    return docs.select(*keep, text_statistics(F.col(text_col)).alias("_stats")).select(
        *keep, *(found[c].alias(c) for c in STATISTICS)
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def features() -> dict[str, Column]:
    """What conditions may test, over the columns of ``with_statistics``."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "distinct_share": _share("n_distinct_words", "n_words"),
        "upper_runs_per_word": _share("n_upper_runs", "n_words"),
        "marks_per_word": _share("n_marks", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > cut, else feature <= cut
    cut: float

    def column(self, value: Column) -> Column:
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a document that fits one is of low quality, else good."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def fired(self) -> Column:
        """Number of the first rule that fits, from 1; 0 when none does."""
        value, out = features(), F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            fits = reduce(lambda a, b: a & b, (c.column(value[c.feature]) for c in rule))
            out = F.when(fits, F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        lines = [f"{i}: low if {' and '.join(map(str, r))}" for i, r in enumerate(self.rules, 1)]
        return "\n".join([*lines, "else good"])


def _cuts(rows: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature within each class."""
    at = [0.001, 0.01, *(i / 20 for i in range(1, 20)), 0.99, 0.999]
    found = rows.groupBy("y").agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in names))
    by_class = found.collect()  # two rows
    return {c: sorted({v for r in by_class for v in r[c]}) for c in names}


def learn_rules(
    stats: DataFrame,
    labels: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.97,
    min_cover: int = 5,
    id_col: str = "doc_id",
    label_col: str = "quality",
) -> DecisionList:
    """Learn a list from the statistics of all labelled documents.

    ``stats`` has the id and the columns of ``with_statistics``. A rule is
    accepted if ``min_precision`` of the held-back rows that it covers are of
    low quality and it covers ``min_cover`` rows to learn from.
    """
    value = features()
    names = list(value)
    marks = (
        labels.filter(F.col(label_col).isin(LOW, KEEP) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("labelled"))
        .agg(F.min(label_col).alias("y"))
    )
    rows = stage(
        stats.join(marks, F.col(id_col) == F.col("labelled")).select(
            F.col("labelled"), "y", *(v.alias(c) for c, v in value.items())
        ),
        "labelled",
    )
    cuts = _cuts(rows, names)
    if not cuts[names[0]]:
        return DecisionList()

    def bin_of(c: str) -> Column:
        below = F.array(*(F.lit(float(v)) for v in cuts[c]))
        return F.size(F.filter(below, lambda v: v < F.col(c)))

    table = stage(
        rows.select(
            F.array(*(bin_of(c) for c in names)).alias("bins"),
            "y",
            (F.crc32(F.concat(F.lit("prune"), F.col("labelled").cast("string")).cast("binary")) % 3 == 0)
            .alias("prune"),
        )
        .groupBy("bins", "y", "prune")
        .agg(F.count("*").alias("n")),
        "bins",
        rows.count(),
    )

    # A condition on bins: (feature number, above, cut number); bin b holds the
    # values over b cuts, so "value > cut k" is "bin > k".
    def fits(c: tuple[int, bool, int]) -> Column:
        b = F.col("bins")[c[0]]
        return b > c[2] if c[1] else b <= c[2]

    def best(rows: DataFrame) -> tuple[float, tuple[int, bool, int], int, int] | None:
        """The condition with the largest gain, and what it covers."""
        counts: dict[tuple[int, int], list[int]] = {}
        spread = rows.select(F.posexplode("bins").alias("f", "b"), "y", "n")
        for r in spread.groupBy("f", "b", "y").agg(F.sum("n").alias("n")).collect():
            counts.setdefault((r.f, r.b), [0, 0])[r.y] += r.n
        found = None
        for f, c in enumerate(names):
            by_bin = [counts.get((f, b), [0, 0]) for b in range(len(cuts[c]) + 1)]
            low_all, good_all = (sum(x[y] for x in by_bin) for y in (LOW, KEEP))
            if not low_all:
                return None
            low = good = 0
            for k in range(len(cuts[c])):
                low, good = low + by_bin[k][LOW], good + by_bin[k][KEEP]
                for above in (False, True):
                    p, q = (low_all - low, good_all - good) if above else (low, good)
                    if not p or q == good_all:
                        continue
                    gain = p * (log2(p / (p + q)) - log2(low_all / (low_all + good_all)))
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = gain, (f, above, k), p, q
        return found

    rules: list[tuple[Condition, ...]] = []
    left = table
    for _ in range(max_rules):
        grown: list[tuple[int, bool, int]] = []
        rows, cover = left.filter("not prune"), 0
        while len(grown) < max_conditions and (step := best(rows)):
            _, condition, cover, wrong = step
            grown.append(condition)
            rows = rows.filter(fits(condition))
            if not wrong:
                break
        if not grown or cover < min_cover:
            break
        heads = [reduce(lambda a, b: a & b, map(fits, grown[: i + 1])) for i in range(len(grown))]
        held = left.filter("prune").agg(
            *(
                F.coalesce(F.sum(F.when(h & (F.col("y") == y), F.col("n"))), F.lit(0)).alias(f"c{i}_{y}")
                for i, h in enumerate(heads)
                for y in (LOW, KEEP)
            )
        ).first()
        scored = [(held[f"c{i}_{LOW}"], held[f"c{i}_{KEEP}"]) for i in range(len(heads))]
        worth = [(p - q) / (p + q) if p + q else -1.0 for p, q in scored]
        i = max(range(len(heads)), key=lambda j: (worth[j], -j))
        p, q = scored[i]
        if not p or p < min_precision * (p + q):
            break
        rules.append(
            tuple(Condition(names[f], above, cuts[names[f]][k]) for f, above, k in grown[: i + 1])
        )
        left = left.filter(~heads[i])
    return DecisionList(rules)


def labelled_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that ``labels`` names, so that only their statistics are
    made before the list is learned. The ids go to the documents while they fit
    by count; beyond, both are dealt by id."""
    named = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_labelled")).distinct()
    named = F.broadcast(named) if labels.count() <= BROADCAST_ROWS else named.hint("shuffle_hash")
    return docs.join(named, docs[id_col] == named["_labelled"], "left_semi")


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed, the number of the rule that fired, and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.fired()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Statistics and verdict of every document; learns when called."""
    stats = stage(with_statistics(docs, [id_col]), "statistics")
    return judge(stats, learn_rules(stats, labels, id_col=id_col))


def kept_documents(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected ones, all columns as they are, without a shuffle."""
    names = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(names)))
    found = judge(with_statistics(inner, inner.columns, f"_d{names.index(text_col)}"), rules)
    return found.filter("kept").select(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(names)))
