"""Exact quantiles at scale, quartile scores, shares.

Spark's exact ``percentile`` aggregate merges every distinct value into one
buffer in a single final task, which does not survive a billion customers.
``order_statistics`` instead finds exact k-th smallest values by repeated
histogram narrowing:

1. one aggregate gives n, min and max of each column;
2. each round splits the current value range of every target into ``bins``
   equal-width bins and counts rows, min and max per bin — one distributed
   group-by whose result has at most ``ranges × bins`` rows (targets with the
   same column and range share a histogram);
3. the bin holding the wanted rank becomes the next range (its observed
   min/max), until the range holds a single distinct value.

The range shrinks by a factor of ``bins`` or more per round, so real data
needs two to four rounds; a value repeated by a third of all rows resolves in
one. Only bounded bin tables reach the driver. Each round is an action: pass
an input that is cached or cheap to recompute.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BINS = 4096
MAX_ROUNDS = 200


@dataclass
class _Target:
    column: str
    rank: int  # 0-based rank among the non-null values of the column
    lo: float = 0.0
    hi: float = 0.0
    value: float | None = None


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """n (non-null), min, max per column in one job."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def order_statistics(
    df: DataFrame,
    wanted: dict[str, list[int]],
    stats: dict[str, tuple[int, float, float]] | None = None,
    bins: int = DEFAULT_BINS,
) -> dict[str, dict[int, float]]:
    """Exact k-th smallest non-null value (0-based k) for each column → ranks.

    Values are compared as doubles (exact for integers below 2**53).
    """
    stats = stats or column_stats(df, list(wanted))
    targets: list[_Target] = []
    for c, ranks in wanted.items():
        n, lo, hi = stats[c]
        for k in sorted(set(ranks)):
            if not 0 <= k < n:
                raise ValueError(f"rank {k} out of range for {c!r} with {n} values")
            t = _Target(c, k, lo, hi)
            if lo == hi:
                t.value = lo
            targets.append(t)

    for _ in range(MAX_ROUNDS):
        active = [(i, t) for i, t in enumerate(targets) if t.value is None]
        if not active:
            break
        # Targets with the same column and range (all of a column's targets
        # in the first round; later, any that fell into the same bin) share
        # one histogram, so a row is emitted once per distinct range.
        ranges: dict[tuple[str, float, float], int] = {}
        for _, t in active:
            ranges.setdefault((t.column, t.lo, t.hi), len(ranges))
        # One SQL expression for all ranges (a single parse on the JVM side
        # instead of hundreds of Column calls): for each range holding x, a
        # struct (range, bin, x).
        entries = []
        for (col, rlo, rhi), j in ranges.items():
            x = f"CAST(`{col}` AS DOUBLE)"
            lo, hi = _dlit(rlo), _dlit(rhi)
            if math.isfinite(rhi - rlo):
                b = (f"least(CAST(floor(({x} - {lo}) / {_dlit(rhi - rlo)} * {bins}) AS INT), "
                     f"{bins - 1})")
            else:  # a range wider than the largest double: bin on halves
                b = (f"least(CAST(floor(({x} / 2 - {_dlit(rlo / 2)}) / "
                     f"{_dlit(rhi / 2 - rlo / 2)} * {bins}) AS INT), {bins - 1})")
            entries.append(
                f"CASE WHEN {x} >= {lo} AND {x} <= {hi} "
                f"THEN named_struct('t', {j}, 'b', {b}, 'x', {x}) END"
            )
        arr = F.expr(f"filter(array({', '.join(entries)}), s -> s IS NOT NULL)")
        hist = (
            df.select(F.explode(arr).alias("s"))
            .groupBy(F.col("s.t").alias("t"), F.col("s.b").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi"))
            .collect()
        )
        per_range: dict[int, list] = {}
        for r in hist:
            per_range.setdefault(r["t"], []).append(r)
        for j in per_range:
            per_range[j].sort(key=lambda r: r["b"])
        for _, t in active:
            seen = 0
            for r in per_range.get(ranges[(t.column, t.lo, t.hi)], []):
                if seen + r["n"] > t.rank:
                    t.rank -= seen
                    t.lo, t.hi = r["lo"], r["hi"]
                    if t.lo == t.hi:
                        t.value = t.lo
                    break
                seen += r["n"]
            else:  # pragma: no cover - counts always cover the rank
                raise RuntimeError("order statistic lost its bin")
    if any(t.value is None for t in targets):  # pragma: no cover - defensive
        raise RuntimeError("order statistics did not converge")
    # Targets were appended column by column, ranks ascending.
    out: dict[str, dict[int, float]] = {}
    idx = 0
    for c, ranks in wanted.items():
        out[c] = {}
        for k in sorted(set(ranks)):
            out[c][k] = targets[idx].value
            idx += 1
    return out


def _dlit(v: float) -> str:
    """A double literal for Spark SQL that parses back to exactly ``v``."""
    if not math.isfinite(v):
        raise ValueError(f"non-finite value {v!r}")
    return f"{float(v)!r}D"


def _linear_ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = math.floor(h)
    return lo, min(math.ceil(h), n - 1), h - lo


def nearest_rank(n: int, p: float) -> int:
    """Rank of the 'nearest' quantile: round((n−1)·p), halves away from zero."""
    return int(math.floor((n - 1) * p + 0.5))


def quantiles(
    df: DataFrame,
    probs: dict[str, list[float]],
    method: str = "linear",
    approx_accuracy: int | None = None,
    stats: dict[str, tuple[int, float, float]] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles per column.

    ``linear``: v[⌊h⌋] + (h − ⌊h⌋)·(v[⌈h⌉] − v[⌊h⌋]), h = (n−1)·p.
    ``nearest``: v[round(h)].
    ``approx_accuracy`` switches to ``percentile_approx`` (one job, relative
    rank error 1/accuracy) for inputs where exactness is not needed.
    ``stats`` may carry a ``column_stats`` result computed earlier.
    """
    if approx_accuracy:
        row = df.agg(
            *[
                F.percentile_approx(F.col(c).cast("double"), ps, approx_accuracy).alias(c)
                for c, ps in probs.items()
            ]
        ).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(ps)
                for c, ps in probs.items()}
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    linear, nearest = both_quantiles(df, probs, stats)
    return linear if method == "linear" else nearest


def both_quantiles(
    df: DataFrame,
    probs: dict[str, list[float]],
    stats: dict[str, tuple[int, float, float]] | None = None,
) -> tuple[dict[str, list[float | None]], dict[str, list[float | None]]]:
    """Exact quantiles per column by interpolation and by nearest rank, in the
    same rounds: the nearest rank is one of the two that interpolation needs."""
    if stats is None or any(c not in stats for c in probs):
        stats = column_stats(df, list(probs))
    wanted: dict[str, list[int]] = {
        c: [k for p in ps for k in _linear_ranks(stats[c][0], p)[:2]]
        for c, ps in probs.items()
        if stats[c][0]
    }
    values = order_statistics(df, wanted, stats) if wanted else {}
    linear: dict[str, list[float | None]] = {}
    nearest: dict[str, list[float | None]] = {}
    for c, ps in probs.items():
        linear[c], nearest[c] = [], []
        for p in ps:
            if c not in values:
                linear[c].append(None)
                nearest[c].append(None)
                continue
            v, n = values[c], stats[c][0]
            lo, hi, d = _linear_ranks(n, p)
            linear[c].append(v[lo] if lo == hi else v[lo] + (v[hi] - v[lo]) * d)
            nearest[c].append(v[nearest_rank(n, p)])
    return linear, nearest


def quartile_score(col: str | Column, breaks: list[float | None]) -> Column:
    """Value-based quartile bin 1..4 with right-closed bins:
    (−∞,q1] → 1, (q1,q2] → 2, (q2,q3] → 3, (q3,∞) → 4.

    Equal values always share a bin (``ntile`` would split them); tied
    breakpoints collapse bins downward instead of failing.
    """
    x = F.col(col) if isinstance(col, str) else col
    if any(b is None for b in breaks):
        return F.lit(None).cast("int")
    score = F.lit(1)
    for b in breaks:
        score = score + F.when(x > F.lit(float(b)), 1).otherwise(0)
    return F.when(x.isNull(), F.lit(None)).otherwise(score).cast("int")
