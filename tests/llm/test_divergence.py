"""Source divergence against plain Python and the SQL, and its run-length columns."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from shelfwise.llm import divergence as V


def plain(rows, min_docs, most=50):
    """rows (lang, source, text) -> the result as a set of tuples."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(V.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def p(of):
            total = sum(of[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (of[t] + 5) // total for t in kept}

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(q[t] - ps[s][t], t.encode()) for t in kept if counts[lang, s][t]]
            terms = sorted(x for x in terms if x[0] < 0)[:most]
            for part, found in (("pair", sorted(pairs)), ("term", terms)):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def corpus(given):
    rows = [(r[2], r[3], r[1]) for r in given["documents"]]
    rows += [
        (None, None, None), (None, "a", "x"), ("", "", "Y y"), ("zz", "only", "one one 日本 one"),
        ("aa", "p", "Straße ÀB kelvinK İx tie Tie"), ("aa", "q", "tie b"), ("aa", "q", "tie b"),
        ("aa", "é", ""), ("aa", "z", "12 @@ \n\t"), ("aa", "p", "long Word " * 30_000 + "@9" * 1000),
        ("\x00l", "\x00s", "nul\x00byte"),
    ]
    return rows


@pytest.mark.parametrize("min_docs", [2, 30])
def test_equals_plain_python(spark, corpus, min_docs, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 64 * 5)  # several blocks a language
    monkeypatch.setattr(V, "SLICE", 3)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, "lang string, source string, text string").withColumns(
        {c: F.lit("x") for c in ("term", "n", "rank", "total", "block", "at", "p", "part", "item", "value")}
    )
    found = rows_of(V.audit_sources(df, min_docs))
    assert found == plain(corpus, min_docs)


def test_sql(spark, corpus, tmp_path):
    rows = [r for r in corpus if "\x00" not in (r[0] or "")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    for min_docs in (2, 30):
        found = rows_of(V.audit_sources(spark.read.parquet(path), min_docs))
        assert found == set(con.execute(V.oracle_sql(min_docs)).fetchall())


def test_flushed_counts_are_whole(spark, given, monkeypatch):
    import pyarrow as pa

    rows = [(r[2] or "", r[3] or "", r[1] or "") for r in given["documents"][:80]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows]) for i in range(3)], ["lang", "source", "text"]
    )
    sums = []
    for held in (V.KEPT_COUNTS, 10):
        monkeypatch.setattr(V, "KEPT_COUNTS", held)
        total = Counter()
        for out in V.count_terms(iter([batch])):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in out.columns), strict=True):
                total[lang, source, term, "n"] += n
                total[lang, source, term, "docs"] += docs
        sums.append(total)
    assert sums[0] == sums[1]


def test_runs_and_distance():
    rng = np.random.default_rng(4)
    for _ in range(100):
        length = int(rng.integers(1, 60))
        columns, dense = [], []
        for _ in range(2):
            at = np.flatnonzero(rng.random(length) < 0.5)
            p = rng.integers(1, 4, len(at))
            zero = int(rng.integers(0, 3))
            whole = np.full(length, zero)
            whole[at] = p
            dense.append(whole)
            columns.append(V.runs(at, p, zero, length))
            ends, values = columns[-1]
            assert ends[-1] == length and (np.diff(values) != 0).all()
        assert V.distance(*columns) == int(np.abs(dense[0] - dense[1]).sum())


def test_counts_beyond_a_long_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 9_000_000_000_123, 40_000_000_000_001, 77
    row = spark.range(1).select(V._p(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_empty_table(spark):
    assert V.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
