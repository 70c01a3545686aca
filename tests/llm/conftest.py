"""Small document tables with the awkward cases that every operator meets."""

from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that clash with names the operators use inside.
CLASHING = "id, key, n, text_hash, items, kept, rep, digest, size, label, y, _id, _gone, _d0"


def tables(name: str) -> list[tuple]:
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="session")
def given():
    """Rows of sf0.001 as Python tuples: documents, labels, benchmark, pages."""
    return {n: tables(n) for n in ("documents", "labels", "benchmark", "pages")}


@pytest.fixture
def make_docs(spark):
    def build(texts, ids=None, lang="en", clash=False):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, "s", None) for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c.strip(): F.lit("x") for c in CLASHING.split(",")})
        return df

    return build


@pytest.fixture
def awkward(make_docs):
    """Null and empty texts, ties, repeated rows, a null id, a very long text."""
    texts = [None, "", " \n\t", "one two", "one two", "a b c d e f g", "a b c d e f g", "x " * 50_000]
    return make_docs(texts, [0, 1, 2, 3, 3, 5, None, 7], clash=True)
