"""Exact distributed order statistics against a local sort."""

from __future__ import annotations

import numpy as np
import pytest

from shelfwise.functions.stats import nearest_rank, order_statistics, quantiles, quartile_score


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([
        rng.lognormal(3, 2, 3000),        # long tail
        np.full(2000, 42.5),              # one value holding 40 % of the rows
        rng.integers(0, 5, 1000).astype(float),
    ])
    rng.shuffle(x)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    return x, df.cache()


def test_order_statistics_exact(values):
    x, df = values
    s = np.sort(x)
    ks = [0, 1, 999, 2500, 3000, 4999, 5999]
    got = order_statistics(df, {"x": ks}, bins=64)["x"]
    assert [got[k] for k in ks] == [s[k] for k in ks]


def test_linear_quantiles_match_numpy(values):
    x, df = values
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    got = quantiles(df, {"x": probs})["x"]
    want = np.quantile(x, probs, method="linear")
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_nearest_quantile_rule(values):
    x, df = values
    s = np.sort(x)
    got = quantiles(df, {"x": [0.75, 0.5]}, method="nearest")["x"]
    assert got == [s[nearest_rank(len(x), 0.75)], s[nearest_rank(len(x), 0.5)]]
    assert nearest_rank(5, 0.5) == 2 and nearest_rank(4, 0.5) == 2  # 1.5 rounds up


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([], "x double")
    assert quantiles(df, {"x": [0.5]})["x"] == [None]


def test_quartile_score_ties_share_a_bin(spark):
    # Five customers, four with equal frequency: equal values share a bin.
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (4, 3), (5, 9)], "id int, f long")
    q = quantiles(df, {"f": [0.25, 0.5, 0.75]})["f"]
    assert q == [3.0, 3.0, 3.0]
    scores = dict(df.select("id", quartile_score("f", q).alias("s")).collect())
    assert scores == {1: 1, 2: 1, 3: 1, 4: 1, 5: 4}


def test_extreme_range(spark):
    vals = [-1.5e308, -1.0, 0.0, 2.0, 1.7e308]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = order_statistics(df, {"x": [0, 1, 2, 3, 4]})["x"]
    assert [got[k] for k in range(5)] == vals
