"""Compression scores: held-out separation, calibration, awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from shelfwise.llm.compression_quality import Model, Sizer, _fit, learn, marked, score_quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(500):
        words = rng.choices(vocabulary, k=rng.randint(40, 200))
        good = rng.random() < 0.7
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words), int(good)))
    return rows


def test_held_out_separation(spark, make_docs, labelled):
    docs = make_docs([t for _, t, _ in labelled], [i for i, _, _ in labelled])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in labelled] + [(None, 0, 0), (1, None, 0)], LABELS)
    model = learn(docs, labels, dictionary_bytes=64 * 1024)
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    held = [(got[i], q) for i, _, q in labelled if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.5) == bool(q) for s, q in held]) >= 0.95


def test_learns_from_rows_that_are_not_held_out_only(spark, make_docs):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in held], LABELS)
    model = learn(make_docs(["some text here"] * 60), labels)
    assert model.bad == model.good == b"" and model.slope == 0


def test_curve_follows_the_weights():
    x = np.array([-1.0, -0.5, 0.5, 1.0] * 50)
    y = (x > 0).astype(float)
    y[::7] = 1 - y[::7]
    slope, shift = _fit(x, y, np.ones(200))
    assert slope > 0 and Model(b"", b"", slope, shift).score(1.0) > 0.7 > 0.3 > Model(b"", b"", slope, shift).score(-1.0)
    assert _fit(x, y, np.where(y == 1, 9.0, 1.0))[1] > shift
    assert _fit(np.zeros(0), np.zeros(0), np.zeros(0)) == (0.0, 0.0)


def test_whole_text_counts_and_dittos():
    assert marked("he he he said") == "he 〃 〃 said".encode()
    sizer = Sizer(b"BAD TEXT!! " * 100, b"good words here " * 100)
    assert sizer.difference("good words here " * 40) > 0 > sizer.difference("BAD TEXT!! " * 40)
    tail = "good words here " * 500
    assert sizer.difference(tail + "BAD TEXT!! " * 500) < sizer.difference(tail)
    assert sizer.difference(None) == sizer.difference("") == 0.0


def test_awkward_rows(awkward, spark, make_docs):
    model = learn(awkward, spark.createDataFrame([(0, 1, 0), (3, 0, 0), (5, 1, 0), (5, 0, 0)], LABELS))
    got = score_quality(awkward, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    empty = learn(make_docs([]), spark.createDataFrame([], LABELS))
    assert score_quality(make_docs([]), empty).count() == 0
