"""Statistics against plain Python, learned lists, base rule, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from shelfwise.llm.quality_rules import (
    Condition,
    DecisionList,
    judge,
    kept_documents,
    learn_rules,
    quality_report,
    with_statistics,
)

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LABELS = "doc_id long, quality int, toxic int"


def by_hand(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {
        i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(repeated),
    )


def test_statistics_equal_plain_python(make_docs, given):
    rng = random.Random(5)
    texts = [r[1] for r in given["documents"]]
    texts += ["".join(rng.choice("ab \n\té#| ") for _ in range(rng.randint(0, 120))) for _ in range(200)]
    texts += ["a b c d e " * 3, "a a a a a a", "x\n\n x\nx\n", None, "", "q " * 30_000]
    got = {r.doc_id: r for r in with_statistics(make_docs(texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COLUMNS) == by_hand(t), repr((t or "")[:80])


@pytest.fixture(scope="module")
def report(spark, given):
    from tests.llm.conftest import DOCS

    docs = spark.createDataFrame(given["documents"], DOCS)
    return {r.doc_id: r for r in quality_report(docs, spark.createDataFrame(given["labels"], LABELS)).collect()}


def test_report_keeps_good_and_rejects_bad(report, given):
    label = {i: q for i, q, _ in given["labels"]}
    judged = [(label[i], r) for i, r in report.items() if i in label and not r.base_failed]
    good = [r.kept for q, r in judged if q == 1]
    assert sum(good) >= 0.97 * len(good)
    for r in report.values():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_sequential_covering_finds_planted_thresholds(spark, make_docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 60))]
        kind = rng.choice(["good", "good", "good", "symbols", "shout"])
        if kind == "symbols":
            words = [w + "###" for w in words]
        if kind == "shout":
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(kind == "good"), 0))
    labels += [(0, 1, 0), (None, 0, 0), (5, None, 0), (9999, 0, 1)]  # repeated, null, unknown
    stats = with_statistics(make_docs(texts), ["doc_id"])
    rules = learn_rules(stats, spark.createDataFrame(labels, LABELS))
    assert 1 <= len(rules.rules) <= 4 and "else good" in str(rules)
    truth = {i: q for i, q, _ in labels[:600]}
    got = {r.doc_id: r.kept for r in judge(stats, rules).collect()}
    assert sum(got[i] == bool(truth[i]) for i in truth) >= 0.99 * len(truth)


def test_rules_apply_in_order(make_docs):
    rules = DecisionList(
        [(Condition("symbols_per_word", True, 0.5),), (Condition("n_words", True, 11.0), Condition("n_words", False, 13.0))]
    )
    texts = ["# # # a b c d e f g h i", "a b c d e f g h i j k l", "a b c d e f g h i j k l m n"]
    got = judge(with_statistics(make_docs(texts), ["doc_id"]), rules)
    # 3 symbols in 12 words do not fire the first rule; twelve words fire the second.
    assert [r.rule for r in got.orderBy("doc_id").collect()] == [2, 2, 0]


def test_without_labels_or_one_class(spark, make_docs):
    docs = make_docs(["a b c d e f g h i j k", "short", None])
    stats = with_statistics(docs, ["doc_id"])
    for rows in ([], [(0, 1, 0)], [(0, 0, 0)]):
        got = judge(stats, learn_rules(stats, spark.createDataFrame(rows, LABELS)))
        assert [r.kept for r in got.orderBy("doc_id").collect()] == [True, False, False]
    assert quality_report(make_docs([]), spark.createDataFrame([], LABELS)).count() == 0


def test_kept_documents_keeps_columns(awkward, make_docs):
    kept = kept_documents(awkward, DecisionList())
    assert kept.columns == awkward.columns and kept.count() == 0
    fine = make_docs(["a b c d e f g h i j k"] * 3, [1, None, 1], clash=True)
    assert kept_documents(fine, DecisionList()).count() == 3
