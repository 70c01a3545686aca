"""Language profiles: held-out accuracy, distances by hand, awkward rows."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest

from shelfwise.llm.language_id import Profiles, identify, learn_profiles, n_grams, top


@pytest.fixture(scope="module")
def profiles(spark, given):
    from tests.llm.conftest import DOCS

    return learn_profiles(spark.createDataFrame(given["documents"], DOCS))


def test_held_out_accuracy(make_docs, given, profiles):
    truth = {r[0]: r[2] for r in given["documents"] if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    docs = make_docs([r[1] for r in given["documents"]], [r[0] for r in given["documents"]])
    got = {r.doc_id: r for r in identify(docs, profiles).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == lang for i, lang in truth.items()) >= 0.97 * len(truth)


def test_learns_from_rows_that_are_not_held_out_only(spark):
    from tests.llm.conftest import DOCS

    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    other = [i for i in range(60) if i not in held]
    rows = [(i, "zzz zzz", "hidden", "", 0) for i in held] + [(i, "aba bab", "shown", "", 0) for i in other]
    rows += [(None, "aba", "shown", "", 0), (100, "qqq", None, "", 0)]
    got = learn_profiles(spark.createDataFrame(rows, DOCS))
    assert set(got) == {"shown"}


def gram(s):
    n = 0
    for c in s:
        n = n << 21 | ord(c)
    return n


def test_n_grams_by_hand():
    text = "Ab, aB1"  # becomes " ab ab "
    s = " ab ab "
    want = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    del want[" "]
    grams, counts = n_grams(text)
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {gram(g): c for g, c in want.items()}
    assert top(grams, counts, 3).tolist() == [g for _, g in sorted((-c, gram(g)) for g, c in want.items())[:3]]


def test_out_of_place_distance_by_hand():
    model = Profiles({"x": [gram("b"), gram("a")], "y": [gram("a"), gram("b")]}, 10)
    # Own order of "a": a, " a", "a ", " a " (ties by code point): a stands at 1 in x, 0 in y.
    own = top(*n_grams("a"), 10).tolist()
    at = own.index(gram("a"))
    best = min(abs(1 - at), abs(0 - at)) + 10 * (len(own) - 1)
    lang, score = model.classify("a")
    assert lang == ("x" if abs(1 - at) < abs(at) else "y")
    assert score == pytest.approx(1 - best / (10 * len(own)))


def test_awkward_rows(awkward, profiles):
    got = identify(awkward, profiles).collect()
    assert len(got) == 8
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_nothing_to_learn_and_empty(make_docs):
    assert learn_profiles(make_docs([])) == {}
    assert [r.lang_pred for r in identify(make_docs(["abc"]), {}).collect()] == ["und"]
    assert identify(make_docs([]), {}).count() == 0


def test_equals_brute_force_on_the_test_table(spark, make_docs, given):
    from tests.llm.conftest import DOCS

    def counted(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not letters.strip(" "):
            return Counter()
        s = f" {' '.join(letters.split())} "
        found = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
        del found[" "]
        return found

    def ordered(counts, size):
        return sorted(counts, key=lambda g: (-counts[g], gram(g)))[:size]

    size, sums = 400, {}
    for doc_id, text, lang, *_ in given["documents"]:
        if lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            sums.setdefault(lang, Counter()).update(counted(text))
    ranks = {lang: {g: i for i, g in enumerate(ordered(c, size))} for lang, c in sums.items()}
    learned = learn_profiles(spark.createDataFrame(given["documents"], DOCS), size, rows_per_language=10**9)
    assert learned == {lang: [gram(g) for g in r] for lang, r in ranks.items()}

    def predicted(text):
        own = ordered(counted(text), size)
        if not own:
            return "und", 0.0
        apart = {x: sum(abs(r[g] - i) if g in r else size for i, g in enumerate(own)) for x, r in ranks.items()}
        best = min(sorted(apart), key=apart.get)
        return best, 1 - apart[best] / (size * len(own))

    texts = [r[1] for r in given["documents"]] + [None, "", "7 @ 7", "1" * 100_000, " \n" * 100_000, "a1@b " * 20_000]
    got = {r.doc_id: r for r in identify(make_docs(texts), learned, size).collect()}
    for i, text in enumerate(texts):
        lang, score = predicted(text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-12)
