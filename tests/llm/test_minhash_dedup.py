"""Near-duplicates against all pairs, groups, chains and awkward rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwise.llm.components import components
from shelfwise.llm.minhash_dedup import keep_one_of_each, near_duplicates, shingle_set, signature


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(texts: dict[int, str], percent: int) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    by_shingle = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in by_shingle[s])
        for s in sets[i]:
            by_shingle[s].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_all_pairs_on_the_test_table(make_docs, given, percent):
    texts = {r[0]: r[1] for r in given["documents"]}
    docs = make_docs(list(texts.values()), list(texts))
    got = {r.doc_id: r for r in near_duplicates(docs, percent).collect()}
    want = brute_force(texts, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) for i, r in got.items())
    assert all(r.n_shingles == len(shingles(texts[i])) for i, r in got.items())


def test_large_group_of_near_copies_and_a_chain(make_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(120):  # one to four words changed: near the threshold among themselves
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(150)] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(400)]
    for k in range(12):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain[12 * k : 12 * k + 200]))
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r.doc_id: r.component_id for r in near_duplicates(make_docs(texts, ids), 85).collect()}
    assert got == brute_force(dict(zip(ids, texts, strict=True)), 85)


def test_awkward_rows(awkward):
    rows = near_duplicates(awkward, 85).collect()
    assert len(rows) == 8
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert got[(0, 0)] == (0, True) and got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True)
    assert got[(3, 1)] == (3, True)  # both rows of id 3
    assert got[(5, 3)] == (5, True)
    assert got[(None, 3)] == (None, True)  # a null id is not linked
    assert got[(7, 1)] == (7, True)


def test_fewer_than_five_words_link_only_when_equal(make_docs):
    rows = near_duplicates(make_docs(["a b c", "A  b c", "a b", "É b c", "é b c"]), 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_keep_one_of_each_keeps_columns(awkward, make_docs):
    kept = keep_one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == 8
    same = keep_one_of_each(make_docs(["p q r s t u v"] * 50, clash=True))
    assert [r.doc_id for r in same.collect()] == [0]


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = (signature(a, 2000) == signature(b, 2000)).mean()
    assert abs(agree - alike) < 0.06


def test_shingle_set_ignores_ascii_case_and_white_space_only():
    assert (shingle_set("A b\tc\x0bd  e f") == shingle_set("a B c d e F")).all()
    assert len(shingle_set("a b c d e f")) == 1  # a no-break space is part of a word


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 7 for i in [7, *range(1000, 1200)])
    assert 5 not in got and 3 not in got
