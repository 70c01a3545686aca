"""The pipeline's stages on planted documents, and the registered names."""

from __future__ import annotations

import random
import re
import shutil

import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from shelfwise.llm.common import stage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, given):
    """A folder with documents (planted cases in front), labels and benchmark."""
    from tests.llm.conftest import DOCS, SF

    rng = random.Random(8)
    base = [r for r in given["documents"] if len(r[1].split()) > 60][:60]
    item = next(t for _, t in given["benchmark"] if len(t.split()) > 20)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijk", k=5)) for _ in range(n))
    near = prose(200)
    planted = [
        (10_000, near, "en", "p", 1),
        (10_001, near.replace(near.split()[100], "changed"), "en", "p", 1),
        (10_002, prose(60) + ". " + item + " " + prose(60), "en", "p", 1),
        (10_003, prose(40) + " mail someone@mail.example.com now " + prose(40), "en", "p", 1),
        (10_004, "too short", "en", "p", 1),
        (10_005, None, "en", "p", None),
        (10_006, prose(120), None, None, None),
    ]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(base + planted, DOCS).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", path / f"{name}.parquet")
    return str(path)


def test_stages_on_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {}
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "minhash_dedup", "decontamination", "personal_data", "best_fit_packing"]
    for name, apply in C.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(apply(spark, docs, folder), name)
        assert docs.columns == columns
        rows = docs.collect()
        texts[name] = {r.doc_id: r.text for r in rows}
        assert set(texts[name]) <= before
        if name == "personal_data":
            assert all(r.n_chars == len(r.text) for r in rows)
    kept = texts["quality_rules"]
    assert not {10_004, 10_005} & set(kept) and {10_000, 10_001, 10_002, 10_003, 10_006} <= set(kept)
    kept = texts["minhash_dedup"]
    assert 10_000 in kept and 10_001 not in kept and {10_002, 10_003, 10_006} <= set(kept)
    kept = texts["decontamination"]
    assert 10_002 not in kept and {10_000, 10_003, 10_006} <= set(kept)
    assert set(texts["personal_data"]) == set(kept)
    assert "someone" not in texts["personal_data"][10_003] and "<EMAIL>" in texts["personal_data"][10_003]
    assert texts["personal_data"][10_006] == kept[10_006]
    packed = C.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_every_operator_is_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert E.queries()["pipeline"] is C.run and C.ORACLE_SQL is None
