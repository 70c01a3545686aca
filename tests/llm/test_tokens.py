"""Token ids, the digest cache, and packing."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import token_counts as TC
from shelfwise.llm.packing import OpenBins, cut, pack_documents
from shelfwise.llm.token_counts import count_tokens
from shelfwise.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b ", "a b ", "日本語 テキスト a", "x<|endoftext|> y", "foo\n\n bar baz  q", "'s 're don't",
    "\u0085 a b", "é" * 70 + " " + "a" * 200, " \n", "ʼn ʻ x", "1 2 3 ½ ²", " em  nb", "😀 ok", "𝟘 ༠ ௧",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library, given):
    rng = random.Random(0)
    texts = ODD + [r[1] for r in given["documents"]]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x2FF), 32, 10, rng.randrange(0x370, 0xD7FF)])) for _ in range(60)) for _ in range(300)]
    encoder = Encoder.of(PATH)
    assert encoder._fast is not None
    for t in texts:
        assert encoder.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_other_tokenizer_files_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert Encoder.of(path)._fast is None
    want = Tokenizer.from_file(path).encode("Some Words here", add_special_tokens=False).ids
    assert Encoder.of(path).ids("Some Words here").tolist() == want


def test_counts_and_awkward_rows(library, awkward, make_docs):
    got = count_tokens(awkward, PATH).collect()
    assert len(got) == 8
    by = {(r.doc_id): r for r in got}
    assert (by[0].n_bytes, by[0].n_tokens, by[0].over_limit) == (0, 0, False)
    n = len(library.encode("x " * 50_000, add_special_tokens=False).ids)
    assert (by[7].n_tokens, by[7].over_limit) == (n, True)
    texts = [*ODD, None]
    for r in count_tokens(make_docs(texts), PATH).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
    assert count_tokens(make_docs([]), PATH).count() == 0


def test_only_distinct_misses_are_encoded_and_appended(spark, make_docs, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    first = count_tokens(make_docs(["a b", "a b", "c"]), PATH, cache)
    assert first.count() == 3 and spark.read.parquet(cache).count() == 2
    # A stored count is believed, not encoded again.
    stored = spark.read.parquet(cache).toPandas()
    assert len(stored.tokenizer.unique()) == 1
    again = count_tokens(make_docs(["c", "d e f", "c"]), PATH, cache)
    assert sorted(r.n_tokens for r in again.collect()) == [1, 1, 3]
    assert spark.read.parquet(cache).count() == 3
    monkeypatch.setattr(TC, "tokenizer_digest", lambda path: "another version")
    count_tokens(make_docs(["c"]), PATH, cache)
    assert spark.read.parquet(cache).count() == 4


def test_packing_is_exact(library, awkward, given, make_docs):
    texts = [r[1] for r in given["documents"]] + ["word " * 5000, "word " * 2047, "", None, *ODD]
    rows = pack_documents(make_docs(texts), PATH, pieces_per_task=100).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(texts)))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        ps = sorted(pieces[i], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert [(p.start, p.length) for p in ps] == list(cut(len(ids), 2048))
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in ps)
        assert all(p.length == 2048 for p in ps[1:])
    for b in bins.values():
        at = 0
        for p in sorted(b, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 6
    assert len(pack_documents(awkward, PATH).collect()) >= 8
    assert pack_documents(make_docs([]), PATH).count() == 0


def test_best_fit_and_the_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(3) == (1, 7)  # the fuller of the two that fit, now full
    assert bins.place(9) == (2, 0)
    assert bins.place(5) == (3, 0)  # two are open: bin 2, the fullest, closes
    assert bins.place(1) == (0, 6)  # bin 2 is gone, bin 0 is the fuller one left
    assert list(cut(5, 4)) == [(0, 1), (1, 4)] and list(cut(8, 4)) == [(0, 4), (4, 4)] and list(cut(3, 4)) == [(0, 3)]


def test_no_bin_closes_before_the_small_pieces_come(make_docs):
    # 400 long pieces come first, more than may be open; 400 short ones fill them.
    docs = make_docs(["word " * 59] * 400 + ["word " * 35] * 400)
    rows = pack_documents(docs, PATH, capacity=100, max_open=64).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 800
    assert len({r.sequence_id for r in rows}) <= 1.1 * -(-total // 100)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n"])
def test_very_long_runs_of_blanks(library, make_docs, blank):
    texts = [blank * 2_000_000, "a@b.c 12" + blank * 1_000_000 + "+3 end"]
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    docs = make_docs(texts)
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()} == {
        i: len(ids) - 1 for i, ids in enumerate(want)
    }
    for r in pack_documents(docs, PATH).collect():
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())


def test_repeated_rows_are_spread_and_encoded_once(spark, tmp_path):
    from pyspark.sql import functions as F

    same = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("again and again").alias("text")
    )
    cache = str(tmp_path / "cache")
    counted = count_tokens(same, PATH, cache)
    assert counted.groupBy("n_tokens").count().collect()[0]["count"] == 200_000
    assert spark.read.parquet(cache).count() == 1  # each encoded text is one appended row
    packed = pack_documents(same, PATH, pieces_per_task=10_000)
    tasks = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 40).alias("task")).count().collect()]
    assert sum(tasks) == 200_000 and len(tasks) >= 15 and max(tasks) <= 2 * 200_000 / len(tasks)
