"""Merkle fingerprints against plain Python, and where edits are found."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import fingerprints as P


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(text):
    """(root, sections of paragraphs of (hash, length)) by the documented cuts."""
    sections = [
        [re.findall(r"(?s).{64,255}?[.!?][\x20\x09-\x0D]{1,16}|.{1,256}", p) for p in re.split(r"(?<=\n)(?!\n|\Z)", s)]
        for s in re.split(r"(?<=\n\n)(?!\n|\Z)", text or "")
    ]
    assert "".join(leaf for s in sections for p in s for leaf in p) == (text or "")
    up = lambda nodes: sha("".join(nodes))
    root = up(up(up(sha(leaf) for leaf in p) for p in s) for s in sections)
    long = lambda t: ((xxhash.xxh64_intdigest(t.encode(), seed=42) << 12) | len(t)) & (2**64 - 1)
    return root, [[[long(leaf) for leaf in p] for p in s] for s in sections]


def plain_text(tree):
    root, sections = tree
    return f"{root}:" + "/".join(",".join(".".join(f"{x:016x}" for x in p) for p in s) for s in sections)


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    x, y = (Counter(leaf for s in t[1] for p in s for leaf in p) for t in (a, b))
    total = sum((leaf & 4095) * n for c in (x, y) for leaf, n in c.items())
    both = 2 * sum((leaf & 4095) * n for leaf, n in (x & y).items())
    return min(both, total - 1) / total if total else 1.0


def plain_edits(rows):
    """rows (id, text) -> (id, n, edited sha, fingerprints, near_edited, near_next), as a Counter."""
    rows = sorted(
        ((i, t or "") for i, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()),
    )
    out = Counter()
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, new, following = plain_tree(text), plain_tree(edited), plain_tree(after)
        out[
            i, len(text), sha(edited), plain_text(own), plain_text(new),
            round(plain_likeness(own, new), 12), round(plain_likeness(own, following), 12),
        ] += 1
    return out


def found(df):
    return Counter(
        (
            r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
            round(r.near_edited, 12), round(r.near_next, 12),
        )
        for r in df.collect()
    )


TEXTS = [
    None, "", "", "short", "One. Two. " * 40, "para one.\n\npara two.\n\n\n\npara three is last.\n", "\n\n\n",
    "a line.\n" * 60, "É 日本\U0001f600 " * 90, "no end " * 300, " " * 3_000, "12@x.y " * 2_000 + "\n" * 500,
]


def test_equals_plain_python(spark, make_docs, given):
    rows = [(r[0], r[1]) for r in given["documents"]]
    rows += [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(3, "same id, other text. " * 9), (3, "same id, other text. " * 9), (None, "null id"), (None, None)]
    ids, texts = zip(*rows, strict=True)
    docs = make_docs(list(texts), list(ids), clash=True)
    assert found(P.edits_by_next(docs)) == plain_edits(rows)


@pytest.mark.parametrize("rows", [[(1, "alone in the table. " * 20)], [(1, "twice. " * 50)] * 3, [(5, None)]])
def test_single_documents(spark, make_docs, rows):
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    assert found(P.edits_by_next(docs)) == plain_edits(rows)


def test_many_repeated_rows(spark, make_docs):
    text = "Repeated. " * 30
    rows = [(7, text)] * 9_000 + [(8, "another text. " * 20), (6, "first text. " * 20)]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows]).repartition(8)
    assert found(P.edits_by_next(docs)) == plain_edits(rows)


def test_very_long_text(spark, make_docs):
    rng = random.Random(2)
    long = "".join(rng.choice(["word ", "and. ", "x\n", "1@ "]) for _ in range(300_000)) + "same.\n" * 50_000
    rows = [(1, long), (2, " " * 500_000), (3, "end")]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    assert found(P.edits_by_next(docs)) == plain_edits(rows)


def test_roots_and_changed_branches(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefgh ", k=90)) + ".\n" for _ in range(40)]
    whole = "".join(lines)
    changed = "".join(lines[:20] + ["another line here.\n"] + lines[21:])
    moved = "".join(lines[1:] + lines[:1])
    rows = [(whole, whole), (whole, changed), (whole, moved), (whole, ""), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", P.fingerprint(F.col("a")).alias("x"), P.fingerprint(F.col("b")).alias("y")
    )
    out = df.select(
        (F.col("x.root") == F.col("y.root")).alias("equal"),
        P.likeness(F.col("x"), F.col("y")).alias("near"),
        P.changed_span(F.col("x"), F.col("y")).alias("span"),
    ).collect()
    assert [r.equal for r in out] == [True, False, False, False, True]
    assert out[0].near == out[4].near == 1.0 and out[0].span is None and out[4].span is None
    at = sum(map(len, lines[:20]))
    assert tuple(out[1].span) == (at, at + len(lines[20])) and 0.95 < out[1].near < 1
    assert 0.99 < out[2].near < 1 and out[3].near == 0 and tuple(out[3].span) == (0, len(whole))


def test_no_python_on_the_main_path(spark, make_docs):
    plan = P.edits_by_next(make_docs(["a b c", "d"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, make_docs):
    assert P.edits_by_next(make_docs([])).collect() == []
