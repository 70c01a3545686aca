"""Hash-tree shards: balance, movement, slots, awkward rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shelfwise.llm.sharding import assign_shards, grown, tree


def test_growth_moves_rows_into_the_new_shard_only(make_docs):
    root = tree(40)
    got = assign_shards(make_docs(["t"] * 4000), root, grown(root, 40), rows_per_bucket=500).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) < 2.2 * 100
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {40} and 40 <= len(moved) <= 180
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_draw_rows_and_confine_movement(make_docs):
    docs = make_docs([""] * 6000)
    even = {r.doc_id: r.shard for r in assign_shards(docs, tree(20)).collect()}
    heavy = {r.doc_id: r.shard for r in assign_shards(docs, tree(20, weights={3: 3.0})).collect()}
    share = Counter(heavy.values())[3] / 6000
    assert abs(share - 3 / 22) < 0.02
    # Region 0 gains weight: nothing moves between shards of the other region,
    # nothing leaves region 0, and rack 1 gives to rack 0 only.
    moves = {(a, b) for a, b in ((even[i], heavy[i]) for i in even) if a != b}
    assert moves and all(b < 10 for _, b in moves)
    assert not any(5 <= a < 10 and 5 <= b < 10 for a, b in moves)


def test_sizes_and_awkward_rows(awkward):
    root = tree(40)
    got = assign_shards(awkward, root, grown(root, 40)).collect()
    text = {0: "", 1: "", 2: " \n\t", 3: "one two", 5: "a b c d e f g", None: "a b c d e f g", 7: "x " * 50_000}
    assert len(got) == 8
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    three = [r for r in got if r.doc_id == 3]
    assert len(three) == 2 and three[0].shard == three[1].shard and three[0].slot != three[1].slot


def test_a_hot_key_and_empty(make_docs):
    got = assign_shards(make_docs(["a"] * 3000, [1] * 2000 + list(range(1000))), tree(4), rows_per_bucket=100)
    by = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in by.collect())
    assert assign_shards(make_docs([]), tree(40)).count() == 0


def test_the_descent_is_recomputed_in_plain_python(make_docs):
    def drawn(key, node):
        bits = int(hashlib.md5(f"{key}/{node.name}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / node.weight

    def descend(key, node):
        while node.shard is None:
            node = min(node.children, key=lambda c: drawn(key, c))
        return node.shard

    root = tree(37, weights={3: 3.0, 17: 0.25})
    more = grown(root, 37, weight=2.0)
    ids = [*range(-50, 1500), 2**60, None]
    got = assign_shards(make_docs(["t"] * len(ids), ids), root, more).collect()
    want = {i: (descend("null" if i is None else i, root), descend("null" if i is None else i, more)) for i in ids}
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == want
