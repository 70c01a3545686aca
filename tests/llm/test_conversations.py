"""Conversation repair against exhaustive edits, a plain search and the damage rule."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shelfwise.llm import conversations as V
from shelfwise.llm.conversations import Repair, Weights, damage, repair_conversations
from shelfwise.llm.queries import op11_conversation_repair

COLUMNS = "conv_id long, turn long, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
VALID = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\f\r"


def damaged(rows):
    """The damage rule in plain Python: rows (conv, turn, role, text)."""
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        yield row
        if kind == 3:
            yield row


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.strip(BLANK)
        if not core:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif core[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def cheapest(rows, faults, insert=5):
    """(cost, audit, repaired lines) by trying every edit of every row and up to
    two inserts in each place."""
    inserts = [()] + [tuple(p) for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n)]
    per_row = []
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        stays = 5 if fault == "truncated" else 0
        choices = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            choices += [(stays, "K", (role, text))] + [(1 + stays, "R", (r, text)) for r in ("user", "assistant")]
        per_row.append(choices)
    best = None
    for edits in itertools.product(*per_row):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                cost += insert * len(added[k])
                audit += "I" * len(added[k])
                lines += [(r, "") for r in added[k]]
                if k < len(rows):
                    cost += edits[k][0]
                    audit += edits[k][1]
                    lines += [edits[k][2]] if edits[k][2] else []
            if VALID.fullmatch("".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def tuple_search(rows, faults, insert=5):
    """The same minimum over (cost, audit) pairs, for longer conversations."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    after = [(0, ""), (2 * insert, "II"), (insert, "I"), (0, "")]
    for (_, _, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        stays = 5 if fault == "truncated" else 0
        now = []
        for s in range(4):
            found = [(after[s][0] + 2, "D" + after[s][1])]
            if fault not in ("blank", "duplicate"):
                for initial, to in steps[s].items():
                    if initial != "s":
                        found.append((after[to][0] + 1 + stays, "R" + after[to][1]))
                    if initial == role[:1]:
                        found.append((after[to][0] + stays, "K" + after[to][1]))
            now.append(min(found))
        for _ in range(3):
            now = [
                min([now[s]] + [(now[t][0] + insert, "I" + now[t][1]) for i, t in steps[s].items() if i != "s"])
                for s in range(4)
            ]
        after = now
    return tuple(after[0])


def expected(rows, search):
    by_conv = {r[0]: [] for r in rows}
    for row in damaged(rows):
        by_conv[row[0]].append(row)
    out = {}
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults = faults_of(kept)
        turns = {r[1] for r in kept if r[1] is not None}
        pairs = zip(kept, kept[1:])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs),
            *search(kept, faults),
        )
    return out


def brute(kept, faults):
    cost, audit, lines = cheapest(kept, faults)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def result(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.fixture(scope="module")
def short_rows():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Hello.", "Cut off", "", None, " \n", "Why?\n", "Ünï!", "Hello.", "a:b\nc."]
    rows = []
    for conv in [None, *range(90)]:
        for _ in range(rng.randint(1, 3)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_equals_every_possible_edit(spark, short_rows):
    df = spark.createDataFrame(short_rows, COLUMNS)
    from pyspark.sql import functions as F

    clash = df.withColumns({c: F.lit("x") for c in ("dropped_", "n", "digest", "fault", "audit", "cost")})
    found = result(repair_conversations(damage(clash)))
    assert found == expected(short_rows, brute)
    assert set("".join(v[6] for v in found.values())) == set("DKR")  # a deletion is cheaper than an insert
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in found.values())


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_give_the_minimum_of_the_whole(block):
    rng = random.Random(block)
    for _ in range(150):
        n = rng.randint(0, 40)
        rows = [(0, i, rng.choice(["system", "user", "assistant", "assistant", "tool"]), "") for i in range(n)]
        faults = [rng.choice([None, None, None, "blank", "duplicate", "truncated"]) for _ in rows]
        assert weighed(rows, faults, block) == tuple_search(rows, faults)


def weighed(rows, faults, block):
    weights = Weights(block)
    for (_, _, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        weights.add(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    return weights.result()


@pytest.mark.parametrize("block", [1, 2, 64])
def test_cheap_inserts(block, monkeypatch):
    """With inserts at 1 they appear, among the weights and in the repaired text."""
    monkeypatch.setattr(V, "INSERT", 1)
    monkeypatch.setattr(V, "CLOSING", ((0, ""), (2, "II"), (1, "I"), (0, "")))
    rng, audits = random.Random(9), ""
    for case in range(60):
        n = rng.randint(1, 3 if case < 12 else 30)
        rows = [(0, i, rng.choice(["system", "user", "assistant", "tool"]), f"t{i}") for i in range(n)]
        faults = [rng.choice([None, None, "blank", "truncated"]) for _ in rows]
        cost, audit = weighed(rows, faults, block)
        assert (cost, audit) == tuple_search(rows, faults, insert=1)
        audits += audit
        if n <= 3:
            want = cheapest(rows, faults, insert=1)
            repair = Repair(audit)
            for _, _, role, text in rows:
                repair.row(role, text)
            lines = "\n".join(f"{r}:{t}" for r, t in want[2])
            assert (cost, audit) == want[:2] and repair.digest() == hashlib.sha256(lines.encode()).hexdigest()
    assert set(audits) == set("DIKR")


def test_a_conversation_with_a_third_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"row {rng.randint(0, 15_000)}.") for t in range(20_000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}. " + "x" * 50) for c in range(2, 4_002) for t in range(10)]
    rows += [(5_000, 0, "user", "long " * 200_000 + "."), (5_000, 1, "assistant", "12@ " * 100_000 + "?")]
    found = result(repair_conversations(spark.createDataFrame(rows, COLUMNS)))
    assert len(found) == 4_002
    hot = [(*r[:3], r[3]) for r in rows if r[0] == 1]
    faults = faults_of(hot)
    assert found[1][5:7] == tuple_search(hot, faults)
    assert found[1][2] == faults.count("duplicate")
    whole = "\n".join(f"{r}:{t}" for _, _, r, t in rows[-2:])
    assert found[5_000] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(whole.encode()).hexdigest())


def test_given_conversations(spark):
    from tests.llm.conftest import SF, tables

    rows = tables("conversations")
    found = result(op11_conversation_repair(spark, SF))
    want = expected(rows, tuple_search)
    assert {k: v[:7] for k, v in found.items()} == want


def test_empty_table(spark):
    assert repair_conversations(damage(spark.createDataFrame([], COLUMNS))).collect() == []
