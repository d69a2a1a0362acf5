"""Conversation repair against a plain search, with small chunks, few and many tasks, nulls, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from ledgerloom.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, piece string, copies long, last string"


def plain(rows):
    """What the contract says, conversation by conversation: the cheapest edits by a recursion over places and states."""
    damaged, order = {}, lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    found = {}
    for conv, kept in damaged.items():
        kept.sort(key=order)
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))

        def after(state, letter):
            return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(letter)

        @cache
        def best(i, state, inserted=0, kept=tuple(kept), faults=tuple(faults)):
            ways = [(0, "", ())] if i == len(kept) and state in ("", "a") else []
            forced = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[forced]
            if inserted < 3:
                cost, edits, out = best(i, forced, inserted + 1)
                ways.append((cost + 3, "I" + edits, (f"{role}:", *out)))
            if i < len(kept):
                _, own, text = kept[i]
                cost, edits, out = best(i + 1, state)
                ways.append((cost + 4, "D" + edits, out))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 if faults[i] == "truncated" else 0
                    cost, edits, out = best(i + 1, forced)
                    ways.append((cost + 3 + more, "R" + edits, (f"{role}:{text}", *out)))
                    if after(state, own[:1]):
                        cost, edits, out = best(i + 1, after(state, own[:1]))
                        ways.append((cost + more, "K" + edits, (f"{own}:{text}", *out)))
            return min(ways, default=(10**6, "", ()), key=lambda w: w[:2])

        for i in reversed(range(len(kept))):  # keeps the recursion flat
            for state in ("", "s", "u", "a"):
                best(i, state)
        cost, edits, out = best(0, "")
        turns = {t for t, *_ in kept if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )
    return found


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        long = conv in (7, 31)
        for turn in range(rng.randint(150, 260) if long else rng.randint(0, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice(["yes.", "no!", "so", " ", None, "one more. ", "\x0b", "a b c?", f"w{turn}", f"w{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    rows += [rng.choice(rows) for _ in range(40)]
    rows += [(500, 3, "user", "the same.")] * 30
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "chunk", "parts"), [(1, 3, 4), (2, 16, 7), (3, 256, 1)])
def test_repair_against_a_plain_search(spark, seed, chunk, parts):
    rows = random_rows(seed)
    table = spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = dialogue.report(dialogue.repair(dialogue.damage(table), chunk)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r["conv_id"]: tuple(r[c] for c in columns) for r in got}
    assert len(found) == len(got) and found == plain(rows)


def test_a_dropped_conversation_has_an_empty_audit(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "Hello.")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in dialogue.report(dialogue.repair(dialogue.damage(table))).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_no_conversations(spark):
    assert dialogue.report(dialogue.repair(dialogue.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).collect() == []


def test_a_rerun_ends_where_vectors_differ_by_a_constant():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(50):
        size = rng.integers(0, 40, 5)
        code, fault = rng.integers(0, 4, size.sum()), rng.integers(0, 4, size.sum())
        end = np.stack([dialogue._closed(rng.integers(0, 9, (1, 4)).astype(np.int16))[0] for _ in size])
        end -= end.min(1, keepdims=True)
        guess = dialogue.backward(code, fault, size, np.zeros((5, 4), np.int16))
        assert (dialogue.backward(code, fault, size, end, guess) == dialogue.backward(code, fault, size, end)).all()
