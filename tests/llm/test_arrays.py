"""Hashes of words: sound where a hash decides, for words that meet under polynomial hashes modulo a power of two."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import arrays, near_dup, piece_nbest, repeats, toxicity

from .test_token_files import thue_morse


@pytest.mark.parametrize("n", [9, 10, 11, 12])
@pytest.mark.parametrize("letters", ["ab", "AB", "xé", "01"])
def test_colliding_words_have_different_hashes(n, letters):
    s, t = thue_morse(n, letters)
    words = arrays.Words(pa.array([f"{s} {t}", s, t]))
    a, b, c, d = words.hash.tolist()
    assert a == c and b == d and a != b


@pytest.mark.parametrize("seed", range(3))
def test_hashes_are_equal_where_bytes_are(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("aAbBé .") for _ in range(400))
    data = np.frombuffer(text.encode(), np.uint8)
    for fold, clean in ((False, bytes), (True, lambda b: bytes(b).lower())):
        sums, seen = arrays.prefix_hash(data, fold), {}
        spans = [(a, b) for a in range(0, len(data), 3) for b in range(a, min(len(data), a + 12))]
        hashes = arrays.span_hash(sums, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
        for (a, b), h in zip(spans, hashes.tolist(), strict=True):
            assert seen.setdefault(clean(data[a:b]), h) == h
        assert len(set(seen.values())) == len(seen)


def test_powers_are_those_of_the_base():
    for base, (up, down) in zip(arrays._BASES, arrays.prime_powers(1000), strict=True):
        p = 2**31 - 1
        assert [int(x) % p for x in up[:1000]] == [pow(base, k, p) for k in range(1000)] and [int(x) % p for x in down[:1000]] == [pow(base, -k, p) for k in range(1000)]


@pytest.mark.parametrize("n", [10, 12])
def test_near_duplicates_do_not_link_colliding_words(spark, n):
    s, t = thue_morse(n)
    rows = [(1, f"x {s} y"), (2, f"x {t} y"), (3, s), (4, t), (5, s)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


@pytest.mark.parametrize("n", [10, 12])
def test_pieces_of_colliding_words(n):
    pieces = piece_nbest.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for ids, text in zip((x[0] for x in pieces.encode_all(pa.array(thue_morse(n)), 2)), thue_morse(n), strict=True):
        assert b"".join(pieces.bytes_of[i] for i in ids.tolist()) == f" {text}".encode()


@pytest.mark.parametrize("n", [10, 12])
def test_repeats_of_colliding_texts(spark, n):
    s, t = thue_morse(n)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame([(1, s), (2, t), (3, s)], "doc_id long, text string"), length=100).collect()}
    seen, want = set(), {}
    for k, text in ((1, s), (2, t), (3, s)):
        gone = set()
        for i in range(len(text) - 99):
            gone |= set(range(i, i + 100)) if text[i : i + 100] in seen else set()
            seen.add(text[i : i + 100])
        want[k] = hashlib.sha256("".join(c for i, c in enumerate(text) if i not in gone).encode()).hexdigest()
    assert {k: r["kept_sha256"] for k, r in got.items()} == want


def test_words_of_a_long_text_are_told_apart():
    s, t = thue_morse(10)
    text = " ".join(f"w{k}" for k in range(30)) + f" {s} end"
    a, b = (arrays.Words(pa.array([x])).hash for x in (text, text.replace(s, t)))
    assert np.flatnonzero(a != b).tolist() == [30]


def test_rows_that_reach_the_driver_are_bounded(spark, monkeypatch):
    """One labelled id on very many rows, and one row many times."""
    rows = spark.range(50_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("thing "), F.col("id") % 900).alias("text")).union(spark.createDataFrame([(2, "bad word")] * 50, "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, labels, slot, **more: seen.append(len(rows)))
    toxicity.fit(rows, labels, rows=200)
    assert seen == [200]


def test_scores_are_the_plain_double_sum_of_pairs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(12))) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.fit(table, spark.createDataFrame([(k, int("w1" in t.split() and "w2" in t.split() or k % 7 == 0)) for k, t in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, machine).collect()}
    for k, text in rows[:40]:
        _, buckets = toxicity._terms(pa.array([text]))
        slots = sorted({int(machine.slot[b]) for b in buckets if machine.slot[b] >= 0})
        z = machine.bias + sum(machine.weight[i] for i in slots) + sum(machine.factor[i] @ machine.factor[j] for i in slots for j in slots if i < j)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)
