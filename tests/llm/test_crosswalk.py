"""Alignment of two tokenizers against whole texts encoded by themselves and a plain merge."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import crosswalk, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text, a=[], b=[]):
    """(id, start, end) of the tokens of the whole text, or none if one of the tokenizers loses bytes."""
    if not a:
        a.append(Tokenizer.from_file(A))
        a[0].encode_special_tokens = True
        b.append(sentencepiece.SentencePieceProcessor(model_file=B))
    whole, out = (" " + text).encode(), []
    for ids, of in (
        (a[0].encode(" " + text, add_special_tokens=False).ids, lambda i: a[0].decoder.decode([a[0].id_to_token(i)]).encode() if a[0].id_to_token(i).isascii() else crosswalk._level(a[0].id_to_token(i))),
        (b[0].encode(text), lambda i: bytes([int(b[0].id_to_piece(i)[3:5], 16)]) if b[0].is_byte(i) else b[0].id_to_piece(i).replace("▁", " ").encode()),
    ):
        spans, at = [], 0
        for i in ids:
            spans.append((i, at, at + len(of(i))))
            at += len(of(i))
        if b"".join(map(of, ids)) != whole:
            return None
        out.append(spans)
    return out


def plain(rows):
    found, counts = [], Counter()
    for doc, text in rows:
        both = tokens(text) if text else None
        if not both:
            found.append((doc, 0, 0, 0, [], ""))
            continue
        a, b = both
        links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e] if len(a) < 500 else swept(a, b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in spans if start <= s < end) for spans in (a, b)))
            start = end
        counts.update(links)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, a, b, g, ls, h in found]


def swept(a, b):
    out, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "thing", "naïve", "größe", "日本語テキスト", "привет", "мир", " ", " ", "　", "  ", "\n", "\t", " \n ", "x" * 40, "0x41", "<0x41>", "<s>", "<|endoftext|>", "don't", "1234567", "…", "😀👍🏽", "é", "\x00", "\x7f", "​", ");\r", "a_b.c", "ſ", "\x1c", "\x85"]
    out = []
    for _ in range(n):
        words = [rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcdefghé ,.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 25))]
        out.append(rng.choice([" ", ""]).join(words))
    return [*out, "", None, " ", "  ", "a ", "▁", "a▁b c", "one", "one", "ab" * 3000, "日本" * 2000, "\n\n"]


@pytest.mark.parametrize("held", [1 << 20, 40, 0])
def test_alignment_against_whole_texts(spark, held):
    rows = [(k if k % 7 else 7, t) for k, t in enumerate(random_texts(4, 150))]
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, row long, pairs long, n_a string").repartition(5)
    got = crosswalk.find_links(table, A, B, held=held).collect()
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(plain(rows))


def test_groups_are_those_of_the_digest(spark):
    table = spark.createDataFrame([(1, "Some thing naïvely said."), (2, None)], "doc_id long, text string")
    for r in crosswalk.align(table, A, B, groups=True).collect():
        a, b, out = iter(r["a_tokens"]), iter(r["b_tokens"]), []
        for x, y in zip(r["a_group_sizes"], r["b_group_sizes"], strict=True):
            out.append(",".join(str(next(a)) for _ in range(x)) + "|" + ",".join(str(next(b)) for _ in range(y)))
        assert r["groups_sha256"] == (hashlib.sha256(";".join(out).encode()).hexdigest() if out else "")


def test_alignment_of_no_documents(spark):
    assert crosswalk.find_links(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_units_are_remembered_by_their_bytes():
    memory = units.Memory(lambda xs: units.flat_lists([[len(x), x[0]] for x in xs]), lambda xs: units.flat_lists([[7] * len(x) for x in xs]), most=50)
    rng = random.Random(1)
    for _ in range(60):
        names = [bytes([rng.randrange(65, 70)]) * rng.randint(1, 9) for _ in range(40)]
        data = np.frombuffer(b"".join(names), np.uint8)
        edges = np.cumsum([0, *map(len, names)])
        (ids, ends), (_, more) = memory.look_up(*units.distinct(data, edges))
        assert more.tolist() == edges[1:].tolist()
        assert ids.tolist() == [v for x in names for v in (len(x), x[0])] and ends.tolist() == [2 * k + 2 for k in range(40)]


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(units, "hash", lambda x: len(x) % 2, raising=False)
    memory = units.Memory(lambda xs: units.flat_lists([[x[0]] for x in xs]))
    for names in ([b"a", b"b", b"cc"], [b"b", b"d", b"a"], [b"dd", b"cc", b"eeee"]):
        data, edges = np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)])
        ((ids, _),) = memory.look_up(*units.distinct(data, edges))
        assert ids.tolist() == [x[0] for x in names]


def test_lanes_end_where_both_end():
    both = crosswalk.tokenizers(A, B)
    text = pa.array(["ab" * 3000 + " " + "word " * 900, "日本" * 2000, "", "x"])
    good, (a, a_rows), (b, _), unit_end, rows_end = crosswalk._tokens(both, text)
    a_end, b_end = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    first_a, first_b, stop = crosswalk.lanes(a_end, b_end, unit_end, rows_end)
    assert good.tolist() == [True, True, False, True] and set(stop) <= set(a_end) & set(b_end) and set(rows_end) <= set(stop)
    assert len(stop) > len(a) / crosswalk.LANE / 2 and first_a[0] == first_b[0] == 0
