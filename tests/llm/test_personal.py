"""Personal data: plain patterns against the patterns as they are written, the field against enumeration, and what it adds on unseen rows."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import personal
from ledgerloom.llm.arrays import Words

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def checked(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and checked(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


PARTS = ["a", "x.y", "@", "@@", "a@b", "b-c.de", ".", "1", "255", "256", "0007", "12.", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "  ", " ", "-", "+", "+1", "(212) 555-0100", "é", "😀", "\n", "+49", "%", "378282246310005"]


@pytest.mark.parametrize("seed", range(4))
def test_plain_spans(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert personal.base_spans(text) == plain(text)


@pytest.mark.parametrize("part", ["a", "1", "1.", "a@", "+", "+1", "+1 ", "1 ", "@", "a.", "@a.", "9 8-"])
def test_time_grows_with_length_only(part):
    began = time.time()
    text = part * (300_000 // len(part))
    personal.base_spans(text)
    words = Words(pa.array([text]))
    personal.train(np.zeros((0, 1), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)).decode(personal.stretches(words))
    assert time.time() - began < 20


def random_chain(rng):
    return personal.Chain(rng.normal(size=(personal.FEATURES, personal.LABELS)), rng.normal(size=(personal.LABELS, personal.LABELS)), rng.normal(size=personal.LABELS))


def score(chain, features, labels):
    """Of one stretch, or None where the labels may not follow each other."""
    if not personal._FIRST[labels[0]] or not all(personal._ALLOWED[a, b] for a, b in itertools.pairwise(labels)):
        return None
    return chain.begin[labels[0]] + sum(chain.emit[f, y].sum() for f, y in zip(features, labels, strict=True)) + sum(chain.step[a, b] for a, b in itertools.pairwise(labels))


def test_decoding_and_likelihood_against_all_labelings():
    rng = np.random.default_rng(3)
    found = personal.stretches(Words(pa.array(["a 1 b@c", "", "7", "x y z 8 v", "12 ab " + "word " * 9 + "3-4", None])))
    size = np.diff(found.first)
    assert size.tolist() == [3, 1, 5, 4, 4]
    chain = random_chain(rng)
    got = chain.decode(found)
    labels = np.array([0, 1, 2, 3, 0, 5, 6, 0, 0, 1, 0, 7, 8, 0, 0, 3, 4])
    want = 0.0
    for a, b in itertools.pairwise(found.first.tolist()):
        ways = {y: s for y in itertools.product(range(personal.LABELS), repeat=b - a) if (s := score(chain, found.features[a:b], y)) is not None}
        assert max(ways, key=ways.get) == tuple(got[a:b].tolist())
        want += ways[tuple(labels[a:b].tolist())] - np.log(np.exp(np.array(list(ways.values()))).sum())
    value, slope, steps, begins = personal.likelihood(chain, found.features, found.first, labels)
    assert value == pytest.approx(want)
    for part, at, grad in ((chain.emit, (int(found.features[4, 7]), 3), slope[(found.features == found.features[4, 7]).any(1)][:, 3].sum()), (chain.step, (0, 5), steps[0, 5]), (chain.step, (7, 8), steps[7, 8]), (chain.begin, 1, begins[1])):
        part[at] += 1e-5
        up = personal.likelihood(chain, found.features, found.first, labels)[0]
        part[at] -= 1e-5
        assert (up - value) / 1e-5 == pytest.approx(grad, abs=1e-3)


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(k, f"thing {k} was wher 48451681144073{k % 90 + 10} and so on" if k % 2 else "the one of all") for k in range(300)]
    return personal.fit(personal.examples(spark), spark.createDataFrame(rows, "doc_id long, text string"))


UNSEEN = [
    ("Please call 555-0121 tonight.", "phone:12:20"), ("Phone: (503) 555-0144", "phone:7:21"), ("Ring 617-555-0192 for a cab.", "phone:5:17"), ("Our office number is 020 7946 0731 on Fridays.", "phone:21:34"),
    ("Amex card 3714 496353 98431 was lost.", "card:10:27"), ("Card 5105.1051.0510.5100 expires.", "card:5:24"), ("My card number is 371449635398431 here.", "card:18:33"),
    ("Contact: admin@localhost only.", "email:9:24"), ("Login from 2001:db8:85a3::7 was denied.", "ip:11:27"), ("Send it to lee(at)example.org or a.b@example.net soon.", "email:11:29,email:33:48"),
]
CLEAN = [
    "We met on 2023-11-02 at 09:15 in room 44.", "Version 2.14.1 was out on 03/11/2019.", "It costs 3,499.00 or 99.50 a month.", "Order 77120934 of 12 items.", "ISBN 978-0-306-40615-7 is out.", "Between 1815-1848 some 300,000 left.",
    "Follow @everyone here.", "Number 4929348385146308 is no card.", "Use 256.1.1.300 as a test.", "At 6:30 am, 12 of 19 came.", "Population of 2 345 678 was given.",
]


def test_the_field_finds_unseen_rows_and_leaves_clean_ones(chain):
    texts = [t for t, _ in UNSEEN] + CLEAN
    _, base, more = personal.scan(chain, pa.array(texts))
    got = [personal._joined(a + b) for a, b in zip(base, more, strict=True)]
    assert sum(g == w for g, (_, w) in zip(got, UNSEEN, strict=False)) >= 9
    assert got[len(UNSEEN) :] == [""] * len(CLEAN)


def test_personal_data(spark, chain):
    texts = [*[t for t, _ in UNSEEN], "é😀 jo@a.example.com, +1 (303) 555-0164", "", None, None, "word " * 50_000 + "10.0.0.1"]
    table = spark.createDataFrame([(k if k < 12 else 12, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_email long, spans string")
    got = personal.find_personal(table, chain).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] < 12:
            want = plain(texts[r["doc_id"]])
            joined = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in want)
            assert (r["base_sha256"], r["base_spans"]) == (hashlib.sha256(joined.encode()).hexdigest(), joined)
            assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(k == s[0] for s in want) for k in range(4)] and set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert sorted(r["spans"] for r in got if r["doc_id"] == 12) == ["", "", "ip:250000:250008"]
    assert {r["doc_id"]: r["spans"] for r in got}[10] == "email:3:19,phone:21:38"
    masked = {r["doc_id"]: r["text"] for r in personal.mask_personal(table, chain).collect()}
    assert masked[10] == "é😀 [email], [phone]" and masked[0] == "Please call [phone] tonight."


def test_the_field_is_the_same_however_rows_are_dealt(spark):
    rows = [(k, f"w{k % 7} 10.0.{k % 5}.1 said {k} or a{k % 3}@b.example.com") for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (personal.fit(personal.examples(spark), table.repartition(n), most=40) for n in (1, 9))
    assert all((getattr(one, x) == getattr(other, x)).all() for x in ("emit", "step", "begin"))


def test_no_labelled_rows_and_no_documents(spark):
    empty = personal.fit(spark.createDataFrame([], "text string, spans string"))
    assert personal.find_personal(spark.createDataFrame([], "doc_id long, text string"), empty).collect() == []
    assert personal.find_personal(spark.createDataFrame([(1, "call 555-0143")], "doc_id long, text string"), empty).first()["spans"] == ""
