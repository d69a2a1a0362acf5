"""Personal data: plain patterns, and a linear-chain conditional random field over word shapes for what they miss.

Each text is scanned on its own, so nothing is shuffled. The field labels the words around those that hold a digit
or an at sign (all other words are outside whatever they are) with the kinds of personal data. Its features are
shapes of words: digits and letters by number, marks, ends, checks of digits, and hashed neighbouring words. It
is trained in the driver from a small labelled table, examples() or another, and from a bounded number of stretches
of documents in which the plain patterns are the labels. All stretches of a slice are decoded by Viterbi together.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, slices
from .shared import cut, packed, texts, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Labels: outside, then first word and further word of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Stretches of documents that a field is trained on, at most (the smallest by hash), and of how many words each.
TRAINING_STRETCHES, STRETCH_WORDS = 2_000, 40
#: Words to either side of one with a digit or at sign that are labelled, and bytes from which on a word is outside.
AROUND, LONGEST = 3, 200
#: Variants of each built-in labelled sentence.
VARIANTS = 10

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the plain patterns find, in that order. Time grows with the length, whatever the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:  # from each at sign to both sides, which is where the leftmost match lies
        start = len(text[end:at].rstrip(_LOCAL)) + end
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
        end = domain.end() if domain else at + 1
        at = text.find("@", end)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return out


# -- stretches and their features --------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 digit, 2 letter, then single marks
_CLASS[48:58] = 1
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
for _k, _c in enumerate(b"@.-()+/:,"):
    _CLASS[_c] = 3 + _k
_CLASSES = 12
_ODD = np.zeros(256, np.int64)
_ODD[[*range(48, 58), 64]] = 1
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 7, 7, 7, 8, 8, 8, 9, 10, 10, 10, 11])
_OFFSETS = (-2, -1, 0, 1, 2)
_WORDS = 512
#: Values of each feature of a word: digits by letters, marks, ends, dots by hyphens, checks, hash of the word.
_SIZES = np.array([12 * 4, 512, _CLASSES * _CLASSES, 25, 4, _WORDS])
#: Values of all features at all offsets; each has one more for "no such word".
_STARTS = np.concatenate([[0], np.cumsum(np.tile(_SIZES + 1, len(_OFFSETS)))])
FEATURES = int(_STARTS[-1])


@dataclass
class Stretches:
    """Words that are labelled: their numbers among all words, feature values, and where each stretch starts (one more entry than stretches)."""

    word: np.ndarray
    features: np.ndarray
    first: np.ndarray


def _picked(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words near one with a digit or at sign, and where a new stretch starts among them."""
    odd = np.concatenate([[0], np.cumsum(_ODD[words.data])])
    size = words.end - words.start
    is_odd = (odd[words.end] > odd[words.start]) & (size <= LONGEST)
    n = len(size)
    near = np.zeros(n + 1, np.int64)
    row = np.repeat(np.arange(len(words.first) - 1), words.count())
    at = np.flatnonzero(is_odd)
    np.add.at(near, np.maximum(at - AROUND, words.first[row[at]]), 1)
    np.add.at(near, np.minimum(at + AROUND + 1, words.first[row[at] + 1]), -1)
    chosen = np.flatnonzero((np.cumsum(near)[:n] > 0) & (size <= LONGEST))
    new = np.ones(len(chosen), bool)
    new[1:] = (np.diff(chosen) > 1) | (np.diff(row[chosen]) > 0)
    return chosen, np.append(np.flatnonzero(new), len(chosen))


def stretches(words: Words) -> Stretches:
    chosen, first = _picked(words)
    start, size = words.start[chosen], (words.end - words.start)[chosen]
    n, edges = len(chosen), np.cumsum(size) - size
    if not n:
        return Stretches(chosen, np.zeros((0, len(_STARTS) - 1), np.int64), first)
    body = words.data[np.repeat(start - edges, size) + np.arange(int(size.sum()))]
    counts = np.bincount(np.repeat(np.arange(n), size) * _CLASSES + _CLASS[body], minlength=n * _CLASSES).reshape(n, _CLASSES)
    digits, letters = _DIGITS[np.minimum(counts[:, 1], 20)], np.digitize(counts[:, 2], [1, 2, 5])
    marks = ((counts[:, 3:] > 0) << np.arange(9)).sum(1)
    ends = _CLASS[body[edges]] * _CLASSES + _CLASS[body[edges + size - 1]]
    parts = np.minimum(counts[:, 4], 4) * 5 + np.minimum(counts[:, 5], 4)
    checks = np.zeros(n, np.int64)
    for k in np.flatnonzero((counts[:, 1] >= 12) | ((counts[:, 4] == 3) & (counts[:, 1] >= 4))):
        text = body[edges[k] : edges[k] + size[k]].tobytes().decode("ascii", "replace")
        number = _NOT_DIGITS.sub("", text)
        checks[k] = 1 + luhn(number) if len(number) >= 12 else 3 * bool(_IP.search(text) and all(int(p) <= 255 for p in _NOT_DIGITS.split(text) if p))
    hashed = (words.hash[chosen] >> np.uint64(55)).astype(np.int64)
    values = np.stack([digits * 4 + letters, marks, ends, parts, checks, hashed], 1)
    stretch = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.empty((n, len(_OFFSETS) * len(_SIZES)), np.int64)
    for k, offset in enumerate(_OFFSETS):
        there = np.clip(np.arange(n) + offset, 0, n - 1)
        inside = (stretch[there] == stretch) & (there == np.arange(n) + offset)
        out[:, k * len(_SIZES) : (k + 1) * len(_SIZES)] = np.where(inside[:, None], values[there], _SIZES)
    return Stretches(chosen, out + _STARTS[:-1], first)


# -- the field ---------------------------------------------------------------------------------------------------

#: A further word follows a first or further word of its own kind only.
_ALLOWED = np.ones((LABELS, LABELS), bool)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = False
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_FIRST = np.array([k == 0 or k % 2 == 1 for k in range(LABELS)])
_NEVER = -1e9


@dataclass
class Chain:
    """emit: weight of each feature value for each label; step: of each label after each other; begin: of the first."""

    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def decode(self, found: Stretches) -> np.ndarray:
        """The likeliest labels of all stretches' words, in lockstep; ties go to the smaller label."""
        scores = self.emit[found.features].sum(1)
        size = np.diff(found.first)
        order = np.argsort(-size, kind="stable")
        first, size = found.first[:-1][order], size[order]
        back = np.zeros((len(scores), LABELS), np.int8)
        step, labels = self.step + np.where(_ALLOWED, 0, _NEVER), np.zeros(len(scores), np.int64)
        if not len(scores):
            return labels
        now = scores[first] + self.begin + np.where(_FIRST, 0, _NEVER)
        last = now.copy()
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, "left"))  # stretches of more than t words come first
            ways = now[:live, :, None] + step
            best = ways.argmax(1)
            back[first[:live] + t] = best
            now = np.take_along_axis(ways, best[:, None], 1)[:, 0] + scores[first[:live] + t]
            last[:live] = now
        label, at = last.argmax(1), size - 1
        labels[first + at] = label
        live = np.flatnonzero(at > 0)
        while len(live):
            label[live] = back[first[live] + at[live], label[live]]
            at[live] -= 1
            labels[first[live] + at[live]] = label[live]
            live = live[at[live] > 0]
        return labels


def likelihood(chain: Chain, features: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of labelled stretches, and its slopes by emissions (word by label), steps and beginnings; stretches may have weights."""
    scores, size = chain.emit[features].sum(1), np.diff(first)
    n, most = len(size), int(size.max())
    weight = np.ones(n) if weight is None else weight
    of_word = np.repeat(weight, size)
    order = np.argsort(-size, kind="stable")  # long stretches first: at each place only those that reach it are looked at
    size, weight, begins_at = size[order], weight[order], first[:-1][order]
    live = np.searchsorted(-size, -np.arange(most), "left")
    inside = np.arange(most) < size[:, None]
    place = np.minimum(begins_at[:, None] + np.arange(most), len(scores) - 1)
    step = chain.step + np.where(_ALLOWED, 0, _NEVER)
    begin = chain.begin + np.where(_FIRST, 0, _NEVER)
    padded = scores[place]

    def summed(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    fore, hind = np.zeros((n, most, LABELS)), np.zeros((n, most, LABELS))
    fore[:, 0] = padded[:, 0] + begin
    for t in range(1, most):
        on = slice(0, live[t])
        fore[on, t] = summed(fore[on, t - 1, :, None] + step, 1) + padded[on, t]
    for t in range(most - 2, -1, -1):
        on = slice(0, live[t + 1])
        hind[on, t] = summed(step + (padded[on, t + 1] + hind[on, t + 1])[:, None], 2)
    total = summed(fore[np.arange(n), size - 1], 1)
    slope = np.eye(LABELS)[labels]
    slope[place[inside]] -= np.exp((fore + hind - total[:, None, None])[inside])
    slope *= of_word[:, None]
    steps = np.zeros((LABELS, LABELS))
    for t in range(1, most):
        on = slice(0, live[t])
        steps -= (np.exp(fore[on, t - 1, :, None] + step + (padded[on, t] + hind[on, t])[:, None] - total[on, None, None]) * weight[on, None, None]).sum(0)
    follows = np.ones(len(labels), bool)
    follows[first[:-1]] = False
    pairs = labels[np.flatnonzero(follows) - 1], labels[follows]
    np.add.at(steps, pairs, of_word[follows])
    value = scores[np.arange(len(labels)), labels] @ of_word + step[pairs] @ of_word[follows] + begin[labels[begins_at]] @ weight - total @ weight
    return float(value), slope, steps, slope[first[:-1]].sum(0)


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None, epochs: int = 120, shrink: float = 3e-5) -> Chain:
    """Fit by Adam on the mean log-likelihood with shrinkage; the result depends on the rows and their weights only."""
    chain = Chain(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS))
    if len(first) < 2:
        chain.begin[1:] = -1
        return chain
    used, at = np.unique(features, return_inverse=True)
    at = at.reshape(features.shape)
    small = Chain(np.zeros((len(used), LABELS)), chain.step, chain.begin)
    values, total = [small.emit, small.step, small.begin], len(first) - 1 if weight is None else weight.sum()
    means, squares = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    for turn in range(1, epochs + 1):
        _, slope, steps, begins = likelihood(small, at, first, labels, weight)
        emits = np.stack([np.bincount(at.ravel(), np.repeat(slope[:, k], at.shape[1]), len(used)) for k in range(LABELS)], 1)
        for value, gain, mean, square in zip(values, (emits, steps, begins), means, squares, strict=True):
            grad = gain / total - shrink * value
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad**2 - square)
            value += 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    chain.emit[used] = small.emit
    return chain


# -- labelled rows -----------------------------------------------------------------------------------------------

#: Hand-labelled sentences: [kind text] is personal data. Numbers are of ranges kept free for examples.
_EXAMPLES = """
Call me at [phone 555-0143] after lunch.
Phone: [phone (212) 555-0187]
Dial [phone 555-0150] for help, or [phone 555-0151] at night.
Ask for me on [phone 555-0166] tomorrow.
Tel. [phone 030 23125 014] or write to us.
Our office number is [phone 020 7946 0958] on weekdays.
His mobile is [phone 07700 900461] now.
Ring [phone 202-555-0119] for a taxi.
Fax [phone (415) 555-0132] and phone [phone (415) 555-0133] are new.
Numéro de téléphone : [phone 01 99 00 55 12] le matin.
Teléfono [phone 91 555 01 78] por la tarde.
Telefon [phone 0171 39 200 55] abends.
Call [phone 1-800-555-0199] today.
You can text [phone 303.555.0164] as well.
Please ring [phone +1 (303) 555-0164] or [phone +44 20 7946 0123] instead.
Amex card [card 3782 822463 10005] was charged.
My card number is [card 378282246310005] for this.
Card [card 4111.1111.1111.1111] expires soon.
Kreditkarte [card 5555 5555 5555 4444] bis Mai.
Pay with [card 4012888888881881] please.
Carte [card 3714 496353 98431] refusée.
Write to [email jane.doe@mail.example.com] for help.
Mail [email sam_42@example.org] today.
Contact: [email root@localhost] only.
E-mail [email kim@intranet] works inside.
Adresse [email léa@exemple.fr] pour tous.
Send it to [email pat(at)example.com] or [email o.k@example.net] soon.
Server [ip 192.0.2.17] is down.
Ping [ip 198.51.100.23] first.
The host has address [ip 203.0.113.5] since May.
Login from [ip 2001:db8::8a2e:370:7334] was denied.
Client [ip 2001:db8:0:1::42] timed out.
We met on 2021-05-17 at 10:30 in room 12.
Version 10.4.2 was out on 12/03/2020.
It costs 1,299.00 or 15.50 a month.
Order 48213377 of 17 items left in 1998.
Chapter 4 has 12 parts and 301 pages.
The ratio was 3.14159 in test 7.
Between 1914-1918 some 20,000,000 people died.
ISBN 978-3-16-148410-0 is the second edition.
Follow @someone or @other_one for more.
Invoice 20210517 has 3 lines at 19.99 each.
Room 101, floor 2, building 33.
Total 4929348385146307 units were counted.
Number 4845168114407320 is no card.
Build 1.2.3.4567 failed after 120 s.
Use 300.400.500.600 as a test of the check.
They sold 5,555,555 of 7,777,777 shares.
At 7:45 pm, 23 of 40 people left.
Section 12-345 and table 6-7 agree.
Populations of 1 234 567 and 890 123 were given.
Population of 8 214 905 in the year 2004.
Lot A1-B2-C3 weighs 250 kg.
""".strip()
_MARKED = re.compile(r"\[(\w+) ([^\]]*)\]")


def _varied(text: str, card: bool, rng: random.Random) -> str:
    """The text with other digits, of a card such that they pass its check, and of other long numbers such that they don't."""
    out = "".join(rng.choice("123456789") if c in "123456789" else c for c in text)
    digits = _NOT_DIGITS.sub("", out)
    if card or len(digits) >= 12:
        at = max(k for k, c in enumerate(out) if c.isdigit())
        out = next(x for x in (out[:at] + d + out[at + 1 :] for d in "0123456789") if luhn(_NOT_DIGITS.sub("", x)) == card)
    return out


def examples(spark: SparkSession, variants: int = VARIANTS) -> DataFrame:
    """The built-in labelled table: text, and spans as kind:start:end in code points, comma-joined.

    Each sentence is followed by variants with other digits; in every second one its plain words are made-up ones too.
    Addresses of four numbers keep their digits, and so do sentences without personal data that are about one.
    """
    rows, rng = [], random.Random(11)
    for line in _EXAMPLES.split("\n"):
        for variant in range(1 + variants):
            text, spans, at = "", [], 0
            for m in [*_MARKED.finditer(line), None]:
                between = line[at : m.start() if m else len(line)]
                if variant and not _IP.search(between):
                    between = _varied(between, False, rng)
                if variant and variant % 2 == 0:
                    between = re.sub(r"(?<![^\x20])[A-Za-z]{2,}", lambda w: "".join(rng.choice("abcdefghilmnoprstuw") for _ in w[0]), between)
                text += between
                if m:
                    held = _varied(m[2], m[1] == "card", rng) if variant and m[1] in ("card", "phone") else m[2]
                    spans.append(f"{m[1]}:{len(text)}:{len(text) + len(held)}")
                    text, at = text + held, m.end()
            rows.append((text, ",".join(spans)))
    return spark.createDataFrame(rows, "text string, spans string")


def _labels(words: Words, texts_: list[str], spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The label of every word of a slice: the first span, in order of its start, that it meets."""
    out = np.zeros(len(words.start), np.int64)
    for row, (text, found) in enumerate(zip(texts_, spans, strict=True)):
        for kind, a, b in sorted(found, key=lambda s: (s[1], s[0])):
            base = int(words.rows[row])
            a, b = base + len(text[:a].encode()), base + len(text[:b].encode())
            here = np.arange(np.searchsorted(words.end, a, "right"), np.searchsorted(words.start, b, "left"))
            here = here[out[here] == 0]
            out[here] = 2 + 2 * kind
            out[here[:1]] = 1 + 2 * kind
    return out


_TRAINING = "mark long, features array<int>, labels array<int>"


def _training(batches: Iterable[pa.RecordBatch], most: int):
    """Different stretches with labels, cut at STRETCH_WORDS, and a hash of each; of a task only the smallest hashes go on."""
    held: dict[int, tuple[list, list]] = {}
    for part in slices(batches):
        bodies, given = ((x or "" for x in part.column("text").to_pylist()), part.column("spans").to_pylist() if "spans" in part.schema.names else None)
        bodies = list(bodies)
        spans = [base_spans(t) for t in bodies] if given is None else [[(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in (x or "").split(",") if s)] for x in given]
        words = Words(part.column("text"))
        found, label = stretches(words), _labels(words, bodies, spans)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            for at in range(a, b, STRETCH_WORDS):
                features, labels = found.features[at : min(b, at + STRETCH_WORDS)], label[found.word[at : min(b, at + STRETCH_WORDS)]].copy()
                if labels[0] and labels[0] % 2 == 0:
                    labels[0] -= 1  # a span that the cut parts
                mark = int.from_bytes(hashlib.blake2b(features.tobytes() + labels.tobytes(), digest_size=8).digest(), "big", signed=True)
                held[mark] = features.ravel().tolist(), labels.tolist()
        if len(held) > 4 * most:
            held = dict(sorted(held.items())[:most])
    for mark, (features, labels) in sorted(held.items())[:most]:
        yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([features], pa.list_(pa.int32())), pa.array([labels], pa.list_(pa.int32()))], ["mark", "features", "labels"])


def _smallest(stretches_: DataFrame, most: int) -> list:
    """The rows of the smallest marks, in order: counts by a step of the mark say up to which one they are asked for."""
    kept = cut(stretches_).dropDuplicates(["mark"])
    step = F.shiftright("mark", 48)
    counts = sorted((r["step"], r["count"]) for r in kept.groupBy(step.alias("step")).count().collect())
    upto, total = None, 0
    for upto, n in counts:
        total += n
        if total >= most:
            break
    return [] if upto is None else sorted(kept.where(step <= upto).collect(), key=lambda r: r["mark"])[:most]


def fit(labelled: DataFrame, documents: DataFrame | None = None, most: int = TRAINING_STRETCHES) -> Chain:
    """Train on a labelled table (text, spans) and on at most so many stretches of documents, labelled by the plain patterns.

    Of each table that many different stretches (the smallest by a hash of their features) are learned from, whatever its size and however its rows are dealt; the
    driver gets those and at most the rows of one of 65,536 steps of the hash besides. The two tables weigh the same. Nulls are empty texts, and rows without stretches teach nothing.
    """
    tables = [labelled.select("text", "spans")] + ([documents.select("text")] if documents is not None else [])
    rows, weights = [], []
    for table in tables:
        found = _smallest(table.mapInArrow(lambda batches: _training(batches, most), _TRAINING), most)
        rows += [(r["features"], r["labels"]) for r in found]
        weights += [1 / max(1, len(found))] * len(found)
    width = len(_STARTS) - 1
    if not rows:
        return train(np.zeros((0, width), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    features = np.concatenate([np.array(f, np.int64).reshape(-1, width) for f, _ in rows])
    first = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])])
    return train(features, first, np.concatenate([np.array(x, np.int64) for _, x in rows]), np.array(weights))


# -- scans -------------------------------------------------------------------------------------------------------

_TRIM = ".,;:!?\"'<>[]{}*#$%&|"
#: Numbers with several groups that are none of a phone: grouped by thousands, dates, and book numbers.
_NO_PHONE = re.compile(r"[1-9][0-9]{0,2}(?:[ .][0-9]{3})+|(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|97[89](?:[ -][0-9]+){4}")
_AT = re.compile(r"@|[(\[{ ]at[)\]} ]", re.I)


def _credible(kind: int, text: str) -> bool:
    """What a labelled span must hold besides its shape."""
    digits = _NOT_DIGITS.sub("", text)
    if kind == 0:
        at = _AT.search(text)
        return bool(at and text[: at.start()].strip() and text[at.end() :].strip())
    if kind == 1:
        return bool(re.fullmatch(r"[0-9A-Fa-f:.]+", text)) and (text.count(":") >= 3 or bool(_IP.fullmatch(text)) and all(len(p) <= 3 and int(p) <= 255 for p in text.split(".")))
    if kind == 2:
        return 12 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits) and not re.search(r"[^0-9 .-]", text)
    groups = re.findall(r"[0-9]+", text)
    return 7 <= len(digits) <= 15 and len(groups) >= 2 and not re.search(r"[^0-9 ()+./-]", text) and not _NO_PHONE.fullmatch(text)


def more_spans(chain: Chain, words: Words, texts_: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The spans that the field adds to each row's plain ones: trimmed, credible for their kind, and apart from those."""
    found = stretches(words)
    label = chain.decode(found)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts_]
    begin = np.flatnonzero(label % 2 == 1)
    if not len(begin):
        return out
    letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    row_of = np.searchsorted(words.first, found.word[begin], "right") - 1
    taken = [sorted((a, b) for _, a, b in spans) for spans in base]
    for at, row in zip(begin.tolist(), row_of.tolist(), strict=True):
        kind, end = int(label[at]) // 2, at + 1
        while end < len(label) and label[end] == label[at] + 1:
            end += 1
        zero = letters[words.rows[row]]
        a, b = int(letters[words.start[found.word[at]]] - zero), int(letters[words.end[found.word[end - 1]]] - zero)
        text = texts_[row][a:b]
        a, b = a + len(text) - len(text.lstrip(_TRIM)), b - (len(text) - len(text.rstrip(_TRIM)))
        text = texts_[row][a:b]
        if kind == 3 and text.count("(") < text.count(")"):
            b -= text.endswith(")")
        k = np.searchsorted([x for x, _ in taken[row]], b) if taken[row] else 0
        if b > a and not (k and max(y for _, y in taken[row][:k]) > a) and _credible(kind, texts_[row][a:b]):
            out[row].append((kind, a, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(chain: Chain, column: pa.Array) -> tuple[list[str], list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Texts of a slice, their plain spans, and those that the field adds."""
    bodies = [t or "" for t in column.to_pylist()]
    base = [base_spans(t) for t in bodies]
    return bodies, base, more_spans(chain, Words(column), bodies, base)


def find_personal(documents: DataFrame, chain: Chain) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card and n_phone of the plain patterns, base_spans, their digest, and all spans (kind:start:end in code points).

    Null and empty texts have none; repeated rows are each scanned; other columns are ignored.
    """
    kind, held = documents.schema["doc_id"].dataType.simpleString(), documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pa.RecordBatch]):
        for part in slices(batches):
            _, base, more = scan(held.value, part.column("text"))
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
            joined = [_joined(spans) for spans in base]
            spans = pa.array([_joined(a + b) for a, b in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(joined, pa.string()), pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()), spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "base_sha256", "spans"])

    return texts(documents, "doc_id").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_spans string, base_sha256 string, spans string")


def mask_personal(documents: DataFrame, chain: Chain) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, all columns kept; n_chars, where there is one, follows. A null text becomes empty."""
    held = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pa.RecordBatch]):
        for part in slices(batches):
            out = []
            for text, base, more in zip(*scan(held.value, part.column("text")), strict=True):
                kept, at = [], 0
                for k, a, b in sorted(base + more, key=lambda s: (s[1], s[2])):
                    kept += [text[at:a], f"[{KINDS[k]}]"] if a >= at else []
                    at = max(at, b)
                out.append("".join(kept) + text[at:])
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    rows = packed(documents.withColumn("text", F.coalesce("text", F.lit(""))), "text")
    masked = unpacked(rows.mapInArrow(run, rows.schema), documents.columns, "text")
    return masked.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else masked
