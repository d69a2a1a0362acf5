"""SentencePiece encoding and decoding with the N best segmentations.

A text is a row of units, each a run of blanks and the word after it; no piece crosses from one unit to the
next, so the piece lattice is a chain of small lattices. A forward Viterbi pass scores every position of a
unit (and its second-best way through). For the N best segmentations of the whole text only the N - 1 units
with the cheapest second choice matter; over them an A-star search runs backward, with the forward scores
as its exact estimate of what is left.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .arrays import flat, rough_hash, rough_sums, slices
from .shared import texts
from .units import Memory, distinct

_UNIT = re.compile(r" *[^ ]+| +")
#: Units that a worker remembers; beyond that it starts afresh, which changes no result.
REMEMBERED = 800_000
_NONE = -(10**17)
#: Bytes of a unit up to which many are passed at once.
_SHORT = 48
_models: dict[str, "Pieces"] = {}


class _Units(Memory):
    """Units with their best pieces, scores and losses."""

    def __init__(self, pieces: "Pieces"):
        self.pieces = pieces
        super().__init__(self._learned, most=REMEMBERED)

    def _clear(self) -> None:
        super()._clear()
        self.scores, self.losses = np.zeros(0, np.int64), np.zeros(0)

    def _learned(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, scores, losses = self.pieces.learn(units)
        self.scores, self.losses = np.concatenate([self.scores, scores]), np.concatenate([self.losses, losses])
        return ids, sizes

    def best(self, units: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the units which[0], which[1], ...: their ids in one array, where each one's end, scores and losses."""
        slots = self.find(units)
        ids, ends = self.held[0].take(slots, which)
        return ids, ends, self.scores[slots[which]], self.losses[slots[which]]


class Pieces:
    """A vocabulary with scores as a lattice over characters; characters without a piece go byte by byte."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str | None] = [None] * model.get_piece_size()
        self.byte: dict[int, int] = {}
        self.id: dict[str, tuple[int, int]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace("▁", " ")
                self.id[self.text[i]] = (i, round(model.get_score(i)))
        self.byte_value = {i: b for b, i in self.byte.items()}
        self.kind = np.uint16 if len(self.text) <= 65536 else np.uint32
        self.plain = np.array([t or "" for t in self.text], object)
        self.is_byte = np.zeros(len(self.text), bool)
        self.is_byte[list(self.byte_value)] = True
        lengths: dict[str, set[int]] = {}
        for piece in self.id:  # by the first two characters; pieces of one character are looked up apart
            lengths.setdefault(piece[:2], set()).add(len(piece))
        self.lengths = {c: tuple(sorted(n)) for c, n in lengths.items() if len(c) == 2}
        self.unknown = min((s for s in (score for _, score in self.id.values()) if s > -(10**8)), default=0) - 10
        self.units: dict[str, tuple[bytes, int, float]] = {}
        self._index()
        self.bytes_of = [(t or "").encode() if i not in self.byte_value else bytes([self.byte_value[i]]) for i, t in enumerate(self.text)]
        self.memory = _Units(self)

    def _index(self) -> None:
        """The vocabulary as an open-addressed table from the hash of a piece's bytes to its id, and the pieces' scores."""
        whole = dict(self.id)
        for byte in range(128):  # a character of one byte without a piece is its byte's piece
            whole.setdefault(chr(byte), (self.byte[byte], self.unknown))
        names = list(whole)
        data, at = flat(pa.array(names, pa.large_string()))
        keys = rough_hash(rough_sums(data), at[:-1], at[1:])
        self.score_of = np.zeros(len(self.text), np.int64)
        self.score_of[[whole[x][0] for x in names]] = [whole[x][1] for x in names]
        self.longest = int(np.diff(at).max())
        self.table_bits = 20
        self.table_key, self.table_id = np.zeros(1 << self.table_bits, np.uint64), np.full(1 << self.table_bits, -1, np.int32)
        for key, name in zip(keys.tolist(), names, strict=True):
            spot = key >> (64 - self.table_bits)
            while self.table_id[spot] >= 0:
                spot = (spot + 1) % (1 << self.table_bits)
            self.table_key[spot], self.table_id[spot] = key, whole[name][0]

    def _ids_at(self, keys: np.ndarray) -> np.ndarray:
        """Ids of pieces by their hashes, -1 where there's none."""
        spot = (keys >> np.uint64(64 - self.table_bits)).astype(np.int64)
        found = np.where(self.table_key[spot] == keys, self.table_id[spot], -1)
        open_ = np.flatnonzero((found < 0) & (self.table_id[spot] >= 0))
        while len(open_):  # a few collide
            spot[open_] = (spot[open_] + 1) % (1 << self.table_bits)
            here = spot[open_]
            hit = (self.table_key[here] == keys[open_]) & (self.table_id[here] >= 0)
            found[open_[hit]] = self.table_id[here[hit]]
            open_ = open_[~hit & (self.table_id[here] >= 0)]
        return found

    def _forward_all(self, data: np.ndarray, sums: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass of many units of known bytes at once, place by place: (ids of all, sizes, scores, losses).

        Units with a character of several bytes that is no piece aren't reached to their end; their size is -1.
        """
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n, most = len(size), int(size[0])
        best, second = np.full((most + 1, n), _NONE, np.int64), np.full((most + 1, n), _NONE, np.int64)
        step, piece = np.zeros((most + 1, n), np.int16), np.zeros((most + 1, n), np.int32)
        best[0] = 0
        for t in range(1, most + 1):
            live = int(np.searchsorted(-size, -t, "right"))  # units of at least t bytes come first
            now, other, back, which = best[t, :live], second[t, :live], step[t, :live], piece[t, :live]
            end = start[:live] + t
            for length in range(min(t, self.longest), 0, -1):
                ids = self._ids_at(rough_hash(sums, end - length, end))
                hit = np.flatnonzero((ids >= 0) & (best[t - length, :live] > _NONE))
                if not len(hit):
                    continue
                gain = self.score_of[ids[hit]]
                score, less = best[t - length, hit] + gain, second[t - length, hit] + gain
                old = now[hit]
                better = score > old
                other[hit] = np.where(better, np.maximum(old, less), np.maximum(other[hit], np.maximum(score, less)))
                won = hit[better]
                now[won], back[won], which[won] = score[better], length, ids[hit][better]
        column = np.arange(n)
        total, runner = best[size, column], second[size, column]
        losses = np.where(runner > _NONE // 2, (total - runner).astype(float), np.inf)
        reached = total > _NONE
        at, backward = np.where(reached, size, 0), []
        while at.any():
            on = np.flatnonzero(at)
            backward.append((on, piece[at[on], on]))
            at[on] -= step[at[on], on]
        sizes = np.zeros(n, np.int64)
        for on, _ in backward:
            sizes[on] += 1
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if n else 0, self.kind)
        for k, (on, ids) in enumerate(backward):
            out[ends[on] - 1 - k] = ids
        # back to the order of the units
        place = np.empty(n, np.int64)
        place[order] = column
        final = np.where(reached, sizes, -1)[place]
        begin = (ends - sizes)[place]
        keep = np.maximum(final, 0)
        spread = np.concatenate([[0], np.cumsum(keep)])
        ids = out[np.repeat(begin - spread[:-1], keep) + np.arange(spread[-1])]
        return ids, final, total[place], losses[place]

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best pieces of many units in one array, how many each has, their scores, and what the second-best way loses."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        data, start = np.frombuffer(b"".join(units), np.uint8), np.cumsum(size) - size
        short, slow, parts, sums = np.flatnonzero(size <= _SHORT), [np.flatnonzero(size > _SHORT)], [], rough_sums(data)
        for at in range(0, len(short), 16384):
            some = short[at : at + 16384]
            ids, sizes, scores, losses = self._forward_all(data, sums, start[some], size[some])
            ok = sizes >= 0
            if b"".join(map(self.bytes_of.__getitem__, ids.tolist())) != b"".join([units[k] for k in some[ok].tolist()]):
                ok[:] = False  # a hash of other bytes than a piece's: all of these one by one
                ids = ids[:0]
            slow.append(some[~ok])
            parts.append((some[ok], ids, sizes[ok], scores[ok], losses[ok]))
        for i in np.concatenate(slow).tolist():
            own, score, loss = self.unit(units[i].decode())
            ids = np.frombuffer(own, self.kind)
            parts.append((np.array([i]), ids, np.array([len(ids)]), np.array([score]), np.array([loss], float)))
        place, ids, sizes, scores, losses = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.argsort(place)
        begin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        ends = np.cumsum(sizes)
        return ids[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]))], sizes, scores[order], losses[order]

    def encode_all(self, column: pa.Array, n: int) -> list[tuple[np.ndarray, int, list]]:
        """encode() for a column of texts: units are found, looked up and joined for all of them at once."""
        filled = pc.fill_null(column, "")
        padded = pc.if_else(pc.equal(pc.binary_length(filled), 0), "", pc.binary_join_element_wise("", filled, " "))
        data, rows = flat(padded)
        if not len(data):
            return [(np.zeros(0, self.kind), 0, []) for _ in range(len(column))]
        blank = data == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[rows[:-1][np.diff(rows) > 0]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(data)))
        ids, ends, scores, losses = self.memory.best(*distinct(data, np.append(start, len(data))))
        ids, ends = ids.astype(self.kind), np.concatenate([[0], ends])
        first = np.searchsorted(start, rows)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            score, others = int(scores[a:b].sum()), []
            if n > 1 and b > a:
                few = np.sort(_smallest(losses[a:b], min(n - 1, b - a)))
                chosen = [data[start[a + i] : start[a + i] + size[a + i]].tobytes().decode() for i in few.tolist()]
                best = [tuple(ids[ends[a + i] : ends[a + i + 1]].tolist()) for i in few.tolist()]
                rest = score - int(scores[a + few].sum())
                for total, parts in self.n_best(chosen, n):
                    others.append((total + rest, [(int(few[i]), p) for i, p in enumerate(parts) if p != best[i]]))
            out.append((ids[ends[a] : ends[b]], score, others))
        return out

    def edges(self, unit: str, at: int) -> list[tuple[int, tuple[int, ...], int]]:
        """(end, ids, score) of the pieces that start at a place of a unit."""
        found = []
        for n in (1, *self.lengths.get(unit[at : at + 2], ())):
            if at + n > len(unit):
                break
            hit = self.id.get(unit[at : at + n])
            if hit is not None:
                found.append((at + n, (hit[0],), hit[1]))
        if unit[at] not in self.id:
            data = unit[at].encode()
            found.append((at + 1, tuple(self.byte[b] for b in data), self.unknown * len(data)))
        return found

    def forward(self, unit: str) -> tuple[list, list, list]:
        """Best score and last edge at each place, and the score of the second-best way there."""
        n = len(unit)
        best, second, back = [_NONE] * (n + 1), [_NONE] * (n + 1), [None] * (n + 1)
        best[0] = 0
        ids, lengths = self.id, self.lengths
        for at in range(n):
            here, other = best[at], second[at]
            if here == _NONE:
                continue
            c = unit[at]
            hit = ids.get(c)
            if hit is None:
                data = c.encode()
                hit = tuple(self.byte[b] for b in data), self.unknown * len(data)
            end, (piece, gain) = at + 1, hit
            for length in (0, *lengths.get(unit[at : at + 2], ())):
                if length:
                    end = at + length
                    if end > n:
                        break
                    hit = ids.get(unit[at:end])
                    if hit is None:
                        continue
                    piece, gain = hit
                score = here + gain
                if score > best[end]:
                    best[end], second[end], back[end] = score, best[end], (at, piece)
                elif score > second[end]:
                    second[end] = score
                if other + gain > second[end]:
                    second[end] = other + gain
        return best, second, back

    def unit(self, unit: str) -> tuple[bytes, int, float]:
        """(ids, score, loss of the second-best segmentation) of a unit."""
        known = self.units.get(unit)
        if known is None:
            best, second, back = self.forward(unit)
            out, at = [], len(unit)
            while at:
                at, ids = back[at]
                if ids.__class__ is tuple:
                    out.extend(reversed(ids))
                else:
                    out.append(ids)
            out.reverse()
            loss = best[-1] - second[-1] if second[-1] > _NONE / 2 else float("inf")
            known = np.array(out, self.kind).tobytes(), best[-1], loss
            if len(self.units) >= REMEMBERED:
                self.units.clear()
            if len(unit) <= _SHORT:
                self.units[unit] = known
        return known

    def n_best(self, units: list[str], n: int) -> list[tuple[int, list[tuple[int, ...]]]]:
        """The n best (score, ids of each unit) of a chain of units: backward A-star, exact forward scores as estimate.

        Of ways with equal estimates the one nearest to the start goes first, so ties, of which a run of one letter has
        exponentially many, are finished one by one and never unfolded side by side.
        """
        if not units:
            return [(0, [])]
        forward = [self.forward(u)[0] for u in units]
        incoming = []
        for u in units:
            into: list[list] = [[] for _ in range(len(u) + 1)]
            for at in range(len(u)):
                for end, ids, score in self.edges(u, at):
                    into[end].append((at, ids, score))
            incoming.append(into)
        prefix = [0]
        for f in forward:
            prefix.append(prefix[-1] + f[-1])
        tick = 0
        heap = [(-prefix[-1], len(units) - 1, len(units[-1]), 0, 0, None)]  # estimate, unit, place, order, score so far, way
        found = []
        while heap and len(found) < n:
            estimate, k, at, _, gained, way = heapq.heappop(heap)
            if at == 0 and k == 0:
                ids: list[list[int]] = [[] for _ in units]
                while way is not None:
                    unit, piece, way = way
                    ids[unit].extend(piece)
                found.append((-estimate, [tuple(x) for x in ids]))
                continue
            if at == 0:
                k, at = k - 1, len(units[k - 1])
            for start, piece, score in incoming[k][at]:
                left = forward[k][start]
                if left != _NONE:
                    tick += 1
                    heapq.heappush(heap, (-(gained + score + left + prefix[k]), k, start, -tick, gained + score, (k, piece, way)))
        return found

    def encode(self, text: str, n: int = 1) -> tuple[np.ndarray, int, list[tuple[int, list[tuple[int, tuple[int, ...]]]]]]:
        """(ids, score, alternatives); an alternative is (score, [(unit, its ids)]) where it differs from the best."""
        units = _UNIT.findall(" " + text) if text else []
        look, unit = self.units.get, self.unit
        known = [look(u) or unit(u) for u in units]
        ids = np.frombuffer(b"".join([k[0] for k in known]), self.kind)
        score = sum([k[1] for k in known])
        if n < 2 or not units:
            return ids, score, []
        few = np.sort(_smallest(np.array([k[2] for k in known]), min(n - 1, len(units))))
        chosen = [units[i] for i in few]
        rest = score - sum(known[i][1] for i in few)
        best = [tuple(np.frombuffer(known[i][0], self.kind).tolist()) for i in few]
        others = []
        for total, parts in self.n_best(chosen, n):
            others.append((total + rest, [(int(few[i]), p) for i, p in enumerate(parts) if p != best[i]]))
        return ids, score, others

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, the blank before it taken off; bytes join to characters."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if not self.is_byte[ids].any():
            return "".join(self.plain[ids].tolist())[1:]
        out: list[str] = []
        held = bytearray()
        for i in ids.tolist():
            if i in self.byte_value:
                held.append(self.byte_value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.plain[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)[1:]


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest values, earlier ones of equals."""
    top = np.partition(values, n - 1)[n - 1]
    below = np.flatnonzero(values < top)
    return np.concatenate([below, np.flatnonzero(values == top)[: n - len(below)]])


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


_OTHERS = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(pa.struct([("unit", pa.int32()), ("pieces", pa.list_(pa.int32()))])))]))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)))


def _encode(batches, path: str, n: int, names: list[str], check: str | None):
    model = pieces(path)
    for part in slices(batches, most=2 << 20):
        rows = model.encode_all(part.column("text"), n)
        others = [[{"score": s, "changes": [{"unit": u, "pieces": p} for u, p in c]} for s, c in r[2]] for r in rows]
        back = [pa.array([model.decode(r[0]) == t for r, t in zip(rows, part.column("text").to_pylist(), strict=True)], pa.bool_())] if check else []
        columns = [*(part.column(c) for c in names), _lists([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array(others, _OTHERS), *back]
        yield pa.RecordBatch.from_arrays(columns, [*names, "pieces", "score", "n_best", *([check] if check else [])])


def encode_pieces(documents: DataFrame, path: str, n: int = 1, keep: tuple[str, ...] = ("doc_id",), check: str | None = None) -> DataFrame:
    """The kept columns, pieces (ids of the best segmentation), its score, and n_best: the n best segmentations by score,
    each with the units in which it differs from the best (empty for n = 1). A column named by `check` says whether the
    pieces decode to the text again.

    A null or empty text has no pieces and score 0. Ties of score keep the first found, which depends on the
    text alone. Repeated rows are each encoded; other columns are ignored. A kept text is empty where it was null.
    """
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    rows = texts(documents, *(c for c in keep if c != "text"))
    schema = f"{kinds}, pieces array<int>, score long, n_best array<struct<score:long,changes:array<struct<unit:int,pieces:array<int>>>>>" + (f", `{check}` boolean" if check else "")
    return rows.mapInArrow(lambda b: _encode(b, path, n, list(keep), check), schema)


def _decode(batches, path: str, names: list[str], into: str):
    model = pieces(path)
    for batch in batches:
        column = batch.column("pieces")
        at, ids = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([model.decode(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())], [*names, into])


def decode_pieces(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), into: str = "text") -> DataFrame:
    """The kept columns and, in a column of the given name, the text of the pieces; no pieces (or null) are an empty text.

    Ids without a text of their own (control pieces) are skipped.
    """
    schema = StructType([*(encoded.schema[c] for c in keep), StructField(into, StringType())])
    rows = encoded.withColumn("pieces", F.coalesce("pieces", F.array().cast("array<int>"))).select(*keep, *(() if "pieces" in keep else ("pieces",)))
    return rows.mapInArrow(lambda b: _decode(b, path, list(keep), into), schema)


def encode_and_decode(documents: DataFrame, path: str, n: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of encode_pieces() with n_pieces, the n best scores as text, and round_trip: whether decoding gives the text back."""
    encoded = encode_pieces(documents, path, n, keep, "round_trip")
    scores = F.concat_ws(",", F.transform("n_best", lambda x: x["score"].cast("string")))
    return encoded.select(*keep, F.size("pieces").cast("long").alias("n_pieces"), "score", scores.alias("best_scores"), "round_trip", "pieces", "n_best")
