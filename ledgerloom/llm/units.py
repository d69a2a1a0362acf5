"""Texts as rows of short units that tokenizers treat one by one, each distinct unit encoded once per worker.

Units are told apart by their bytes, never by a hash alone, so what a worker remembers changes no result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units, and bytes of units, that a worker remembers; beyond that it starts afresh.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 64 << 20


def spaced(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a space before each row that is not empty."""
    size = np.diff(rows)
    shift = np.cumsum(size > 0)
    out = np.full(len(data) + int(shift[-1] if len(shift) else 0), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out, np.concatenate([[0], rows[1:] + shift])


def after_words(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where units start: at each row that is not empty and at each space that follows a character surely not white space, and the end."""
    start = data == 32
    if len(data):
        before = np.concatenate([[32], data[:-1]])
        start &= before > 32
        start &= before != 127
        # white space of several bytes starts with C2, E1 9A, E2 80, E2 81 or E3 80
        wide = before >= 128
        two, three = np.concatenate([[0], before[:-1]]), np.concatenate([[0, 0], before[:-2]])
        start &= ~(wide & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & np.isin(two, (0x9A, 0x80, 0x81)))))
        start[rows[:-1][np.diff(rows) > 0]] = True
    return np.append(np.flatnonzero(start), len(data))


def words_of(data: np.ndarray, rows: np.ndarray, whole: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without spaces and line ends, where words start in them (and the end), and the first word of each row.

    A-Z are folded, but not in words that hold the two bytes given: those may be names whose case counts.
    """
    blank = (data == 32) | (data == 10)
    start = ~blank
    if len(data):
        start[1:] &= blank[:-1]
        start[rows[:-1][np.diff(rows) > 0]] = True
        start &= ~blank
    keep = ~blank
    at = np.flatnonzero(start)
    place = np.concatenate([[0], np.cumsum(keep)])
    body, edges = data[keep], np.append(place[at], place[-1])
    upper = (body >= 65) & (body <= 90)
    named = np.flatnonzero((body[:-1] == whole[0]) & (body[1:] == whole[1]))
    if len(named):
        which = np.unique(np.searchsorted(edges, named, "right") - 1)
        marks = np.zeros(len(body) + 1, np.int8)
        marks[edges[which]] += 1
        marks[edges[which + 1]] -= 1
        upper &= np.cumsum(marks[:-1]) == 0
    return np.where(upper, body + np.uint8(32), body), edges, np.searchsorted(at, rows)


def distinct(data: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different units between consecutive edges, and which of them each unit is."""
    if len(edges) < 2:
        return [], np.zeros(0, np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    coded = pc.dictionary_encode(units)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


Flat = tuple[np.ndarray, np.ndarray]


def flat_lists(lists: list[list[int]]) -> Flat:
    """All ids one after the other, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class Memory:
    """Ids of units for one or more encoders; each gives the ids of many units, and how many each has.

    Units are found by a hash and then compared byte by byte; one that differs is encoded again each time.
    """

    def __init__(self, *encoders: Callable[[list[bytes]], Flat], most: int = REMEMBERED):
        self.encoders, self.most = encoders, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text, self.held = _Lists(np.uint8), [_Lists(np.int32) for _ in self.encoders]

    def _known(self, keys: np.ndarray, body: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each unit, -1 where there's none with its bytes."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        slots = np.where(self.keys[at] == keys, self.slots[at], -1)
        slots[(slots >= 0) & (self.text.size[slots] != size)] = -1
        hits = np.flatnonzero(slots >= 0)
        stored, ends = self.text.take(slots, hits)
        here = np.repeat(slots >= 0, size)
        wrong = np.searchsorted(ends, np.flatnonzero(stored != body[here]), "right")
        slots[hits[wrong]] = -1
        return slots

    def look_up(self, units: list[bytes], which: np.ndarray) -> list[Flat]:
        """For each encoder, the ids of the units which[0], which[1], ... in one array, and where each one's end; units are distinct."""
        slots = self.find(units)
        return [lists.take(slots, which) for lists in self.held]

    def find(self, units: list[bytes]) -> np.ndarray:
        """The slots of distinct units, new ones encoded in their order."""
        if self.text.count + len(units) > self.most or self.text.used > REMEMBERED_BYTES:
            self._clear()
        keys, size = np.fromiter(map(hash, units), np.int64, len(units)), np.fromiter(map(len, units), np.int64, len(units))
        slots = self._known(keys, np.frombuffer(b"".join(units), np.uint8), size)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            new, count = [units[k] for k in fresh.tolist()], self.text.count
            self.text.add(np.frombuffer(b"".join(new), np.uint8), size[fresh])
            for encode, lists in zip(self.encoders, self.held, strict=True):
                lists.add(*encode(new))
            slots[fresh] = np.arange(count, self.text.count)
            order = fresh[np.argsort(keys[fresh], kind="stable")]
            at = np.searchsorted(self.keys, keys[order])
            self.keys, self.slots = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, slots[order])
        return slots


class _Lists:
    """Lists of numbers one after the other."""

    def __init__(self, kind: type) -> None:
        self.count = self.used = 0
        self.end, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, kind)

    def add(self, new: np.ndarray, sizes: np.ndarray) -> None:
        stop, used = self.count + len(sizes), self.used + len(new)
        self.ids, self.size, self.end = _room(self.ids, used), _room(self.size, stop), _room(self.end, stop)
        self.ids[self.used : used], self.size[self.count : stop], self.end[self.count : stop] = new, sizes, self.used + np.cumsum(sizes)
        self.count, self.used = stop, used

    def take(self, slots: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = slots[which]
        size = self.size[slots].astype(np.int64)
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.end[slots] - ends, size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])
