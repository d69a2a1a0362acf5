"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Patterns are the windows of consecutive benchmark words. Patterns of one length share a shift table over
blocks of two words: it says how far the search may jump before any pattern can end. Where the shift is
nought, the hash of the last block picks a bucket of patterns, and comparing the words themselves confirms
an occurrence. Documents are only scanned, never shuffled.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import ALPHANUMERIC, Words, chain, slices
from .shared import cut, packed, texts, unpacked

#: The most benchmark words that are searched for, and broadcast, at once; a larger benchmark is searched in blocks.
BLOCK_WORDS = 400_000
_BITS = 18


class Patterns:
    """Windows of one block of items, by length, with their shift tables."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        column = pa.array([text for _, text in items], pa.large_string())
        words = Words(column, ALPHANUMERIC)
        for (name, _), a, b in zip(items, words.first[:-1], words.first[1:], strict=True):
            own = [words.word(i) for i in range(a, b)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners[tuple(own[i : i + window])].add(name)
        by_length = defaultdict(list)
        for text in owners:
            by_length[len(text)].append(text)
        self.owners = dict(owners)
        self.groups = [self._group(m, by_length[m]) for m in sorted(by_length)]

    @staticmethod
    def _group(m: int, patterns: list[tuple[bytes, ...]]):
        width = min(2, m)
        words = Words(pa.array([b" ".join(p) for p in patterns], pa.large_binary()), ALPHANUMERIC)
        rows = words.hash.reshape(len(patterns), m)
        shift = np.full(1 << _BITS, min(255, m - width + 1), np.uint8)
        buckets = defaultdict(list)
        for j in range(m - width + 1):  # a block that ends j + width words into a pattern
            blocks = chain(np.ascontiguousarray(rows[:, j : j + width]).ravel(), width)[::width]
            np.minimum.at(shift, (blocks >> np.uint64(64 - _BITS)).astype(np.int64), min(255, m - width - j))
        for block, p in zip(blocks.tolist(), patterns, strict=True):  # those of the last column
            buckets[block].append(p)
        return m, width, shift, dict(buckets)

    def occurrences(self, words: Words) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(index of its first word, pattern) of every occurrence within a row."""
        row_end = np.repeat(words.first[1:], words.count())
        for m, width, shift, buckets in self.groups:
            blocks = chain(words.hash, width)
            jumps = shift[(blocks >> np.uint64(64 - _BITS)).astype(np.int64)].tobytes()
            i, n, hits = m - width, len(jumps), []
            while i < n:
                jump = jumps[i]
                if jump:
                    i += jump
                else:
                    hits.append(i)
                    i += 1
            for i in hits:
                first = i + width - m
                if first + m > row_end[first]:
                    continue
                for pattern in buckets.get(int(blocks[i]), ()):
                    if all(words.word(first + k) == w for k, w in enumerate(pattern)):
                        yield first, pattern


_FOUND = "items array<string>, spans array<struct<start:long,end:long>>"
_ITEMS, _SPANS = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(patterns: Patterns, batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(slice, n_words, n_hit, items, spans), with what earlier blocks of the benchmark found."""
    for part in slices(batches):
        words = Words(part.column("text"), ALPHANUMERIC)
        items: dict[int, set[str]] = defaultdict(set)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, into in (("items", items), ("spans", spans)):
            if name in part.schema.names:
                for row, known in enumerate(part.column(name).to_pylist()):
                    if known:
                        into[row] = set(known) if name == "items" else [(s["start"], s["end"]) for s in known]
        for first, pattern in patterns.occurrences(words):
            row = int(np.searchsorted(words.first, first, "right")) - 1
            items[row] |= patterns.owners[pattern]
            spans[row].append((first - int(words.first[row]), first - int(words.first[row]) + len(pattern)))
        merged = {row: _merged(found) for row, found in spans.items()}
        n_hit = np.array([sum(s["end"] - s["start"] for s in merged.get(r, ())) for r in range(part.num_rows)], np.int64)
        yield (
            part,
            words.count(),
            n_hit,
            pa.array([sorted(items[r]) if r in items else [] for r in range(part.num_rows)], _ITEMS),
            pa.array([merged.get(r, []) for r in range(part.num_rows)], _SPANS),
        )


def _pass(patterns: Patterns, batches, carried: list[str]):
    for part, _, _, items, spans in _scan(patterns, batches):
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), items, spans], [*carried, "items", "spans"])


def _report(patterns: Patterns, batches):
    for part, n_words, n_hit, items, spans in _scan(patterns, batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit), items, spans], ["doc_id", "n_words", "n_hit", "items", "spans"])


def _clean(patterns: Patterns, batches, carried: list[str]):
    for part, n_words, n_hit, _, _ in _scan(patterns, batches):
        yield part.select(carried).filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _build(rows: pa.Table, window: int) -> pa.Table:
    items = list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True))
    return pa.table({"block": rows.column("block")[:1], "patterns": pa.array([pickle.dumps(Patterns(items, window))], pa.binary())})


def _blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[Patterns, bool]]:
    """The benchmark's distinct items as blocks of bounded size, built in tasks, and whether each is the last."""
    items = texts(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), "item_id").distinct()
    sized = items.withColumn("n", F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = int(total // BLOCK_WORDS) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    built = cut(dealt.groupBy("block").applyInArrow(lambda rows: _build(rows, window), "block long, patterns binary"))
    for block in range(blocks):
        found = built.where(F.col("block") == block).first()
        yield (Patterns([], window) if found is None else pickle.loads(found["patterns"])), block == blocks - 1


def _searched(rows: DataFrame, benchmark: DataFrame, window: int):
    """The rows with what all blocks but the last found in them, and the last block as a broadcast."""
    carried = rows.columns
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(_FOUND).fields])
    for patterns, last in _blocks(benchmark, window):  # each pass adds to what the one before has found
        held = rows.sparkSession.sparkContext.broadcast(patterns)
        if last:
            return rows, held
        rows = cut(rows.mapInArrow(lambda batches, held=held: _pass(held.value, batches, carried), schema))
        held.destroy()


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (ids of the items with a window in it, sorted as strings), spans (hit word ranges).

    Null and empty texts have no words and no hits; an item of fewer words than the window is one window;
    repeated document or item rows are each searched; an item without id counts as the item "". An empty
    benchmark hits nothing. Columns other than doc_id, item_id and text are ignored, whatever their names.
    """
    key = documents.schema["doc_id"].dataType.simpleString()
    rows, held = _searched(texts(documents, "doc_id"), benchmark, window)
    return rows.mapInArrow(lambda batches: _report(held.value, batches), f"doc_id {key}, n_words long, n_hit long, {_FOUND}")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, a digest of the item ids and the verdict."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, all columns kept. Each row is judged by its own text, whatever its doc_id."""
    packed_rows = packed(documents, "text")
    rows, held = _searched(packed_rows, benchmark, window)
    kept = rows.mapInArrow(lambda batches: _clean(held.value, batches, ["text", "row"]), packed_rows.schema)
    return unpacked(kept, documents.columns, "text")
