"""Cross-tokenizer alignment: which tokens of two tokenizers lie on the same bytes.

A task encodes its texts with both tokenizers (each distinct word once) and merges the two rows of token ends in
lockstep: one vector of pointers into the A tokens and one into the B tokens, a place for each lane, advance together;
each step links the tokens that all lanes point at, cuts where both end, and drops the lanes that are done. A lane
is a document, or, of a longer one, a part of about LANE tokens between places where both tokenizers end.

How often a pair of ids is linked in the whole corpus decides which links are best. The commonest pairs (HELD at most)
go to all tasks as two sorted arrays; links of rarer pairs are joined with their counts, summed by document first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import flat, slices
from .shared import cut, texts
from .units import Memory, after_words, distinct, flat_lists, spaced

#: Tokens after which a lane ends at the next common end.
LANE = 64
#: Pairs whose counts all tasks hold: 12 bytes each.
HELD = 1 << 20
#: Distinct units that a worker remembers with the ids of both tokenizers, some 100 bytes each.
REMEMBERED = 500_000

_pairs: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """A byte-level BPE (A) and a piece vocabulary with byte fallback that adds a space before a text (B)."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [_level(a.id_to_token(i) or "") for i in range(a.get_vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
        self.pair = np.int32 if len(self.a_bytes) * len(self.b_bytes) < 1 << 31 else np.int64
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        space = [b.piece_to_id("▁")]
        self.lossy: set[bytes] = set()  # units that a tokenizer does not give back
        encode_a = lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
        self.memory = Memory(
            lambda units: self._checked(units, *_together(units, encode_a, self.a_size), self.a_bytes),
            # a unit starts with the space that the tokenizer adds
            lambda units: self._checked(units, *flat_lists([ids or space for ids in b.encode([u[1:].decode() for u in units], num_threads=1)]), self.b_bytes),
            most=REMEMBERED,
        )
        names = [f"{i}{mark}" for mark, size in ((",", len(self.a_size)), ("|", len(self.a_size)), (",", len(self.b_size)), (";", len(self.b_size))) for i in range(size)]
        self.names = pa.array([n.encode() for n in names], pa.large_binary())


    def _checked(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if b"".join(map(names.__getitem__, ids.tolist())) != b"".join(units):
            ends = np.cumsum(sizes).tolist()
            self.lossy.update(u for u, a, b in zip(units, [0, *ends], ends, strict=False) if b"".join(map(names.__getitem__, ids[a:b].tolist())) != u)
        return ids, sizes


def _together(units: list[bytes], encode: Callable[[list[str]], list[list[int]]], size: np.ndarray, most: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units that start with a space, many in one text: where one ends in a visible ASCII character, no token reaches from it into the next."""
    texts, held, length = [], [], 0
    for unit in units:
        held.append(unit)
        length += len(unit)
        if not 32 < unit[-1] < 127 or length >= most:
            texts.append(b"".join(held).decode())
            held, length = [], 0
    texts += [b"".join(held).decode()] if held else []
    ids, _ = flat_lists(encode(texts))
    ends, stops = np.cumsum(size[ids]), np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
    return ids, np.diff(np.searchsorted(ends, stops, "right"), prepend=0)


def _level(token: str) -> bytes:
    """The bytes that a token of the byte-level alphabet stands for: visible characters for themselves, from U+0100 on the others in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return bytes(ord(c) if ord(c) < 256 else others[ord(c) - 256] for c in token)


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Tokenizers(a_path, b_path)
    return _pairs[a_path, b_path]


def merge(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A place, B place) and cuts (last A place, last B place) of all lanes, in lockstep from their first tokens to the byte where they stop."""
    links, cuts, a, b = [], [], a_at, b_at
    while len(a):
        at_a, at_b = a_end[a], b_end[b]
        links.append((a, b))
        both = at_a == at_b
        cuts.append((a[both], b[both]))
        going = np.minimum(at_a, at_b) < stop
        a, b = a + (at_a <= at_b), b + (at_b <= at_a)
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    none = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    (link_a, link_b), (cut_a, cut_b) = ((np.concatenate(x) for x in zip(*found, strict=True)) for found in (links or none, cuts or none))
    return link_a, link_b, cut_a, cut_b


def lanes(a_end: np.ndarray, b_end: np.ndarray, unit_end: np.ndarray, rows_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A and B tokens and the last byte of each lane; units end where both tokenizers do, and rows where units do."""
    stops = unit_end
    a_next = np.searchsorted(a_end, stops, "right")
    if len(stops) and (long := np.diff(a_next, prepend=0) > LANE).any():  # units without a space inside: any common end will do
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        owner = np.searchsorted(stops, common)
        stops = np.union1d(stops, common[long[owner]])
        a_next = np.searchsorted(a_end, stops, "right")
    bucket = a_next // LANE
    keep = np.append(bucket[1:] != bucket[:-1], True) if len(stops) else np.zeros(0, bool)
    keep[np.searchsorted(stops, rows_end)] = True
    stops = stops[keep]
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    return np.searchsorted(a_end, starts, "right"), np.searchsorted(b_end, starts, "right"), stops


def _whole(ids: np.ndarray, ends: np.ndarray, names: list[bytes], data: np.ndarray, rows: np.ndarray, first: np.ndarray, doubtful: np.ndarray) -> np.ndarray:
    """Whether the tokens of each row joined are its bytes; only rows with a unit that is not given back are looked at."""
    at, good = np.concatenate([[0], ends])[first], np.ones(len(rows) - 1, bool)
    for k in doubtful.tolist():
        good[k] = b"".join(map(names.__getitem__, ids[at[k] : at[k + 1]].tolist())) == data[rows[k] : rows[k + 1]].tobytes()
    return good


def _tokens(both: Tokenizers, column: pa.Array) -> tuple[np.ndarray, tuple, tuple, np.ndarray, np.ndarray]:
    """Which rows have tokens; ids and row starts of A and of B over these rows; ends of their units and rows in bytes."""
    data, rows = spaced(*flat(column))
    edges = after_words(data, rows)
    units, which = distinct(data, edges)
    first = np.searchsorted(edges[:-1], rows)
    found = both.memory.look_up(units, which)
    good, units_of = np.diff(rows) > 0, np.repeat(np.arange(len(rows) - 1), np.diff(first))
    lossy = np.fromiter((u in both.lossy for u in units), bool, len(units))
    doubtful = np.unique(units_of[lossy[which]]) if lossy.any() else np.zeros(0, np.int64)
    for (ids, ends), names in zip(found, (both.a_bytes, both.b_bytes), strict=True):
        good &= _whole(ids, ends, names, data, rows, first, doubtful)
    kept, out = good[units_of], []
    for ids, ends in found:
        size = np.diff(ends, prepend=0)
        out.append((ids[np.repeat(kept, size)].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(units_of, size * kept, len(rows) - 1))]).astype(np.int64)))
    return good, *out, np.cumsum(np.diff(edges)[kept]), np.cumsum(np.diff(rows)[good])


def align_rows(both: Tokenizers, column: pa.Array) -> dict[str, pa.Array]:
    """Of each row of a slice: ids of both tokenizers, tokens of each in every group, linked pairs in the order of the text, counts and the digest of the groups."""
    good, (a, a_rows), (b, b_rows), unit_end, rows_end = _tokens(both, column)
    n = len(column)
    a_end, b_end = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    link_a, link_b, cut_a, cut_b = merge(a_end, b_end, *lanes(a_end, b_end, unit_end, rows_end))
    order = np.argsort(link_a * (len(b) + 1) + link_b, kind="stable")
    link_a, link_b = link_a[order], link_b[order]
    row_of_a = np.repeat(np.arange(n), np.diff(a_rows))
    links = np.bincount(row_of_a[link_a], minlength=n) if len(link_a) else np.zeros(n, np.int64)
    cut_a, cut_b = np.sort(cut_a), np.sort(cut_b)
    groups = np.bincount(row_of_a[cut_a], minlength=n) if len(cut_a) else np.zeros(n, np.int64)
    # the text of the groups: every token's number and mark at its place, A tokens of a group before its B tokens
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[cut_a], b_last[cut_b] = True, True
    group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    b_before, a_before = np.concatenate([[0], cut_b + 1]), cut_a + 1
    spot = np.zeros(len(a) + len(b), np.int64)
    spot[np.arange(len(a)) + b_before[group_a]] = a + a_last * len(both.a_size)
    spot[np.arange(len(b)) + (a_before[group_b] if len(b) else 0)] = 2 * len(both.a_size) + b + b_last * len(both.b_size)
    body, at = flat(pc.take(both.names, pa.array(spot)))
    edges = at[a_rows + b_rows].tolist()
    digests = [hashlib.sha256(body[x : max(x, y - 1)]).hexdigest() if ok else "" for x, y, ok in zip(edges[:-1], edges[1:], good.tolist(), strict=True)]  # the last group has no mark after it
    return {
        "n_a": pa.array(np.diff(a_rows)), "n_b": pa.array(np.diff(b_rows)), "n_groups": pa.array(groups), "n_links": pa.array(links), "groups_sha256": pa.array(digests, pa.string()),
        "pairs": _lists(links, (a[link_a] * len(both.b_size) + b[link_b]).astype(both.pair)), "a_tokens": _lists(np.diff(a_rows), a), "b_tokens": _lists(np.diff(b_rows), b),
        "a_group_sizes": _lists(groups, np.diff(cut_a, prepend=-1)), "b_group_sizes": _lists(groups, np.diff(cut_b, prepend=-1)),
    }


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


_ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")
_GROUPS = ("a_tokens", "b_tokens", "a_group_sizes", "b_group_sizes")


def align(documents: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """Per document row: doc_id, row (its own number), n_a, n_b, n_groups, n_links, groups_sha256, and pairs, its links in order as A id * size of B + B id.

    With groups also the ids of both tokenizers and how many of each a group has. A text that is null or empty, or that one of the
    tokenizers does not give back, has no tokens: zeros and an empty digest. Repeated rows are aligned each; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = (*_ALIGNED, *(_GROUPS if groups else ()))

    def run(batches: Iterable[pa.RecordBatch]):
        both, count = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 40
        for part in slices(batches):
            found = align_rows(both, part.column("text"))
            row = pa.array(np.arange(count, count + part.num_rows))
            count += part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), row, *(found[n] for n in names)], ["doc_id", "row", *names])

    pair = "int" if tokenizers(a_path, b_path).pair is np.int32 else "long"
    lists = ", ".join(f"{n} array<{pair if n == 'pairs' else 'long'}>" for n in names[5:])
    return texts(documents, "doc_id").mapInArrow(run, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {lists}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): the links of each pair of ids over all documents."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _parts(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterable[pa.RecordBatch]:
    """The batches cut at about so many links."""
    for batch in batches:
        at, start = batch.column("pairs").offsets.to_numpy(), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _commonest(counts: DataFrame, held: int) -> int:
    """The least count from which on no more than so many pairs are left; levels of counts are some four hundredths apart."""
    level = F.floor(F.log2("n") * 16)
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("n")).collect(), key=lambda r: -r["level"])
    least, total = (levels[0]["n"] + 10**9 if levels else 1), 0  # over a thousand levels at most
    for r in levels:
        total += r["pairs"]
        if total > held:
            break
        least = r["n"]
    return least


def _values(pairs: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count of each pair, and whether it is known."""
    at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
    there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
    return np.where(there, counts[at] if len(known) else 0, 0), there


def score_links(aligned: DataFrame, b_size: int, held: int = HELD) -> DataFrame:
    """The rows of align() with n_best, their links whose pair is the commonest of its B id (ties included), and count_sum, the counts of all their links.

    aligned is a written table: its row numbers stay as they are.
    """
    spark = aligned.sparkSession
    counts = cut(pair_counts(aligned))
    best = np.zeros(b_size, np.int64)
    for r in counts.groupBy((F.col("pair") % b_size).cast("int").alias("b")).agg(F.max("n").alias("n")).collect():  # one a B id
        best[r["b"]] = r["n"]
    least = _commonest(counts, held)
    common = counts.where(F.col("n") >= least).toPandas().sort_values("pair")  # at most `held`
    known = spark.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), best))
    columns = [c for c in aligned.columns if c not in ("pairs", *_GROUPS)]

    def sums(batches: Iterable[pa.RecordBatch]):
        pairs_known, n_known, best_of = known.value
        for batch in _parts(batches):
            offsets, pairs = batch.column("pairs").offsets.to_numpy(), batch.column("pairs").values.to_numpy(zero_copy_only=False)
            pairs = pairs[offsets[0] : offsets[-1]]
            n, there = _values(pairs, pairs_known, n_known)
            top = np.concatenate([[0], np.cumsum(there & (n == best_of[pairs % b_size]))])[offsets - offsets[0]]
            total = np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.diff(top), pa.int64()), pa.array(np.diff(total), pa.int64())], [*columns, "n_best", "count_sum"])

    def rare(batches: Iterable[pa.RecordBatch]):
        pairs_known, n_known, best_of = known.value
        for batch in _parts(batches):
            column, row = batch.column("pairs"), batch.column("row").to_numpy()
            pairs = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(row, pc.list_value_length(column).to_numpy(zero_copy_only=False))
            left = ~_values(pairs, pairs_known, n_known)[1]
            both, times = np.unique(np.stack([rows[left], pairs[left]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(times, pa.int64()), pa.array(best_of[both[:, 1] % b_size])], ["row", "pair", "times", "best"])

    out = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in columns)
    first = aligned.select(*columns, "pairs").mapInArrow(sums, f"{out}, n_best long, count_sum long")
    others = counts.where(F.col("n") < least)
    if others.isEmpty():
        return first
    links = aligned.select("row", "pairs").mapInArrow(rare, "row long, pair long, times long, best long")
    more = links.join(others, "pair").groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    joined = first.join(more, "row", "left")
    return joined.select(*columns, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def find_links(documents: DataFrame, a_path: str, b_path: str, held: int = HELD) -> DataFrame:
    """align() and score_links(), the aligned rows written between them so that texts are encoded once."""
    return score_links(cut(align(documents, a_path, b_path)), len(tokenizers(a_path, b_path).b_bytes), held)
