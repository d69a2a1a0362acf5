"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?.

Rows are dealt in ranges of (conversation, turn), so a long conversation lies in many tasks, as chunks of at most
CHUNK rows. The edits are a shortest path over rows and four states, found by Viterbi from the end of a
conversation to its start. A conversation that lies in one chunk is finished where it is; all its task's
conversations go through the pass in lockstep. The chunks of others each start from a speculative cost vector, and
fix-up passes rerun a chunk from the vector of its successor until its vectors differ from the ones before only by
a constant, which ends that chunk's rerun. Vectors are kept less their minimum, so that "by a constant" is
equality. From the stitched vectors each chunk is traced from each state, the chunks' state maps are composed in
order, and the trace from the true state gives the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: A chunk ends at so many rows or characters of text.
CHUNK, CHUNK_CHARS = 256, 1 << 18
#: Rows that a task takes through the pass together.
TOGETHER = 8192
#: Repaired lines of a long conversation that travel together.
LINES = 16

#: Fixed costs of the edits.
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: nothing yet, after system, after user, after assistant. What an inserted or re-roled row leads to from each.
TO = np.array([2, 2, 3, 2])
#: Where a kept row leads by its initial (s, u, a, other) and the state; 4 is nowhere.
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
NOWHERE = 1 << 12
LETTERS = np.frombuffer(b"DIKR", np.uint8)
_END = np.array([0, 6, 3, 0], np.int16)
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_BLANKS = "\t\n\x0b\x0c\r "


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after a damage chosen by the checksum of "conv_id:turn"; a dropped row has 0 copies, a repeated one 2.

    A null role or text is one space, and so is a null id or turn in the checksum.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


# -- the pass ------------------------------------------------------------------------------------------------


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs to go with rows inserted first where that is cheaper."""
    once = np.minimum(costs, INSERT_COST + costs[:, TO])
    return np.minimum(once, INSERT_COST + once[:, TO])


def _before(code: np.ndarray, fault: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go before a row of each lane, of all edits and of deleting, keeping and re-roling it, from those after it."""
    extra = np.where(fault == TRUNCATED, TRUNCATED_COST, 0).astype(np.int16)[:, None]
    gone = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    padded = np.concatenate([after, np.full((len(after), 1), NOWHERE, np.int16)], 1)
    delete = after + np.int16(DELETE_COST)
    keep = np.where(gone, np.int16(NOWHERE), np.take_along_axis(padded, KEEP[code], 1) + extra)
    rerole = np.where(gone, np.int16(NOWHERE), after[:, TO] + np.int16(REROLE_COST) + extra)
    return _closed(np.minimum(delete, np.minimum(keep, rerole))), delete, keep, rerole


def _places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each lane's rows and vectors (one more than rows) start."""
    rows = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    return rows, rows + np.arange(len(size))


def backward(code: np.ndarray, fault: np.ndarray, size: np.ndarray, end: np.ndarray, stored: np.ndarray | None = None) -> np.ndarray:
    """Cost vectors, less their minimum, at every place of every lane, from the vectors at the lanes' ends.

    Lanes go in lockstep. With the vectors of an earlier pass, a lane stops where the new vector is equal to the old:
    from there on all vectors differ only by a constant.
    """
    rows, vectors = _places(size)
    out = np.zeros((int(size.sum()) + len(size), 4), np.int16) if stored is None else stored.copy()
    lanes = np.arange(len(size))
    if stored is not None:
        lanes = lanes[(out[vectors + size] != end).any(1)]
    out[vectors[lanes] + size[lanes]] = end[lanes]
    now, k = end[lanes], 1
    while len(lanes):
        left = size[lanes] >= k
        lanes, now = lanes[left], now[left]
        row, at = rows[lanes] + size[lanes] - k, vectors[lanes] + size[lanes] - k
        now = _before(code[row], fault[row], now)[0] if len(lanes) else now
        now = now - now.min(1, keepdims=True) if len(lanes) else now
        if stored is not None:
            new = (out[at] != now).any(1)
            lanes, now, at = lanes[new], now[new], at[new]
        out[at] = now
        k += 1
    return out


def trace(code: np.ndarray, fault: np.ndarray, size: np.ndarray, vectors: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least cheapest edits of each lane from its state: lane, letter, row in the lane (-1: inserted), state after; and the lanes' end states.

    At each place the smallest letter on a cheapest path is taken. A lane that ends its conversation is completed.
    """
    rows, first = _places(size)
    state, at, lanes = state.copy(), np.zeros(len(size), np.int64), np.flatnonzero(size > 0)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    while len(lanes):
        row, s, each = rows[lanes] + at[lanes], state[lanes], np.arange(len(lanes))
        after = vectors[first[lanes] + at[lanes] + 1]
        whole, delete, keep, rerole = _before(code[row], fault[row], after)
        best = whole[each, s]
        letter = np.select([delete[each, s] == best, INSERT_COST + whole[each, TO[s]] == best, keep[each, s] == best], [0, 1, 2], 3)
        now = np.where(letter == 0, s, np.where(letter == 2, np.minimum(KEEP[code[row], s], 3), TO[s]))
        steps.append((lanes, letter, np.where(letter == 1, -1, at[lanes]), now))
        state[lanes] = now
        at[lanes] += letter != 1
        lanes = lanes[at[lanes] < size[lanes]]
    while len(lanes := np.flatnonzero(last & ((state == 1) | (state == 2)))):
        state[lanes] = TO[state[lanes]]
        steps.append((lanes, np.full(len(lanes), 1), np.full(len(lanes), -1), state[lanes]))
    none = np.zeros(0, np.int64)
    lane, letter, row, now = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (none, none, none, none)
    order = np.argsort(lane, kind="stable")
    return lane[order], letter[order], row[order], now[order], state


# -- chunks --------------------------------------------------------------------------------------------------


@dataclass
class Chunk:
    """Consecutive rows of one conversation, after damage."""

    conv: object
    number: int
    turns: list = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    seen: set = field(default_factory=set)
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        for _ in range(copies):
            again = fault != BLANK and (role, text) in self.seen
            self.seen.add((role, text))
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.faults.append(DUPLICATE if again else fault)
            self.chars += len(text)

    def full(self, most: int) -> bool:
        return len(self.roles) >= most or self.chars >= CHUNK_CHARS


_INITIAL = {"s": 0, "u": 1, "a": 2}


def _codes(roles: Iterable[str]) -> np.ndarray:
    return np.array([_INITIAL.get(r[:1], 3) for r in roles], np.int64)


def _chunks(batches: Iterable[pa.RecordBatch], part: int, most: int) -> Iterator[tuple[Chunk, bool]]:
    """The chunks of a task's sorted rows, and whether each is known to be its conversation's only one."""
    now, count, open_, conversations = None, 0, True, 0
    for batch in batches:
        for conv, turn, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now, not open_
                    conversations += 1
                now, open_ = Chunk(conv, part << 32 | count), conversations == 0  # the first may have begun in the task before
                count += 1
            elif now.full(most):
                yield now, False
                now, open_ = Chunk(conv, part << 32 | count), True
                count += 1
            now.add(turn, role, text, copies, fault)
    if now is not None:
        yield now, False  # the last may go on in the next task


def _fields(key: pa.DataType) -> pa.Schema:
    texts, whole = pa.list_(pa.string()), pa.int64()
    return pa.schema(
        [("conv_id", key), ("piece", whole), ("complete", pa.bool_()), ("edits", pa.string()), ("roles", texts), ("texts", texts), ("cost", whole), ("rows", whole), ("turns", whole), ("first_turn", whole), ("last_turn", whole),
         ("blank", whole), ("duplicate", whole), ("truncated", whole), ("illegal", whole), ("first_code", whole), ("last_code", whole), ("faults", pa.binary())]
    )


def _schema(key: str) -> str:
    return f"conv_id {key}, piece long, complete boolean, edits string, roles array<string>, texts array<string>, cost long, rows long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_code long, last_code long, faults binary"


def _measures(turns: list, codes: np.ndarray, faults: np.ndarray) -> dict:
    known = [t for t in turns if t is not None]
    pairs = list(zip(codes[:-1].tolist(), codes[1:].tolist(), strict=True))
    return {
        "rows": len(turns), "turns": len(set(known)), "first_turn": min(known, default=None), "last_turn": max(known, default=None),
        **{name: int((faults == k).sum()) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
        "illegal": sum(p not in _LEGAL for p in pairs), "first_code": int(codes[0]) if len(codes) else None, "last_code": int(codes[-1]) if len(codes) else None, "faults": faults.astype(np.uint8).tobytes(),
    }


def _repaired(lane: np.ndarray, letter: np.ndarray, row: np.ndarray, now: np.ndarray, lanes: int, roles: list[list[str]], texts: list[list[str]], faults: list[np.ndarray]) -> Iterator[dict]:
    """Edits, cost, and the roles and texts that come out, lane by lane."""
    edges = np.searchsorted(lane, np.arange(lanes + 1)).tolist()
    audit = LETTERS[letter].tobytes().decode()
    letter, row, now = letter.tolist(), row.tolist(), now.tolist()
    for k in range(lanes):
        out_roles, out_texts, cost = [], [], 0
        for i in range(edges[k], edges[k + 1]):
            if letter[i] == 0:
                cost += DELETE_COST
                continue
            out_roles.append(roles[k][row[i]] if letter[i] == 2 else "user" if now[i] == 2 else "assistant")
            out_texts.append("" if letter[i] == 1 else texts[k][row[i]])
            cost += (0, INSERT_COST, 0, REROLE_COST)[letter[i]] + (TRUNCATED_COST if letter[i] != 1 and faults[k][row[i]] == TRUNCATED else 0)
        yield {"edits": audit[edges[k] : edges[k + 1]], "roles": out_roles, "texts": out_texts, "cost": cost}


def _first_pass(batches: Iterable[pa.RecordBatch], key: pa.DataType, most: int):
    """Pieces of the conversations that lie in one chunk, and the chunks of the others with their rows as they are."""
    fields = _fields(key)
    waiting: list[tuple[Chunk, bool]] = []

    def solved() -> pa.RecordBatch:
        codes, faults = [_codes(c.roles) for c, _ in waiting], [np.array(c.faults, np.int64) for c, _ in waiting]
        done = [k for k, (_, complete) in enumerate(waiting) if complete]
        size = np.array([len(codes[k]) for k in done], np.int64)
        code, fault = (np.concatenate([x[k] for k in done]) if done else np.zeros(0, np.int64) for x in (codes, faults))
        vectors = backward(code, fault, size, np.tile(_END, (len(done), 1)))
        steps = trace(code, fault, size, vectors, np.zeros(len(done), np.int64), np.ones(len(done), bool))[:4]
        found = dict(zip(done, _repaired(*steps, len(done), [waiting[k][0].roles for k in done], [waiting[k][0].texts for k in done], [faults[k] for k in done]), strict=True))
        rows = []
        for k, (chunk, complete) in enumerate(waiting):
            out = found.get(k) or {"edits": None, "roles": chunk.roles, "texts": chunk.texts, "cost": None}
            rows.append({"conv_id": chunk.conv, "piece": chunk.number, "complete": complete, **out, **_measures(chunk.turns, codes[k], faults[k])})
        waiting.clear()
        return pa.RecordBatch.from_pylist(rows, fields)

    held = chars = 0
    for chunk, complete in _chunks(batches, TaskContext.get().partitionId(), most):
        waiting.append((chunk, complete))
        held, chars = held + len(chunk.roles) + 1, chars + chunk.chars
        if held >= TOGETHER or chars >= 4 * CHUNK_CHARS:
            yield solved()
            held = chars = 0
    if waiting:
        yield solved()


# -- chunks of the same conversation ---------------------------------------------------------------------------


def _digests(batches: Iterable[pa.RecordBatch]):
    """A digest of the role and text of each distinct row of a chunk that is not blank."""
    for batch in batches:
        for conv, piece, roles, texts, faults in zip(batch.column("conv_id"), *(batch.column(c).to_pylist() for c in ("piece", "roles", "texts", "faults")), strict=True):
            found = sorted({hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for r, t, f in zip(roles, texts, faults, strict=True) if f != BLANK})
            yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * len(found), batch.schema.field("conv_id").type), pa.array([piece] * len(found), pa.int64()), pa.array(found, pa.binary())], ["conv_id", "piece", "digest"])


def _with_repeats(batches: Iterable[pa.RecordBatch]):
    """Chunks whose rows that an earlier chunk has too are duplicates, without their texts; the vectors of a speculative pass."""
    for batch in batches:
        for x in batch.select(["conv_id", "piece", "last", "roles", "texts", "faults", "earlier"]).to_pylist():
            faults, earlier = np.frombuffer(x["faults"], np.uint8).astype(np.int64), set(x["earlier"] or ())
            for k, (role, text) in enumerate(zip(x["roles"], x["texts"], strict=True) if earlier else ()):
                if faults[k] != BLANK and hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest() in earlier:
                    faults[k] = DUPLICATE
            code = _codes(x["roles"])
            vectors = backward(code, faults, np.array([len(code)]), (_END if x["last"] else np.zeros(4, np.int16))[None])
            row = {"conv_id": x["conv_id"], "piece": x["piece"], "last": x["last"], "code": code.astype(np.uint8).tobytes(), "faults": faults.astype(np.uint8).tobytes(), "vectors": vectors.astype(np.uint8).tobytes(), "start": vectors[0].astype(np.uint8).tobytes()}
            yield pa.RecordBatch.from_pylist([row], _thin(batch.schema.field("conv_id").type))


def _thin(key: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", key), ("piece", pa.int64()), ("last", pa.bool_()), *((c, pa.binary()) for c in ("code", "faults", "vectors", "start"))])


def _lanes(batch: pa.RecordBatch, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    size = np.array([len(x) for x in batch.column("code").to_pylist()], np.int64)
    return size, [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).astype(np.int64) for c in columns]


def _fix_up(batches: Iterable[pa.RecordBatch]):
    """Chunks rerun from the vector that their successor now starts with, where that is another than they ended with."""
    for batch in batches:
        size, (code, fault, vectors) = _lanes(batch, "code", "faults", "vectors")
        vectors = vectors.reshape(-1, 4).astype(np.int16)
        first = _places(size)[1]
        end = vectors[first + size]
        for k, want in enumerate(batch.column("want").to_pylist()):
            end[k] = end[k] if want is None else np.frombuffer(want, np.uint8)
        now = backward(code, fault, size, end, vectors)
        lists = [now[a : a + n + 1].astype(np.uint8).tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)]
        new = batch.set_column(batch.schema.get_field_index("vectors"), "vectors", pa.array(lists, pa.binary()))
        new = new.set_column(new.schema.get_field_index("start"), "start", pa.array([x[:4] for x in lists], pa.binary()))
        yield new.select(["conv_id", "piece", "last", "code", "faults", "vectors", "start"])


def _state_maps(batches: Iterable[pa.RecordBatch]):
    """The state after a chunk for each state before it."""
    for batch in batches:
        size, (code, fault, vectors) = _lanes(batch, "code", "faults", "vectors")
        vectors = vectors.reshape(-1, 4).astype(np.int16)
        ends = [trace(code, fault, size, vectors, np.full(len(size), s), np.zeros(len(size), bool))[4] for s in range(4)]
        maps = np.stack(ends, 1).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array([m.tobytes() for m in maps], pa.binary())], ["conv_id", "piece", "goes"])


def _entered(batches: Iterable[pa.RecordBatch]):
    """The state before each chunk: the maps of those before it, one after the other. Chunks come in order."""
    conv, state = object(), 0
    for batch in batches:
        states = []
        for c, goes in zip(batch.column("conv_id").to_pylist(), batch.column("goes").to_pylist(), strict=True):
            conv, state = (conv, state) if c == conv else (c, 0)
            states.append(state)
            state = goes[state]
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(states, pa.int64())], ["piece", "state"])


def _traced(batches: Iterable[pa.RecordBatch], key: pa.DataType):
    """The pieces of chunks whose vectors and states are known."""
    for batch in batches:
        size, (code, fault, vectors) = _lanes(batch, "code", "new_faults", "vectors")
        state, last = (batch.column(c).to_numpy(zero_copy_only=False).astype(kind) for c, kind in (("state", np.int64), ("last", bool)))
        steps = trace(code, fault, size, vectors.reshape(-1, 4).astype(np.int16), state, last)[:4]
        faults = np.split(fault, np.cumsum(size)[:-1]) if len(size) else []
        rows = batch.drop_columns(["code", "new_faults", "vectors", "state", "last"]).to_pylist()
        found = _repaired(*steps, len(size), [x["roles"] for x in rows], [x["texts"] for x in rows], faults)
        new = [x | out | {name: int((f == k).sum()) for name, k in (("duplicate", DUPLICATE), ("truncated", TRUNCATED))} | {"faults": f.astype(np.uint8).tobytes()} for x, out, f in zip(rows, found, faults, strict=True)]
        yield pa.RecordBatch.from_pylist(new, _fields(key))


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Repaired pieces of conversations from rows (conv_id, turn, role, text, copies), as damage() gives them.

    Columns: conv_id, piece (pieces of a conversation in order), complete (it is the only one), edits (letters D, I, K, R
    in order), roles and texts of the rows that come out, cost, and what was found: rows, distinct turns, first and last
    turn, rows that are blank, duplicate or truncated, illegal neighbours, the initials at both ends (0 to 3) and the
    fault of each row. Rows of one turn are in the order of role and text; a null turn comes first, a null conv_id is a
    conversation of its own, and one without rows (copies 0) has an empty piece. Other columns are ignored.
    """
    text = F.col("text")
    solid = F.rtrim(text, F.lit(_BLANKS))
    fault = F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    # equal rows are dealt out by their place in the table, so that no range of the order is one key
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("mark"), F.col("place")]
    placed = rows.select("conv_id", "turn", "role", "text", "copies", fault.cast("long").alias("fault"), F.substring(text, 1, 32).alias("head"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("place"))
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "mark", "place")
    kind, key = rows.schema["conv_id"].dataType.simpleString(), _arrow_type(rows, "conv_id")
    schema = _schema(kind)
    found = cut(ranged.mapInArrow(lambda batches: _first_pass(batches, key, chunk), schema))
    open_ = found.where(~F.col("complete"))
    if open_.isEmpty():
        return found
    chain = Window.partitionBy("conv_id").orderBy("piece")  # chunks, of which a conversation has one for CHUNK rows
    order_of = open_.select("conv_id", "piece").withColumn("last", F.lead("piece").over(chain).isNull())
    seen = open_.mapInArrow(_digests, f"conv_id {kind}, piece long, digest binary").withColumn("first", F.min("piece").over(Window.partitionBy("conv_id", "digest")))
    earlier = seen.where(F.col("first") < F.col("piece")).groupBy("piece").agg(F.collect_list("digest").alias("earlier"))  # no more than rows of a piece
    thin = f"conv_id {kind}, piece long, last boolean, code binary, faults binary, vectors binary, start binary"
    inside = open_.select("conv_id", "piece", "roles", "texts", "faults")
    chunks = cut(inside.join(order_of.select("piece", "last"), "piece").join(earlier, "piece", "left").select("conv_id", "piece", "last", "roles", "texts", "faults", "earlier").mapInArrow(_with_repeats, thin))
    while True:
        wanted = chunks.select("piece", F.col("vectors").substr(-4, 4).alias("end"), F.lead("start").over(chain).alias("want"))
        wanted = cut(wanted.where(F.col("want").isNotNull() & (F.col("want") != F.col("end"))).select("piece", "want"))
        if wanted.isEmpty():
            break
        chunks = cut(chunks.join(wanted, "piece", "left").mapInArrow(_fix_up, thin))
    maps = chunks.mapInArrow(_state_maps, f"conv_id {kind}, piece long, goes binary").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    states = maps.mapInArrow(_entered, "piece long, state long")
    known = chunks.select("piece", "last", "code", F.col("faults").alias("new_faults"), "vectors").join(states, "piece")
    pieces = open_.join(known, "piece").select(*found.columns, "last", "code", "new_faults", "vectors", "state").mapInArrow(lambda batches: _traced(batches, key), schema)
    return found.where("complete").union(cut(pieces))


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _report(batches: Iterable[pa.RecordBatch], key: pa.DataType):
    """One row a conversation from its pieces, which come one after the other."""
    fields = pa.schema([("conv_id", key), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv = None
    for batch in batches:
        done = []
        for x in batch.to_pylist():
            if conv is None or conv["conv_id"] != x["conv_id"]:
                done += [_row(conv)] if conv else []
                conv = {"conv_id": x["conv_id"], "audit": [], "sum": hashlib.sha256(), "lines": 0, "turns": 0, "first": None, "end": None, "code": None} | dict.fromkeys(_COUNTS, 0)
            for c in _COUNTS:
                conv[c] += x[c]
            if conv["code"] is not None and x["rows"]:
                conv["illegal"] += (conv["code"], x["first_code"]) not in _LEGAL
            conv["code"] = x["last_code"] if x["rows"] else conv["code"]
            if x["turns"]:
                conv["turns"] += x["turns"] - (conv["end"] == x["first_turn"])
                conv["first"], conv["end"] = x["first_turn"] if conv["first"] is None else conv["first"], x["last_turn"]
            conv["audit"].append(x["edits"])
            lines = [f"{r}:{t}" for r, t in zip(x["roles"], x["texts"], strict=True)]
            if lines:
                conv["sum"].update((("\n" if conv["lines"] else "") + "\n".join(lines)).encode())
                conv["lines"] += len(lines)
        yield pa.RecordBatch.from_pylist(done, fields)
    if conv:
        yield pa.RecordBatch.from_pylist([_row(conv)], fields)


def _row(conv: dict) -> dict:
    gaps = conv["end"] - conv["first"] + 1 - conv["turns"] if conv["turns"] else 0
    return {c: conv[c] for c in ("conv_id", *_COUNTS)} | {"gaps": gaps, "audit": "".join(conv["audit"]), "repaired_sha256": conv["sum"].hexdigest()}


def report(pieces: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, counts of faults and illegal neighbours, cost, audit and the digest of its repaired "role:text" lines.

    Conversations of one piece are read where they are; only the others' lines come together, LINES in a row and in order,
    through a task that holds one batch of them: such a digest is one sum over all lines.
    """
    kind, key = pieces.schema["conv_id"].dataType.simpleString(), _arrow_type(pieces, "conv_id")
    schema = f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    needed = pieces.select("conv_id", "piece", "complete", "edits", "roles", "texts", "rows", "turns", "first_turn", "last_turn", *_COUNTS, "first_code", "last_code")
    split = F.explode(F.sequence(F.lit(0), F.greatest(F.size("roles") - 1, F.lit(0)), F.lit(LINES)))
    parts = needed.where(~F.col("complete")).withColumn("at", split)
    first = F.col("at") == 0
    part = parts.select(
        "conv_id", "piece", "at", F.when(first, F.col("edits")).otherwise("").alias("edits"), *(F.slice(c, F.col("at") + 1, F.lit(LINES)).alias(c) for c in ("roles", "texts")),
        *(F.when(first, F.col(c)).otherwise(0).alias(c) for c in ("rows", "turns", *_COUNTS)), "first_turn", "last_turn", "first_code", "last_code",
    )
    together = part.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at")
    return needed.where("complete").mapInArrow(lambda b: _report(b, key), schema).union(together.mapInArrow(lambda b: _report(b, key), schema))
