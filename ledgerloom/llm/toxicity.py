"""Toxicity: a factorization machine over hashed terms.

Terms are words, prefixes of words and pairs with a repeat count ("seen twice", "seen three times"), hashed
into a fixed number of buckets. A bounded sample of labelled rows chooses the most telling buckets and
trains the machine: weights of single terms, and factors whose inner products weigh pairs of terms, such
as an insult next to a group it is aimed at. The model has a fixed size and scores every document in one
scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALPHANUMERIC, Words, mix, rough_hash, slices
from .shared import cut, packed, texts, unpacked

#: Labelled rows that a model is trained on, at most (the smallest by hash of the id).
TRAINING_ROWS = 20_000
BUCKET_BITS = 20
#: Buckets that take part in the model, and factors of each.
CHOSEN, FACTORS = 1024, 8
PREFIXES = (4, 5, 6, 7, 8)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct term of every row of a slice."""
    words = Words(column, ALPHANUMERIC, rough=True)
    size = words.end - words.start
    row = np.repeat(np.arange(len(column)), words.count())
    rows, hashes = [row], [words.hash]
    for n in PREFIXES:
        long = size > n
        start = words.start[long]
        rows.append(row[long])
        hashes.append(rough_hash(words.sums, start, start + n) ^ np.uint64(n))
    row, bucket = np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key, seen = np.unique((row << BUCKET_BITS) | bucket, return_counts=True)
    row, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    rows, buckets = [row], [bucket]
    for least in (2, 3, 5):
        often = seen >= least
        rows.append(row[often])
        buckets.append((mix(bucket[often].astype(np.uint64) + np.uint64(least << 40)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Machine:
    """slot: place of a bucket among the chosen, or -1; the rest are the weights."""

    slot: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        row, bucket = _terms(column)
        slot = self.slot[bucket]
        row, slot = row[slot >= 0], slot[slot >= 0]
        key = np.unique(row * (CHOSEN + 1) + slot)
        row, slot = key // (CHOSEN + 1), key % (CHOSEN + 1)
        n = len(column)
        linear = np.bincount(row, self.weight[slot], n)
        total = np.stack([np.bincount(row, self.factor[slot, f], n) for f in range(FACTORS)], 1)
        square = np.bincount(row, (self.factor**2).sum(1)[slot], n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + ((total**2).sum(1) - square) / 2, -40, 40)))


def train(rows: list[np.ndarray], labels: np.ndarray, slot: np.ndarray, epochs: int = 12, seed: int = 7) -> Machine:
    """Fit by Adam on the logistic loss with shrinkage; rows hold the chosen slots of each training text."""
    rng = np.random.default_rng(seed)
    bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))) if len(labels) else 0.0
    weight, factor = np.zeros(CHOSEN), rng.normal(0, 0.01, (CHOSEN, FACTORS))
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(factor), np.zeros_like(factor)]
    step, size = 0, 256
    for _ in range(epochs if len(labels) else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            x = np.zeros((len(chosen), CHOSEN))
            for i, k in enumerate(chosen):
                x[i, rows[k]] = 1
            total = x @ factor
            z = bias + x @ weight + ((total**2).sum(1) - x @ (factor**2).sum(1)) / 2
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[chosen]) / len(chosen)
            grads = x.T @ error + 1e-5 * weight, x.T @ (error[:, None] * total) - (x.T @ error)[:, None] * factor + 1e-4 * factor
            bias -= 0.05 * error.sum()
            step += 1
            for k, (value, grad) in enumerate(zip((weight, factor), grads, strict=True)):
                state[2 * k] += 0.1 * (grad - state[2 * k])
                state[2 * k + 1] += 0.001 * (grad**2 - state[2 * k + 1])
                value -= 0.02 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return Machine(slot, bias, weight, factor)


def _counts(batches):
    """Every bucket that a task has seen, however seldom: sums over all tasks decide, whatever the number of tasks."""
    found = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for part in slices(batches):
        row, bucket = _terms(part.column("text"))
        key = np.unique((row << BUCKET_BITS) | bucket)
        toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[key >> BUCKET_BITS]
        for label in (0, 1):
            found[label] += np.bincount((key & ((1 << BUCKET_BITS) - 1))[toxic == label], minlength=1 << BUCKET_BITS)
    seen = np.flatnonzero(found.sum(0))
    for at in range(0, len(seen), 65536):
        some = seen[at : at + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[0][some]), pa.array(found[1][some])], ["bucket", "clean", "toxic"])


def _chosen_slots(batches, slot: np.ndarray):
    for part in slices(batches):
        row, bucket = _terms(part.column("text"))
        place = slot[bucket]
        key = np.unique(row[place >= 0] * (CHOSEN + 1) + place[place >= 0])
        lists = np.split(key % (CHOSEN + 1), np.searchsorted(key // (CHOSEN + 1), np.arange(1, part.num_rows)))
        yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], ["toxic", "slots"])


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Machine:
    """Train on at most so many labelled rows (doc_id, toxic 0/1); rows of unknown label or id are left out.

    An id that is labelled both ways counts as toxic. Of the documents with one of the labelled ids of smallest hash, the
    different (id, text) of smallest hash are learned from, each once, so neither an id that very many
    documents share nor a row that is repeated brings more to the driver; a null text is empty.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, hence broadcast
    labelled = texts(documents, "doc_id").join(F.broadcast(sample), "doc_id").select(F.sha2(F.concat_ws(" ", "doc_id", "text"), 256).alias("mark"), "toxic", "text")
    marks = cut(labelled.select("mark").distinct().orderBy("mark").limit(rows))
    training = cut(labelled.join(F.broadcast(marks), "mark").groupBy("mark").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text"))
    counts = training.mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = training.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    p, q = (F.col("toxic") + 0.5) / (n.get(1, 0) + 1), (F.col("clean") + 0.5) / (n.get(0, 0) + 1)
    telling = F.abs(F.log(p) - F.log(q)) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.orderBy(telling.desc(), "bucket").limit(CHOSEN).collect()
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    slot[[r["bucket"] for r in best]] = np.arange(len(best), dtype=np.int32)
    held = documents.sparkSession.sparkContext.broadcast(slot)
    seen = training.mapInArrow(lambda batches: _chosen_slots(batches, held.value), "toxic int, slots array<int>").toPandas()
    order = sorted(range(len(seen)), key=lambda i: (seen["toxic"][i], tuple(seen["slots"][i])))  # not the order of the tasks
    return train([np.asarray(seen["slots"][i], np.int64) for i in order], np.array([seen["toxic"][i] for i in order], float), slot)


def _score(batches, machine: Machine):
    for part in slices(batches):
        score = machine.scores(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])


def score_toxicity(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) per document row; a null or empty text gets the score of no terms."""
    held = documents.sparkSession.sparkContext.broadcast(machine)
    key = documents.schema["doc_id"].dataType.simpleString()
    return texts(documents, "doc_id").mapInArrow(lambda batches: _score(batches, held.value), f"doc_id {key}, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _reject(batches, machine: Machine, threshold: float):
    for part in slices(batches):
        keep = machine.scores(part.column("text")) < threshold
        yield part.filter(pa.array(keep))


def drop_toxic(documents: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The documents scored below the threshold, all columns kept. Each row is judged by its own text."""
    held = documents.sparkSession.sparkContext.broadcast(machine)
    rows = packed(documents, "text")
    return unpacked(rows.mapInArrow(lambda batches: _reject(batches, held.value, threshold), rows.schema), documents.columns, "text")
