"""Exact top-k inner products over norm-sorted vectors.

Vectors become integers, are range-partitioned by descending length and packed into blocks, with their sums over
the leading axes of an SVD rotation and the lengths of what is left; the queries are packed likewise. The block
of the longest vectors gives every query a first k-th score. From it follows the least length that a vector needs,
so only blocks that reach it are sent to a block of queries: a block travels once to each block of queries that
needs it, a block of queries once to each run of blocks. There, in descending order of length, a block is skipped
if no product of lengths can reach the k-th score so far; the partial sums plus the product of the residual
lengths (Cauchy-Schwarz) bound each score, and only pairs whose bound reaches it get their exact integer product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Vectors of a block, queries of a block, queries that meet a block at once, and axes of the partial sums.
BLOCK, QUERY_BLOCK, AT_ONCE, LEADING = 2048, 4096, 512, 16


def _integers(batches, scale: int):
    """vec_id, ints (list) and length of the vectors without null or non-finite components."""
    for batch in batches:
        column = batch.column("embedding")
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~np.asarray(column.is_null()) & ~np.asarray(batch.column("vec_id").is_null())
        size = np.diff(offsets)
        whole = np.floor(scale * np.where(np.isfinite(values), values, 0)).astype(np.int64)
        keep = np.flatnonzero(good)
        ends = np.concatenate([[0], np.cumsum(size[keep])])
        picked = whole[np.repeat(offsets[keep] - ends[:-1], size[keep]) + np.arange(ends[-1])]
        squares = np.concatenate([[0], np.cumsum(picked.astype(np.float64) ** 2)])
        length = np.sqrt(squares[ends[1:]] - squares[ends[:-1]])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(picked)), pa.array(length)], ["vec_id", "ints", "length"])


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)] = values[offsets[0] : offsets[-1]]
    return out


def _packed(batches, width: int, rows: int, rotation: np.ndarray):
    """One record per block: its longest length, the rows' numbers and ids, components in as few bytes as hold them, partial sums and lengths."""
    held: pa.Table | None = None

    def block(table: pa.Table) -> pa.RecordBatch:
        one = table.combine_chunks().to_batches()[0]
        x = _matrix(one.column("ints"), width)
        turned = x.astype(np.float64) @ rotation
        rest, length = np.sqrt((turned[:, LEADING:] ** 2).sum(1)), one.column("length").to_numpy()
        most = int(np.abs(x).max(initial=0))
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        parts = [one.column("row").to_numpy(), one.column("vec_id").to_numpy(), x.astype(kind), np.ascontiguousarray(turned[:, :LEADING]), rest, length]
        return pa.RecordBatch.from_arrays([pa.array([float(length.max())]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["longest", *_PARTS])

    for batch in batches:
        rest = pa.Table.from_batches([batch])
        held = rest if held is None else pa.concat_tables([held, rest])
        while held.num_rows >= rows:
            yield block(held.slice(0, rows))
            held = held.slice(rows)
    if held is not None and held.num_rows:
        yield block(held)


_PARTS = ("rows", "ids", "ints", "lead", "rest", "lengths")


class _Block:
    """A packed block, unpacked."""

    def __init__(self, record: dict, width: int):
        self.rows, self.ids = np.frombuffer(record["rows"], np.int64), np.frombuffer(record["ids"], np.int64)
        self.rest, self.length = np.frombuffer(record["rest"], np.float64), np.frombuffer(record["lengths"], np.float64)
        n = len(self.rows)
        self.ints = np.frombuffer(record["ints"], f"<i{len(record['ints']) // max(1, n * width)}").reshape(n, width).astype(np.int64)
        self.lead = np.frombuffer(record["lead"], np.float64).reshape(n, -1)
        self.longest, self.most = float(self.length.max(initial=0)), float(np.abs(self.ints).max(initial=0))


def _moments(batches, width: int):
    total = np.zeros((width, width))
    for batch in batches:
        x = _matrix(batch.column("ints"), width).astype(np.float64)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])


class _Best:
    """The k best (score, smaller id first) of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = [np.zeros(0, np.int64) for _ in range(n)], [np.zeros(0, np.int64) for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[row], scores]), np.concatenate([self.ids[row], ids])
        if len(scores) > 4 * self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= kth
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[row], self.ids[row] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[row] = max(self.least[row], scores[order[-1]])

    def meet(self, queries: _Block, vectors: _Block) -> None:
        """Take in what a block of vectors holds for a block of queries; no query meets its own row."""
        reach = queries.length * vectors.longest * (1 + 1e-9) + 1
        exact = vectors.ints.shape[1] * vectors.most * queries.most < 2**53
        for at in range(0, len(queries.rows), AT_ONCE):
            live = at + np.flatnonzero(reach[at : at + AT_ONCE] >= self.least[at : at + AT_ONCE])
            if not len(live):
                continue
            bound = queries.lead[live] @ vectors.lead.T + queries.rest[live, None] * vectors.rest
            bound += 1 + 1e-9 * queries.length[live, None] * vectors.length
            wanted = (bound >= self.least[live, None]) & (queries.rows[live, None] != vectors.rows)
            dense = wanted.mean() > 0.1 and exact
            scores = (queries.ints[live].astype(np.float64) @ vectors.ints.T.astype(np.float64)).astype(np.int64) if dense else None
            for i in np.flatnonzero(wanted.any(1)):
                some = np.flatnonzero(wanted[i])
                product = scores[i, some] if dense else vectors.ints[some] @ queries.ints[live[i]]
                keep = product >= self.least[live[i]]
                if keep.any():
                    self.add(live[i], product[keep], vectors.ids[some[keep]])


def _seeded(batches, width: int, k: int, leader: dict | None):
    """Each block of queries with its k-th scores in the leading block, and the least length that any of its queries needs of a vector."""
    vectors = _Block(leader, width)
    for batch in batches:
        for record in batch.to_pylist():
            queries = _Block(record, width)
            best = _Best(len(queries.rows), k)
            best.meet(queries, vectors)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(best.least > 0, (best.least - 1) / (queries.length * (1 + 1e-9)), -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([record["query_block"]]), *(pa.array([record[p]], pa.binary()) for p in _PARTS), pa.array([best.least.tobytes()], pa.binary()), pa.array([float(np.nan_to_num(need.min(), neginf=-1.0))])],
                ["query_block", *_PARTS, "least", "need"],
            )


def _meet(batches, width: int, k: int):
    """Records sorted by block of queries and run: first the queries, then blocks of vectors by descending length."""
    queries, best = None, None

    def done():
        n = [len(x) for x in best.ids]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries.rows, n)), pa.array(np.repeat(queries.ids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_row", "query_id", "vec_id", "score"]
            )

    for batch in batches:
        for at in range(batch.num_rows):
            record = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            if record["block"] < 0:
                if queries is not None:
                    yield from done()
                queries, best = _Block(record, width), None
                best = _Best(len(queries.rows), k)
                best.least = np.frombuffer(record["least"], np.float64).copy()
            else:
                best.meet(queries, _Block(record, width))
    if queries is not None:
        yield from done()


def top_inner_products(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with every other row.

    Components x become floor(scale * x). Queries are the rows whose vec_id is divisible by query_every. A query's
    own row is no candidate; other rows are, also those that share its vec_id, and repeated query rows are
    searched each by itself. Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components, and rows without vec_id, take no part; shorter vectors end in zeros. Other columns are ignored.
    The moments of the rotation, as many numbers as the square of the width, are gathered on the driver.
    """
    spark = vectors.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(lambda b: _integers(b, scale), "vec_id long, ints array<long>, length double")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    width = max(1, rows.agg(F.max(F.size("ints"))).first()[0] or 1)
    cells = rows.mapInArrow(lambda b: _moments(b, width), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    moments = np.zeros(width * width)
    moments[[c["cell"] for c in cells]] = [c["value"] for c in cells]
    rotation = np.linalg.svd(moments.reshape(width, width))[0]

    order = [F.col("length").desc(), F.col("vec_id"), F.col("row")]
    parts = ", ".join(f"{p} binary" for p in _PARTS)
    blocks = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _packed(b, width, BLOCK, rotation), f"longest double, {parts}")
    # a run is the partition that blocks were made in: blocks of like length
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id()))
    asked = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).repartitionByRange(max(1, spread // 4), *order).sortWithinPartitions(*order)
    asked = asked.mapInArrow(lambda b: _packed(b, width, QUERY_BLOCK, rotation), f"longest double, {parts}").withColumn("query_block", F.monotonically_increasing_id())

    runs = blocks.groupBy("run").agg(F.max("longest").alias("longest"), F.min("block").alias("first")).orderBy("run").collect()  # no more than partitions
    if not runs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    leader = blocks.where(F.col("block") == runs[0]["first"]).select(*_PARTS).first().asDict()  # one block
    asked = cut(asked.select("query_block", *_PARTS).mapInArrow(lambda b: _seeded(b, width, k, leader), f"query_block long, {parts}, least binary, need double"))
    reached = F.filter(F.array(*(F.struct(F.lit(r["run"]).alias("run"), F.lit(r["longest"]).alias("longest")) for r in runs)), lambda r: r["longest"] >= F.col("need"))
    asked = asked.withColumn("run", F.explode(F.transform(reached, lambda r: r["run"])))
    needed = blocks.join(asked.select("query_block", "run", "need"), "run").where(F.col("longest") >= F.col("need"))
    columns = ["query_block", "run", "block", *_PARTS, "least"]
    meeting = asked.withColumn("block", F.lit(-1).cast("long")).select(*columns).union(needed.withColumn("least", F.lit(None).cast("binary")).select(*columns))
    meeting = meeting.repartition(spread, "query_block", "run").sortWithinPartitions("query_block", "run", "block")
    found = meeting.mapInArrow(lambda b: _meet(b, width, k), "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
