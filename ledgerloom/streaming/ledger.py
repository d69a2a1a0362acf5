"""Streams over a ledger (T01-T15): the batch functions per micro-batch, sealed buckets, rolling windows, and chain switches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

#: Fixed value: a switch deeper than this many blocks stops the stream.
DEEPEST = 36


_MARKS = "batch long, tip long, fork long"


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MARKS).parquet(f"{path}/_commits")


def _switch(df: DataFrame, number: int, path: str, block: str) -> tuple[int | None, int | None]:
    """The tip after a micro-batch, and the fork if it is a switch; both as its marker will say."""
    spark = df.sparkSession
    low, tip = df.agg(F.min(block), F.max(block)).first()
    seen = _marks(spark, path).where((F.col("batch") < number) & F.col("tip").isNotNull()).agg(F.max_by("tip", "batch"), F.max("tip")).first() if number else (None, None)
    if tip is None or seen[0] is None or low > seen[0]:
        return (seen[0] if tip is None else tip), None
    reachable(seen[1], low - 1)
    return tip, low - 1


def _write_mark(spark: SparkSession, path: str, number: int, tip: int | None, fork: int | None) -> None:
    mark = spark.range(1).select(F.lit(tip).cast("long").alias("tip"), F.lit(fork).cast("long").alias("fork"))
    mark.write.mode("overwrite").parquet(f"{path}/_commits/batch={number}")


def stream_ledger(source: DataFrame, derive: Callable[..., dict[str, DataFrame]], path: str, checkpoint: str, block: str | None = None, tell_switch: bool = False) -> DataStreamWriter:
    """Derived tables of every micro-batch, written under the batch's number so that a repeated batch replaces itself.

    The commit marker is the last write; readers take committed batches only (read_committed()). With a block column,
    blocks come in order, and one at or below the tip so far is a switch: the marker says from which fork, rows of earlier
    batches above it don't count any more, and the batch's own are the new branch (T08). A switch more than DEEPEST blocks
    below the highest block so far stops the stream. With tell_switch, derive also gets a table of the batch's switch
    (fork, tip), which has no row where there is none.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.persist()
        try:
            tip, fork = _switch(df, number, path, block) if block else (None, None)
            switch = [spark.range(0 if fork is None else 1).select(F.lit(fork).cast("long").alias("fork"), F.lit(tip).cast("long").alias("tip"))] if tell_switch else []
            for name, table in derive(df, *switch).items():
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            _write_mark(spark, path, number, tip, fork)
        finally:
            df.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_days(source: DataFrame, daily: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, block: str, day: str) -> DataStreamWriter:
    """Rows of a ledger by day, and a daily table of which each micro-batch recomputes the days it touches.

    Rows are kept under (batch, day). A batch touches the days of its own rows, and after a switch those of the rows that it takes
    back; only their rows are read, and only their partitions of the daily table are overwritten. daily maps rows to a table with the
    day column; a day that a switch has left without rows keeps a partition with one marked row, which read_days() leaves out.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.persist()
        try:
            tip, fork = _switch(df, number, path, block)
            df.write.mode("overwrite").partitionBy(day).parquet(f"{path}/rows/batch={number}")
            before = _counted_rows(spark, path, df, number, block)
            gone = before.where(F.col(block) > fork) if fork is not None else before.limit(0)
            touched = [r[0] for r in df.select(day).union(gone.select(day)).distinct().collect()]  # days of a micro-batch
            if touched or not number:  # the first batch makes the table, with or without days
                kept = (before if fork is None else before.where(F.col(block) <= fork)).where(F.col(day).isin(touched))
                made = daily(kept.unionByName(df)).withColumn("_gone", F.lit(False))
                left = spark.createDataFrame([(x,) for x in touched], f"{day} {df.schema[day].dataType.simpleString()}")
                empty = left.join(made.select(day), day, "left_anti").withColumn("_gone", F.lit(True))
                made.unionByName(empty, allowMissingColumns=True).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{path}/daily")
            _write_mark(spark, path, number, tip, fork)
        finally:
            df.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _limits(marks: DataFrame) -> DataFrame:
    """(batch, _limit): up to which block the rows of each batch count after the switches that came later; null for all."""
    later = Window.orderBy("batch").rowsBetween(1, Window.unboundedFollowing)  # one row a batch
    return marks.select("batch", F.min("fork").over(later).alias("_limit"))


def _counted_rows(spark: SparkSession, path: str, like: DataFrame, number: int, block: str) -> DataFrame:
    """The rows of the batches before one that no switch has taken back."""
    if not number:
        return like.limit(0)
    schema = StructType([*like.schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("batch") < number)
    kept = rows.join(_limits(_marks(spark, path).where(F.col("batch") < number)), "batch")
    return kept.where(F.col("_limit").isNull() | (F.col(block) <= F.col("_limit"))).select(*like.columns)


def read_days(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The daily table that stream_days() keeps, with the schema stated where it may have no days. Between a batch's last write and its marker it is that batch ahead."""
    reader = spark.read.schema(f"{schema}, _gone boolean") if schema else spark.read
    return reader.parquet(f"{path}/daily").where(~F.col("_gone")).drop("_gone")


def reachable(tip: int, fork: int) -> None:
    if tip - fork > DEEPEST:
        raise ValueError(f"a switch from block {tip} to a fork at {fork} is deeper than {DEEPEST} blocks")


def read_committed(spark: SparkSession, path: str, name: str, block: str | None = None) -> DataFrame:
    """The rows of a derived table from committed batches; with a block column, without what later switches took back."""
    rows = spark.read.parquet(f"{path}/{name}").join(_limits(_marks(spark, path)), "batch")
    return (rows.where(F.col("_limit").isNull() | (F.col(block) <= F.col("_limit"))) if block else rows).drop("batch", "_limit")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table of batches with their place, from 1, in the order in which each batch wrote them.

    A batch's files follow each other, and so do the rows of each. So a place is that in the file and the counts of the few files
    before it; no row is put in order again.
    """
    written = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = written.groupBy("batch", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("batch").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    starts = files.select("batch", "_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return written.join(F.broadcast(starts), ["batch", "_file"]).withColumn("place", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def switches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, fork, tip) of the switches that a stream has seen."""
    return _marks(spark, path).where(F.col("fork").isNotNull())


def feed(parts: list[DataFrame], folder: str, start: Callable[[DataFrame, str, str], DataStreamWriter]) -> str:
    """Feed parts of a ledger to a stream one after the other, as files that arrive later, and give the folder that it writes to.

    start makes the writer from the source, that folder and the checkpoint.
    """
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        start(source, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def run_parts(parts: list[DataFrame], derive: Callable[..., dict[str, DataFrame]], folder: str, block: str | None = None, tell_switch: bool = False) -> str:
    """feed() with a stream of derived tables."""
    return feed(parts, folder, lambda source, out, checkpoint: stream_ledger(source, derive, out, checkpoint, block, tell_switch))


def stream_buckets(stream: DataFrame, ts: str, length: str, offset: str = "0 seconds", late: str = "0 seconds", keys: list[str] | None = None, **measures: Column) -> DataFrame:
    """Tumbling buckets, each emitted once when it is over (T02); the ledger's day is "1 day" with offset "16 hours"."""
    bucket = F.window(ts, length, length, offset)
    grouped = stream.withWatermark(ts, late).groupBy(bucket.alias("bucket"), *(keys or []))
    out = grouped.agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(F.col("bucket.start").alias("start"), F.col("bucket.end").alias("end"), *(keys or []), *measures)


def late_rows(df: DataFrame, bucket_end: str | Column, chain_ms: str | Column) -> DataFrame:
    """Rows of a bucket that is over already: an error to store, never to drop."""
    end = F.col(bucket_end) if isinstance(bucket_end, str) else bucket_end
    return df.where(end <= (F.col(chain_ms) if isinstance(chain_ms, str) else chain_ms))


@dataclass
class IncrementalAgg:
    """An aggregate kept by deltas per block.

    delta maps ledger rows to (keys, block, measures). The kept state is the deltas of the last DEEPEST
    blocks, block by block, and the sum of all before, so a switch takes back exactly the blocks it drops.
    """

    name: str
    delta: Callable[[DataFrame], DataFrame]
    keys: list[str]
    measures: list[str]
    block: str = "block"
    extra: dict = field(default_factory=dict)

    def rebuild(self, rows: DataFrame) -> DataFrame:
        """Deltas per (keys, block) of a whole table."""
        return self.delta(rows).groupBy(*self.keys, self.block).agg(*(F.sum(m).alias(m) for m in self.measures))

    def apply(self, state: DataFrame, rows: DataFrame, tip: int | None = None) -> DataFrame:
        """State with the deltas of new blocks, and the blocks out of reach of a switch folded into one row (block null).

        tip is the last block of both, where it is known; else it is looked up in both, which works out a state that isn't written twice.
        """
        both = state.unionByName(self.delta(rows).select(*self.keys, self.block, *self.measures))
        last = both.agg(F.max(self.block).alias("_tip")) if tip is None else state.sparkSession.range(1).select(F.lit(tip).cast("long").alias("_tip"))
        folded = both.join(F.broadcast(last)).withColumn(self.block, F.when(F.col(self.block) > F.col("_tip") - DEEPEST, F.col(self.block)))
        return folded.groupBy(*self.keys, self.block).agg(*(F.sum(m).alias(m) for m in self.measures))

    def roll_back(self, state: DataFrame, fork: int) -> DataFrame:
        """State without the blocks above the fork (T08); a fork more than DEEPEST blocks below the tip is an error."""
        tip = state.agg(F.max(self.block).alias("_tip"))
        stop = F.raise_error(F.lit(f"a fork at {fork} is deeper than {DEEPEST} blocks")).cast("boolean")
        stays = F.col(self.block).isNull() | (F.col(self.block) <= fork)
        return state.join(F.broadcast(tip)).where(F.when(F.lit(fork) < F.col("_tip") - DEEPEST, stop).otherwise(stays)).drop("_tip")

    def current(self, state: DataFrame) -> DataFrame:
        return state.groupBy(*self.keys).agg(*(F.sum(m).alias(m) for m in self.measures))

    def verify(self, state: DataFrame, rows: DataFrame) -> DataFrame:
        """Keys whose kept sums differ from a rebuild."""
        from ..operators.quality import equal_by_key

        # sums over rows are sums over their blocks, so the rebuild is not by block
        return equal_by_key(self.name, self.current(self.delta(rows)), self.current(state), self.keys, self.measures)


def rolling_window(df: DataFrame, ts_ms: str, tip_ms: int, hours: int, party: str) -> DataFrame:
    """Rows and distinct parties in the hours up to the tip."""
    inside = df.where((F.col(ts_ms) > tip_ms - hours * 3_600_000) & (F.col(ts_ms) <= tip_ms))
    return inside.select(F.col(party).alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("rows"), F.count("_p").alias("parties"))


def stream_distinct(stream: DataFrame, ts: str, party: str, length: str, late: str = "0 seconds") -> DataFrame:
    """Rows of distinct (bucket, party); count them per bucket downstream, their state goes when the bucket is over."""
    return stream.withWatermark(ts, late).withColumn("bucket", F.window(ts, length)).dropDuplicates(["bucket", party]).select("bucket", party)


def detect_switch(new: DataFrame, stored: DataFrame, number: str = "number", hash_: str = "hash") -> DataFrame:
    """The highest height at which both chains agree among the last DEEPEST, and the first that differs.

    Chains that differ and agree nowhere there are an error: the switch is deeper.
    """
    tip = stored.agg(F.max(number).alias("_tip"))
    recent = stored.join(F.broadcast(tip)).where(F.col(number) > F.col("_tip") - DEEPEST).select(number, F.col(hash_).alias("_old"))
    both = new.select(number, F.col(hash_).alias("_new")).join(recent, number)
    same = F.col("_old") == F.col("_new")
    found = both.agg(F.max(F.when(same, F.col(number))).alias("fork"), F.min(F.when(~same, F.col(number))).alias("first_orphan"))
    stop = F.raise_error(F.lit(f"a switch deeper than {DEEPEST} blocks")).cast("bigint")
    return found.withColumn("fork", F.when(F.col("fork").isNull() & F.col("first_orphan").isNotNull(), stop).otherwise(F.col("fork")))


def rollback(tables: dict[str, DataFrame], fork: int, number: str = "number", tip: int | None = None) -> dict[str, DataFrame]:
    """Every table without rows above the fork (T08); with the tip given, a fork too deep below it is an error."""
    if tip is not None:
        reachable(tip, fork)
    return {name: df.where(F.col(number) <= fork) for name, df in tables.items()}


def canonical(blocks: DataFrame, path: str, number: str = "number", hash_: str = "hash", parent: str = "parent_hash", weight: str | None = None, settled: str | None = None, depth: int = DEEPEST) -> DataFrame:
    """All blocks with canonical true for the chain of the heaviest tip (T09); of equal weights the higher block, then the smaller hash.

    Weights are added up along parents over the last `depth` heights by doubling: a few joins of the blocks of those
    heights with themselves, each written to the given folder. Deeper heights are settled: their flag is the column
    `settled`, or, without it, they have one block each, else it is an error.
    """
    spark = blocks.sparkSession
    tip = blocks.agg(F.max(number).alias("_tip"))
    placed = blocks.join(F.broadcast(tip))
    deep = F.col(number) <= F.col("_tip") - depth
    if settled is None and not placed.where(deep).groupBy(number).count().where("count > 1").isEmpty():
        raise ValueError(f"several blocks of one height more than {depth} below the tip need a settled flag")
    recent = placed.where(~deep).select(F.col(hash_).alias("_h"), F.col(parent).alias("_p"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), F.col(number).alias("_n"))
    above = recent.select(F.col("_h").alias("_p"), F.col("_h").alias("_up"))
    steps, reach = [], 1
    now = recent.join(above, "_p", "left").select("_h", "_n", "_w", "_up")
    while True:
        now.write.mode("overwrite").parquet(f"{path}/{reach}")
        now = spark.read.parquet(f"{path}/{reach}")
        steps.append(now)
        if reach >= depth:
            break
        further = now.select(F.col("_h").alias("_up"), F.col("_up").alias("_up2"), F.col("_w").alias("_w2"))
        now = now.join(further, "_up", "left").select("_h", "_n", (F.col("_w") + F.coalesce("_w2", F.lit(0))).alias("_w"), F.col("_up2").alias("_up"))
        reach *= 2
    chain = steps[-1].orderBy(F.desc("_w"), F.desc("_n"), "_h").limit(1).select("_h")
    for step in steps:
        chain = chain.union(chain.join(step, "_h").where(F.col("_up").isNotNull()).select(F.col("_up").alias("_h")))
    found = placed.join(chain.select(F.col("_h").alias(hash_), F.lit(True).alias("_on")), hash_, "left")
    flag = F.when(deep, F.col(settled) if settled else F.lit(True)).otherwise(F.coalesce("_on", F.lit(False)))
    return found.withColumn("canonical", flag).select(*(c for c in blocks.columns if c != "canonical"), "canonical")


def switch_events(events: DataFrame, old_tip: str, new_tip: str, key: str) -> DataFrame:
    """Switches with the later one that reversed them, if any."""
    back = events.select(F.col(old_tip).alias(new_tip), F.col(new_tip).alias(old_tip), F.col(key).alias("_k"))
    return events.join(back, [new_tip, old_tip], "left").groupBy(*events.columns).agg(F.min(F.when(F.col("_k") > F.col(key), F.col("_k"))).alias("reversed_by"))


def pending_proposals(proposals: DataFrame, committed: DataFrame, tip: int, key: str, proposed: str, farthest: int) -> DataFrame:
    """Proposals neither committed nor out of their window at the tip."""
    return proposals.where(F.col(proposed) + farthest >= tip).join(committed.select(key), key, "left_anti")


def proposal_fates(stream: DataFrame, key: str, block: str, commits: str, near: int, farthest: int, late: int = 1, buckets: int = 4096) -> DataFrame:
    """What becomes of proposals, told by the stream itself (T13): rows (key, proposed, fate, block).

    The stream has a row for each proposal and, with commits true, for each commitment; blocks come in order and without
    switches, so it belongs behind the blocks that a switch can reach. A proposal is "proposed" when it comes,
    "committed" by the first commitment `near` to `farthest` blocks after it, and "expired" by a timer as soon as the blocks are more
    than `late` past its window, with rows of its key or without. Block numbers are the event time, a second each from late + 1 on, and `late` is the
    watermark's delay: a block may be dealt over so many batches. Keys are dealt to buckets by hash, and the state of a bucket is its
    open proposals: a call and a timer serve all keys of a bucket, so their number doesn't grow with the keys.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind, first = stream.schema[key].dataType.simpleString(), late + 1  # the second of block 0: times at the first watermark, 0, would be late

    def step(_, parts, state):
        """The rows of one bucket in order, or its timer."""
        open_, told = {}, []
        for k, p in zip(*state.get, strict=True) if state.exists else ():
            open_.setdefault(k, []).append(p)
        if not state.hasTimedOut:
            rows = set()
            for part in parts:
                keys = part["key"].astype(object).where(part["key"].notna(), None)
                rows.update(zip(keys.tolist(), part["at"].tolist(), part["done"].tolist(), strict=True))
            for k, at, done in sorted(rows, key=lambda r: (r[1], not r[2])):
                mine = open_.get(k, [])
                if not done and at not in mine:
                    open_[k] = [*mine, at]
                    told.append((k, at, "proposed", at))
                elif done and mine:
                    told += [(k, p, "committed", at) for p in mine if p + near <= at <= p + farthest]
                    open_[k] = [p for p in mine if not p + near <= at <= p + farthest]
        now = state.getCurrentWatermarkMs() - first * 1000
        told += [(k, p, "expired", p + farthest) for k, mine in open_.items() for p in mine if (p + farthest) * 1000 < now]
        left = [(k, p) for k, mine in open_.items() for p in mine if (p + farthest) * 1000 >= now]
        if left:
            state.update(([k for k, _ in left], [p for _, p in left]))
            state.setTimeoutTimestamp(max((min(p for _, p in left) + farthest) * 1000, now) + first * 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame({"key": [k for k, *_ in told], "proposed": [p for _, p, *_ in told], "fate": [f for *_, f, _ in told], "block": [b for *_, b in told]})

    # keys pass as text: pandas would make floats of integers beside a null
    text, back = (F.hex(key), F.unhex("key")) if kind == "binary" else (F.col(key).cast("string"), F.col("key").cast(kind))
    rows = stream.select(F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket"), text.alias("key"), F.col(block).cast("long").alias("at"), F.col(commits).alias("done"), F.timestamp_seconds(F.col(block) + first).alias("_time")).withWatermark("_time", f"{late} seconds")
    told = rows.groupBy("bucket").applyInPandasWithState(step, "key string, proposed long, fate string, block long", "keys array<string>, open array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(back.alias(key), "proposed", "fate", "block")


def push_feed(feeds: dict[str, DataFrame]) -> DataFrame:
    """Rows of several kinds as (topic, value JSON), ready for a Kafka or file sink."""
    from functools import reduce

    rows = [df.select(F.lit(topic).alias("topic"), F.to_json(F.struct(*df.columns)).alias("value")) for topic, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


#: Order of the topics of one block in a feed: a switch comes before the blocks that replace others, the status after all.
TOPICS = ("switch", "block", "tx", "activity", "status")


def ordered_feed(feeds: dict[str, DataFrame], block: str = "block") -> DataFrame:
    """Rows of several topics as (block, step, topic, value JSON) in the order in which they are to be pushed.

    Each table has the block that a row belongs to, which is no part of the value; a switch belongs to its fork, a status to the tip.
    """
    from functools import reduce

    step = {t: k for k, t in enumerate(TOPICS)}
    rows = [df.select(F.col(block).alias("block"), F.lit(step[t]).alias("step"), F.lit(t).alias("topic"), F.to_json(F.struct(*(c for c in df.columns if c != block))).alias("value")) for t, df in feeds.items()]
    return reduce(DataFrame.unionByName, rows).orderBy("block", "step", "value")


def pool_diff(before: DataFrame, after: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """arrived, stayed, committed or rejected per transaction of two pool snapshots."""
    b, a, c = (df.select(key).distinct().withColumn(n, F.lit(True)) for df, n in ((before, "_b"), (after, "_a"), (committed, "_c")))
    change = F.when(F.col("_b").isNull(), "arrived").when(F.col("_a"), "stayed").when(F.col("_c"), "committed").otherwise("rejected")
    return b.join(a, key, "full_outer").join(c, key, "left").select(key, change.alias("change"))


def latest_per_key(stream_rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; what an upsert of a micro-batch keeps."""
    return stream_rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
