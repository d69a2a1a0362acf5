"""State by key that a stream keeps in a bounded number of tables, exact across chain switches.

The state has two levels. The base holds one row a key: the sums of all blocks that no switch can reach any more. Above
it lie the deltas of recent micro-batches by (key, block), one table a batch. Every so many batches they are folded: blocks
out of reach go into a new base, the rest into one table of recent blocks. Tables lie in a fixed number of slots that are
used in turn, and a small head names those in use, so what is stored and read is bounded by the keys, the
recent blocks and the batches since the last fold, however long the stream has run. A batch writes its tables to slots
that the head does not name and the head last, into the slot that the head before did not use; a batch that is
repeated finds its number in the head, or starts again from the head before.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from .ledger import DEEPEST, IncrementalAgg, reachable

#: Batches after which recent deltas are folded.
FOLD_EVERY = 16

Evict = Callable[[DataFrame], DataFrame]


def read_head(spark: SparkSession, path: str) -> dict | None:
    """The newest head: batch, tip, highest (block ever seen), base (slot), live (slots of recent deltas with the block up to which they count), schema."""
    try:
        heads = [json.loads(r["value"]) for r in spark.read.text(f"{path}/head").select("value").collect()]  # two at most
    except AnalysisException:
        return None
    return max(heads, key=lambda h: h["batch"], default=None)


def _write_head(spark: SparkSession, path: str, head: dict) -> None:
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head/slot={head['batch'] % 2}")


def _tables(spark: SparkSession, path: str, head: dict, block: str) -> list[DataFrame]:
    schema = StructType.fromJson(head["schema"])
    base = [spark.read.schema(schema).parquet(f"{path}/base/slot={head['base']}")] if head["base"] is not None else []
    return base + [(df if limit is None else df.where(F.col(block) <= limit)) for df, limit in ((spark.read.schema(schema).parquet(f"{path}/recent/slot={s}"), limit) for s, limit in head["live"])]


def update_state(df: DataFrame, number: int, agg: IncrementalAgg, path: str, every: int = FOLD_EVERY, evict: Evict | None = None) -> None:
    """Take one micro-batch into the state.

    Blocks come in order; one at or below the tip so far is a switch, and blocks above its fork that came before don't
    count any more. A switch more than DEEPEST blocks below the highest block ever seen is an error. evict may drop folded rows
    that no later state can need; it sees the folded rows only, whose blocks stay whatever happens.
    """
    spark, head = df.sparkSession, read_head(df.sparkSession, path)
    if head and head["batch"] >= number:
        return
    df.persist()
    try:
        low, tip = df.agg(F.min(agg.block), F.max(agg.block)).first()
        delta = agg.rebuild(df)
        schema = json.loads(delta.schema.json())
        head = head or {"batch": -1, "tip": None, "highest": None, "base": None, "live": [], "schema": schema}
        if tip is not None:
            live, highest = head["live"], tip if head["highest"] is None else max(tip, head["highest"])
            if head["tip"] is not None and low <= head["tip"]:
                reachable(head["highest"], low - 1)
                live = [[s, low - 1 if limit is None else min(limit, low - 1)] for s, limit in live]
            free = min(set(range(every + 2)) - {s for s, _ in live})
            head = head | {"tip": tip, "highest": highest, "live": live}
            if len(live) < every:
                delta.write.mode("overwrite").parquet(f"{path}/recent/slot={free}")
                head["live"] = [*live, [free, None]]
            else:
                _fold(spark, path, head, agg, delta, free, evict)
        _write_head(spark, path, head | {"batch": number})
    finally:
        df.unpersist()


def _fold(spark: SparkSession, path: str, head: dict, agg: IncrementalAgg, delta: DataFrame, free: int, evict: Evict | None) -> None:
    rows = reduce(DataFrame.unionByName, [*_tables(spark, path, head, agg.block), delta])
    floor, sums = head["highest"] - DEEPEST, [F.sum(m).alias(m) for m in agg.measures]
    settled = F.col(agg.block).isNull() | (F.col(agg.block) <= floor)
    folded = rows.where(settled).groupBy(*agg.keys).agg(*sums)
    base = 1 - head["base"] if head["base"] is not None else 0
    folded = (evict(folded) if evict else folded).withColumn(agg.block, F.lit(None).cast(delta.schema[agg.block].dataType)).select(*delta.columns)
    folded.write.mode("overwrite").parquet(f"{path}/base/slot={base}")
    rows.where(~settled).groupBy(*agg.keys, agg.block).agg(*sums).select(*delta.columns).write.mode("overwrite").parquet(f"{path}/recent/slot={free}")
    head |= {"base": base, "live": [[free, None]]}


def stream_state(source: DataFrame, agg: IncrementalAgg, path: str, checkpoint: str, every: int = FOLD_EVERY, evict: Evict | None = None) -> DataStreamWriter:
    """A stream that keeps an aggregate by key."""
    return source.writeStream.foreachBatch(lambda df, number: update_state(df, number, agg, path, every, evict)).option("checkpointLocation", checkpoint)


def kept_state(spark: SparkSession, path: str, agg: IncrementalAgg) -> DataFrame:
    """(keys, block, measures): the base (block null) and the recent deltas that count; agg.current() sums them."""
    head = read_head(spark, path)
    if head is None:
        raise ValueError(f"no batch has been taken into the state at {path}")
    tables = _tables(spark, path, head, agg.block)
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], StructType.fromJson(head["schema"]))


# -- activity of the last hours (T05) -----------------------------------------------------------------------------


def window_agg(ts_ms: str, party: str, block: str = "block") -> IncrementalAgg:
    """Rows of each party by hour and time; what a rolling window needs."""
    hour = F.floor(F.col(ts_ms) / 3_600_000).cast("long")
    return IncrementalAgg("window", lambda t: t.select(hour.alias("hour"), F.col(party).alias("party"), F.col(ts_ms).alias("ts_ms"), F.col(block).alias("block"), F.lit(1).cast("long").alias("n")), ["hour", "party", "ts_ms"], ["n"])


def evict_hours(hours: int) -> Evict:
    """Drops folded rows of hours that ended before the window of the last folded row began: no tip that a switch can lead to looks back further."""

    def evict(folded: DataFrame) -> DataFrame:
        last = folded.agg((F.max("hour") - hours).alias("_first"))
        return folded.join(F.broadcast(last), F.col("hour") >= F.col("_first")).drop("_first")

    return evict


def stream_rolling(source: DataFrame, ts_ms: str, party: str, path: str, checkpoint: str, hours: int = 24, block: str = "block", every: int = FOLD_EVERY) -> DataStreamWriter:
    """A stream that keeps the activity of the last hours before the tip (T05): rows older than that leave the state when it is folded."""
    return stream_state(source, window_agg(ts_ms, party, block), path, checkpoint, every, evict_hours(hours))


def rolling_now(spark: SparkSession, path: str, hours: int = 24) -> DataFrame:
    """Rows and distinct parties of the hours up to the latest row kept."""
    kept = kept_state(spark, path, window_agg("ts_ms", "party")).select("party", "ts_ms", "n")
    start = kept.agg((F.max("ts_ms") - hours * 3_600_000).alias("_start"))
    inside = kept.join(F.broadcast(start), F.col("ts_ms") > F.col("_start"))
    return inside.groupBy("party").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("parties"))
