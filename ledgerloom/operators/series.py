"""Ordered folds and calendar series (W01-W16, A27, A45 and others share them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def running_total(df: DataFrame, keys: list[str], day: str, *columns: str) -> DataFrame:
    """Running sums of daily deltas per entity as total_* (W01); find negative ones with quality.negative_state()."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"total_{c}": F.sum(c).over(w) for c in columns})


def daily_change(df: DataFrame, keys: list[str], day: str, *columns: str) -> DataFrame:
    """Difference to the row of the day before it as change_*; the first has null."""
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumns({f"change_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def filled_days(df: DataFrame, keys: list[str], day: str, last: DataFrame | None = None) -> DataFrame:
    """Every day from each entity's first to the last day of all (or of `last`, one value), with the day's row if any."""
    end = (df.agg(F.max(day)) if last is None else last).toDF("_end")
    spans = df.groupBy(*keys).agg(F.min(day).alias("_start")) if keys else df.agg(F.min(day).alias("_start"))
    days = spans.join(F.broadcast(end)).where("_start <= _end").select(*keys, F.explode(F.sequence("_start", "_end")).alias(day))
    return days.join(df, [*keys, day], "left")


def carry_fill(df: DataFrame, keys: list[str], day: str, *columns: str, last: DataFrame | None = None) -> DataFrame:
    """Missing days take the last known state (W03); for cumulative series only."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return filled_days(df, keys, day, last).withColumns({c: F.last(c, True).over(w) for c in columns})


def zero_fill(df: DataFrame, keys: list[str], day: str, *columns: str, last: DataFrame | None = None) -> DataFrame:
    """Missing days take 0 (W04); for counts."""
    return filled_days(df, keys, day, last).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def state_over_time(df: DataFrame, start: str, end: str, keys: list[str], **measures: str | Column) -> DataFrame:
    """Sum of each measure over the rows alive at the end of every day on which it changes.

    Each row becomes a signed event at its start and one at its end in a single pass, events are summed to (key, day),
    and only that small table is ordered; rows never meet days.
    """
    named = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), *(( F.col(m) if isinstance(m, str) else m).alias(n) for n, m in measures.items()))
    events = F.array(F.struct(F.col("_s").alias("day"), *measures), F.struct(F.col("_e").alias("day"), *((-F.col(n)).alias(n) for n in measures)))
    daily = named.select(*keys, F.inline(events)).where(F.col("day").isNotNull()).groupBy(*keys, "day").agg(*(F.sum(n).alias(n) for n in measures))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, "day", *(F.sum(n).over(w).alias(n) for n in measures))


def age_bands(cells: DataFrame, start: str, end: str, measure: str, bands: list[tuple[str, int, int | None]]) -> DataFrame:
    """Measure by age band at the end of every day on which a band changes; a band is (name, from, to) in days, to excluded.

    Each cell enters and leaves bands at fixed days, so it's a few signed events, not a row for each day.
    """
    entries = F.array(*(F.struct(F.lit(n).alias("band"), F.lit(a).alias("a"), F.lit(b).cast("int").alias("b")) for n, a, b in bands))
    spread = cells.select(F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(measure).alias("measure"), F.inline(entries))
    enter = F.date_add("_start", F.col("a"))
    leave = F.least(F.date_add("_start", F.col("b")), F.col("_end"))  # least() skips nulls
    held = spread.select("band", enter.alias("enter"), leave.alias("leave"), "measure").where(F.col("leave").isNull() | (F.col("enter") < F.col("leave")))
    return state_over_time(held, "enter", "leave", ["band"], measure="measure")


def all_positions(df: DataFrame, measure: str, key: str, path: str, name: str = "position") -> DataFrame:
    """Places 1..n of all rows by measure descending, then key, without one task for all of them.

    Rows are dealt into ranges of the order and written to a new folder, so that the ranges stay as they are; the
    counts of the few ranges before it are what a range adds to the places inside it.
    """
    spark = df.sparkSession
    order = [F.desc(measure), F.asc(key)]
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(spread, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(offsets, "_range").withColumn(name, inside + F.col("_before")).drop("_range", "_before")


def in_ranges(df: DataFrame, keys: list[str], order: list[str], path: str) -> DataFrame:
    """The rows written in ranges of (keys, order), with their range's number: a group, however large, lies in consecutive ranges."""
    spread = [F.col(c) for c in (*keys, *order)]
    df.repartitionByRange(*spread).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)


def carried(ranged: DataFrame, keys: list[str], **folds: Column) -> DataFrame:
    """Aggregates of the ranges of each group, (keys, _range, names), to be carried from range to range in a window over few rows."""
    return ranged.groupBy(*keys, "_range").agg(*(f.alias(n) for n, f in folds.items()))


def exact_quantiles(df: DataFrame, by: str, value: str, wanted: dict[str, float], path: str) -> DataFrame:
    """Exact interpolated quantiles of each group, by rank selection over ranges of its values.

    Equal values are counted first. The counts of ranges say which of them hold a wanted rank, and only those are put in
    order, so no task holds a group. Null values don't count; a group without values has nulls.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = in_ranges(counted, [by], ["_v"], path)
    along = Window.partitionBy(by).orderBy("_range")  # a row for each range of a group
    ranges = carried(ranged, [by], _rows=F.sum("_n")).withColumns({"_after": F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_rows").over(Window.partitionBy(by))})
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), F.lit(float(q)).alias("_q")) for n, q in wanted.items())))
    groups = ranges.select(by, "_all").distinct().select(by, "_all", asked.alias("_a")).select(by, "_a.*", (F.col("_a._q") * (F.col("_all") - 1)).alias("_at"))
    low = F.floor("_at")
    ends = F.array(F.struct(low.alias("_rank"), (low + 1 - F.col("_at")).alias("_weight")), F.struct(F.ceil("_at").alias("_rank"), (F.col("_at") - low).alias("_weight")))
    ranks = groups.select(by, "_name", F.inline(ends)).where(F.col("_weight") > 0)
    inside = (F.col("_rank") < F.col("_after")) & (F.col("_rank") >= F.col("_after") - F.col("_rows"))
    held = ranks.join(ranges, by).where(inside).select(by, "_range", "_name", "_weight", (F.col("_rank") - F.col("_after") + F.col("_rows")).alias("_rank"))
    needed = ranged.join(held.select(by, "_range").distinct(), [by, "_range"], "left_semi")
    upto = needed.withColumn("_upto", F.sum("_n").over(Window.partitionBy(by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = upto.join(held, [by, "_range"]).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    return hit.groupBy(by).agg(*(F.sum(F.when(F.col("_name") == n, F.col("_weight") * F.col("_v"))).alias(n) for n in wanted))


def positions(df: DataFrame, measure: str | Column, key: str, *by: str, name: str = "position") -> DataFrame:
    """Places 1..n by measure descending, then key, within `by` (W07); without it for bounded tables only, such as a page."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(measure) if isinstance(measure, str) else measure.desc(), F.asc(key))))


def trailing_sum(df: DataFrame, keys: list[str], day: str, column: str, days: int) -> Column:
    """Sum over the last so many rows of filled days."""
    return F.sum(column).over(Window.partitionBy(*keys).orderBy(day).rowsBetween(1 - days, 0))


def median_time(blocks: DataFrame, number: str, ms: str, n: int = 37) -> DataFrame:
    """Upper median of the times of each block and the n - 1 before it.

    Each block's time is sent to the n blocks that count it, so there's no global order.
    """
    sent = blocks.select((F.explode(F.sequence(F.col(number), F.col(number) + (n - 1)))).alias(number), F.col(ms).alias("_ms"))
    gathered = sent.groupBy(number).agg(F.sort_array(F.collect_list("_ms")).alias("_all"))  # n values at most
    half = F.floor(F.size("_all") / 2).cast("int")
    return blocks.join(gathered, number).withColumn("median_ms", F.element_at("_all", half + 1)).drop("_all")


def become_positive(deltas: DataFrame, entity: str, day: str, delta: str) -> DataFrame:
    """How many entities go from nothing to something by the end of each day."""
    daily = deltas.groupBy(entity, day).agg(F.sum(delta).alias("_d"))
    now = F.sum("_d").over(Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    held = daily.withColumn("_now", now)
    return held.where((F.col("_now") > 0) & (F.col("_now") - F.col("_d") <= 0)).groupBy(day).agg(F.count(F.lit(1)).alias("new"))


def held_since(versions: DataFrame, item: str, order: str, owner: str) -> DataFrame:
    """First place of each item, its last owner, and since which place that owner has held it."""
    w = Window.partitionBy(item).orderBy(order)
    runs = versions.withColumn("_new", (~F.lag(owner).over(w).eqNullSafe(F.col(owner))).cast("int"))
    starts = runs.where((F.col("_new") == 1))
    last = starts.groupBy(item).agg(F.min(order).alias("first_seen"), F.max(order).alias("held_since"), F.max_by(owner, order).alias(owner))
    return last


def latest_of_day(points: DataFrame, keys: list[str], day: str, hour: str) -> DataFrame:
    """The row of the latest hour of each day."""
    return points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, day).orderBy(F.desc(hour)))).where("_n = 1").drop("_n")


def holder_steps(deltas: DataFrame, party: str, day: str, delta: str) -> DataFrame:
    """By how much the number of parties that hold something changes on each day with a delta."""
    daily = deltas.groupBy(party, day).agg(F.sum(delta).alias("_d"))
    w = Window.partitionBy(party).orderBy(day)
    held = daily.withColumn("_now", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.when((F.col("_now") > 0) & (F.col("_now") - F.col("_d") <= 0), 1).when((F.col("_now") <= 0) & (F.col("_now") - F.col("_d") > 0), -1).otherwise(0)
    return held.groupBy(day).agg(F.sum(step).alias("step"))


def holders_over_time(deltas: DataFrame, party: str, day: str, delta: str) -> DataFrame:
    """How many parties hold something at the end of every day on which that may change."""
    return holder_steps(deltas, party, day, delta).select(day, F.sum("step").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)).alias("holders"))
