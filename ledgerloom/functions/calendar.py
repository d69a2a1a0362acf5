"""Two calendars over integer milliseconds: UTC hours and UTC+8 days. No session time zone takes part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lengths in milliseconds and the offset of the ledger's day.
HOUR_MS, DAY_MS, SHIFT_MS = 3_600_000, 86_400_000, 8 * 3_600_000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_div(x: str | Column, by: int) -> Column:
    """Integer quotient that rounds down, for negative numbers too."""
    x = _c(x)
    return ((x - F.pmod(x, F.lit(by))) / by).cast("bigint")


def day_of(ms: str | Column) -> Column:
    """The UTC+8 day of a time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(_c(ms) + SHIFT_MS, DAY_MS).cast("int"))


def hour_index(ms: str | Column) -> Column:
    """Hours since 1970 in UTC."""
    return floor_div(ms, HOUR_MS)


def local_hour(ms: str | Column) -> Column:
    """Hour of the UTC+8 day, 0..23."""
    return F.pmod(floor_div(_c(ms) + SHIFT_MS, HOUR_MS), F.lit(24)).cast("int")


def day_end_ms(day: str | Column) -> Column:
    """The first millisecond after a UTC+8 day."""
    return (F.datediff(_c(day), F.lit("1970-01-01").cast("date")).cast("bigint") + 1) * DAY_MS - SHIFT_MS


def day_key(day: str | Column) -> Column:
    """YYYYMMDD as an integer."""
    day = _c(day)
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def days_between(df: DataFrame, first: str | Column, last: str | Column, name: str = "day") -> DataFrame:
    """One row for every day from first to last of each row, both included."""
    return df.withColumn(name, F.explode(F.sequence(_c(first), _c(last))))


def calendar(df: DataFrame, ms: str) -> DataFrame:
    """The calendar columns day, hour, local_hour of a time column."""
    return df.withColumns({"day": day_of(ms), "hour": hour_index(ms), "local_hour": local_hour(ms)})


def prefix(df: DataFrame, order: str, value: str, name: str, how: str = "max", width: int = 100_000) -> DataFrame:
    """A running max or sum in the order of an integer column without one task for all rows (4.3).

    Ranges of the order column are aggregated first; the few ranges get their own prefix, which is carried
    into an ordinary window inside each range.
    """
    fold = {"max": F.max, "sum": F.sum}[how]
    ranged = df.withColumn("_range", floor_div(order, width))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("_range").agg(fold(value).alias("_v")).select("_range", fold("_v").over(before).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = fold(value).over(inside)
    joined = ranged.join(carried, "_range")
    out = F.greatest(own, "_carried") if how == "max" else own + F.coalesce("_carried", F.lit(0))
    return joined.withColumn(name, out).drop("_range", "_carried")


def chain_time(blocks: DataFrame, order: str = "number", ms: str = "ts_ms", name: str = "chain_ms") -> DataFrame:
    """Running maximum of raw times in block order: raw time may step back, chain time never does."""
    return prefix(blocks, order, ms, name, "max")


def complete_only(df: DataFrame, bucket_end: str | Column, tip: DataFrame) -> DataFrame:
    """The rows whose bucket has ended at the tip's chain time; tip has one row and one column."""
    return df.join(F.broadcast(tip.toDF("_tip")), _c(bucket_end) <= F.col("_tip")).drop("_tip")
