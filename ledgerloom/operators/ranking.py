"""Pages and ranked lists: each has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import positions


def page(df: DataFrame, order: list[str], limit: int, cursor: tuple | None = None) -> DataFrame:
    """The newest rows by descending order columns, after a cursor of their values."""
    if cursor is not None:
        after = F.lit(False)
        for k, (column, value) in enumerate(zip(order, cursor, strict=True)):
            same = F.lit(True)
            for c, v in list(zip(order, cursor, strict=True))[:k]:
                same = same & (F.col(c) == v)
            after = after | (same & (F.col(column) < value))
        df = df.where(after)
    return df.orderBy(*(F.desc(c) for c in order)).limit(limit)


def ranked_page(df: DataFrame, measure: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """A page by measure descending, then key, with each row's place in the whole.

    The place of the first row is a count of the rows before it; the page itself is a top-k, not a sort of all.
    """
    if cursor is None:
        first, rest = 0, df
    else:
        m, k = cursor
        after = (F.col(measure) < m) | ((F.col(measure) == m) & (F.col(key) > k))
        first, rest = df.where(~after).count(), df.where(after)
    return positions(rest.orderBy(F.desc(measure), key).limit(limit), measure, key).withColumn("position", F.col("position") + first)


def top(df: DataFrame, measure: str, key: str, n: int) -> DataFrame:
    """The n greatest."""
    return df.orderBy(F.desc(measure), key).limit(n)


def top_n_with_rest(daily: DataFrame, day: str, label: str, measure: str, drawn: int, rest: str = "rest") -> DataFrame:
    """Daily series of the labels greatest on the last day, all others summed as the rest."""
    last = daily.agg(F.max(day).alias(day))
    best = daily.join(F.broadcast(last), day, "left_semi").orderBy(F.desc(measure), label).limit(drawn).select(label, F.lit(True).alias("_top"))
    named = daily.join(F.broadcast(best), label, "left").withColumn(label, F.when(F.col("_top"), F.col(label)).otherwise(rest))
    return named.groupBy(day, label).agg(F.sum(measure).alias(measure))


def most_utilised(daily: DataFrame, day: str, label: str, measures: list[str], n: int = 20, drawn: int = 5, rest: str = "rest") -> DataFrame:
    """For each measure, the n labels greatest on the last day with their rank, and daily series of the first drawn and the rest.

    Rows: measure, part (top or drawn), day, label, rank (of the top) and value.
    """
    from functools import reduce

    last = daily.agg(F.max(day).alias(day))
    out = []
    for m in measures:
        best = daily.join(F.broadcast(last), day, "left_semi").orderBy(F.desc(m), label).limit(n)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(m), label)))  # n rows
        series = top_n_with_rest(daily.select(day, label, m), day, label, m, drawn, rest)
        out.append(ranked.select(F.lit(m).alias("measure"), F.lit("top").alias("part"), day, label, "rank", F.col(m).alias("value")))
        out.append(series.select(F.lit(m).alias("measure"), F.lit("drawn").alias("part"), day, label, F.lit(None).cast("int").alias("rank"), F.col(m).alias("value")))
    return reduce(lambda a, b: a.union(b), out)


def pool_order(pool: DataFrame, fee: str, size: str, arrived: str, key: str) -> DataFrame:
    """By fee rate descending, arrival, key (L09): a decimal quotient with more digits than two sizes can differ by."""
    rate = (F.col(fee).cast("decimal(18,0)") * F.lit(1_000_000_000_000).cast("decimal(13,0)")).cast("decimal(38,0)") / F.col(size).cast("decimal(10,0)")
    return pool.orderBy(rate.desc(), arrived, key)


def sorted_list(df: DataFrame, column: str, key: str, descending: bool = True) -> DataFrame:
    """By any chosen measure, ties by key."""
    return df.orderBy(F.desc(column) if descending else F.asc(column), key)


def series_peak(df: DataFrame, series: str | list[str], day: str, measure: str) -> DataFrame:
    """Peak of each series and the first day it was reached."""
    keys = [series] if isinstance(series, str) else series
    peaks = df.groupBy(*keys).agg(F.max(measure).alias("peak"))
    return df.join(peaks, keys).where(F.col(measure) == F.col("peak")).groupBy(*keys, "peak").agg(F.min(day).alias("peak_day"))


def seeded_sample(df: DataFrame, key: str | Column, n: int, seed: int) -> DataFrame:
    """The same n rows for the same seed, whatever the partitions."""
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def stride_sample(df: DataFrame, number: str, stride: int) -> DataFrame:
    """Every so-many-th row."""
    return df.where(F.col(number) % stride == 0)
