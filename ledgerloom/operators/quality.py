"""Checks as jobs (Q01-Q25). A check returns its findings as rows (check, key, expected, actual); no rows is a pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def _finding(df: DataFrame, check: str, key: Column, expected: Column, actual: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def unresolved_inputs(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs that spend an unknown output (Q01)."""
    return _finding(inputs.join(outputs.select(key), key, "left_anti"), "unresolved_inputs", F.col(key), F.lit("known output"), F.lit(None))


def contiguous(blocks: DataFrame, number: str, hash_: str | None = None, parent: str | None = None) -> DataFrame:
    """Heights without a predecessor, and parents whose hash differs (Q02); by an equi-join on the height."""
    before = blocks.select((F.col(number) + 1).alias(number), F.lit(True).alias("_has"), *([F.col(hash_).alias("_hash")] if hash_ else []))
    first = blocks.agg(F.min(number).alias("_first"))
    joined = blocks.join(before, number, "left").join(F.broadcast(first)).where(F.col(number) > F.col("_first"))
    gaps = _finding(joined.where(F.col("_has").isNull()), "contiguous", F.col(number), F.col(number) - 1, F.lit(None))
    if not hash_:
        return gaps
    wrong = _finding(joined.where(F.col("_has") & (F.col("_hash") != F.col(parent))), "parent_hash", F.col(number), F.col("_hash"), F.col(parent))
    return gaps.union(wrong)


def equal_by_key(name: str, expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or that one side lacks (Q03-Q05, Q09-Q15, Q18-Q20, Q23, Q25)."""
    a = expected.select(*keys, F.struct(*values).alias("_a"))
    b = actual.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return _finding(both, name, F.concat_ws("/", *keys), F.to_json("_a"), F.to_json("_b"))


def parts_make_whole(name: str, df: DataFrame, key: str, parts: list[str], whole: str) -> DataFrame:
    """Rows whose parts don't sum to the whole (Q06)."""
    total = reduce(lambda x, y: x + y, (F.coalesce(F.col(p), F.lit(0)) for p in parts))
    return _finding(df.where(~total.eqNullSafe(F.col(whole))), name, F.col(key), F.col(whole), total)


def negative_state(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Running states below 0 (Q07)."""
    return reduce(lambda a, b: a.union(b), (_finding(df.where(F.col(c) < 0), f"negative_{c}", F.col(key), F.lit(">= 0"), F.col(c)) for c in columns))


def decreasing(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Places where a cumulative series goes down (Q07)."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(order))
    return _finding(df.withColumn("_before", before).where(F.col(column) < F.col("_before")), "decreasing", F.concat_ws("/", *keys, order), F.col("_before"), F.col(column))


def missing_days(series: DataFrame, active: DataFrame, day: str) -> DataFrame:
    """Days with blocks that a series lacks (Q08)."""
    return _finding(active.select(day).distinct().join(series.select(day), day, "left_anti"), "missing_days", F.col(day), F.lit("a row"), F.lit(None))


def ranks_complete(ranked: DataFrame, position: str, measure: str | None = None, whole: DataFrame | None = None) -> DataFrame:
    """A ranking whose positions aren't 1..n, or whose measure doesn't sum to the whole (one value) (Q11)."""
    n = F.count(F.lit(1))
    distinct = ranked.groupBy(position).agg(n.alias("_times"), *([F.sum(measure).alias("_sum")] if measure else []))
    found = distinct.agg(F.sum("_times").alias("n"), n.alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"), *([F.sum("_sum").alias("total")] if measure else []))
    wrong = _finding(found.where("n > 0 AND (n <> d OR lo <> 1 OR hi <> n)"), "ranks_complete", F.lit("ranking"), F.concat(F.lit("1.."), "n"), F.concat(F.col("lo"), F.lit(".."), "hi"))
    if not measure:
        return wrong
    off = found.join(whole.toDF("_whole")).where(~F.col("total").eqNullSafe(F.col("_whole")))
    return wrong.union(_finding(off, "ranking_sum", F.lit("ranking"), F.col("_whole"), F.col("total")))


def linked_ring(names: DataFrame, id_: str, next_: str) -> DataFrame:
    """Pointers that aren't the next id in ascending order, the last pointing to the first (Q16); no traversal.

    Every id must be pointed to once, and every pointer but that of the last id must go up; together these leave one
    ring in ascending order. Both are aggregates and joins on the id.
    """
    spread = names.select(F.col(id_).alias("_i"), F.col(next_).alias("_n"))
    ends = spread.agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    hits = spread.groupBy("_n").agg(F.count(F.lit(1)).alias("times"))
    known = spread.join(hits.withColumnRenamed("_n", "_i"), "_i", "left").where(F.coalesce("times", F.lit(0)) != 1)
    once = _finding(known, "linked_ring", F.col("_i"), F.lit("1"), F.coalesce("times", F.lit(0)))
    back = spread.join(F.broadcast(ends)).where((F.col("_n") <= F.col("_i")) & ~((F.col("_i") == F.col("_last")) & (F.col("_n") == F.col("_first"))))
    return once.union(_finding(back, "linked_ring", F.col("_i"), F.lit("a later id"), F.col("_n")))


def hash_matches(df: DataFrame, id_: str, hashed: str) -> DataFrame:
    """Ids that differ from the hash of their label (Q17)."""
    return _finding(df.where(~F.col(id_).eqNullSafe(F.col(hashed))), "hash_matches", F.col(id_), F.col(hashed), F.col(id_))


def within_tolerance(ours: DataFrame, theirs: DataFrame, day: str, value: str, tolerance: float, last_days: int = 30) -> DataFrame:
    """Days among the last of an external series that differ by more than a share (Q21)."""
    last = theirs.agg(F.max(day).alias("_last"))
    both = theirs.withColumnRenamed(value, "_theirs").join(F.broadcast(last)).where(F.datediff("_last", day) < last_days).join(ours.withColumnRenamed(value, "_ours"), day, "left")
    off = F.col("_ours").isNull() | (F.abs(F.col("_ours") - F.col("_theirs")) > tolerance * F.abs(F.col("_theirs")))
    return _finding(both.where(off), "within_tolerance", F.col(day), F.col("_theirs"), F.col("_ours"))


def compare_rows(name: str, ours: DataFrame, theirs: DataFrame, key: str, severity: dict[str, str]) -> DataFrame:
    """Fields that differ from an external explorer's, with their severity (Q22)."""
    both = ours.alias("o").join(theirs.alias("t"), key, "full_outer")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"), F.col(f"o.{f}").cast("string").alias("ours"), F.col(f"t.{f}").cast("string").alias("theirs")) for f, s in severity.items()))
    return both.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"), F.inline(fields)).where(~F.col("ours").eqNullSafe(F.col("theirs")))


def only_code(index: DataFrame, key: str, data: str) -> DataFrame:
    """Rows of a code index that hold no code (Q24)."""
    from .ledger import is_code_cell

    return _finding(index.where(~is_code_cell(data)), "only_code", F.col(key), F.lit("7F454C46"), F.hex(F.substring(data, 1, 4)))


@dataclass
class Check:
    """A named check: run gives its findings from the tables."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    tier: str = "fast"


def run_checks(checks: list[Check], tables: dict[str, DataFrame]) -> DataFrame:
    """(check, tier, status, findings) of each: pass, fail, or error where the check itself breaks."""
    rows = []
    for check in checks:
        try:
            n = check.run(tables).count()
            rows.append((check.name, check.tier, "fail" if n else "pass", n))
        except Exception as error:  # a broken check is a result of its own
            rows.append((check.name, check.tier, f"error: {type(error).__name__}", -1))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "check string, tier string, status string, findings long")


