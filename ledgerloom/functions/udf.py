"""The few functions Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import hashlib
from math import gcd

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blake2b(column: str | Column, person: bytes = b"") -> Column:
    """Personalised blake2b-256 of a binary column (X04); null stays null."""

    @F.pandas_udf("binary")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.blake2b(bytes(v), digest_size=32, person=person).digest())

    return digest(F.col(column) if isinstance(column, str) else column)


def rational_mean(df: DataFrame, by: str, numerator: str, denominator: str, scale: int = 1000) -> DataFrame:
    """Exact mean of numerator / denominator per group, times scale, cut.

    Rows are first counted by distinct denominator, so a group's exact sum adds few fractions. Groups come in order
    through Arrow batches and are added up as they pass, so a task holds one fraction, whatever the number of groups.
    """
    total = F.sum(numerator)
    if dict(df.dtypes)[numerator] not in ("tinyint", "smallint", "int", "bigint"):
        total = total.cast("decimal(38,0)")
    sums = df.groupBy(by, denominator).agg(total.alias("_sum"), F.count(F.lit(1)).alias("_n")).select(by, F.col(denominator).alias("_of"), "_sum", "_n")

    def means(batches):
        group, held = None, False
        above, below, rows = 0, 1, 0  # of the open group: its sum as a fraction, and its rows
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out, values = [], []
            for key, d, s, n in zip(keys, *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if not held or key != group and (key == key or group == group):  # NaN is one group
                    if held:
                        out.append(group)
                        values.append(above * scale // (below * rows))
                    group, held, above, below, rows = key, True, 0, 1, 0
                d, s = int(d), int(s)
                common = gcd(below, d)
                above, below, rows = above * (d // common) + s * (below // common), below // common * d, rows + n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(0).type), pa.array(values, pa.int64())], [by, "mean"])
            kind = batch.schema.field(0).type
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([above * scale // (below * rows)], pa.int64())], [by, "mean"])

    ordered = sums.repartition(by).sortWithinPartitions(by)
    return ordered.mapInArrow(means, T.StructType([df.schema[by], T.StructField("mean", T.LongType())]))
