"""A fixed-size bitmap of ids, to keep rows from a shuffle that no join partner waits for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import packed, unpacked

#: Bits of the bitmap: 2 MB whatever the data; with very many ids it only lets more rows through.
BITS = 1 << 24


def _place(column):
    return column.bitwiseAND(F.lit(BITS - 1)).bitwiseXOR(F.shiftright(column, 24).bitwiseAND(F.lit(BITS - 1)))


def rows_with_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id", others: bool = False) -> DataFrame:
    """The rows whose integer key may be among the ids: all that are, and few others; or all the other rows. Nothing of the rows is shuffled."""
    spot = _place(F.col(key).cast("long"))
    words = ids.where(F.col(key).isNotNull()).select(F.shiftright(spot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(BITS >> 6, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batches):
        for batch in batches:
            key_values = batch.column("key")
            x = key_values.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            at = (x & (BITS - 1)) ^ ((x >> 24) & (BITS - 1))
            found = (held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            among = (found == 1) & ~np.asarray(key_values.is_null())
            yield batch.filter(pa.array(~among if others else among))

    keyed = packed(rows).select(F.col(f"row.c{rows.columns.index(key)}").alias("key"), "row")
    return unpacked(keyed.mapInArrow(keep, keyed.schema), rows.columns)
