"""Unions and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_feed(feeds: dict[str, DataFrame]) -> DataFrame:
    """Feeds of several kinds as one, with a kind column (U01); page it with ranking.page()."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("kind", F.lit(kind)) for kind, df in feeds.items()))


def first_wins(dfs: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in which the first row of each key stays: by source, then order."""
    both = reduce(lambda a, b: a.unionByName(b), (df.withColumn("source", F.lit(k)) for k, df in enumerate(dfs)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("source", *order))).where("_n = 1").drop("_n")


def search(text: str, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Typed matches (kind, id, name, exact) of a text in named tables of (rows, id column, name column).

    A row matches by its whole name or by a part of it, case ignored; each (kind, id) comes once, exact first;
    ambiguous says that several are exact.
    """
    parts = []
    for kind, (df, key, name) in tables.items():
        low, wanted = F.lower(name), text.lower()
        hits = df.where(F.contains(low, F.lit(wanted)))
        parts.append(hits.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"), (low == wanted).alias("exact")))
    found = reduce(lambda a, b: a.unionByName(b), parts).groupBy("kind", "id").agg(F.min("name").alias("name"), F.max("exact").alias("exact"))
    exact = found.agg((F.count_if("exact") > 1).alias("ambiguous"))
    return found.join(F.broadcast(exact))


def presence(wanted: DataFrame, key: str, sources: dict[str, DataFrame], other: str = "none") -> DataFrame:
    """The first source that has each key."""
    out, found = wanted, F.lit(None).cast("string")
    for k, (name, df) in enumerate(sources.items()):
        out = out.join(df.select(key, F.lit(name).alias(f"_{k}")).distinct(), key, "left")
    found = F.coalesce(*(F.col(f"_{k}") for k in range(len(sources))), F.lit(other))
    return out.select(*wanted.columns, found.alias("presence"))


def diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one side has, with multiplicity."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("actual")))


def item_flow(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in inputs only (out), outputs only (in) or both (kept)."""
    a, b = inputs.select(*keys).distinct().withColumn("_i", F.lit(True)), outputs.select(*keys).distinct().withColumn("_o", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("_i") & F.col("_o"), "kept").when(F.col("_i"), "out").otherwise("in").alias("flow"))
