"""Ledger-shaped views of the given tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import chain_time, day_of, hour_index


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    number = ((F.col("event_id") - F.pmod("event_id", F.lit(10))) / 10).cast("bigint")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    shifted = F.when(F.col("number") % 7 == 0, 7_200_000).otherwise(0)
    rows = e.groupBy(number.alias("number")).agg(
        F.max(ms).alias("ms"), F.count(F.lit(1)).alias("tx_count"), F.min("user_id").alias("miner"), F.sum(cents("value")).alias("difficulty"), F.count_if(F.col("event_type") == "error").alias("uncles")
    )
    epoch = ((F.col("number") - F.col("number") % 36) / 36).cast("bigint")
    return rows.select("number", (F.col("ms") - shifted).alias("ts_ms"), "tx_count", "miner", "difficulty", "uncles", epoch.alias("epoch"))


def timed(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with chain time, day, hour and the interval to the parent in chain time."""
    b = chain_time(blocks(spark, d))
    parent = b.select((F.col("number") + 1).alias("number"), F.col("chain_ms").alias("parent_ms"))
    return b.join(parent, "number", "left").withColumns({"day": day_of("chain_ms"), "hour": hour_index("chain_ms"), "interval_ms": F.col("chain_ms") - F.col("parent_ms")})


def txs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("tx"), ((F.col("event_id") - F.pmod("event_id", F.lit(10))) / 10).cast("bigint").alias("block"), (F.col("event_id") % 10).cast("int").alias("tx_index"),
        F.col("event_type").alias("kind"), F.col("user_id").alias("party"), cents("value").alias("moved"), ms.alias("ts_ms"), day_of(ms).alias("day"), hour_index(ms).alias("hour"), "props",
    )


def outputs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("outpoint"), F.col("o_custkey").alias("party"), F.col("o_orderpriority").alias("type"), cents("o_totalprice").alias("capacity"), F.to_date("o_orderdate").alias("created_day")).withColumns(
        {"data_size": F.col("outpoint") % 40, "occupied": F.least("capacity", (F.lit(94) + F.length("type") + F.col("outpoint") % 40) * 1_000)}
    )


def inputs(spark: SparkSession, d: str) -> DataFrame:
    line, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    later = line.select(F.col("l_orderkey").alias("outpoint"), "l_shipdate").join(o.select(F.col("o_orderkey").alias("outpoint"), "o_orderdate"), "outpoint").where(F.col("l_shipdate") > F.col("o_orderdate"))
    return later.groupBy("outpoint").agg(F.to_date(F.min("l_shipdate")).alias("consumed_day"), F.to_date(F.max("l_shipdate")).alias("complete_day"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d).join(inputs(spark, d), "outpoint", "left")


def legs(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("tx"), (F.col("l_partkey") % 50).alias("token"), F.col("l_suppkey").alias("party"), F.when(F.col("l_returnflag") == "R", "input").otherwise("output").alias("side"),
        F.col("l_quantity").cast("bigint").alias("amount"), F.col("l_partkey").alias("item"), F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("line"),
        cents("l_extendedprice").alias("capacity"), (F.col("l_linenumber") * 10 + 41).cast("bigint").alias("occupied"),
    )


def deposits(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    done = F.when(F.col("complete_day") > F.col("consumed_day"), F.col("complete_day"))
    return c.select("outpoint", "party", "capacity", F.col("created_day").alias("deposit_day"), F.col("consumed_day").alias("request_day"), done.alias("complete_day"))


def rates(spark: SparkSession, d: str) -> DataFrame:
    """An accumulated rate at the end of each day with an order: it grows by the day's orders."""
    from pyspark.sql.window import Window

    daily = outputs(spark, d).groupBy(F.col("created_day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", (F.lit(10_000_000_000).cast("bigint") + F.sum("n").over(w) * 1_000).alias("ar"))


def peers(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("version"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"), (F.col("c_acctbal") > 0).alias("reachable"), F.col("c_name").alias("name")
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("collection"), F.col("p_type").alias("kind"), F.col("p_size").cast("bigint").alias("size"), F.col("p_name").alias("name"))


CTE = {
    "blocks": """blocks AS (SELECT event_id // 10 AS number,
  CAST(max((epoch_us(ts) // 1000)) - CASE WHEN (event_id // 10) % 7 = 0 THEN 7200000 ELSE 0 END AS BIGINT) AS ts_ms, count(*) AS tx_count, min(user_id) AS miner,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS difficulty, count(*) FILTER (WHERE event_type = 'error') AS uncles, (event_id // 10) // 36 AS epoch
  FROM events GROUP BY event_id // 10)""",
    "timed": """chained AS (SELECT *, max(ts_ms) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS chain_ms FROM blocks),
timed AS (SELECT *, lag(chain_ms) OVER (ORDER BY number) AS parent_ms, chain_ms - lag(chain_ms) OVER (ORDER BY number) AS interval_ms,
  DATE '1970-01-01' + CAST((chain_ms + 28800000) // 86400000 AS INTEGER) AS day, chain_ms // 3600000 AS hour FROM chained)""",
    "txs": """txs AS (SELECT event_id AS tx, event_id // 10 AS block, CAST(event_id % 10 AS INTEGER) AS tx_index, event_type AS kind, user_id AS party,
  CAST(round(value * 100) AS BIGINT) AS moved, (epoch_us(ts) // 1000) AS ts_ms, DATE '1970-01-01' + CAST(((epoch_us(ts) // 1000) + 28800000) // 86400000 AS INTEGER) AS day, (epoch_us(ts) // 1000) // 3600000 AS hour, props FROM events)""",
    "outputs": """outputs AS (SELECT o_orderkey AS outpoint, o_custkey AS party, o_orderpriority AS type, CAST(round(o_totalprice * 100) AS BIGINT) AS capacity, CAST(o_orderdate AS DATE) AS created_day,
  o_orderkey % 40 AS data_size, CAST(least(CAST(round(o_totalprice * 100) AS BIGINT), (94 + length(o_orderpriority) + o_orderkey % 40) * 1000) AS BIGINT) AS occupied FROM orders)""",
    "inputs": """inputs AS (SELECT l_orderkey AS outpoint, CAST(min(l_shipdate) AS DATE) AS consumed_day, CAST(max(l_shipdate) AS DATE) AS complete_day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate GROUP BY l_orderkey)""",
    "cells": """cells AS (SELECT o.*, i.consumed_day, i.complete_day FROM outputs o LEFT JOIN inputs i USING (outpoint))""",
    "legs": """legs AS (SELECT l_orderkey AS tx, l_partkey % 50 AS token, l_suppkey AS party, CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'output' END AS side,
  CAST(l_quantity AS BIGINT) AS amount, l_partkey AS item, CAST(l_shipdate AS DATE) AS day, l_linenumber AS line,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS capacity, CAST(l_linenumber * 10 + 41 AS BIGINT) AS occupied FROM lineitem)""",
    "deposits": """deposits AS (SELECT outpoint, party, capacity, created_day AS deposit_day, consumed_day AS request_day, CASE WHEN complete_day > consumed_day THEN complete_day END AS complete_day FROM cells)""",
    "rates": """rates AS (SELECT created_day AS day, CAST(10000000000 + sum(count(*)) OVER (ORDER BY created_day ROWS UNBOUNDED PRECEDING) * 1000 AS BIGINT) AS ar FROM outputs GROUP BY created_day)""",
    "peers": """peers AS (SELECT c_custkey AS node, c_mktsegment AS version, n_name AS country, n_regionkey AS region, c_acctbal > 0 AS reachable, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "items": """items AS (SELECT p_partkey AS item, p_brand AS collection, p_type AS kind, CAST(p_size AS BIGINT) AS size, p_name AS name FROM part)""",
}
NEEDS = {"timed": ["blocks"], "cells": ["outputs", "inputs"], "deposits": ["cells"], "rates": ["outputs"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def statement(body: str, *views: str) -> str:
    """The body with the views it needs, in order, before it; a body may start with its own tables after WITH."""
    names: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in names:
            names.append(v)

    for v in views:
        add(v)
    body = body.strip()
    heads = [CTE[n] for n in names]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*heads, body[5:]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def query(sql: str | None = None, *views: str):
    """Register a function (spark, folder) under its name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = statement(sql, *views)
        return f

    return register
