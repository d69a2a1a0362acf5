"""Reading and writing ledger tables (S01-S02, S05-S11). Schemas are stated, never inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCKS = T.StructType([T.StructField(n, t) for n, t in (("number", T.LongType()), ("hash", T.StringType()), ("parent_hash", T.StringType()), ("ts_ms", T.LongType()), ("epoch", T.LongType()))])
#: Width of the block ranges that event tables are partitioned by.
RANGE = 100_000


def read_ledger(spark: SparkSession, path: str, from_block: int, to_block: int, schema: T.StructType | None = None, number: str = "number") -> DataFrame:
    """A table's rows of a block range, both ends included; the partition filter prunes whole directories."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if "block_range" in df.columns:
        df = df.where(F.col("block_range").between(from_block // RANGE, to_block // RANGE))
    return df.where(F.col(number).between(from_block, to_block))


#: Shape of a node's block JSON: numbers are hex text.
BLOCK_JSON = (
    "header struct<number:string,hash:string,parent_hash:string,timestamp:string,epoch:string>, "
    "transactions array<struct<hash:string,inputs:array<struct<since:string,previous_output:struct<tx_hash:string,index:string>>>,"
    "outputs:array<struct<capacity:string,lock:struct<code_hash:string,hash_type:string,args:string>,type:struct<code_hash:string,hash_type:string,args:string>>>,outputs_data:array<string>>>"
)


def hex_number(x: str | Column) -> Column:
    """0x hex text of up to 63 bits as an integer."""
    return F.conv(F.regexp_replace(F.col(x) if isinstance(x, str) else x, "^0x", ""), 16, 10).cast("bigint")


def normalize_blocks(df: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """blocks, txs, inputs and outputs from a column of block JSON."""
    b = df.select(F.from_json(column, BLOCK_JSON).alias("b")).select("b.*").withColumn("number", hex_number("header.number"))
    epoch = hex_number("header.epoch")
    blocks = b.select("number", "header.hash", "header.parent_hash", hex_number("header.timestamp").alias("ts_ms"), epoch.bitwiseAND(F.lit(0xFFFFFF)).alias("epoch"), F.size("transactions").alias("tx_count"))
    t = b.select("number", F.posexplode("transactions").alias("tx_index", "t"))
    txs = t.select("number", "tx_index", F.col("t.hash").alias("tx_hash"), (F.col("tx_index") == 0).alias("is_cellbase"), F.size("t.inputs").alias("inputs"), F.size("t.outputs").alias("outputs"))
    i = t.where("tx_index > 0").select("number", F.col("t.hash").alias("tx_hash"), F.posexplode("t.inputs").alias("index", "i"))
    inputs = i.select("number", "tx_hash", "index", F.col("i.previous_output.tx_hash").alias("previous_tx_hash"), hex_number("i.previous_output.index").cast("int").alias("previous_index"), F.col("i.since").alias("since"))
    o = t.select("number", F.col("t.hash").alias("tx_hash"), F.posexplode(F.arrays_zip("t.outputs", "t.outputs_data")).alias("index", "o"))
    outputs = o.select("number", "tx_hash", "index", hex_number("o.outputs.capacity").alias("capacity"), F.col("o.outputs.lock").alias("lock"), F.col("o.outputs.type").alias("type"), F.col("o.outputs_data").alias("data"))
    return {"blocks": blocks, "txs": txs, "inputs": inputs, "outputs": outputs}


def read_labels(spark: SparkSession, path: str, schema: str, format: str = "csv") -> DataFrame:
    """A label table (script families, tokens, pools); header and stated schema."""
    reader = spark.read.schema(schema).format(format)
    return (reader.option("header", True) if format == "csv" else reader).load(path)


def write_events(df: DataFrame, path: str, number: str = "number") -> None:
    """Append event rows by block range."""
    df.withColumn("block_range", F.floor(F.col(number) / RANGE).cast("long")).write.mode("append").partitionBy("block_range").parquet(path)


def event_schema(df: DataFrame) -> T.StructType:
    """The schema of what write_events() has written, with which a table without rows can be read too."""
    return T.StructType([*df.schema.fields, T.StructField("block_range", T.LongType())])


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace a table of latest states."""
    df.write.mode("overwrite").parquet(path)


def write_sealed(df: DataFrame, path: str, day: str, bucket_end: str, chain_ms: int) -> None:
    """Write days that are over, each as a whole partition."""
    sealed = df.where(F.col(bucket_end) <= chain_ms)
    sealed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def export_entity_history(ids: DataFrame, key: str, tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """The rows of chosen entities from several tables, one folder each."""
    for name, df in tables.items():
        df.join(ids.select(key), key, "left_semi").write.mode("overwrite").format(format).save(f"{path}/{name}")


def entity_series(events: DataFrame, key: str, day: str, measure: str, anchor: DataFrame) -> DataFrame:
    """Daily rows of each entity up to an anchor day (one value): delta, the state before and after, the state at the anchor, and
    whether the day is over there (S09, Q09)."""
    daily = events.join(F.broadcast(anchor.toDF("_anchor"))).where(F.col(day) <= F.col("_anchor")).groupBy(key, day, "_anchor").agg(F.sum(measure).alias("delta"))
    own = Window.partitionBy(key)
    after = F.sum("delta").over(own.orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return daily.select(key, day, "delta", (after - F.col("delta")).alias("before"), after.alias("after"), F.sum("delta").over(own).alias("current"), (F.col(day) < F.col("_anchor")).alias("complete"))


def latency_summary(samples: DataFrame, by: str, ms: str, failed: str, at_ms: str | None = None) -> DataFrame:
    """Count, error rate, exact p50, p95, p99, and samples a second from the first to the last (where times are given) per endpoint."""
    from ..operators.series import exact_quantiles

    rate = [(F.count(F.lit(1)) * 1000 / F.nullif(F.max(at_ms) - F.min(at_ms), F.lit(0))).alias("throughput")] if at_ms else []
    totals = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(failed) / F.count(F.lit(1))).alias("error_rate"), *rate)
    found = exact_quantiles(samples, by, ms, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, work_folder(samples.sparkSession))
    joined = totals.alias("t").join(found.alias("q"), F.col(f"t.{by}").eqNullSafe(F.col(f"q.{by}")), "left")
    return joined.select(*(F.col(f"t.{c}") for c in (by, "n", "error_rate")), "p50", "p95", "p99", *(["throughput"] if at_ms else []))


def compare_summaries(base: DataFrame, current: DataFrame, by: str, slower: float = 0.2, faster: float = 0.1) -> DataFrame:
    """regression, improvement, same, new or gone per endpoint, by p95."""
    a, b = base.select(by, F.col("p95").alias("base_p95")), current.select(by, F.col("p95").alias("p95"))
    change = F.col("p95") / F.col("base_p95") - 1
    verdict = F.when(F.col("base_p95").isNull(), "new").when(F.col("p95").isNull(), "gone").when(change > slower, "regression").when(change < -faster, "improvement").otherwise("same")
    return a.join(b, by, "full_outer").withColumn("verdict", verdict)


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = f"file://{tempfile.mkdtemp(prefix='spark-work-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A table written once, for what is read several times."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A given table as a file stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files).parquet(folder)
