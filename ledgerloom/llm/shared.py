"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder as Parquet and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """Only the named id columns and the text, a null text taken as empty."""
    return df.select(*ids, F.coalesce(F.col(text), F.lit("")).alias("text"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame, *apart: str) -> DataFrame:
    """The named columns and, as one struct "row", all others: what goes through Arrow whatever the others are called."""
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns) if c not in apart]
    return df.select(*apart, (F.struct(*others) if others else F.lit(0)).alias("row"))


def unpacked(df: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The columns in their order again."""
    return df.select(*(F.col(c) if c in apart else F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(columns)))
