"""Token-ID output: Parquet files of token lists with dictionary encoding, small row groups' pages and page indexes.

Documents are range-partitioned by id and sorted inside each file, so files, row groups and pages hold
narrow id ranges and a reader can fetch the tokens or the counts of a few documents by page. Words between
blanks are encoded once per worker and looked up afterwards, which gives the same ids as encoding the whole
text: the tokenizer's pieces never reach across white space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import flat, slices
from .shared import texts
from .units import Memory, distinct, flat_lists, words_of

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts word by word; words are told apart by their bytes, without case unless they may be special tokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(lambda words: flat_lists([e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and where each row starts."""
        body, edges, first = words_of(*flat(column), b"<|")
        ((ids, ends),) = self.memory.look_up(*distinct(body, edges))
        return ids, np.concatenate([[0], ends])[first]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(batches: Iterable[pa.RecordBatch], path: str, end_id: int):
    words = encoder(path)
    position = 0  # of the row in its file
    for part in slices(batches):
        ids, at = words.encode(part.column("text"))
        out = np.full(len(ids) + part.num_rows, end_id, np.int32)
        size = np.diff(at)
        out[np.arange(len(ids)) + np.repeat(np.arange(part.num_rows), size)] = ids
        offsets = (at + np.arange(part.num_rows + 1)).astype(np.int32)
        place = pa.array(np.arange(position, position + part.num_rows))
        position += part.num_rows
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out)), pa.array(np.diff(offsets)), place], ["doc_id", "tokens", "n_tokens", "position"])


def encode_texts(documents: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, tokens (ids of the whole text, then end_id), n_tokens and position (of the row in its partition) per document row; a null text is empty."""
    key = documents.schema["doc_id"].dataType.simpleString()
    return texts(documents, "doc_id").mapInArrow(lambda batches: _encode(batches, tokenizer_path, end_id), f"doc_id {key}, tokens array<int>, n_tokens int, position long")


def write_tokens(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode and write the token files in ascending doc_id order (rows without id first).

    Each row also has file_part, the order of its file, and position, its own place in it, so that global
    positions follow from counts alone, whichever ids and texts repeat. Ids are dictionary encoded; pages are
    small and carry min/max indexes for doc_id.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a text goes to its place once, before it is encoded; token lists are then written where they are made
    ordered = texts(documents, "doc_id").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    (
        encode_texts(ordered, tokenizer_path, end_id)
        .withColumn("file_part", F.spark_partition_id())
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on doc_id and a selection of columns reach the pages."""
    return spark.read.parquet(path)


_COUNTS = ("file_part", "position", "doc_id", "n_tokens")


def _checksums(batches):
    for batch in batches:
        tokens = batch.column("tokens")
        offsets, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(memoryview(values[a:b]).cast("B")) if b > a else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _COUNTS), pa.array(crc, pa.int64())], [*_COUNTS, "ids_crc32"])


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens and ids_crc32.

    Starts come from two levels: totals of the files, of which there are no more than partitions, and sums inside each file
    in the order of its rows. Rows that share a doc_id each have a row here, with the place of their own tokens.
    """
    files = read_tokens(spark, path)
    key = files.schema["doc_id"].dataType.simpleString()
    rows = files.select(*_COUNTS, "tokens").mapInArrow(_checksums, f"file_part int, position long, doc_id {key}, n_tokens int, ids_crc32 long")
    sums = read_tokens(spark, path).groupBy("file_part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("file_part", F.coalesce(F.sum("n").over(Window.orderBy("file_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file_part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "file_part").select(
        "doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )
