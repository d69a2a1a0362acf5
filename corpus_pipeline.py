"""A corpus pipeline in five stages, each an operator of ledgerloom.llm on what its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, documents contaminated by the
benchmark go, secrets are masked, and the rest is encoded in pieces and decoded again as a check.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, near_dup, piece_nbest, secrets, toxicity
from ledgerloom.llm.id_filter import rows_with_ids
from ledgerloom.llm.queries import toxicity_machine
from ledgerloom.llm.shared import cut, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_machine(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group; rows without id all stay."""
    gone = near_dup.near_duplicates(docs, n=5, percent=80).where(~F.col("kept")).select("doc_id")
    gone = cut(gone)
    doubtful = rows_with_ids(docs, gone).join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))  # only these texts are shuffled
    return rows_with_ids(docs, gone, others=True).union(doubtful)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, the next best segmentation, and whether the pieces decode to the text again."""
    encoded = piece_nbest.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), n=2, keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", "n_pieces", "round_trip", "pieces", "n_best")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

#: A trained model and a lattice search have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
