"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosswalk, decontaminate, dialogue, html_text, licenses, near_dup, personal, piece_nbest, repeats, secrets, token_files, top_inner, toxicity
from .shared import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.token_positions(spark, path)


def op4_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner.top_inner_products(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    """Learned from the labelled rows that are not held out."""
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~toxicity.held_out()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_nbest.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report(dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosswalk.find_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = personal.find_personal(documents, personal.fit(personal.examples(spark), documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_html_extraction, op3_token_files, op4_top_inner_products, op5_toxicity, op6_license_scans, op7_secret_scans, op8_decontamination, op9_piece_nbest, op10_repeated_bytes, op11_dialogue_repair, op12_token_alignment, op13_personal_data)}


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL states the result on whole tables in reasonable time; the tests hold the others against brute force."""
    return {"op4_top_inner_products": OP4_SQL}
