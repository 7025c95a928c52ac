"""The thin opN_<name> queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, language, licences, line_dedup, packing, pii, sharding, simhash, sstable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs.where(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source/thousand/doc_id.txt."""
    path = F.expr("concat_ws('/', source, cast(doc_id div 1000 AS string), concat(doc_id, '.txt'))")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), path.alias("path"), "text")
    return licences.resolve(files).withColumnRenamed("key", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


SHARDS = [f"shard-{k:02d}" for k in range(64)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", SHARDS)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 0.8)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, entries = sstable.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return entries


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 4)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 1, None)
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.learn(pii.sample_regions(docs)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_licences, op3_packing, op4_sharding, op5_decontamination, op6_token_shards, op7_simhash, op8_line_dedup, op9_pii, op10_embeddings)}


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_SHINGLES = "list_distinct(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' ')))"

ORACLE_OP5 = f"""
WITH items AS (
  SELECT item_id, len(s) AS n, s FROM (
    SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0)
), asked AS (SELECT item_id, n, unnest(s) AS shingle FROM items),
docs AS (
  SELECT doc_id, unnest({_SHINGLES}) AS shingle FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0
)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / CAST(n AS DOUBLE) AS containment
FROM asked JOIN docs USING (shingle) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""


ORACLE_OP4 = f"""
WITH placed AS (
  SELECT doc_id, source, n_chars, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.table_size(len(SHARDS))} AS INTEGER) AS slot FROM documents
)
SELECT *, printf('shard-%02d', [{", ".join(map(str, sharding.lookup_table(SHARDS, sharding.table_size(len(SHARDS)))))}][slot + 1]) AS shard FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": ORACLE_OP4, "op5_decontamination": ORACLE_OP5}
