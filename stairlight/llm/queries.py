"""The registered queries of the training-data operators: each applies its operator to the whole table it is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontamination, fingerprints, katz, language_id, near_dedup, packing, quality, sharding, substring_dedup, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_read(spark, sf_dir, "documents"), train="crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_read(spark, sf_dir, "documents"), window=20)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_text("sketch").alias("fingerprint"), fingerprints.as_text("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").filter(_remainder(4) != 2)
    scored = quality.classify(docs, labels)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.train(docs.filter(_remainder(3) != 1))
    found = language_id.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_sharding, op3_decontamination, op4_katz, op5_substring_dedup, op6_near_dedup, op7_fingerprints, op8_quality, op9_language_id, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {}
