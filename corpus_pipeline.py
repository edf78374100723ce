"""Cleaning pipeline over `documents`; every stage's result is written and read again before the next.

Each stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents. Texts that the
substring stage empties stay as empty documents; rows with a null id are never near-duplicates of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stairlight.llm import decontamination, near_dedup, packing, quality, substring_dedup
from stairlight.llm.common import Scratch

#: Words of a passage that must repeat for the substring stage to cut it.
PASSAGE_WORDS = 50


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))  # columns named like the classifier's stay as they are
    scored = quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs)
    return docs.join(found.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(docs, window=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", drop_low_quality), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeated_passages), ("decontamination", drop_contaminated), ("packing", pack_tokens)]
#: No stage can be written in SQL (learned scores, signatures, edit distances, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
