"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded random order; row r (from 1) of n gets the fractional rank (r - 0.5) / n.
All rows sorted by fractional rank are cut into shards whose row counts differ by one at most, so every stretch,
and with it every shard, has the sources in the proportions of the whole.

Ranks are counted without a task that holds a whole source: rows fall into ranges of their random key (and then
of their fractional rank), ranges are counted, and only rows of one range are numbered together.

Defined cases: null text has size 16 and checksum 0; null source is a source of its own; repeated rows and ties
are ordered by id and then checksum, and identical rows are interchangeable; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, partitions


def _numbered(rows: DataFrame, group: list[str], key: str, ties: list[str], buckets: int, out: str) -> DataFrame:
    """Adds `out`, the 0-based position of each row within its group by `key` (in [0, 1)), then `ties`."""
    rows = rows.withColumn("_bucket", F.least(F.floor(F.col(key) * buckets), F.lit(buckets - 1)).cast("long"))
    sizes = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[F.col(c) for c in group] or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_bucket") == F.col("_b")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    local = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(key, *ties))
    return rows.withColumn("_local", local).join(starts, same).withColumn(out, F.col("_start") + F.col("_local") - 1).drop("_bucket", "_b", "_start", "_local", *[f"_{c}" for c in group])


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, source, size, text_crc32, rank (in its source), position (overall), shard and slot of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # 52 bits, so that the key is an exact double
    random = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "source"), 12) / F.lit(float(1 << 52))
    rows = scratch.table(rows.withColumn("random", random), "rows")
    total = rows.count()
    buckets = max(16, 4 * partitions(spark), total // bucket_rows)
    ranked = _numbered(rows, ["source"], "random", ["doc_id", "text_crc32"], buckets, "rank")
    of = rows.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = ranked.join(of, F.col("source").eqNullSafe(F.col("_s"))).withColumn("fraction", (F.col("rank") + 0.5) / F.col("_rows")).drop("_s", "_rows", "random")
    placed = _numbered(ranked, [], "fraction", ["source", "doc_id", "text_crc32"], buckets, "position")
    n = F.lit(max(total, 1))
    placed = placed.withColumn("shard", F.expr(f"(position * {shards}) div {max(total, 1)}").cast("int"))
    # the first position of shard s is ceil(s * n / shards)
    first = F.floor((F.col("shard").cast("long") * n + (shards - 1)) / F.lit(shards))
    return placed.withColumn("slot", F.col("position") - first).select("doc_id", "source", "size", "text_crc32", "rank", "position", "shard", F.col("slot").cast("long").alias("slot"))
