"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest 63-bit hashes of a text's distinct shingles. Sketches of parts
merge into the sketch of the whole, and two sketches estimate resemblance, containment and set sizes.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a shingle is five words; a text of fewer words has one
shingle, all of them. Defined cases: a null text is empty; a text without words has an empty sketch, which is
like another empty one (1.0) and unlike all others (0.0); repeated rows have equal sketches; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions

K = 128
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_HASHES = float(1 << 63)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = 5) -> DataFrame:
    """Adds the sketch of column `text`. One projection a step, so that no step is computed twice."""
    w, h, s = f"_{out}_w", f"_{out}_h", f"_{out}_s"
    folded = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(_SPACE))
    df = df.withColumn(w, F.split(folded, r"[\x20\x09-\x0D]+"))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    items = F.col(h)
    grams = F.transform(F.sequence(F.lit(0), F.size(items) - shingle), lambda i: F.xxhash64(*[items[i + j] if j else items[i] for j in range(shingle)]).bitwiseAND(F.lit((1 << 63) - 1)))
    short = F.array(F.xxhash64(F.concat_ws(" ", F.transform(items, lambda x: x.cast("string")))).bitwiseAND(F.lit((1 << 63) - 1)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(s, F.when((F.size(w) == 1) & (F.col(w)[0] == ""), none).when(F.size(w) < shingle, short).otherwise(grams))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(s)), 1, k)).drop(w, h, s)


def merge(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of the union of each group's sets. At most k values a row leave a task, each once a task."""
    hashes = df.select(*by, F.explode(sketch).alias("_hash")).distinct()
    salted = hashes.groupBy(*by, (F.col("_hash") % 64).alias("_salt")).agg(F.slice(F.sort_array(F.collect_list("_hash")), 1, k).alias("_part"))
    whole = F.slice(F.sort_array(F.flatten(F.collect_list("_part"))), 1, k)
    found = salted.groupBy(*by).agg(whole.alias(sketch))
    groups = df.select(*by).distinct()
    kept = groups.alias("g").join(found.alias("f"), [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by], "left")
    return kept.select(*[F.col(f"g.{c}").alias(c) for c in by], F.coalesce(F.col(f"f.{sketch}"), F.array().cast("array<bigint>")).alias(sketch))


def distinct_shingles(sketch: str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    s = F.col(sketch)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit((k - 1) * _HASHES) / s[k - 1])


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    lowest = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), lowest)), F.size(lowest)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both, of = _shared(F.col(a), F.col(b), k)
    return F.when(of == 0, F.lit(1.0)).otherwise(both / of)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def as_text(sketch: str) -> Column:
    """16 hexadecimal digits a hash, in ascending order."""
    return F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def _below(marks: list[int], value: Column, equal: bool) -> Column:
    """How many of the ascending marks are smaller than value (or equal to it): a binary search."""
    if not marks:
        return F.lit(0).cast("long")
    steps = [1 << i for i in reversed(range(len(marks).bit_length()))]
    table = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")  # folded into one constant
    inside = lambda m: m <= value if equal else m < value
    step = lambda at, s: F.when((at + s <= len(marks)) & inside(F.get(table, (at + s - 1).cast("int"))), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)).cast("array<bigint>"), F.lit(0).cast("long"), step)


def with_range(base: DataFrame, buckets: int) -> DataFrame:
    """base (doc_id, text) with tie and bucket: ranges of (doc_id, tie) of about equal counts, null ids first.

    An id that many rows share lies on several marks; its rows, and those with null ids, are cut by their tie, a
    hash of the text, so that no range holds them all. Marks are approximate, which moves no row out of order."""
    found = base.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100_000).alias("m"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    marks, nulls = sorted(found["m"] or []), found["n"] - found["known"]
    rows = base.withColumn("tie", F.xxhash64("text"))
    part = F.col("tie") / F.lit(float(1 << 64)) + 0.5  # in [0, 1], ascending with tie
    low, high = _below(marks, F.col("doc_id"), False), _below(marks, F.col("doc_id"), True)
    own = max(1, -(-nulls * buckets // max(found["n"], 1)))
    first = F.least(F.floor(part * own), F.lit(own - 1)) - own
    rows = rows.withColumn("low", low).withColumn("high", high)
    cut = F.col("low") + F.least(F.floor(part * (F.col("high") - F.col("low") + 1)), F.col("high") - F.col("low"))
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), first).otherwise(cut).cast("long")).drop("low", "high")


def with_next(df: DataFrame, id_col: str, text_col: str, bucket_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, text and next_text: the text of the next document by id, the first one's after the last.

    Ids are cut into ranges of about equal counts, small enough for a task; each range also gets the first row of
    the range after it, so only one exchange of the texts is needed and no task sees more than a range. Equal ids
    are ordered by a hash of the text."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = df.sparkSession
    size = base.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    rows = with_range(base, int(max(4 * partitions(spark), size // bucket_bytes))).withColumn("borrowed", F.lit(0))
    heads = sorted(((r["bucket"], r["h"]["doc_id"], r["h"]["tie"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("h")).collect()), key=lambda h: h[0])
    if heads:
        lent = [(*heads[i][1:], heads[i - 1][0]) for i in range(len(heads))]
        lent = F.broadcast(spark.createDataFrame(lent, "h_id long, h_tie long, h_bucket long"))  # one row a range
        first = rows.drop("bucket", "borrowed").join(lent, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")))
        first = first.select("doc_id", "text", "tie", F.col("h_bucket").alias("bucket"), F.lit(1).alias("borrowed")).dropDuplicates(["bucket", "doc_id", "tie"])
        rows = rows.unionByName(first)
    return rows.withColumn("next_text", F.lead("text").over(in_order())).withColumn("next_text", F.coalesce("next_text", F.lit("")))


def in_order() -> Window:
    return Window.partitionBy("bucket").orderBy("borrowed", "doc_id", "tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of every text and of its edited text, with their estimated likeness.

    The edited text has its last floor(n / 4) code points replaced by as many of the next document's first ones."""
    rows = with_next(docs, id_col, text_col)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_sketch(with_sketch(rows, "text", "sketch", k), "edited", "edited_sketch", k)
    rows = rows.drop("text", "edited", "next_text").withColumn("next_sketch", F.lead("sketch").over(in_order()))
    rows = rows.filter("borrowed = 0").withColumn("near_edited", resemblance("sketch", "edited_sketch", k)).withColumn("near_next", resemblance("sketch", "next_sketch", k))
    return rows.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next")
