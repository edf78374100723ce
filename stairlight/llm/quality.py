"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and of the hashed character n-grams of its words (each
with a border before and after); a softmax layer on top gives the class. Vectors and layer are fitted together by stochastic
gradient descent in numpy, on a bounded sample of the labelled documents: at most `sample_rows`, those with the smallest seeded
hashes of their ids, and of these, in that order, those that together stay within `sample_bytes`. Because average and
layer are linear, scoring needs one number a bucket: its vector times the layer.

Defined cases: a null text is empty; an empty text has the score of the bias alone; without labels of both classes
every score is the share of label 1 (0.5 without labels); repeated rows score alike; an id that is null has no
label; of conflicting labels of an id the larger counts, and of its texts the smallest; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE_WORDS, U64, Bordered, Scratch, Words, mix, pieces_of, text_buffers

BITS = 16
GRAMS = (3, 4)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, grams: tuple = GRAMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of bucket numbers and n + 1 positions: where each document's features of that kind begin."""
    shift = U64(64 - bits)
    words = Words(data, offsets, SPACE_WORDS)
    rows, out = Bordered(words), [(mix(words.hashes + U64(1)), words.first)]
    out += [rows.grams(n) for n in grams]
    return [((h >> shift).astype(np.int32), first) for h, first in out]


class Model:
    """scores[b]: what one feature of bucket b adds before averaging; bias: added to the average."""

    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores.astype(np.float32), float(bias)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for buckets, first in features(data, offsets, int(len(self.scores)).bit_length() - 1):
            sums = np.concatenate([[0.0], np.cumsum(self.scores[buckets], dtype=np.float64)])
            total += sums[first[1:]] - sums[first[:-1]]
            n += np.diff(first)
        return total / np.maximum(n, 1) + self.bias


def _weighted(texts: pa.Array, block: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's buckets and their shares, as views of a few large arrays (small ones would fragment memory)."""
    data, offsets = text_buffers(texts)
    rows = []
    for at in range(0, len(offsets) - 1, block):
        part = []
        for a, b in zip(offsets[at : at + block], offsets[at + 1 : at + block + 1], strict=False):
            own = np.concatenate([x for x, _ in features(data[a:b], np.array([0, b - a]))])
            buckets, counts = np.unique(own, return_counts=True)
            part.append((buckets.astype(np.int32), (counts / max(len(own), 1)).astype(np.float32)))
        edges = np.cumsum([0, *(len(b) for b, _ in part)])
        buckets, weights = (np.concatenate([p[k] for p in part]) for k in (0, 1))
        rows += [(buckets[a:b], weights[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return rows


def fit(texts: pa.Array, labels: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 5) -> Model:
    """Gradient descent one document a step; each bucket's rate falls with the gradients it has had."""
    labels, share = np.asarray(labels), float(np.mean(labels)) if len(labels) else 0.5
    if not 0 < share < 1:
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), np.log(edge / (1 - edge)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, dim)) / dim
    layer, bias = rng.uniform(-1, 1, (dim, 2)) / dim, np.zeros(2)
    seen, seen_layer = np.full(1 << BITS, 1e-8), 1e-4
    rows = _weighted(texts)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, weights = rows[i]
            pace = rate * (1 - done / steps)
            own = vectors[buckets]  # a document's buckets are distinct
            hidden = weights @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back, outer = layer @ p, np.outer(hidden, p)
            seen_layer += float((outer**2).sum())
            layer -= pace * outer / np.sqrt(seen_layer)
            bias -= 0.05 * pace * p
            had = seen[buckets] + weights**2 * float(back @ back)
            seen[buckets] = had
            vectors[buckets] = own - (pace * weights / np.sqrt(had))[:, None] * back
            done += 1
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, sample_bytes: int = 64 << 20, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the bounded sample of labelled documents. Only their ids (a bounded list) and the fitted numbers reach the
    driver; texts go to the one task that fits."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).collect()
    place = {r["id"]: i for i, r in enumerate(chosen)}
    chosen = F.broadcast(spark.createDataFrame(chosen, known.schema))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(chosen, "id")
    sample = scratch.table(sample.groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text").cast("long")), "sample")
    fits, total = [], 0
    for row in sorted(sample.select("id", "size").collect(), key=lambda r: place[r["id"]]):
        if total + row["size"] <= sample_bytes:
            fits.append((row["id"],))
            total += row["size"]
    sample = sample.join(F.broadcast(spark.createDataFrame(fits, "id long")), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        model = fit(pa.array(pdf["text"], pa.string()), pdf["label"].to_numpy())
        return pd.DataFrame({"scores": [model.scores.tobytes()], "bias": [model.bias]})

    fitted = sample.select("id", "label", "text").groupBy(F.lit("all")).applyInPandas(run, "scores binary, bias double").collect()
    scratch.drop("sample")
    if not fitted:
        return Model(np.zeros(1 << BITS), 0.0)
    return Model(np.frombuffer(bytes(fitted[0]["scores"]), np.float32), fitted[0]["bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 in column `out`, in place of one of that name; whole texts, one pass, no
    exchange. The model is of fixed size."""
    kept = [c for c in docs.columns if c != out]
    plain = docs.select(docs[text_col].cast("string").alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(kept)))
    schema = plain.drop("text").withColumn("out", F.lit(0.0).cast("double")).schema
    held = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            z = [own.logits(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in pieces_of(offsets, 1 << 20)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([*z, []]), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], schema.names)

    return plain.mapInArrow(run, schema).toDF(*kept, out)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """docs with score and predicted."""
    model = train(docs, labels, **options)
    return score(docs, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
