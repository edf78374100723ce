"""Language identification with language-bitmask n-gram filters.

A Bloom filter a language, bit-sliced: one table whose entry at a hash is a bitmask of languages, so that a lookup of
an n-gram (the AND of its entries) returns all languages that contain it. The hits a language gets are corrected for
its filter's false positives; the most corrected hits decide.

N-grams are bytes of words in lower case with a border on each side. A language's filter holds those that occur in
at least `least_share` of its sample, the most frequent first, at most `most_grams`; the sample is bounded at about
`per_language` documents, those with the smallest seeded hashes of their ids.

Defined cases: a null text and one without a letter are `und` with score 0; a text with letters but no known n-gram
gets the most frequent language with score 0; ties go to the first name; rows without a language teach nothing;
repeated rows are alike; an empty table gives no rows, and without languages all is `und`; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM_WORDS, LOWER, U64, Words, mix, pieces_of, ranges, text_buffers

SIZES = (3, 4)
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123)]] = False


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words and n + 1 positions: where each document's n-grams begin."""
    words = Words(data, offsets, ALNUM_WORDS, LOWER)
    lengths = words.ends - words.starts + 2
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.full(at[-1], 32, U64)  # words end to end, a space before and after each
    flat[ranges(at[:-1] + 1, lengths - 2)] = words.data[ranges(words.starts, lengths - 2)]
    hashes, order = [], []
    for n in SIZES:
        many = np.maximum(lengths - n + 1, 0)
        begin = ranges(at[:-1], many)
        code = flat[begin] if len(begin) else np.zeros(0, U64)
        for j in range(1, n):
            code = code | flat[begin + j] << U64(8 * j)
        hashes.append(mix(code + U64(n << 56)))
        order.append(np.concatenate([[0], np.cumsum(many)])[words.first])
    counts = sum(np.diff(o) for o in order)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(first[-1], U64)
    shift = first[:-1].copy()
    for h, o in zip(hashes, order, strict=True):
        out[ranges(shift, np.diff(o))] = h
        shift += np.diff(o)
    return out, first


class Filters:
    """table[h]: bitmask of the languages whose filter has bit h set."""

    def __init__(self, names: list[str], table: np.ndarray, counts: list[int], probes: int):
        self.names, self.table, self.counts, self.probes = names, table, counts, probes
        each = [np.mean((table[:, i // 64] >> U64(i % 64)) & U64(1)) for i in range(len(names))]
        self.false = np.array(each) ** probes

    @classmethod
    def build(cls, learned: dict[str, np.ndarray], counts: dict[str, int], probes: int = 2, bits_each: int = 16) -> Filters:
        names = sorted(learned)
        most = max([len(x) for x in learned.values()], default=1)
        table = np.zeros((1 << max(12, (most * bits_each - 1).bit_length()), max(1, -(-len(names) // 64))), U64)
        for i, name in enumerate(names):
            for at in cls._places(learned[name], probes, len(table)):
                table[at, i // 64] |= U64(1) << U64(i % 64)
        return cls(names, table, [counts[n] for n in names], probes)

    @staticmethod
    def _places(hashes: np.ndarray, probes: int, size: int) -> list[np.ndarray]:
        step = (hashes >> U64(32)) | U64(1)
        return [((hashes + U64(p) * step) & U64(size - 1)).astype(np.int64) for p in range(probes)]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Bitmasks of all languages that contain each n-gram."""
        out = None
        for at in self._places(hashes, self.probes, len(self.table)):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def decide(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each document's language and its score; index -1 where nothing is known."""
        masks, n = self.lookup(hashes), np.diff(first)
        hits = np.zeros((len(n), len(self.names)))
        for i in range(len(self.names)):
            bit = ((masks[:, i // 64] >> U64(i % 64)) & U64(1)).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(bit)])
            hits[:, i] = sums[first[1:]] - sums[first[:-1]]
        true = np.maximum(0, (hits - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)))
        best = true.argmax(1) if len(self.names) else np.zeros(len(n), int)
        top = true[np.arange(len(n)), best] if len(self.names) else np.zeros(len(n))
        return np.where(top > 0, best, -1), np.minimum(1, top / np.maximum(n, 1))


def train(docs: DataFrame, per_language: int = 1500, least_share: float = 0.1, most_grams: int = 20_000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Each language's sample goes to a task of its own; its n-grams (a bounded list) come to the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Filters.build({}, {})
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 12) / F.lit(float(1 << 52))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    sample = rows.filter(draw < share)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, docs_with = [], len(pdf)
        data, offsets = text_buffers(pa.array(pdf["text"], pa.string()))
        for lo, hi in pieces_of(offsets):
            hashes, first = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            found += [np.unique(hashes[first[i] : first[i + 1]]) for i in range(hi - lo)]
        kinds, n = np.unique(np.concatenate([*found, np.zeros(0, U64)]), return_counts=True)
        keep = np.lexsort((kinds, -n))[:most_grams]
        keep = keep[n[keep] >= max(1, least_share * docs_with)]
        return pd.DataFrame({"lang": [key[0]], "grams": [kinds[keep].tobytes()]})

    learned = sample.groupBy("lang").applyInPandas(run, "lang string, grams binary").collect()
    return Filters.build({r["lang"]: np.frombuffer(bytes(r["grams"]), U64) for r in learned}, counts)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(~_NO_LETTER[data])])
    out = (ascii_letters[offsets[1:]] - ascii_letters[offsets[:-1]]) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names; whole texts, one pass, no exchange. The filters
    are of bounded size."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    plain = docs.select(docs[text_col].cast("string").alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(kept)))
    schema = plain.drop("text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0).cast("double")).schema
    held = docs.sparkSession.sparkContext.broadcast((filters.names, filters.table, filters.counts, filters.probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*held.value)
        usual = own.names[int(np.argmax(own.counts))] if own.names else "und"
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            langs, scores = [], []
            for lo, hi in pieces_of(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                best, score = own.decide(*grams(part, at))
                for i, letter in enumerate(has_letter(part, at)):
                    langs.append("und" if not letter else own.names[best[i]] if best[i] >= 0 else usual)
                    scores.append(float(score[i]) if letter else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return plain.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")
