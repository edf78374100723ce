"""Katz backoff language model over words, counted and evaluated in partitioned tables.

Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, and one end a text; the model is of any order from two, with
start contexts. Seen n-grams have Good-Turing discounted relative counts (counts over 5 keep theirs); a context's freed
mass goes to its unseen words in proportion to their probability in the next shorter context, with the weight that makes
the whole sum to one exactly. One-word probabilities leave the freed mass to one unknown type.

No table is gathered: documents are read in pieces; a piece's distinct words go to the partition of their hash, which
counts them and answers the piece (a table by piece). Then, order by order, a piece's distinct n-grams, each with the
probability of its word in the shorter context, go to the partition of their context, which has all that the context's discounts,
weight and probabilities need. It answers the piece with the n-grams' probabilities (a table by piece), which go along with the
next order's n-grams; that is the recursion. The highest order returns sums per document. Frequent contexts are dealt out by their
last word, and only their few sums are shared (they are at most `4 * partitions` contexts an order). Counts of counts come from a
first look at the same partitions. N-grams and words are known by 64-bit hashes. fit() stores every order's counted n-grams by
partition; score_with() sends other documents' n-grams to the partitions that hold them; score() does both at once.

Defined cases: a null text is empty and has its end token alone; without training rows every token is the unknown
type, of probability one; repeated rows count and score each; a null id is kept; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, SPACE_WORDS, U64, Scratch, Words, mix, partitions, pieces_of, ranges, text_buffers
from .warc import open_store

CUT = 5  # counts above keep their relative frequency
END, START = U64(0xE5D0000000000001), U64(0x57A27000000000B3)
WORD_ROWS = "p int, piece long, hashes binary, counts binary"
ANSWERS = "p int, piece long, body binary"
#: The piece number of a stored model's rows.
MODEL = -1
PAIR_ROWS = "p int, piece long, kind int, body binary"


class Discounts:
    """Good-Turing factors for counts 1 to CUT from the counts of counts 1 to CUT + 1: Katz's, and where those leave
    (0, 1) or a count of counts is zero, Turing's r* = (r + 1) n(r + 1) / n(r) over a line fitted to log n(r). Where
    no falling line can be fitted, half a count is taken off every count."""

    def __init__(self, of: np.ndarray):
        n, r = np.array(of, float), np.arange(1, CUT + 2, dtype=float)
        self.factors, self.all = np.ones(CUT + 1), False
        usable = False
        if n.all():
            tail = (CUT + 1) * n[CUT] / n[0]
            if tail < 1:
                self.factors[1:] = (r[1:] * n[1:] / n[:-1] / r[:-1] - tail) / (1 - tail)
                usable = bool(((self.factors[1:] > 0) & (self.factors[1:] < 1)).all())
        if not usable:
            x, y = np.log(r[n > 0]), np.log(n[n > 0])
            slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()) if len(x) > 1 else 0.0
            self.factors[1:] = (1 + 1 / r[:-1]) ** (slope + 1)
            self.all = slope >= -1

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = counts.astype(np.float64)
        return np.maximum(c - 0.5, 0) if self.all else c * np.where(counts <= CUT, self.factors[np.minimum(counts, CUT)], 1.0)


class Unigrams:
    """One-word probabilities from a count and the totals."""

    def __init__(self, tokens: int, types: int, of: np.ndarray, singles_kept: float | None = None):
        self.tokens, self.types, self.discounts = tokens, types, Discounts(of)
        d = self.discounts
        lost = types * 0.5 if d.all else sum((1 - d.factors[r]) * r * of[r - 1] for r in range(1, CUT + 1))
        self.unknown = lost / tokens if tokens else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.kept(counts) / max(self.tokens, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


class Piece:
    """Tokens of some documents: index into the distinct words, and where each document begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, train: np.ndarray, parts: int):
        hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for lo, hi in pieces_of(offsets):  # the hash's tables grow with what is hashed at once
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACE_WORDS, LOWER)
            hashes.append(words.hashes)
            counts.append(words.counts)
        hashes, counts = np.concatenate(hashes), np.concatenate(counts) + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        tokens = np.full(self.first[-1], END)
        tokens[ranges(self.first[:-1], counts - 1)] = hashes
        self.kinds, self.index = np.unique(tokens, return_inverse=True)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.train = train[self.doc]
        self.counts = np.bincount(self.index[self.train], minlength=len(self.kinds)).astype(np.uint32)
        # words in the order of their partitions
        self.home = ((self.kinds >> U64(32)) % U64(parts)).astype(np.int64)
        self.order = np.argsort(self.home, kind="stable")
        self.edges = np.searchsorted(self.home[self.order], np.arange(parts + 1))

    def contexts(self, order: int) -> np.ndarray:
        """At each token, the hash of the order - 1 tokens before it; a text begins with START."""
        words = self.kinds[self.index]
        known = np.full(len(words), START)
        for k in range(2, order + 1):
            longer = np.full(len(words), START)
            longer[1:] = words[:-1] if k == 2 else extended(known[:-1], words[:-1])
            longer[self.first[:-1]] = START
            known = longer
        return known


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The context that a word makes with the context before it."""
    return mix(context * U64(0x9E3779B97F4A7C15) + word)


class Grams:
    """A piece's distinct n-grams of one order, by context and word, and the partition each goes to."""

    def __init__(self, piece: Piece, order: int, parts: int, heavy: np.ndarray):
        self.contexts, context = np.unique(piece.contexts(order), return_inverse=True)
        size = len(piece.kinds)
        code = context.astype(np.int64) * size + piece.index
        self.sorted = np.argsort(code, kind="stable")
        code = code[self.sorted]
        self.new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.times = np.diff(np.concatenate([self.new, [len(code)]]))
        self.trained = np.add.reduceat(piece.train[self.sorted].astype(np.int64), self.new)
        self.context, self.word = code[self.new] // size, code[self.new] % size
        home = self.contexts[self.context]
        home = np.where(np.isin(home, heavy), mix(home ^ piece.kinds[self.word]), home)
        home = ((home >> U64(32)) % U64(parts)).astype(np.int64)
        self.by = np.argsort(home, kind="stable")
        self.edges = np.searchsorted(home[self.by], np.arange(parts + 1))

    def of_tokens(self) -> np.ndarray:
        """Each token's n-gram."""
        out = np.empty(len(self.sorted), np.int64)
        out[self.sorted] = np.repeat(np.arange(len(self.new)), self.times)
        return out

    def bodies(self, piece: Piece, lower: np.ndarray, last: bool) -> Iterator[tuple[int, bytes]]:
        """For each partition: contexts and how many n-grams each has; of each n-gram the word, what `lower` says of it, its
        training count and, at the last order, its occurrences and their documents."""
        docs = piece.doc[self.sorted]
        for p in range(len(self.edges) - 1):
            own = self.by[self.edges[p] : self.edges[p + 1]]
            if len(own):
                begin = np.flatnonzero(np.concatenate([[True], self.context[own][1:] != self.context[own][:-1]]))
                times = self.times[own].astype(np.uint32) if last else np.zeros(0, np.uint32)
                yield p, _squeeze(self.contexts[self.context[own][begin]], np.diff(np.concatenate([begin, [len(own)]])).astype(np.uint32), piece.kinds[self.word[own]], lower[own], self.trained[own].astype(np.uint32), times, docs[ranges(self.new[own], self.times[own])].astype(np.uint32) if last else times)


def pieces(batches: Iterator[pa.RecordBatch], parts: int, size: int) -> Iterator[tuple[int, pa.Array, Piece]]:
    """Every piece with its number, which depends on the input's splits only."""
    number, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        train = np.array(batch.column(1).to_pylist(), bool)
        for lo, hi in pieces_of(offsets, size):
            yield task << 36 | number << 20, batch.column(0).slice(lo, hi - lo), Piece(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], train[lo:hi], parts)
            number += 1


def _squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()
    raw = head + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _stretch(body: bytes, kinds: list) -> list[np.ndarray]:
    raw = pa.decompress(bytes(body[8:]), int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += int(size) * np.dtype(kind).itemsize
    return out


def body_kinds(order: int) -> list:
    """Orders over two carry a probability; order two a word's count, which says the same in fewer bytes."""
    return [np.uint64, np.uint32, np.uint64, np.uint32 if order == 2 else np.float64, np.uint32, np.uint32, np.uint32]


class Table:
    """All n-grams of one order of a partition, counted. Rows of piece MODEL come from a stored model."""

    def __init__(self, rows: list[tuple[int, bytes]], order: int, unigrams: Unigrams, last: bool):
        found = [(piece, *_stretch(body, body_kinds(order))) for piece, body in rows]
        join = lambda i, kind: np.concatenate([np.zeros(0, kind), *(f[i] for f in found)])
        context = np.concatenate([np.zeros(0, np.uint64), *(np.repeat(f[1], f[2]) for f in found)])
        word, trained, times = join(3, np.uint64), join(5, np.int64).astype(np.int64), join(6, np.int64).astype(np.int64)
        self.pieces, self.sizes = [f[0] for f in found], [len(f[3]) for f in found]
        self.owner = np.concatenate([np.zeros(0, np.int64), *(f[0] + f[7].astype(np.int64) for f in found)])
        order_ = np.lexsort((word, context))
        c, w = context[order_], word[order_]
        new = np.ones(len(order_), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        self.rank = np.empty(len(order_), np.int64)
        self.rank[order_] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.counts = np.add.reduceat(trained[order_], at) if len(at) else np.zeros(0, np.int64)
        lower = join(4, np.int64 if order == 2 else np.float64)[order_][at]
        self.given, self.lower = lower, unigrams(lower.astype(np.int64)) if order == 2 else lower
        self.occurrence = np.repeat(self.rank, times) if last else None
        edge = np.ones(len(at), bool)
        edge[1:] = c[at][1:] != c[at][:-1]
        self.contexts, self.of, self.words = c[at][edge], np.cumsum(edge) - 1, w[at]

    def stored(self, order: int) -> bytes:
        """The n-grams seen in training, as a body that a later run reads beside its documents' own."""
        own = np.flatnonzero(self.counts > 0)
        context, sizes = np.unique(self.of[own], return_counts=True)
        lower = self.given[own].astype(np.uint32 if order == 2 else np.float64)
        return _squeeze(self.contexts[context], sizes.astype(np.uint32), self.words[own], lower, self.counts[own].astype(np.uint32), np.zeros(len(own), np.uint32), np.zeros(0, np.uint32))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, values, minlength=len(self.contexts))

    def count_of_counts(self) -> np.ndarray:
        return np.bincount(self.counts[(self.counts > 0) & (self.counts <= CUT + 1)], minlength=CUT + 2)[1:]

    def frequent(self, least: int) -> np.ndarray:
        """Contexts of the next order that are n-grams of this one with such a count."""
        own = np.flatnonzero(self.counts >= max(least, 1))
        return extended(self.contexts[self.of[own]], self.words[own])

    def vectors(self) -> np.ndarray:
        """For each context: n-grams of count 1 to CUT, those above, their counts in all, and the shorter context's mass
        of its seen words."""
        seen = self.counts > 0
        columns = [self.sums((self.counts == r).astype(float)) for r in range(1, CUT + 1)]
        above = np.where(self.counts > CUT, self.counts, 0)
        return np.stack([*columns, self.sums((above > 0).astype(float)), self.sums(above.astype(float)), self.sums(np.where(seen, self.lower, 0.0))], 1)

    def log_probabilities(self, discounts: Discounts, shared: dict[int, np.ndarray]) -> np.ndarray:
        """log10 P(word | context) of each n-gram."""
        v = self.vectors()
        for i in np.flatnonzero(np.isin(self.contexts, np.array(list(shared), np.uint64))):
            v[i] = shared[int(self.contexts[i])]
        r = np.arange(1, CUT + 1)
        total = v[:, :CUT] @ r + v[:, CUT + 1]
        kept = v[:, :CUT] @ discounts.kept(r) + (v[:, CUT + 1] - 0.5 * v[:, CUT] if discounts.all else v[:, CUT + 1])
        # a context without freed mass gets one more count, all of it free
        scale = np.where(total - kept > 1e-9 * np.maximum(total, 1), total, total + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, (1 - kept / scale) / (1 - v[:, CUT + 2]), 1.0)
            seen = np.log10(discounts.kept(self.counts) / scale[self.of])
            return np.where(self.counts > 0, seen, np.log10(weight[self.of] * self.lower))


def _word_rows(docs: DataFrame, parts: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, piece in pieces(batches, parts, size):
            rows = [(p, number, (own := piece.order[piece.edges[p] : piece.edges[p + 1]], piece.kinds[own].tobytes())[1], piece.counts[own].tobytes()) for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["p", "piece", "hashes", "counts"])

    return docs.mapInArrow(run, WORD_ROWS)


def _answers(rows: DataFrame, parts: int, keep: bool) -> DataFrame:
    """For each piece and partition the words' counts over all pieces; and a row of totals a partition (piece null):
    tokens, types, counts of counts, and the most frequent words with their counts. keep: also the words seen (MODEL)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        if not got:
            return
        kinds, index = np.unique(np.frombuffer(b"".join(r[2] for r in got), np.uint64), return_inverse=True)
        total = np.bincount(index, np.frombuffer(b"".join(r[3] for r in got), np.uint32), len(kinds)).astype(np.int64)
        known, at, out = total[total > 0], 0, []
        for p, piece, hashes, _ in got:
            n = len(hashes) // 8
            if piece != MODEL:
                out.append((p, piece, zlib.crc32(hashes).to_bytes(4, "little") + total[index[at : at + n]].astype("<i8").tobytes(), None))
            at += n
        top = np.argsort(-total, kind="stable")[:64]
        stats = np.concatenate([[known.sum(), len(known)], np.bincount(known[known <= CUT + 1], minlength=CUT + 2)[1:]]).astype("<i8")
        out.append((got[0][0], None, stats.tobytes(), kinds[top].tobytes() + total[top].astype("<i8").tobytes()))
        if keep:
            out.append((got[0][0], MODEL, kinds[total > 0].tobytes(), known.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["p", "piece", "hashes", "counts"])

    return rows.repartitionById(parts, F.col("p")).mapInArrow(run, WORD_ROWS)


def _read_answer(folder: str, number: int) -> dict[int, bytes]:
    """What the partitions answered to a piece."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = open_store(f"{folder}/piece={number}")
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    return {r["p"]: r["body"] for f in files for r in pq.read_table(store.open_input_file(f)).to_pylist()}


def _counts(folder: str, number: int, piece: Piece) -> np.ndarray:
    """The training counts of the piece's words."""
    rows, out = _read_answer(folder, number), np.empty(len(piece.kinds), np.int64)
    for p in range(len(piece.edges) - 1):
        own = piece.order[piece.edges[p] : piece.edges[p + 1]]
        if int.from_bytes(rows[p][:4], "little") != zlib.crc32(piece.kinds[own].tobytes()):
            raise RuntimeError("documents are dealt into other pieces than before; write them to a table first")
        out[own] = np.frombuffer(rows[p], "<i8", offset=4)
    return out


def _probabilities(folder: str, number: int, grams: Grams) -> np.ndarray:
    rows = _read_answer(folder, number)
    out = np.empty(len(grams.by))
    out[grams.by] = np.concatenate([np.frombuffer(rows[p], "<f8") for p in range(len(grams.edges) - 1) if p in rows])
    return out


def _by_piece(answers: DataFrame, folder: str) -> None:
    answers.repartition(partitions(answers.sparkSession), "piece").write.option("compression", "zstd").partitionBy("piece").parquet(folder)


def score(docs: DataFrame, train: str, order: int = 2, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 6 << 20, part_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; `train` is a SQL condition
    that marks the rows to learn from. docs must be read from files, so that a second reading has the same splits (it
    is checked); another DataFrame is to be written to a table first."""
    return _run(docs, train, order, id_col, text_col, piece_bytes, part_bytes)


def fit(docs: DataFrame, path: str, order: int = 2, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 6 << 20, part_bytes: int = 6 << 20) -> None:
    """Learn from all rows and store the model under path: a table of words and one of n-grams for each order, both by
    partition of the context, and a row of settings."""
    _run(docs, "true", order, id_col, text_col, piece_bytes, part_bytes, save=path)


def score_with(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 6 << 20) -> DataFrame:
    """score() of rows that the stored model has not learned from; every row is held out."""
    kept = docs.sparkSession.read.parquet(f"{path}/settings").first()
    return _run(docs, "false", kept["order"], id_col, text_col, piece_bytes, 0, parts=kept["parts"], model=path)


def _run(docs: DataFrame, train: str, order: int, id_col: str, text_col: str, piece_bytes: int, part_bytes: int, parts: int | None = None, save: str | None = None, model: str | None = None) -> DataFrame | None:
    """save: store the model and score nothing; model: n-grams stored before join the documents' own in their partitions."""
    if order < 2:
        raise ValueError("the order must be two or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"coalesce({train}, false)").alias("train"), F.col(text_col).cast("string").alias("text"))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = max(4, math.ceil(size / part_bytes))
    if save:
        spark.createDataFrame([(order, parts)], "`order` int, parts int").write.parquet(f"{save}/settings")
    also = lambda rows, level: rows.unionByName(spark.read.parquet(f"{model}/order-{level}")) if model else rows

    answers = scratch.table(_answers(also(_word_rows(docs, parts, piece_bytes), 1), parts, save is not None), "answers")
    if save:
        answers.filter(F.col("piece") == MODEL).write.option("compression", "zstd").parquet(f"{save}/order-1")
        answers = answers.filter(F.coalesce(F.col("piece") != MODEL, F.lit(True)))
    totals = answers.filter("piece is null").collect()  # a row a partition
    stats = sum((np.frombuffer(bytes(r["hashes"]), "<i8") for r in totals), np.zeros(CUT + 3, np.int64))
    unigrams = Unigrams(int(stats[0]), int(stats[1]), stats[2:])
    frequent = np.concatenate([np.zeros((0, 2), np.uint64), *(np.frombuffer(bytes(r["counts"]), np.uint64).reshape(2, -1).T for r in totals)])
    least = -(-max(unigrams.tokens, 1) // (4 * parts))
    heavy = {2: np.concatenate([[START], frequent[frequent[:, 1] >= U64(least), 0]])}
    folders = {1: scratch.path("by-piece-1")}
    _by_piece(answers.filter("piece is not null").select("p", F.col("hashes").alias("body"), "piece"), folders[1])
    scratch.drop("answers")

    def asking(level: int) -> DataFrame:
        """Each piece's n-grams of this order for each partition (kind 0); at the last, a row of its documents (kind 1)."""
        last = level == order

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, ids, piece in pieces(batches, parts, piece_bytes):
                counts, grams = _counts(folders[1], number, piece), Grams(piece, level, parts, heavy[level])
                occurs = grams.sorted[grams.new]  # a token of each n-gram
                if level == 2:
                    lower = counts[piece.index[occurs]].astype(np.uint32)
                else:
                    shorter = Grams(piece, level - 1, parts, heavy[level - 1])
                    lower = _probabilities(folders[level - 1], number, shorter)[shorter.of_tokens()[occurs]]
                rows = [(p, number, 0, body) for p, body in grams.bodies(piece, lower, last)]
                if last:
                    token = counts[piece.index]
                    known = np.add.reduceat((token > 0).astype(np.int64), piece.first[:-1])
                    base = np.add.reduceat(unigrams.base(token), piece.first[:-1])
                    null = np.array(ids.is_null())
                    own = _squeeze(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null.astype(np.uint8), np.array([not t for t in piece.train[piece.first[:-1]]], np.uint8), np.diff(piece.first).astype(np.int64), known, base)
                    rows.append((number // (1 << 20) % parts, number, 1, own))
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, [pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["p", "piece", "kind", "body"])

        return docs.mapInArrow(ask, PAIR_ROWS)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """A piece's documents with the sums of all partitions."""
        bodies = list(zip(pdf["kind"], pdf["body"], strict=True))
        own = next(b for k, b in bodies if k)
        ids, null, held, tokens, known, base = _stretch(own, [np.int64, np.uint8, np.uint8, np.int64, np.int64, np.float64])
        score = np.zeros(len(ids))
        for kind, body in bodies:
            if not kind:
                docs, sums = _stretch(body, [np.int64, np.float64])
                score[docs] += sums
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held.astype(bool), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score}).assign(doc_id=lambda x: x["doc_id"].mask(null.astype(bool)))

    for level in range(2, order + 1):
        # an RDD, because two jobs read one shuffle of it: the first for counts of counts, the second for the answers
        asked, last = also(asking(level), level).repartitionById(parts, F.col("p")).rdd, level == order

        def look(rows: Iterator, level: int = level, last: bool = last) -> Iterator[tuple]:
            table = Table([(r["piece"], bytes(r["body"])) for r in rows if r["kind"] == 0], level, unigrams, last)
            shared = np.flatnonzero(np.isin(table.contexts, heavy[level]))
            vectors = table.vectors()
            more = np.zeros(0, U64) if last else table.frequent(least)
            yield table.count_of_counts().tolist(), [(int(table.contexts[i]), vectors[i].tolist()) for i in shared], more.tolist()

        looks = asked.mapPartitions(look).collect()
        discounts = Discounts(sum((np.array(n) for n, _, _ in looks), np.zeros(CUT + 1, np.int64)))
        shared: dict[int, np.ndarray] = {}
        for _, vectors, _ in looks:
            for context, v in vectors:
                shared[context] = shared.get(context, 0) + np.array(v)
        heavy[level + 1] = np.array([int(START), *(c for _, _, more in looks for c in more)], np.uint64)

        def store(rows: Iterator, level: int = level, last: bool = last) -> Iterator[tuple]:
            rows = [(r["p"], r["piece"], bytes(r["body"])) for r in rows if r["kind"] == 0]
            if rows:
                yield int(rows[0][0]), MODEL, 0, Table([r[1:] for r in rows], level, unigrams, last).stored(level)

        if save:
            spark.createDataFrame(asked.mapPartitions(store), PAIR_ROWS).write.option("compression", "zstd").parquet(f"{save}/order-{level}")

        def answer(rows: Iterator, level: int = level, discounts: Discounts = discounts, shared: dict = shared, last: bool = last) -> Iterator[tuple]:
            rows = [(r["p"], r["piece"], r["kind"], bytes(r["body"])) for r in rows]
            table = Table([(piece, body) for _, piece, kind, body in rows if not kind], level, unigrams, last)
            logs = table.log_probabilities(discounts, shared)
            if not last:
                values, at = 10 ** logs[table.rank], 0
                for piece, n in zip(table.pieces, table.sizes, strict=True):
                    if piece != MODEL:
                        yield int(rows[0][0]), int(piece), values[at : at + n].astype("<f8").tobytes()
                    at += n
                return
            owners, index = np.unique(table.owner, return_inverse=True)
            sums = np.bincount(index, logs[table.occurrence], len(owners))
            number = owners >> 20 << 20
            for piece, at, n in zip(*np.unique(number, return_index=True, return_counts=True), strict=True):
                yield 0, int(piece), _squeeze(owners[at : at + n] - piece, sums[at : at + n])
            for _, piece, kind, body in rows:
                if kind:
                    yield 1, piece, body

        found = asked.mapPartitions(answer)
        if not last:
            folders[level] = scratch.path(f"by-piece-{level}")
            _by_piece(spark.createDataFrame(found, ANSWERS), folders[level])

    if save:
        scratch.drop(*(f"by-piece-{k}" for k in folders))
        return None
    # a row a piece and partition; documents become rows only when their sums are whole
    sums = spark.createDataFrame(found, "kind int, piece long, body binary")
    scored = scratch.table(sums.groupBy("piece").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    scratch.drop(*(f"by-piece-{k}" for k in folders))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.tokens).cast("long").alias("train_tokens"), "base_score", "score")
