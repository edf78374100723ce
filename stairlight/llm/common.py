"""Shared pieces: scratch tables on the cluster's shared folder and numpy text kernels.

Text kernels work on whole Arrow batches: the UTF-8 buffer is split into words by lookup tables and every
word gets a 64-bit hash from one polynomial pass, so no Python object is made per word.
"""

from __future__ import annotations

import functools
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; where none is set, one of this machine's, if all runs in the driver's process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stairlight-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


class Scratch:
    """Written tables that cut lineage. They lie in shared storage, so a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def worker_state(key: tuple, make):
    """What a Python worker keeps from task to task (a tokenizer, remembered words)."""
    holder = sys.modules.setdefault("_stairlight_state", types.ModuleType("_stairlight_state")).__dict__
    if key not in holder:
        holder[key] = make()
    return holder[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed))


_SYMBOL = seeds(256, 7)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, grown to n entries by doubling."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * U64(pow(base, k, 1 << 64))])
    return _powers


@functools.lru_cache(maxsize=4)
def _powers_of(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(1, U64)
        while len(p) < size:
            p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base and of its inverse, modulo 2**64."""
    return _powers_of(1 << max(12, (n - 1).bit_length()), base)


def _table(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Bytes that are part of words `[^\x20\x09-\x0D]+`.
SPACE_WORDS = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes that are part of words of letters and digits; bytes of non-ASCII characters all count.
ALNUM_WORDS = _table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def pieces_of(offsets: np.ndarray, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `size` bytes; a longer document is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


#: First and last code points of scripts written without spaces between words: Thai, Lao, Tibetan, Myanmar; Khmer; Tai
#: Le to Tai Lue; Tai Tham; Balinese; CJK with kana and its punctuation; Javanese and Myanmar extended; more ideographs; full and half width.
UNSPACED = np.array([(0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF)])


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the characters of UNSPACED scripts in UTF-8 text, and the bytes after them."""
    lead = np.flatnonzero(data >= 0xE0)
    tail = [(data[np.minimum(lead + i, len(data) - 1)] & 63).astype(np.int64) for i in (1, 2, 3)] if len(lead) else [lead] * 3
    four = data[lead] >= 0xF0
    top = data[lead].astype(np.int64)
    point = np.where(four, (top & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], (top & 15) << 12 | tail[0] << 6 | tail[1])
    row = np.maximum(np.searchsorted(UNSPACED[:, 0], point, "right") - 1, 0)
    found = (UNSPACED[row, 0] <= point) & (point <= UNSPACED[row, 1])
    return lead[found], np.minimum(lead + 3 + four, len(data))[found]


class Words:
    """The words of some documents: byte ranges in `data`, a hash each, and where each document's words begin.

    first[i]:first[i + 1] are the words of document i. With `apart`, each character of an UNSPACED script is a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray = SPACE_WORDS, fold: np.ndarray = SAME, apart: bool = False):
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = member[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        if apart:
            for at in unspaced(data):
                cut[at] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | cut))
        self.ends = np.flatnonzero(before & (~inside | cut))
        self.data = data if fold is SAME else fold[data]
        self.first = np.searchsorted(self.starts, offsets)
        if len(self.starts):
            power, inverse = _power_tables(n)
            part = _SYMBOL[self.data] * power[:n]
            part[~inside[:n]] = 0
            sums = np.add.reduceat(part, self.starts)
            self.hashes = mix(sums * inverse[self.starts] + (self.ends - self.starts).astype(U64))
        else:
            self.hashes = np.zeros(0, U64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def batches_of_words(column: pa.Array, member=SPACE_WORDS, fold=SAME, size: int = 2 << 20, apart: bool = False) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(column)
    for lo, hi in pieces_of(offsets, size):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], member, fold, apart)


def shingles(hashes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions run over the end and are left out."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = hashes[:m].copy()
    for j in range(1, k):
        h = h * U64(base) + hashes[j : j + m]
    return mix(h)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and for each byte the number of characters that begin before it or at it."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    if len(at) < len(data):
        tail = [data[np.minimum(at + j, len(data) - 1)].astype(np.uint32) & 63 for j in (1, 2, 3)]
        two, three, four = (first & 31) << 6 | tail[0], (first & 15) << 12 | tail[0] << 6 | tail[1], (first & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        first = np.select([first < 0xC0, first < 0xE0, first < 0xF0], [first, two, three], four)
    return first, np.cumsum(lead)


class Bordered:
    """The characters of all words in a row, with a space before, between and after them."""

    def __init__(self, words: Words):
        points, upto = code_points(words.data)
        begin = upto[words.starts] - 1 if len(words.starts) else np.zeros(0, np.int64)
        lengths = upto[words.ends - 1] - begin if len(words.starts) else begin
        before = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(before[-1]) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
        self.flat = np.full(before[-1] + len(lengths) + 1, 32, U64)
        self.flat[place] = points[ranges(begin, lengths)]
        self.border = np.ones(len(self.flat), bool)
        self.border[place] = False
        self.first = before[words.first] + words.first

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n characters in a row of a word with its borders, and where each document's begin."""
        m = max(len(self.flat) - n + 1, 0)
        code, inside = self.flat[:m].copy(), np.ones(m, bool)
        for j in range(1, n):
            code = code * U64(_BASE) + self.flat[j : j + m]
            if j < n - 1:
                inside &= ~self.border[j : j + m]
        return mix(code[inside] + U64(n << 56)), np.concatenate([[0], np.cumsum(inside)])[np.minimum(self.first, m)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
