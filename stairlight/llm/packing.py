"""Packing documents into token windows of fixed length, by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's tail goes to the open window that it fills
best; when it fits none, the fullest window is emitted, topped up with a cut piece when its gap is worth a cut.
At the end the leftovers of a partition are merged, then those of groups of partitions, level by level, so
that at most one window in all stays part full.

Defined cases: a null text is empty; an empty document still has its end token; a document longer than a
window is cut into whole windows and a tail; repeated rows and equal or null ids are packed each by itself;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, worker_state

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary, home long"
#: Words of these characters are cut, folded and mapped here; all others go through the whole tokenizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-Þß-öø-ÿ]*\Z")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The vocabulary file's settings under which words may be encoded one by one and plain ones cut here.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


def _is_known(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    plain = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in own["added_tokens"])
    return plain and own["model"]["type"] == "BPE" and all(own.get(k) == v for k, v in _KNOWN.items())


def _byte_letters() -> dict[int, int]:
    """The byte-level vocabulary's letter for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))}


class WordEncoder(dict):
    """Ids of one white-space separated word as little-endian bytes, remembered up to `limit` words.

    A pre-tokenizer of the known kind never crosses white space, so a text's ids are its words' ids in a row.
    Plain words are cut by its pattern and each part is remembered too, because parts repeat far more often than words.
    With a vocabulary of other settings, every text goes through the whole tokenizer."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.parts, self.limit = Tokenizer.from_file(path), {}, limit
        self.model, self.letters, self.known = self.tokenizer.model, _byte_letters(), _is_known(path)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.match(text) and "<|" not in text:
            out = b""
            for part in _CUT.findall(text.lower()):
                if (ids := self.parts.get(part)) is None:
                    if len(self.parts) >= self.limit:
                        self.parts.clear()
                    ids = self.parts[part] = self._part(part)
                out += ids
        else:
            out = self._encode(text)
        if len(self) >= self.limit:
            self.clear()
        self[word] = out
        return out

    def text(self, text: bytes) -> bytes:
        if not self.known:
            return self._encode(text.decode())
        return b"".join(map(self.__getitem__, text.split()))


class Packer:
    """Open windows of one partition. A window is a list of pieces (doc, start, ids, doc tokens)."""

    def __init__(self, length: int, open_windows: int, split_gap: int, number: int):
        self.length, self.most, self.gap = length, open_windows, split_gap
        self.number, self.free, self.windows = number, [], {}
        self.out: list[tuple] = []

    def _next(self) -> int:
        self.number += 1
        return self.number - 1

    def emit(self, pieces: list[tuple]) -> None:
        number, at = self._next(), 0
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), tokens, number, at, ids, None))
            at += n

    def add(self, doc, ids: bytes) -> None:
        tokens, size, at = len(ids) // 4, self.length * 4, 0
        while len(ids) - at >= size:
            self.emit([(doc, at // 4, ids[at : at + size], tokens)])
            at += size
        while at < len(ids):
            n = (len(ids) - at) // 4
            k = bisect_left(self.free, (n, -1))
            if k == len(self.free) and len(self.free) < self.most:
                key = self._next()
                insort(self.free, (self.length, key))
                self.windows[key] = []
                continue
            cut = n
            if k == len(self.free):  # fits none: the fullest goes
                room, key = self.free.pop(0)
                pieces = self.windows.pop(key)
                cut = room if room >= self.gap else 0
                if cut:
                    pieces.append((doc, at // 4, ids[at : at + 4 * cut], tokens))
                self.emit(pieces)
            else:
                room, key = self.free.pop(k)
                pieces = self.windows[key]
                pieces.append((doc, at // 4, ids[at : at + 4 * cut], tokens))
                if room == cut:
                    self.emit(self.windows.pop(key))
                else:
                    insort(self.free, (room - cut, key))
            at += 4 * cut

    def leftovers(self) -> list[tuple]:
        return merge([p for _, key in self.free for p in self.windows[key]], self)


def merge(pieces: list[tuple], packer: Packer) -> list[tuple]:
    """Lay pieces end to end, emit every full window, and return the pieces of the part-full last one."""
    window, room = [], packer.length
    for doc, start, ids, tokens in pieces:
        while ids:
            cut = ids[: 4 * room]
            window.append((doc, start, cut, tokens))
            start, ids, room = start + len(cut) // 4, ids[len(cut) :], room - len(cut) // 4
            if not room:
                packer.emit(window)
                window, room = [], packer.length
    return window


def _rows(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "home"]
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    if not keep_ids:
        rows = [(*r[:7], r[7] if r[8] is not None else None, r[8]) for r in rows]
    columns = zip(*rows, strict=True) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _left(pieces: list[tuple], home: int) -> list[tuple]:
    return [(doc, start, len(ids) // 4, None, tokens, home, None, ids, home) for doc, start, ids, tokens in pieces]


def _merging(length: int, split_gap: int, depth: int, group: int, last: bool, keep_ids: bool):
    """Merges the leftovers of a group of partitions; the last merge also emits its part-full window."""

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        home = int(pdf["home"].iloc[0]) // group
        packer = Packer(length, 0, split_gap, (depth << 60) | (home << 20))
        pdf = pdf.sort_values(["home", "doc_id", "start"], kind="stable")
        pieces = [(None if pd.isna(d) else int(d), int(s), bytes(i), int(t)) for d, s, i, t in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"], strict=True)]
        left = merge(pieces, packer)
        if last:
            packer.emit(left)
            left = []
        return _rows(packer.out + _left(left, home), keep_ids).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return again


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, open_windows: int = 64, split_gap: int = 32, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", group: int = 256) -> DataFrame:
    """One row per piece: its document range, its place in a sequence, and its ids (little-endian u32) or, without
    keep_ids, their CRC-32 only. A partition holds `open_windows` windows in memory, whatever its size."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, home = worker_state(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path)), TaskContext.get().partitionId()
        packer, end = Packer(length, open_windows, split_gap, home << 40), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                packer.add(doc, encoder.text(text.as_py()) + end)
                if len(packer.out) >= 4096:
                    yield _rows(packer.out, keep_ids)
                    packer.out = []
        left = packer.leftovers()
        yield _rows(packer.out + _left(left, home), keep_ids)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level = scratch.table(source.mapInArrow(run, PIECES), "level0")
    out = [level.filter("home is null")]
    homes = level.agg(F.max("home").alias("m")).first()["m"]
    spread, depth = homes, 0
    while spread is not None:
        depth += 1
        last = spread < group

        again = _merging(length, split_gap, depth, group, last, keep_ids)
        level = scratch.table(level.filter("home is not null").groupBy(F.expr(f"home div {group}")).applyInPandas(again, PIECES), f"level{depth}")
        out.append(level.filter("home is null"))
        spread = None if last else spread // group
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    return whole.select(*columns)
