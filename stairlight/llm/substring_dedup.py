"""Substring dedup: words covered by a window of `window` words that also starts earlier in the corpus go.

Suffix automata give the matching statistics: the longest suffix, at each word, that occurs in the reference. A
bounded reference (`remove_reference`) is cut into shards, and each shard's automaton goes to every task. Where the
reference is the corpus itself (`repeated_ranges`), it has no bound, so nothing is broadcast: each window is named by
its anchor, the smallest hash of its word grams, so equal windows have equal anchors, and a stretch is a run of windows
of one anchor. An anchor that occurs once has no repeat. Equal stretches (by a 64-bit name beside the anchor's hash) are reduced
by an aggregate to the first of them, and the others lose all their windows; the different stretches of one anchor
meet in one task, in corpus order, and each is streamed through the automaton of those before it and then added to it. For
an anchor of more than MANY different stretches the aggregate goes by single window instead, where nothing is
left for an automaton to find; so no task holds an unbounded group.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Defined cases: null and empty texts have no words; texts of fewer words
than the window lose nothing; rows of equal text lose all windows but in the row of the smallest id; rows of one id
and text are one document, repeated, and none of them is the earlier; rows of one id with different texts are documents of
their own, in the order of their texts' hashes `v` (0 where an id has one text); a null id counts as smaller than all
others, and rows with null ids go by the same rules; an empty table gives no rows; other columns are ignored or,
by remove_repeats(), kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, Scratch, Words, batches_of_words, mix, partitions, pieces_of, powers, shingles, signed, text_buffers

GRAM = 6
#: Different stretches of one anchor that meet in a task's automaton; beyond, windows are compared one by one.
MANY = 2048
_TERM = 0xA0761D6478BD642F


class SuffixAutomaton:
    """Of several texts over hashable symbols; states are numbered from the root, 0."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state of p's longest text plus symbol: q, or a copy of q that is that short."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, text: list) -> None:
        last = 0
        for symbol in text:
            if symbol in self.next[last]:
                last = self._split(last, symbol, self.next[last][symbol])
                continue
            state, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = state
                p = self.link[p]
            if p >= 0:
                self.link[state] = self._split(p, symbol, self.next[p][symbol])
            last = state

    def matching(self, text: list) -> list[int]:
        """At each place, the length of the longest suffix of text up to there that occurs in an added text."""
        out, state, n = [], 0, 0
        follow, link, length = self.next, self.link, self.length
        for symbol in text:
            while symbol not in follow[state]:
                if not state:
                    n = -1
                    break
                state = link[state]
                n = length[state]
            if n >= 0:
                state = follow[state][symbol]
            n += 1
            out.append(n)
        return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (begin, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def stretch_names(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of the words from each start to before its end."""
    terms, inverse = powers(len(hashes) + 1, _TERM)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ U64(_TERM)) * terms[: len(hashes)], dtype=U64)])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def anchors(words: Words, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, hash, name, first window and number of windows of each stretch; windows count from their document's first."""
    gram = min(gram, window)
    grams, reach = shingles(words.hashes, gram), window - gram + 1
    n = len(words.hashes) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.view(U64), none.view(U64), none, none
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, reach):
        lower = grams[j : j + n] < best
        best[lower] = grams[j : j + n][lower]
        place[lower] = np.flatnonzero(lower) + j
    doc = np.repeat(np.arange(len(words.counts)), words.counts)[:n]
    valid = np.flatnonzero(np.arange(n) + window <= words.first[doc + 1])
    if not len(valid):
        return none, none.view(U64), none.view(U64), none, none
    new = np.concatenate([[True], (place[valid][1:] != place[valid][:-1]) | (doc[valid][1:] != doc[valid][:-1])])
    at = np.flatnonzero(new)
    start, many = valid[at], np.diff(np.concatenate([at, [len(valid)]]))
    return doc[start], best[start], stretch_names(words.hashes, start, start + many + window - 1), start - words.first[doc[start]], many


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    names = ["anchor", "name", "doc_id", "v", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, words in batches_of_words(batch.column(1)):
                doc, h, name, at, n = anchors(words, window)
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(name)), ids.take(rows), batch.column(2).take(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names)

    return docs.select("doc_id", "text", "v").mapInArrow(run, "anchor long, name long, doc_id long, v long, at int, n int")


def _stretches(texts: DataFrame, window: int) -> DataFrame:
    """The words of each stretch; those of anchors with many stretches come window by window, as names only."""
    names = ["anchor", "name", "doc_id", "v", "at", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            lists = batch.column(2)
            bounds, fields = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            anchor, at, n, many = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ids, versions = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in pieces_of(offsets):
                plain = [b" ".join(data[offsets[d] : offsets[d + 1]].tobytes().split()) for d in range(lo, hi)]
                whole = b"".join(plain)
                words = Words(np.frombuffer(whole, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in plain])]))
                starts, ends, rows = words.starts.tolist(), words.ends.tolist(), []
                for d in range(lo, hi):
                    first, last = int(words.first[d - lo]), int(words.first[d - lo + 1])
                    for k in range(bounds[d], bounds[d + 1]):
                        a, m = int(at[k]), int(n[k])
                        if first + a + m + window - 1 > last:  # another text of the same hash
                            continue
                        if many[k] <= MANY:
                            rows.append((anchor[k], None, ids[d], versions[d], a, m, whole[starts[first + a] : ends[first + a + m + window - 2]]))
                        else:
                            own = np.arange(first + a, first + a + m)
                            rows += [(anchor[k], name, ids[d], versions[d], a + s, 1, None) for s, name in enumerate(signed(stretch_names(words.hashes, own, own + window)).tolist())]
                    if len(rows) > 50_000:
                        yield _batch(rows, names)
                        rows = []
                yield _batch(rows, names)

    return texts.select("doc_id", "text", "places", "v").mapInArrow(run, "anchor long, name long, doc_id long, v long, at int, n int, words binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"at": pa.int32(), "n": pa.int32(), "begin": pa.int32(), "end": pa.int32(), "words": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(name, pa.int64())) for c, name in zip(columns, names, strict=True)], names)


class Shard:
    """The different stretches of one anchor in corpus order: an automaton of those so far."""

    def __init__(self, anchor, window: int):
        self.anchor, self.window, self.automaton, self.waiting, self.last = anchor, window, None, None, None

    def repeated(self, doc, at: int, stretch: bytes) -> list[tuple[int, int]]:
        """Word ranges (begin, end) of the windows of this stretch that start earlier too."""
        if self.last == (doc, at):  # a repeated row
            return []
        self.last, symbols, out = (doc, at), stretch.split(b" "), []
        if self.waiting is not None:  # the automaton begins with the second stretch
            if self.automaton is None:
                self.automaton = SuffixAutomaton()
            self.automaton.add(self.waiting)
            longest = np.array(self.automaton.matching(symbols)[self.window - 1 :])
            out = [(at + a, at + b + self.window - 1) for a, b in runs(longest >= self.window)]
        self.waiting = symbols
        return out


def _matched(stretches: DataFrame, window: int) -> DataFrame:
    spread = stretches.repartition(partitions(stretches.sparkSession), "anchor").sortWithinPartitions("anchor", "doc_id", "v", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(None, window)
        for batch in batches:
            out = []
            for anchor, doc, v, at, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard.anchor != anchor:
                    shard = Shard(anchor, window)
                out += [(doc, v, begin, end) for begin, end in shard.repeated((doc, v), at, words)]
            yield _batch(out, ["doc_id", "v", "begin", "end"])

    return spread.select("anchor", "doc_id", "v", "at", "words").mapInArrow(run, "doc_id long, v long, begin int, end int")


def _reduced(rows: DataFrame, scratch: Scratch, name: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (anchor, name, n, doc_id, v, at): the first of each anchor, name and length (its place, and how many rows it
    has), and the word ranges of the others. A task sends one row for all that it has of a stretch."""
    # the aggregate is written before it is joined back: over one exchange, a hot key of the join is not split
    firsts = scratch.table(rows.groupBy("anchor", "name", "n").agg(F.min(F.struct("doc_id", "v", "at")).alias("f"), F.count(F.lit(1)).alias("c")), name)
    again = firsts.filter("c > 1").select("anchor", "name", "n", "f")
    others = rows.join(again, ["anchor", "name", "n"]).filter("doc_id <> f.doc_id or v <> f.v or at <> f.at")
    return firsts, others.select("doc_id", "v", F.col("at").alias("begin"), (F.col("at") + F.col("n") + window - 1).alias("end"))


def versions(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids (clash) of docs (doc_id, text) whose rows have different texts."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return scratch.table(docs.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("clash")), "clashes")


def version(text: Column) -> Column:
    """v of a row, after a left join with the clashes."""
    return F.when(F.col("clash").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.coalesce(text, F.lit(""))))


def repeated_ranges(docs: DataFrame, scratch: Scratch, window: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ranges (doc_id, v, begin, end) of words to remove; copies (doc_id, v): rows whose text a smaller id has, which
    lose all their windows; and texts (doc_id, v, text) of the documents that have ranges. docs: doc_id, text, v."""
    docs = docs.select("doc_id", "text", "v")
    named = docs.select("doc_id", "v", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    # aggregates are written before they are joined back: over one exchange, a hot key of the join is not split
    firsts = scratch.table(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "firsts")
    copies = scratch.table(named.join(firsts, "digest").filter("doc_id <> first").select("doc_id", "v").distinct(), "copies")
    found = scratch.table(_anchors(docs, window), "anchors")
    often = scratch.table(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("anchor"), "often")
    places = scratch.table(found.join(often, "anchor").join(copies, ["doc_id", "v"], "left_anti"), "places")
    scratch.drop("firsts", "anchors", "often")

    stretches, equal = _reduced(places, scratch, "stretches", window)
    different = scratch.table(stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "different")
    todo = stretches.join(different, "anchor").groupBy("f.doc_id", "f.v").agg(F.collect_list(F.struct("anchor", "f.at", "n", "many")).alias("places"))
    words = scratch.table(_stretches(docs.join(todo, ["doc_id", "v"]), window), "words")
    windows, alike = _reduced(words.filter("name is not null"), scratch, "windows", window)
    ranges = scratch.table(equal.unionByName(alike).unionByName(_matched(words.filter("name is null"), window)), "ranges")
    scratch.drop("places", "stretches", "different", "words", "windows")
    texts = docs.join(ranges.select("doc_id", "v").distinct(), ["doc_id", "v"], "left_semi")
    return ranges, copies, texts.select("doc_id", "v", "text")


def _cut(text: bytes, begins: list[int], ends: list[int]) -> tuple[int, bytes]:
    """Number of words removed and the kept words, joined by one space."""
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, np.minimum(begins, len(words)), 1)
    np.add.at(gone, np.minimum(ends, len(words)), -1)
    kept = [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]
    return len(words) - len(kept), b" ".join(kept)


def _applied(docs: DataFrame, texts: bool) -> DataFrame:
    """doc_id, v, n_words, n_removed and kept, a text or its SHA-256. docs: doc_id, text, ranges (null: none), v."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, ranges, v in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = (text or "").encode()
                n = len(raw.split())
                gone, kept = _cut(raw, [r["begin"] for r in ranges], [r["end"] for r in ranges]) if ranges else (0, b" ".join(raw.split()))
                rows.append((doc, v, n, gone, kept.decode() if texts else hashlib.sha256(kept).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "v", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "ranges", "v").mapInArrow(run, "doc_id long, v long, n_words long, n_removed long, kept string")


def _by_document(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc_id", "v").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))


def removal_digests(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row. Only texts that lose words move a second time."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.join(versions(docs, scratch), F.col("doc_id") == F.col("clash"), "left").select("doc_id", "text", version(F.col("text")).alias("v"))
    ranges, copies, texts = repeated_ranges(docs, scratch, window)
    plain = _applied(docs.withColumn("ranges", F.lit(None).cast("array<struct<begin:int,end:int>>")), False)
    changed = scratch.table(_applied(texts.dropDuplicates(["doc_id", "v"]).join(_by_document(ranges), ["doc_id", "v"]), False), "changed")
    gone = copies.withColumn("copy", F.lit(True))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = plain.join(changed.select("doc_id", "v", F.col("n_removed").alias("r"), F.col("kept").alias("k")), ["doc_id", "v"], "left").join(gone, ["doc_id", "v"], "left")
    all_gone = F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= window)
    return out.select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).alias("n_removed"), F.when(all_gone, nothing).otherwise(F.coalesce("k", "kept")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated words removed from text_col; texts that lose nothing stay as they are."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    clashes = versions(own, scratch)
    own = own.join(clashes, F.col("doc_id") == F.col("clash"), "left").select("doc_id", "text", version(F.col("text")).alias("v"))
    ranges, copies, _ = repeated_ranges(own, scratch, window)
    by = _by_document(ranges).withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "v", F.array().cast("array<struct<begin:int,end:int>>").alias("ranges"), F.lit(True).alias("copy")))
    by = by.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "v", "ranges", "copy")))
    # the caller's columns in one, so that none has a name of this join's
    rows = docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_row"), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("_id"), docs[text_col].cast("string").alias("_text"))
    rows = rows.join(clashes, F.col("_id") == F.col("clash"), "left").select("_row", "_id", version(F.col("_text")).alias("_at"))
    joined = rows.join(by, (F.col("_id") == F.col("_doc_id")) & (F.col("_at") == F.col("_v")), "left")
    names, schema, at = docs.columns, docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            texts = columns[at].to_pylist()
            for i, (ranges, copy) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if copy and len((texts[i] or "").encode().split()) >= window:
                    texts[i] = ""
                elif ranges:
                    texts[i] = _cut(texts[i].encode(), [r["begin"] for r in ranges], [r["end"] for r in ranges])[1].decode()
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select("_row.*", "_ranges", "_copy").mapInArrow(run, schema)


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 20, shard_words: int = 50_000, most_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: without the maximal spans of `window` or more words that a reference text holds.

    The reference's size is checked against most_bytes. It is read shard by shard; a shard's automaton is broadcast, all documents
    stream through it, and the spans found are written before the next shard's turn."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring-reference")
    size = reference.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a reference of {size} bytes is not broadcast; union it with the documents and use repeated_ranges")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("v", F.xxhash64("text"))
    found = spark.createDataFrame([], "doc_id long, v long, begin int, end int")

    def spans(texts: list[list[bytes]], name: str) -> DataFrame:
        automaton = SuffixAutomaton()
        for text in texts:
            automaton.add(text)
        held = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc, v, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    longest = np.array(held.value.matching((text or "").encode().split()), np.int64)
                    out += [(doc, v, a, b + window - 1) for a, b in runs(longest[window - 1 :] >= window)]
                yield _batch(out, ["doc_id", "v", "begin", "end"])

        out = scratch.table(rows.select("doc_id", "v", "text").mapInArrow(run, found.schema), name)
        held.destroy()
        return out

    texts, words, shard = [], 0, 0
    for row in reference.select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        text = row[0].encode().split()
        if words + len(text) > shard_words and texts:
            found, texts, words, shard = found.unionByName(spans(texts, f"shard-{shard}")), [], 0, shard + 1
        texts.append(text)
        words += len(text)
    if texts:
        found = found.unionByName(spans(texts, f"shard-{shard}"))
    by = found.distinct().groupBy("doc_id", "v").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    own = rows.alias("r").join(by.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("r.v").eqNullSafe(F.col("b.v")), "left")
    return _applied(own.select("r.doc_id", "r.text", "b.ranges", "r.v"), True).drop("v")
