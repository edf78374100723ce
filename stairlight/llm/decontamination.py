"""Benchmark decontamination: CGK walks, bit-sampling over item-sized windows, exact edit verification.

Words of letters and digits, A-Z in lower case, are the symbols; in scripts written without spaces, characters. An item is
in a document where a stretch of it has a word edit distance of at most `slack`, (1 - similarity) of the item's words.

The CGK walk of a window reads a word a step and, as a random bit of (walk, step, word) says, stays or goes on to the next; past
the window's end it reads padding. Two windows of a small edit distance read the same words at most steps, so an edit
distance becomes a Hamming distance, and a key of the words read at a few sampled steps is likely the same. A walk starts at
every word position of every document, as does one per item; the windows are as long as the item, and every other walk
goes backward from the window's end, so edits at either end leave half the walks unharmed. Two steps are sampled in the walk's
head, which all positions read, a third anywhere up to the item's length, read only where the head meets an item's. How many walks an
item takes part in follows from the measured rate at which they find copies with as many edits as its slack allows
(`walks_for`), so that at least `target` of such copies are found. An unedited copy reads what its item
reads, so every walk finds it. What a walk meets is verified exactly, by the smallest edit distance of the item to a stretch there.

Items are held in blocks of `block_items`, one after another: a block's keys are built on the driver and broadcast, its hits are written
before the next block's turn, so neither the driver nor a task holds more than a block. Items of fewer than `least_words`
words are looked for as unedited copies only, also where these occur by chance. Defined cases: null and empty texts hold no
words and match nothing; repeated documents or items are judged one by one; an empty table on either side gives no hits;
other columns are ignored by find() and kept by remove(), whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM_WORDS, LOWER, U64, Scratch, Words, batches_of_words, mix, ranges, seeds, text_buffers

HITS = "doc_id long, item_id long, start_word long, n_words long, distance long"
#: Steps of a walk that all positions read; steps in all; walks that an item takes part in at most.
HEAD, STEPS, WALKS = 8, 64, 48
#: Item lengths from which on the walks of the one before are used: a walk's sampled steps and the walks' number go by these.
LENGTHS = [*range(1, 17), 20, 24, 28, 32, 40, 48, 64]
#: Items of up to so many words are compared with what their pieces meet in one matrix; and its cells.
MATRIX, CELLS = 64, 1 << 21
_PAD = U64(0x5851F42D4C957F2D)


def slack_of(words: int, similarity: float) -> int:
    """Edits that an item of so many words allows; one word at least is left."""
    return max(0, min(int((1 - similarity) * words + 1e-9), words - 1))


@functools.lru_cache(maxsize=None)
def sampled(walk: int, length: int) -> tuple[int, ...]:
    """The steps whose words make the key of a walk for items of this length: two in the head and one anywhere up to the
    item's length (the walk's last step, for long items)."""
    draw = seeds(3, 1000 + walk).astype(np.float64) / 2**64
    span = min(max(length, 1), STEPS)
    head = min(HEAD, span)
    first = int(draw[0] * ((head + 1) // 2))
    second = first + 1 + int(draw[1] * (head - first - 1))
    return (first, min(second, head - 1), min(HEAD + int(draw[2] * (span - HEAD)), span - 1) if span > HEAD else int(draw[2] * span))


def of_length(words: int) -> int:
    """The greatest of LENGTHS that is not above."""
    return max(n for n in LENGTHS if n <= max(words, 1))


def masks(symbols: np.ndarray, walk: int) -> np.ndarray:
    """A random number for each word: its bits say at which steps of this walk the walk goes on, and it is what a
    sampled step adds to the key. One more, of no bits, stands behind the last word."""
    return np.append(mix(symbols ^ seeds(1, 77 + walk)[0]), U64(0))


def walks(mask: np.ndarray, start: np.ndarray, steps: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """At each step, the places that walks from these starts read, and what is there; they stop behind the last word."""
    at = start.copy()
    for j in range(steps):
        read = mask[at]
        yield j, at, read
        at += ((read >> U64(j)) & U64(1)).view(np.int64)


def window_keys(mask: np.ndarray, start: np.ndarray, plan: dict[int, tuple[int, ...]], stops: dict[int, np.ndarray | None]) -> dict[int, np.ndarray]:
    """For each length of the plan (its sampled steps), the keys of the windows that begin at start and end before
    stops[length] (None: farther than the walk goes)."""
    keys = {n: np.full(len(start), U64(n)) for n in plan}
    for j, at, read in walks(mask, start, 1 + max(max(p) for p in plan.values())):
        for n, steps in plan.items():
            for _ in range(steps.count(j)):
                keys[n] = keys[n] * U64(0x9E3779B97F4A7C15) + (read if stops[n] is None else np.where(at < stops[n], read, _PAD))
    return {n: mix(k) for n, k in keys.items()}


def _copies(length: int, n: int, edits: int, seed: int) -> list[np.ndarray]:
    """n windows of distinct words with that many edits: words changed, left out, put in."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        own = list(range(length))
        for _ in range(edits):
            at, kind = int(rng.integers(len(own))), int(rng.integers(3))
            own[at : at + 1] = [[int(rng.integers(1 << 40, 1 << 50))], [int(rng.integers(1 << 40, 1 << 50)), own[at]], [] if len(own) > 1 else own][kind]
        out.append(np.array([*rng.integers(1 << 51, 1 << 60, length), *own, *rng.integers(1 << 51, 1 << 60, length)], np.int64).view(U64))
    return out


@functools.lru_cache(maxsize=None)
def walks_for(length: int, similarity: float, target: float, copies: int = 1000) -> int:
    """The fewest walks that find at least `target` (by two standard errors) of so many copies of an item with as many
    edits as it allows."""
    slack = slack_of(length, similarity)
    if not slack:
        return 1
    texts = _copies(length, copies, slack, length)
    words, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    item, missed = mix(np.arange(length).astype(U64)), np.ones(copies, bool)
    plain = mix(words)
    near = np.concatenate([np.arange(f + length - slack - 1, f + s - length + slack + 1) for f, s in zip(first, sizes, strict=True)])
    owner = np.repeat(np.arange(copies), sizes - 2 * length + 2 * slack + 2)
    for walk in range(WALKS):
        own, there = (_keys_of(x, at, at + length if k else np.full(1, length), walk, length) for k, (x, at) in enumerate(((item, np.zeros(1, np.int64)), (plain, near))))
        missed[owner[there == own[0]]] = False
        if missed.mean() + 2 * math.sqrt(target * (1 - target) / copies) <= 1 - target:
            return walk + 1
    return WALKS


def _keys_of(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, walk: int, length: int) -> np.ndarray:
    """Keys of the windows from start to before end; odd walks go backward."""
    if walk % 2:
        n = len(symbols)
        symbols, start, end = symbols[::-1], n - end, n - start
    inside = (start >= 0) & (start < len(symbols))
    keys = window_keys(masks(symbols, walk), np.clip(start, 0, len(symbols) - 1), {length: sampled(walk, length)}, {length: end})[length]
    return np.where(inside, keys, U64(0))


def edit_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of item to a stretch of words, and that stretch."""
    m = len(words)
    row, origin, along = np.zeros(m + 1, np.int64), np.arange(m + 1), np.arange(m + 1)
    for i, symbol in enumerate(item, 1):
        best, source = np.empty(m + 1, np.int64), origin.copy()
        best[0], change = i, row[:-1] + (words != symbol)
        best[1:] = np.minimum(change, row[1:] + 1)
        source[1:] = np.where(change <= row[1:] + 1, origin[:-1], origin[1:])
        row = np.minimum.accumulate(best - along)  # words put in
        moved = np.maximum.accumulate(np.where(best - along == row, along, 0))
        row, origin = row + along, source[moved]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


class Keys:
    """Sorted keys with a bit table in front of them."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, bits: int = 64):
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.table = np.zeros(1 << max(16, int(bits * len(keys)).bit_length()), bool)
        self.table[self.place(keys)] = True

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys & U64(len(self.table) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in keys, item) of what is known, in parts of bounded size."""
        maybe = np.flatnonzero(self.table[self.place(keys)])
        lo, hi = np.searchsorted(self.keys, keys[maybe], "left"), np.searchsorted(self.keys, keys[maybe], "right")
        at, lo, many = maybe[lo < hi], lo[lo < hi], (hi - lo)[lo < hi]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // CELLS)) + 1):
            yield np.repeat(at[part], many[part]), self.items[ranges(lo[part], many[part])]


class Walk:
    """One walk of one block's items. Heads of items as long as the head or longer are of one kind, as its walk can't leave
    their windows; whole keys are by length."""

    def __init__(self, number: int, items: list[tuple[int, np.ndarray, int]]):
        """items: (number, symbols, length of LENGTHS)."""
        self.number, self.plan, self.heads, self.whole = number, {}, {}, {}
        heads: dict[int, list[np.ndarray]] = {}
        for length in sorted({n for _, _, n in items}):
            own = [(i, s) for i, s, n in items if n == length]
            self.plan[length] = sampled(number, length)
            symbols = np.concatenate([s[::-1] if number % 2 else s for _, s in own])
            sizes = np.array([len(s) for _, s in own])
            start, mask, kind = np.cumsum(sizes) - sizes, masks(symbols, number), min(length, HEAD)
            heads.setdefault(kind, []).append(self._heads(mask, start, kind))
            # the window of `length` words: the item's own, or its first ones
            self.whole[length] = Keys(window_keys(mask, start, {length: self.plan[length]}, {length: start + length})[length], np.array([i for i, _ in own]))
        for kind, keys in heads.items():
            self.heads[kind] = Keys(np.concatenate(keys), np.zeros(sum(map(len, keys)), np.int64))

    def _heads(self, mask: np.ndarray, start: np.ndarray, kind: int) -> np.ndarray:
        return window_keys(mask, start, {kind: sampled(self.number, kind)[:2]}, {kind: start + kind if kind < HEAD else None})[kind]

    def met(self, symbols: np.ndarray, part: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place where the window begins, item); places count in the walk's direction."""
        mask = masks(symbols, self.number)
        for lo in range(0, len(symbols), part):
            start = np.arange(lo, min(lo + part, len(symbols)))
            for kind, known in self.heads.items():
                alive = start[known.table[known.place(self._heads(mask, start, kind))]]
                plan = {n: p for n, p in self.plan.items() if min(n, HEAD) == kind}
                for n, keys in (window_keys(mask, alive, plan, {n: alive + n for n in plan}) if len(alive) else {}).items():
                    for at, item in self.whole[n].find(keys):
                        yield alive[at], item


class Items:
    """The walks of one block of benchmark items."""

    def __init__(self, ids: list, texts: pa.Array, similarity: float, least_words: int, target: float = 0.97):
        data, offsets = text_buffers(texts)
        words = Words(data, offsets, ALNUM_WORDS, LOWER, apart=True)
        self.ids, self.symbols = ids, [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.lengths = words.counts.astype(np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.slack = np.array([slack_of(n, similarity) if n >= least_words else 0 for n in self.lengths.tolist()], np.int64)
        known = [(i, s, of_length(len(s))) for i, s in enumerate(self.symbols) if len(s)]
        many = {n: walks_for(n, similarity, target) for n in {n for _, _, n in known}}
        needed = [many[n] if self.slack[i] else 1 for i, _, n in known]
        self.walks = [Walk(w, [x for x, m in zip(known, needed, strict=True) if m > w]) for w in range(max(needed, default=0))]
        #: items of one length as a matrix, and the row of each
        self.row, self.matrix = np.zeros(len(ids), np.int64), {}
        for n in np.unique(self.lengths[(self.lengths > 0) & (self.lengths <= MATRIX)]).tolist():
            own = np.flatnonzero(self.lengths == n)
            self.row[own], self.matrix[n] = np.arange(len(own)), np.stack([self.symbols[i] for i in own])

    def _met(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, where the item would begin) of the windows that walks meet, each once, in parts of bounded size."""
        back, held = np.ascontiguousarray(words[::-1]), [np.zeros(0, np.int64)]
        for walk in self.walks:
            for at, item in walk.met(back if walk.number % 2 else words):
                last = len(words) - 1 - at if walk.number % 2 else at  # a word of the window
                begin = last - self.lengths[item] + 1 if walk.number % 2 else at
                # the window begins at most an item's length before its word
                held.append((last * (self.longest + 1) + last - begin) * len(self.ids) + item)
            if sum(map(len, held)) > CELLS // 8 or walk is self.walks[-1]:
                code = np.unique(np.concatenate(held))
                place, item = np.divmod(code, max(len(self.ids), 1))
                last, before = np.divmod(place, self.longest + 1)
                held = [np.zeros(0, np.int64)]
                yield np.searchsorted(first, last, "right") - 1, item, last - before

    def _near(self, words: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Places that hold all but `slack` of the item's words, in any order: each missing word is an edit. A window may
        begin up to `slack` words off."""
        keep = np.ones(len(doc), bool)
        for n in np.unique(self.lengths[item]).tolist():
            own = np.flatnonzero(self.lengths[item] == n)
            if n > MATRIX:  # hits() looks at these one by one
                continue
            slack = int(self.slack[item[own[0]]])
            wide = np.arange(-slack, n + slack)
            for lo in range(0, len(own), max(1, CELLS // len(wide))):
                part = own[lo : lo + max(1, CELLS // len(wide))]
                at = begin[part, None] + wide
                inside = (at >= first[doc[part], None]) & (at < first[doc[part] + 1, None])
                window = np.where(inside, words[np.clip(at, 0, len(words) - 1)], _PAD)
                symbols, there = self.matrix[n][self.row[item[part]]], np.zeros(len(part), np.int64)
                for j in range(n):
                    there += (window == symbols[:, j, None]).any(1)
                keep[part] = there >= n - slack
        return keep

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, distance) of the best stretch for each item in each document."""
        asked: set = set()
        for doc, item, begin in self._met(words, first):
            keep = self._near(words, first, doc, item, begin)
            # of items that allow no edit the first copy in a document is enough
            copy = np.flatnonzero(keep & (self.slack[item] == 0))
            copy = copy[[begin[c] >= first[doc[c]] and begin[c] + self.lengths[item[c]] <= first[doc[c] + 1] and np.array_equal(words[begin[c] : begin[c] + self.lengths[item[c]]], self.symbols[item[c]]) for c in copy]] if len(copy) else copy
            keep[self.slack[item] == 0] = False
            keep[copy[np.unique(np.stack([doc[copy], item[copy]], 1), axis=0, return_index=True)[1]]] = True
            asked |= set(zip(doc[keep].tolist(), item[keep].tolist(), begin[keep].tolist(), strict=True))
        found: dict = {}
        group: list[tuple[int, int, int]] = []
        for place in [*sorted(asked), (-1, -1, 0)]:
            # places of an item that lie within its slack are verified as one
            if group and (place[:2] != group[0][:2] or place[2] - group[0][2] > self.slack[place[1]]):
                d, i, _ = group[0]
                best = self._best(words, int(first[d]), int(first[d + 1]), i, [p[2] for p in group])
                if best and best < found.get((d, i), (len(words) + 1,)):
                    found[d, i] = best
                group = []
            group.append(place)
        for (d, i), (distance, at, n) in sorted(found.items()):
            yield d, i, at - int(first[d]), n, distance

    def _best(self, words: np.ndarray, start: int, end: int, item: int, begins: list[int]) -> tuple[int, int, int] | None:
        symbols, slack, n = self.symbols[item], int(self.slack[item]), int(self.lengths[item])
        for b in begins:
            if b >= start and b + n <= end and np.array_equal(words[b : b + n], symbols):
                return 0, b, n
        lo, hi = max(start, begins[0] - slack), min(end, begins[-1] + n + slack)
        if hi - lo < n - slack or np.isin(symbols, words[lo:hi]).sum() < n - slack:
            return None
        distance, a, b = edit_distance(symbols, words[lo:hi])
        return (distance, lo + a, b - a) if distance <= slack else None


def _blocks(benchmark: DataFrame, block_items: int, id_col: str, text_col: str) -> Iterator[tuple[list, pa.Array]]:
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = max(1, math.ceil(items.count() / block_items))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield [r["item_id"] for r in part], pa.array([r["text"] for r in part], pa.string())


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target: float = 0.97, least_words: int = 5, block_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item it holds: the best stretch of words and its edit distance. No exchange."""
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in HITS.split(", ")])
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontamination")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], HITS)
    for block, (ids, texts) in enumerate(_blocks(benchmark, block_items, item_col, item_text)):
        if not len(ids):
            continue
        held = spark.sparkContext.broadcast(Items(ids, texts, similarity, least_words, target))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                own = batch.column(0).to_pylist()
                rows = [(own[lo + d], items.ids[i], at, n, e) for lo, _, w in batches_of_words(batch.column(1), ALNUM_WORDS, LOWER, apart=True) for d, i, at, n, e in items.hits(w.hashes, w.first)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kinds)

        out = out.unionByName(scratch.table(source.mapInArrow(run, HITS), f"block-{block}"))
        held.destroy()
    return out


def remove(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target: float = 0.97, least_words: int = 5, block_items: int = 20_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold an item, all columns kept, whatever their names. No exchange. What a block leaves is
    written before the next block's turn."""
    names, schema, at = docs.columns, docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).schema, docs.columns.index(text_col)
    spark, scratch, last = docs.sparkSession, Scratch(docs.sparkSession, "decontamination"), None
    docs = docs.toDF(*schema.names)
    for block, (ids, texts) in enumerate(_blocks(benchmark, block_items, item_col, item_text)):
        if not len(ids):
            continue
        held = spark.sparkContext.broadcast(Items(ids, texts, similarity, least_words, target))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, w in batches_of_words(batch.column(at), ALNUM_WORDS, LOWER, apart=True):
                    clean[[lo + hit[0] for hit in held.value.hits(w.hashes, w.first)]] = False
                yield batch.filter(pa.array(clean))

        docs = scratch.table(docs.mapInArrow(run, schema), f"block-{block}")
        held.destroy()
        if last is not None:
            scratch.drop(last)
        last = f"block-{block}"
    return docs.toDF(*names)
