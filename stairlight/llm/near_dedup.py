"""MinHash near-duplicates with sequential Bayesian verification.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a document's set is its distinct shingles of `shingle` words
(with fewer words all of them as one; without words empty, linked with nothing). Documents with equal sets are one
class. Banded MinHash signatures of the classes give candidates. A candidate pair's signatures are compared in
batches; a pair is pruned as soon as the posterior probability that it is similar enough falls under `miss`. Survivors
are verified on full sets. Links give components.

No bucket is expanded into all its pairs. Rounds compare a bucket's members with one hub each (linear), best hub
first, and most members of a group join its component. Buckets whose members are then still in several components are
settled in blocks of bounded size spread over tasks: a first pass names the members that have a plausible partner in
another component, a second one holds the full sets of these, verifies and joins, so that a block gives fewer
links than it has members. Full sets are sets of 64-bit hashes of shingles, which stand for the shingles.

Defined cases: null and empty texts have an empty set; rows of one id are one document for linking; a row with a null id
joins the component of equal sets, or none (component null, kept); repeated rows are returned each; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, SPACE_WORDS, U64, Scratch, Words, batches_of_words, mix, partitions, seeds, shingles, signed
from .components import components

HASHES, ROWS, BATCH = 128, 4, 32
_A = (seeds(HASHES, 101) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeds(HASHES, 202) >> U64(32)).astype(np.uint32)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    all_of, first = shingles(words.hashes, k), words.first
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(all_of[a : b - k + 1])
        else:
            yield shingles(words.hashes[a:b], b - a) + U64(b - a) if b > a else np.zeros(0, U64)


def signature(items: np.ndarray) -> np.ndarray:
    """128 minima of random affine maps modulo 2**32."""
    low, out = (items >> U64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, (low[at : at + 1024, None] * _A + _B).min(0), out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, bands) keys; a band is ROWS hashes."""
    parts = signatures.reshape(len(signatures), -1, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=U64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = key * U64(0x9E3779B97F4A7C15) + parts[:, :, j]
    return mix(key)


def least_matches(similarity: float, miss: float) -> list[int]:
    """After each batch, the fewest equal hashes at which the posterior (uniform prior) that the similarity is
    reached is `miss` or more: the tail of Beta(m + 1, n - m + 1) as a binomial sum."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = lambda m: sum(math.comb(n + 1, j) * similarity**j * (1 - similarity) ** (n + 1 - j) for j in range(m + 1))  # noqa: B023, E731
        out.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return out


def plausible(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of paired signatures that no batch prunes."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
    for b, bound in enumerate(least):
        part = slice(b * BATCH, (b + 1) * BATCH)
        equal[alive] += (left[alive, part] == right[alive, part]).sum(1)
        alive = alive[equal[alive] >= bound]
    return alive


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Of docs (doc_id, text_hash, text): the size, digest and signature of each set."""
    names = ["doc_id", "text_hash", "n", "hi", "lo", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs = [], [], []
            for _, _, words in batches_of_words(batch.column(2), SPACE_WORDS, LOWER):
                for items in shingle_sets(words, k):
                    n.append(len(items))
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    sigs.append(signature(items).tobytes() if len(items) else None)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sigs, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, hi long, lo long, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_signatures(batch.column(1)))
                bands = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys).ravel()), pa.array(bands), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))], ["key", "band", "member"])

    return reps.select("doc_id", "sig").mapInArrow(run, "key long, band int, member long")


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `key` columns; such a run may go over several batches."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
            if group and row[:key] != group[0][:key]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _of_texts(texts: list[str | None], k: int) -> list[np.ndarray]:
    return [s for _, _, words in batches_of_words(pa.array(texts, pa.string()), SPACE_WORDS, LOWER) for s in shingle_sets(words, k)]


def similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets reach the similarity to one, on the full sets: 100 * intersection >= percent * union."""
    if not len(one) or not others:
        return np.zeros(len(others), bool)
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    met = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.diff(np.concatenate([[0], np.cumsum(met)])[np.concatenate([[0], np.cumsum(sizes)])])
    return (sizes > 0) & (100 * both >= percent * (len(one) + sizes - both))


def _to_hubs(pairs: DataFrame, members: DataFrame, least: list[int], k: int, percent: int, most: int = 256) -> DataFrame:
    """Links (u, v) of pairs (member, hub). A hub's text goes once to each task that has up to about `most` of its
    members, and members go once."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    mine = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("member").alias("doc_id"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("doc_id"))
    rows = mine.unionByName(hubs).join(members, "doc_id").select("hub", "part", "kind", "doc_id", "sig", "text")
    spread = rows.repartition(partitions(rows.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            hub, part, kind, doc, sig, text = (batch.column(c).to_pylist() for c in range(6))
            sigs = _signatures(batch.column(4)) if len(doc) else None
            asked: dict[int, list[int]] = {}  # rows that meet a head
            for i in range(len(doc)):
                if (hub[i], part[i]) != at:
                    at, heads = (hub[i], part[i]), []
                if not kind[i]:
                    heads.append((sigs[i], _of_texts([text[i]], k)[0]))
                for h, (own, _) in enumerate(heads if kind[i] else []):
                    if len(plausible(own[None], sigs[i : i + 1], least)):
                        asked.setdefault(i, []).append(h)
                if i + 1 == len(doc) or (hub[i + 1], part[i + 1]) != at:
                    rows = list(asked)
                    found = [(doc[r], hub[r]) for r, own in zip(rows, _of_texts([text[r] for r in rows], k), strict=True) if any(similar(heads[h][1], [own], percent)[0] for h in asked[r])]
                    asked = {}
                    yield _table(found, ["u", "v"])

    return spread.mapInArrow(run, "u long, v long")


def _in_blocks(rows: DataFrame, size: Column) -> DataFrame:
    """rows (key, band, comp, member, ...) dealt into pairs of blocks (i, j) of their bucket; size: how many blocks a
    bucket needs. A row goes to as many pairs as there are blocks."""
    rows = rows.withColumn("blocks", size).withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "comp", "member")


class Block:
    """Members of one pair of blocks of a bucket: rows (key, i, j, own, band, comp, member, sig, ...)."""

    def __init__(self, rows: list[tuple], least: list[int]):
        self.least, (_, i, j, _, self.band) = least, rows[0][:5]
        self.across = i != j
        self.own, self.comp, self.member = (np.array([r[c] for r in rows]) for c in (3, 5, 6))
        self.sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint32).reshape(-1, HASHES)
        self.keys = band_keys(self.sig)[:, : self.band]

    def partners(self, x: int, comp: np.ndarray) -> np.ndarray:
        """Rows after x, in other components, that share this band with x and none before it, and that no batch prunes."""
        rest = np.arange(x + 1, len(comp))
        rest = rest[comp[rest] != comp[x]]
        if self.across:
            rest = rest[self.own[rest] != self.own[x]]
        if len(rest) and self.band:
            rest = rest[~(self.keys[rest] == self.keys[x]).any(1)]
        return rest[plausible(np.broadcast_to(self.sig[x], (len(rest), HASHES)), self.sig[rest], self.least)] if len(rest) else rest


def _open_members(rows: DataFrame, least: list[int]) -> DataFrame:
    """(key, member) of the members that have a plausible partner in another component; never the pairs."""
    spread = rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            block, met = Block(group, least), np.zeros(len(group), bool)
            for x in range(len(group) - 1):
                if len(found := block.partners(x, block.comp)):
                    met[found] = met[x] = True
            yield _table([(group[0][0], int(m)) for m in np.unique(block.member[met])], ["key", "member"])

    return spread.select("key", "i", "j", "own", "band", "comp", "member", "sig").mapInArrow(run, "key long, member long").distinct()


def linked(block: Block, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components, found on full sets: fewer than there are members, as joined ones are not compared again."""
    kinds, comp = np.unique(block.comp, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    shared, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(len(shared), bool), []
    for x in range(len(sets) - 1):
        rest = block.partners(x, comp)
        if not len(rest) or not sizes[x]:
            continue
        mark[flat[ends[x] : ends[x + 1]]] = True
        for y in rest.tolist():
            if comp[y] == comp[x] or not sizes[y]:
                continue
            both = int(mark[flat[ends[y] : ends[y + 1]]].sum())
            if 100 * both >= percent * int(sizes[x] + sizes[y] - both):
                out.append((int(block.member[x]), int(block.member[y])))
                comp = np.where(comp == comp[y], comp[x], comp)
        mark[flat[ends[x] : ends[x + 1]]] = False
    return out


def _linked(rows: DataFrame, least: list[int], k: int, percent: int) -> DataFrame:
    """Links (u, v) within the pairs of blocks."""
    spread = rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            yield _table(linked(Block(group, least), _of_texts([r[8] for r in group], k), percent), ["u", "v"])

    return spread.select("key", "i", "j", "own", "band", "comp", "member", "sig", "text").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-6, rounds: int = 2, block: int = 2048, block_shingles: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of its component) and kept (it is that one) of every row.

    A task of the last step holds two blocks of about `block` signatures, then two of about `block_shingles` shingles."""
    scratch, least = Scratch(docs.sparkSession, "near-dedup"), least_matches(percent / 100, miss)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = scratch.table(_sets(docs.select("doc_id", "text_hash", "text"), shingle), "sets")
    classes = scratch.table(sets.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep")), "classes")
    known = classes.select(F.col("rep").alias("doc_id")).filter("doc_id is not null").distinct()
    reps = sets.filter("n > 0").join(known, "doc_id", "left_semi").dropDuplicates(["doc_id", "hi", "lo"])

    bands = _bands(reps)
    # aggregates are written before they are joined back: over one exchange, a hot key of the join is not split
    shared = scratch.table(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "shared")
    held = scratch.table(bands.join(shared, "key").distinct(), "buckets")
    busy = scratch.table(held.select(F.col("member").alias("doc_id")).distinct(), "busy")
    sigs = reps.join(busy, "doc_id", "left_semi").select("doc_id", "text_hash", "n", "sig")
    members = scratch.table(docs.join(busy, "doc_id", "left_semi").dropDuplicates(["doc_id", "text_hash"]).join(sigs, ["doc_id", "text_hash"]), "members")
    scratch.drop("shared", "busy")

    links, labels = None, None
    for turn in range(rounds + 1):
        rows = held
        if labels is not None:
            rows = rows.join(labels.withColumnRenamed("vertex", "member"), "member", "left")
            rows = rows.select("key", "band", "member", F.coalesce("component", "member").alias("comp"))
        else:
            rows = rows.select("key", "band", "member", F.col("member").alias("comp"))
        one, two = F.xxhash64("member"), F.xxhash64("member", F.lit(turn))
        hub = F.min(F.struct(two if turn else F.lit(0), "member", "comp")).alias("hub")
        keys = rows.groupBy("key", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), hub, F.count(F.lit(1)).alias("c"), F.bit_xor(one).alias("one"), F.bit_xor(F.xxhash64(one, F.lit(7))).alias("two")).filter("x <> y")
        # of buckets with the same members that of the first band is enough
        alike = keys.groupBy("c", "one", "two").agg(F.min(F.struct("band", "key", "hub")).alias("k"), F.count(F.lit(1)).alias("alike"))
        keys = scratch.table(alike.select("k.key", "k.hub", "c", "alike"), f"keys-{turn}")
        rows = scratch.table(rows.join(keys, "key"), f"open-{turn}")
        scratch.drop("buckets" if not turn else f"open-{turn - 1}", f"keys-{turn - 1}", f"keys-{turn}")
        if rows.isEmpty():
            break
        held = rows.select("key", "band", "member")  # buckets of one component are done
        if turn < rounds:
            # one hub a member, that with which it shares most bands; what this leaves out comes up in the next round
            shared_bands = rows.filter("member <> hub.member and comp <> hub.comp").groupBy("member", F.col("hub.member").alias("other")).agg(F.sum("alike").alias("n"))
            best = shared_bands.groupBy("member").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("hub"))
            fresh = _to_hubs(scratch.table(best, f"pairs-{turn}"), members, least, shingle, percent)
        else:
            dealt = _in_blocks(rows, F.ceil(F.col("c") / block).cast("int"))
            met = scratch.table(_open_members(dealt.join(members.select(F.col("doc_id").alias("member"), "sig"), "member"), least), "met")
            left = scratch.table(rows.select("key", "band", "comp", "member").join(met, ["key", "member"]), "left")
            work = left.join(members.groupBy(F.col("doc_id").alias("member")).agg(F.sum("n").alias("n")), "member").groupBy("key").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("size"))
            dealt = _in_blocks(left.join(scratch.table(work, "work"), "key"), F.col("size"))
            fresh = _linked(dealt.join(members.select(F.col("doc_id").alias("member"), "sig", "text"), "member"), least, shingle, percent)
        links = scratch.table(fresh if links is None else links.unionByName(fresh), f"links-{turn}")
        labels = components(links, scratch, f"components-{turn}")
        scratch.drop(f"pairs-{turn}", f"links-{turn - 1}", f"components-{turn - 1}")
    scratch.drop("members", "met", "left", "work", *(f"open-{t}" for t in range(rounds + 1)))

    out = sets.join(classes.withColumnRenamed("n", "n_"), ["hi", "lo"], "left")
    if labels is not None:
        out = out.join(labels, F.col("rep") == F.col("vertex"), "left").withColumn("rep", F.coalesce("component", "rep"))
    root = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", root)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
