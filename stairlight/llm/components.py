"""Connected components: of few edges in one task, of more by alternating large and small stars, in DataFrames.

Up to SMALL edges (a fixed bound, some 50 MB in a task) one task labels all. Beyond, every step is an aggregate and a
join, so a vertex of many links is combined before the exchange and its join is split by adaptive execution (the aggregate is
written first: over one exchange it would not be); nothing is gathered per vertex. Steps are written tables. Both give the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

SMALL = 1_000_000


def labelled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex and the smallest one that it reaches."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = ends[: len(u)], ends[len(u) :], np.arange(len(names))
    while True:
        best = np.minimum(low[a], low[b])
        if (best == np.maximum(low[a], low[b])).all():
            return names, names[low]
        for end in (a, b):
            np.minimum.at(low, low[end], best)
        while (low[low] != low).any():
            low = low[low]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(2)) for b in batches]
        if parts:
            vertex, component = labelled(*(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(2)))
            other = vertex != component
            yield pa.RecordBatch.from_arrays([pa.array(vertex[other]), pa.array(component[other])], ["vertex", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "vertex long, component long")


def _stars(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """edges (u, v). Large: every larger neighbour of u is linked to u's smallest neighbour (u included). Small: u
    and its smaller neighbours are linked to the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-large")
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))  # here a hub is the smaller end, so no u is hot
    return down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str, small: int = SMALL) -> DataFrame:
    """vertex, component (its smallest reachable vertex) for every vertex of edges (u, v) but the components' own
    smallest vertices."""
    held = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    if held.count() <= small:
        found = scratch.table(_in_one_task(held), name)
        scratch.drop(f"{name}-0")
        return found
    state, step = None, 0
    while True:
        now = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or now == state:
            return held.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        state, step = now, step + 1
        stars = _stars(held, True, scratch, f"{name}-{step}").distinct()
        held = scratch.table(_stars(stars, False, scratch, f"{name}-{step}").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-large")
