"""Connected components of a graph of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweft.runtime import cut

TASK_LINKS = 1_000_000  # links that one task may hold, some 100 MB with their ids


def encode(parent: pa.Array, child: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The sorted ids of some links and the links as their numbers."""
    ids = pc.unique(pa.concat_arrays([parent, child]))
    ids = ids.take(pc.sort_indices(ids))
    number = lambda a: pc.index_in(a, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, number(parent), number(child)


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component: hooking and pointer jumping on arrays."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _finish(batches):
    t = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    ids, a, b = encode(t["a"].combine_chunks(), t["b"].combine_chunks())
    label = smallest_labels(len(ids), a, b)
    yield from pa.table({"node": ids, "component": ids.take(pa.array(label))}).to_batches(max_chunksize=100_000)


def connected_components(links: DataFrame, a: str, b: str, task_links: int = TASK_LINKS) -> DataFrame:
    """node, component of every node of a link; a component is named by one of its nodes.

    Links of more than task_links are contracted first: every node is merged into that of its neighbours
    and itself with the smallest hash (salted by the round), which a map-side combined aggregate
    finds, so no node's neighbours are gathered.  A round leaves a fraction of the nodes; what is left
    goes through union-find in one task of at most task_links links.  Rows with a null end are ignored.
    """
    kind = dict(links.select(F.col(a)).dtypes)[a]
    edges = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = cut(edges)
    maps: list[DataFrame] = []
    salt = 0
    while edges.count() > task_links:
        salt += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        ends = edges.select(F.col("a").alias("u"), rank("b").alias("r")).unionByName(edges.select(F.col("b").alias("u"), rank("a").alias("r")))
        own = F.struct(F.xxhash64(F.lit(salt), "u").alias("h"), F.col("u").alias("v"))
        best = cut(ends.groupBy("u").agg(F.min("r").alias("r")).select("u", F.least("r", own)["v"].alias("to")))
        maps.append(best)
        moved = (
            edges.join(best.select(F.col("u").alias("a"), F.col("to").alias("x")), "a")
            .join(best.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        )
        edges = cut(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    out = edges.coalesce(1).mapInArrow(_finish, f"node {kind}, component {kind}")
    for step in reversed(maps):
        up = out.select(F.col("node").alias("to"), "component")
        out = cut(step.join(up, "to", "left").select(F.col("u").alias("node"), F.coalesce("component", "to").alias("component")))
    return out
