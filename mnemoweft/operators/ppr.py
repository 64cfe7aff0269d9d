"""Personalized PageRank for many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS, Settings
from mnemoweft.runtime import cut, parallelism


EDGES = 100_000  # edges that go to the tasks with the plan, some 3 MB
STATE = 4_000_000  # products of queries and edges that a task holds at once


def _iterate(names: list, source: np.ndarray, target: np.ndarray, share: np.ndarray, settings: Settings, eps: float, check: int):
    """Queries with their seeds (list of node, s) to the final scores of the nodes they reach."""
    at = {v: k for k, v in enumerate(names)}
    order = np.argsort(target, kind="stable")
    source, target, share = source[order], target[order], share[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            step = max(1, STATE // max(1, len(source) + len(names)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                s = np.zeros((part.num_rows, len(names)))
                for k, held in enumerate(part.column(1).to_pylist()):
                    for h in held:
                        s[k, at[h["node"]]] += h["s"]
                p, live = s.copy(), np.arange(len(s))
                for r in range(settings.ppr_iterations):
                    new = (1 - settings.damping) * s[live]
                    if len(first):
                        new[:, target[first]] += np.add.reduceat(settings.damping * p[np.ix_(live, source)] * share, first, axis=1)
                    going = np.ones(len(live), bool)
                    if eps > 0 and (r + 1) % check == 0:
                        going = np.abs(new - p[live]).sum(axis=1) >= eps
                    live = live[going]
                    p[live] = new[going]
                    if not len(live):
                        break
                q, n = np.nonzero(p > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), pa.array(n), pa.array(p[q, n])], names=["query", "at", "p"])

    return run


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, settings: Settings = DEFAULTS, epsilon: float | None = None, cut_every: int = 5, task_edges: int = EDGES) -> DataFrame:
    """query, node, score, rank: the best nodes that are no seeds of the query.

    edges(source, target, weight), seeds(query, node, mass).  p <- damping M p + (1 - damping) s with M
    column-normalised by out-weight; the mass of nodes without a way out is lost; at most ppr_iterations
    rounds.  Every few rounds a query whose L1 change is below epsilon stops with the iterate before it.

    A graph of up to task_edges edges goes to the tasks, which iterate over blocks of queries by themselves; for
    a larger one all queries share each round's join and aggregate, and lineage is cut every few rounds.
    Both give the same but for the order of additions.
    """
    eps = settings.ppr_epsilon if epsilon is None else epsilon
    spark = edges.sparkSession
    out = edges.groupBy("source").agg(F.sum("weight").alias("__w"))
    moves = cut(edges.filter("weight > 0").join(out, "source").select(F.col("source").alias("node"), "target", (F.col("weight") / F.col("__w")).alias("share")))
    total = seeds.groupBy("query").agg(F.sum("mass").alias("__m"))
    start = cut(seeds.join(total, "query").groupBy("query", "node").agg(F.sum(F.col("mass") / F.col("__m")).alias("s")))
    kinds = dict(start.dtypes)
    few = moves.limit(task_edges + 1).toArrow()
    known = start.select("node").distinct().limit(task_edges + 1).toArrow() if few.num_rows <= task_edges else few
    if few.num_rows <= task_edges and known.num_rows <= task_edges:
        names = sorted({*few["node"].to_pylist(), *few["target"].to_pylist(), *known["node"].to_pylist()})
        at = {v: k for k, v in enumerate(names)}
        source, target = (np.array([at[v] for v in few[c].to_pylist()], np.int64) for c in ("node", "target"))
        held = start.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("node", "s"))).alias("held")).repartition(parallelism(spark), "query")
        found = held.mapInArrow(_iterate(names, source, target, few["share"].to_numpy(), settings, eps, cut_every), f"query {kinds['query']}, at long, p double")
        number = spark.createDataFrame([(k, v) for v, k in at.items()], f"at long, node {kinds['node']}")
        p = found.join(F.broadcast(number), "at").select("query", "node", "p")  # up to 3 x task_edges rows
    else:
        p = _rounds(moves, start, settings, eps, cut_every)
    best = W.partitionBy("query").orderBy(F.round("p", 12).desc(), "node")
    rest = p.filter("p > 0").join(seeds.select("query", "node"), ["query", "node"], "left_anti")
    return rest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= settings.ppr_top_k).select("query", "node", F.col("p").alias("score"), "rank")


def _rounds(moves: DataFrame, start: DataFrame, settings: Settings, eps: float, cut_every: int) -> DataFrame:
    """query, node, p by joins, for graphs of any size."""
    p = start.select("query", "node", F.col("s").alias("p"))
    stopped = p.limit(0)
    for k in range(settings.ppr_iterations):
        moved = p.join(moves, "node").select("query", F.col("target").alias("node"), (settings.damping * F.col("p") * F.col("share")).alias("p"))
        back = start.select("query", "node", ((1 - settings.damping) * F.col("s")).alias("p"))
        new = moved.unionByName(back).groupBy("query", "node").agg(F.sum("p").alias("p"))
        if (k + 1) % cut_every == 0:
            new = cut(new)
            if eps > 0:
                change = new.withColumnRenamed("p", "n").join(p, ["query", "node"], "full").groupBy("query").agg(F.sum(F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))).alias("d"))
                done = cut(change.filter(F.col("d") < eps).select("query"))
                if not done.isEmpty():
                    stopped = cut(stopped.unionByName(p.join(done, "query", "left_semi")))
                    new, start = cut(new.join(done, "query", "left_anti")), cut(start.join(done, "query", "left_anti"))
                    if start.isEmpty():
                        return stopped
        p = new
    return stopped.unionByName(p)


def closed_form(edges: DataFrame, seeds: DataFrame, damping: float = DEFAULTS.damping, most: int = 2_000) -> DataFrame:
    """query, node, score: the limit of personalized_pagerank, (1 - d) (I - d M)^-1 s, for graphs of up to `most` nodes.

    All nodes of the edges and seeds with a positive score, seeds too.  One matrix is solved per batch of
    queries; a larger graph is refused, as the matrix grows with its square.
    """
    links = edges.filter("weight > 0").groupBy("source", "target").agg(F.sum("weight").alias("w"))
    t = links.limit(most * most + 1).toArrow()
    kind, node = dict(seeds.dtypes)["query"], dict(seeds.dtypes)["node"]
    names = sorted({*t["source"].to_pylist(), *t["target"].to_pylist()})
    if len(names) > most:
        raise ValueError(f"more than {most} nodes: use personalized_pagerank")
    at = {v: k for k, v in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, w in zip(t["source"].to_pylist(), t["target"].to_pylist(), t["w"].to_pylist()):
        m[at[b], at[a]] = w
    total = m.sum(axis=0)
    m = np.divide(m, total, out=m, where=total > 0)

    def solve(batches):
        inverse = (1 - damping) * np.linalg.inv(np.eye(len(names)) - damping * m)
        for batch in batches:
            query, score, of = [], [], []
            for k, held in enumerate(batch.column(1).to_pylist()):
                s, mass = np.zeros(len(names)), sum(h["mass"] for h in held)
                for h in held:
                    if h["node"] in at:
                        s[at[h["node"]]] += h["mass"] / mass
                    else:  # a node without edges keeps what it gets
                        query.append(k), of.append(h["node"]), score.append((1 - damping) * h["mass"] / mass)
                p = inverse @ s
                for j in np.flatnonzero(p > 0):
                    query.append(k), of.append(names[j]), score.append(float(p[j]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(query, pa.int64())), pa.array(of), pa.array(score, pa.float64())], names=["query", "node", "score"])

    held = seeds.groupBy("query").agg(F.collect_list(F.struct("node", "mass")).alias("s"))
    return held.mapInArrow(solve, f"query {kind}, node {node}, score double").groupBy("query", "node").agg(F.sum("score").alias("score"))
