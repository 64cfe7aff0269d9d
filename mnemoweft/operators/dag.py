"""Building and maintaining the topic hierarchy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS, Settings
from mnemoweft.functions.info import jsd
from mnemoweft.functions.sets import jaccard
from mnemoweft.functions.text import containment, words
from mnemoweft.functions.vector import dot
from mnemoweft.operators.components import TASK_LINKS, connected_components, encode
from mnemoweft.operators.hierarchy import Hierarchy
from mnemoweft.operators.search import Shared, by_size, dots, in_cells, pairs_in_blocks
from mnemoweft.runtime import cut, iter_groups, parallelism, with_positions

ROOT = "__ROOT__"


def topic_similarity(a: str, b: str, weights: tuple[float, float, float, float] = DEFAULTS.similarity_weights) -> Column:
    """Of the structs a and b of label, label_vector, summary_vector, keywords.

    Label and summary vectors, keyword overlap and shared label words.  Where either summary is missing
    its weight goes to the labels; without keywords or words that part is 0.
    """
    x, y = F.col(a), F.col(b)
    label = F.coalesce(F.round(dot(x["label_vector"], y["label_vector"]), 9), F.lit(0.0))
    summary = F.coalesce(F.round(dot(x["summary_vector"], y["summary_vector"]), 9), label)
    words = F.coalesce(containment(x["label"], y["label"]), F.lit(0.0))
    return weights[0] * label + weights[1] * summary + weights[2] * jaccard(x["keywords"], y["keywords"]) + weights[3] * words


def _sets(column) -> list[set]:
    """The different values of each list, cut from one flat array."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    return [set(flat[lo:hi]) for lo, hi in zip([0, *ends], ends)]


class _Side:
    """Some topics as a kernel needs them, ordered by the sizes of their summary vectors: vectors by size, and sets."""

    def __init__(self, p, unit: bool):
        lengths = p.field("summary_vector").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.order, self.n = np.argsort(lengths, kind="stable"), len(p)
        p = p.take(pa.array(self.order))
        kinds, first = np.unique(lengths[self.order], return_index=True)
        self.parts = [(int(k), slice(lo, hi)) for k, lo, hi in zip(kinds, first, [*first[1:], self.n])]
        self.vectors = {c: by_size(p.field(c), unit) for c in ("label_vector", "summary_vector")}
        self.sets = {c: _sets(p.field(c)) for c in ("words", "keywords")}
        self.sizes = {c: np.array([len(s) for s in v], np.float32) for c, v in self.sets.items()}

    def rows_of(self, name: str) -> dict:
        """The topics that have each value."""
        number: dict = {}
        code = np.array([number.setdefault(v, len(number)) for s in self.sets[name] for v in s], np.int64)
        order = np.argsort(code, kind="stable")
        at = np.repeat(np.arange(self.n), self.sizes[name].astype(np.int64))[order]
        ends = np.cumsum(np.bincount(code, minlength=len(number))).tolist()
        return {v: at[lo:hi] for v, lo, hi in zip(number, [0, *ends], ends)}

    def places(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The size of each topic's vector and its row among those of that size."""
        size, row = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for dim, (at, _) in self.vectors[name].items():
            size[at], row[at] = dim, np.arange(len(at))
        return size, row

    def short(self, name: str, dims: list[int], share: float, weight: float = 1.0) -> np.ndarray:
        """The first numbers of each vector and the length of the rest, in single precision; a place for each size.

        Weighted so that the product with other such rows is at least the weighted product of the vectors.
        """
        out = []
        for dim in dims:
            m, part = math.ceil(share * dim), np.zeros((self.n, math.ceil(share * dim) + 1), np.float32)
            if dim in self.vectors[name]:
                at, v = self.vectors[name][dim]
                part[at, :m], part[at, m] = weight * v[:, :m], abs(weight) * np.sqrt(np.einsum("ij,ij->i", v[:, m:], v[:, m:]))
            out.append(part)
        return np.hstack(out) if out else np.zeros((self.n, 1), np.float32)


DENSE = 0.02  # share of candidates from which on all pairs of a block are computed


def _similarities(weights: tuple[float, float, float, float], least: float, unit: bool = False):
    """Kernel of similar_topics: topic_similarity of some topics with each topic of a part.

    A bound leaves a few candidates, which are computed exactly: products of the first numbers of the
    vectors in single precision, with the lengths of the rest and an allowance for errors, and shared words
    and keywords.  Where it leaves many, all pairs are computed, by matrices.
    """
    both = weights[0] + weights[1]
    # unlike unit vectors stay below the bound if what is left of them does, with some room
    share = min(1.0, max(0.25, 1 - (least - 0.12) / both)) if both > 0 else 1.0

    def hold(held):
        y = _Side(held, unit)
        known = {c: Shared(y.sizes[c], y.rows_of(c)) for c in ("words", "keywords")}
        dims = {c: sorted(y.vectors[c]) for c in y.vectors}
        places = {c: y.places(c) for c in y.vectors}
        label = y.short("label_vector", dims["label_vector"], share)
        about = {dim: np.hstack([label[at], y.short("summary_vector", [dim], share)[at]]) for dim, at in y.parts if dim}
        gains: dict = {}  # what sharing a value adds at most, for sets of one size
        longest = lambda z: float(np.sqrt(np.einsum("ij,ij->i", z, z, dtype=float).max(initial=0.0)))

        def every(x):
            shape = (x.n, y.n)
            near = np.nan_to_num(dots(x.vectors["label_vector"], y.vectors["label_vector"], shape))
            summary = dots(x.vectors["summary_vector"], y.vectors["summary_vector"], shape)
            score = weights[0] * near + weights[1] * np.where(np.isnan(summary), near, summary)
            for weight, name in ((weights[2], "keywords"), (weights[3], "words")):
                n, shared = x.sizes[name].astype(float)[:, None], known[name].counts(x.sets[name])
                whole = n + known[name].sizes - shared if name == "keywords" else np.minimum(n, known[name].sizes)
                score += weight * np.divide(shared, whole, out=np.zeros(shape), where=whole > 0)
            score = np.round(score, 9)
            r, c = np.nonzero(score >= least)
            return r, c, score[r, c]

        def some(x, r, c):
            own = {name: x.places(name) for name in x.vectors}
            near = {"label_vector": np.zeros(len(r)), "summary_vector": np.full(len(r), np.nan)}
            for name, out in near.items():
                for dim in dims[name]:
                    at = np.flatnonzero((own[name][0][r] == dim) & (places[name][0][c] == dim))
                    for lo in range(0, len(at), 4096):
                        k = at[lo : lo + 4096]
                        pair = x.vectors[name][dim][1][own[name][1][r[k]]], y.vectors[name][dim][1][places[name][1][c[k]]]
                        out[k] = np.round(np.einsum("ij,ij->i", *pair), 9)
            score = weights[0] * near["label_vector"] + weights[1] * np.where(np.isnan(near["summary_vector"]), near["label_vector"], near["summary_vector"])
            for weight, name in ((weights[2], "keywords"), (weights[3], "words")):
                n, m = x.sizes[name][r].astype(float), y.sizes[name][c].astype(float)
                shared = np.array([len(x.sets[name][i] & y.sets[name][j]) for i, j in zip(r.tolist(), c.tolist())], float)
                whole = n + m - shared if name == "keywords" else np.minimum(n, m)
                score += weight * np.divide(shared, whole, out=np.zeros(len(r)), where=whole > 0)
            score = np.round(score, 9)
            keep = score >= least
            return r[keep], c[keep], score[keep]

        def bound(x):
            """At least the similarities, and what they must reach."""
            top, slack = np.empty((x.n, y.n), np.float32), 0.0
            lone = x.short("label_vector", dims["label_vector"], share, both)
            first = x.short("label_vector", dims["label_vector"], share, weights[0])
            for dim, at in x.parts:
                z = np.hstack([first[at], x.short("summary_vector", [dim], share, weights[1])[at]]) if dim in about else None
                for other, to in y.parts:
                    a, b = (z, about[dim]) if dim and dim == other else (lone[at], label[to])
                    top[at, to] = a @ b.T
                    slack = max(slack, (a.shape[1] + 16) * longest(a) * longest(b))
            for weight, name in ((weights[2], "keywords"), (weights[3], "words")):
                if weight <= 0:
                    continue
                whole = np.maximum if name == "keywords" else np.minimum
                for k, (n, values) in enumerate(zip(x.sizes[name].tolist(), x.sets[name])):
                    row = top[k]
                    for v in values:
                        if (at := known[name].rows.get(v)) is not None:
                            if (gain := gains.get((name, v, n))) is None:
                                gain = gains[name, v, n] = np.float32(weight) / whole(np.float32(n), y.sizes[name][at])
                            row[at] += gain
            return top, np.float32(least - 5e-6 - 1.2e-7 * slack)

        def ask(asked):
            x = _Side(asked, unit)
            found = None
            if np.isfinite(least):
                with np.errstate(over="ignore", invalid="ignore"):
                    top, floor = bound(x)
                    r, c = np.nonzero(~(top < floor))
                if len(r) <= DENSE * x.n * y.n:
                    found = some(x, r, c)
            r, c, score = found or every(x)
            yield x.order[r], y.order[c], score

        return ask

    return hold


def _bodies(topics: DataFrame, types: list[str]) -> list:
    vectors = [F.col(c).cast(kind).alias(c) for c, kind in zip(("label_vector", "summary_vector"), types)]
    return [F.struct(*vectors, "keywords", words(F.coalesce("label", F.lit(""))).alias("words")).alias("p")]


def _types(*frames: DataFrame) -> list[str]:
    """array<float> for the vectors that all have so, else array<double>."""
    return ["array<float>" if all(dict(df.dtypes)[c] == "array<float>" for df in frames) else "array<double>" for c in ("label_vector", "summary_vector")]


def similar_topics(left: DataFrame, right: DataFrame, least: float, weights: tuple[float, float, float, float] = DEFAULTS.similarity_weights, keyed: bool = False, unit: bool = False) -> DataFrame:
    """a (of left), b (of right), similarity >= least (nine decimals), every such pair (with keyed: of the same key).

    Both have topic, label, label_vector, summary_vector, keywords; the similarity is topic_similarity,
    with unit that of the vectors divided by their lengths, so that floats need not become doubles before.
    All of left are compared with all of right, in blocks of matrix products, and only pairs that reach
    the bound leave a task; topics without vectors count by keywords and words.
    """
    types = _types(left, right)
    key = ["key"] if keyed else []
    found = in_cells(right.select(F.col("topic").alias("item"), *key, *_bodies(right, types)), left.select(F.col("topic").alias("query"), *key, *_bodies(left, types)), _similarities(weights, least, unit), keyed)
    return found.select(F.col("query").alias("a"), F.col("item").alias("b"), F.col("score").alias("similarity"))


def similar_pairs(topics: DataFrame, least: float, weights: tuple[float, float, float, float] = DEFAULTS.similarity_weights, keyed: bool = False, unit: bool = False) -> DataFrame:
    """a < b, similarity of the pairs of one set of topics, as similar_topics; without keys nothing is written per pair of blocks."""
    if keyed:
        return similar_topics(topics, topics, least, weights, True, unit).filter("a < b")
    found = pairs_in_blocks(topics.select(F.col("topic").alias("item"), *_bodies(topics, _types(topics))), _similarities(weights, least, unit))
    return found.withColumnRenamed("score", "similarity")


def attach_orphans(nodes: DataFrame, links: DataFrame, root: str = ROOT) -> DataFrame:
    """links and a link from the root to each other node without a parent.

    Where nodes has a column scope, each scope has a root of its own (root_of).
    """
    own = root_of(F.col("scope"), root) if "scope" in nodes.columns else F.lit(root)
    lone = nodes.select("topic", own.alias("parent")).filter("topic <> parent").join(links.select(F.col("child").alias("topic")), "topic", "left_anti")
    return links.select("parent", "child").unionByName(lone.select("parent", F.col("topic").alias("child")))


def root_of(scope: Column, root: str = ROOT) -> Column:
    return F.when(scope == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), scope))


def with_depth(topics: DataFrame, links: DataFrame) -> DataFrame:
    """topics with depth, the length of the shortest path from a top; null for topics without a link."""
    depth = Hierarchy(links).paths().groupBy(F.col("node").alias("topic")).agg(F.min("depth").alias("depth"))
    return topics.drop("depth").join(depth, "topic", "left")


def _rounds(ids: pa.Array, a: np.ndarray, b: np.ndarray, s: np.ndarray, n: np.ndarray, top: float):
    """Merges (a, b, distance) by average linkage of nodes numbered in the order of their ids."""
    while len(a):
        d = np.round(1 - s / (n[a] * n[b]), 12)
        order = np.lexsort((b, a, d))
        order = order[d[order] <= top]
        if not len(order):
            return
        best = np.full(len(n), len(order))
        place = np.arange(len(order))
        np.minimum.at(best, a[order], place)
        np.minimum.at(best, b[order], place)
        pairs = order[(best[a[order]] == place) & (best[b[order]] == place)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[pairs])), ids.take(pa.array(b[pairs])), pa.array(d[pairs])], names=["a", "b", "distance"])
        n = n.copy()
        n[a[pairs]] += n[b[pairs]]
        label = np.arange(len(n))
        label[b[pairs]] = a[pairs]
        x, y = label[a], label[b]
        x, y, s = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], s[x != y]
        order = np.lexsort((y, x))
        x, y, s = x[order], y[order], s[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
        a, b, s = x[first], y[first], np.add.reduceat(s, first) if len(first) else s


def _linkage(top: float):
    def run(batches):
        for t in iter_groups(batches, ["component"]):
            ids, a, b = encode(t["a"].combine_chunks(), t["b"].combine_chunks())
            n = np.ones(len(ids))
            n[a], n[b] = t["n_a"].to_numpy(), t["n_b"].to_numpy()
            yield from _rounds(ids, a, b, t["s"].to_numpy(), n, top)

    return run


def _merge_rounds(edges: DataFrame, top: float, task_links: int) -> tuple[DataFrame, DataFrame]:
    """edges(a, b, s, n_a, n_b) after rounds of joins until a task can hold them, and the merges made."""
    merges = None
    while edges.count() > task_links:
        d = F.round(1 - F.col("s") / (F.col("n_a") * F.col("n_b")), 12)
        near = edges.select(F.struct(d.alias("d"), "a", "b").alias("e"), "n_a", "n_b").filter(F.col("e.d") <= top)
        best = near.select(F.explode(F.array("e.a", "e.b")).alias("node"), "e", "n_a", "n_b").groupBy("node").agg(F.min(F.struct("e", "n_a", "n_b")).alias("m"))
        pairs = cut(best.groupBy("m").agg(F.count("*").alias("k")).filter("k = 2").select("m.e.a", "m.e.b", F.col("m.e.d").alias("distance"), (F.col("m.n_a") + F.col("m.n_b")).alias("n")))
        if pairs.isEmpty():
            return edges.limit(0), merges
        found = pairs.select("a", "b", "distance")
        merges = found if merges is None else cut(merges.unionByName(found))
        moved = pairs.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), "n")
        for end in ("a", "b"):
            m = moved.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"), F.col("n").alias(f"m_{end}"))
            edges = edges.join(m, end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).withColumn(f"n_{end}", F.coalesce(f"m_{end}", f"n_{end}")).drop(f"new_{end}", f"m_{end}")
        turned = F.col("a") > F.col("b")
        flip = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
        one = edges.filter("a <> b").select(flip("a", "b"), flip("b", "a"), flip("n_a", "n_b"), flip("n_b", "n_a"), "s")
        edges = cut(one.groupBy("a", "b", "n_a", "n_b").agg(F.sum("s").alias("s")))
    return edges, merges


def cluster_cuts(distances: DataFrame, cuts: tuple[float, ...] = DEFAULTS.cluster_distances, nested: bool = False, task_links: int = TASK_LINKS) -> DataFrame:
    """cluster, distance, member: average-linkage clusters of two or more leaves at each cut.

    distances(a, b, distance) of pairs; a pair that is missing counts as 1, so cuts are below 1.  The same
    members at several cuts are one cluster, at its smallest cut; its name is its smallest member's and
    the number of members.  nested adds the parent, the next larger cluster around it.  Pairs with a null
    end or distance are ignored, an empty table gives no rows.

    Two clusters that are each other's nearest (ties by name) merge in the same round, which for average
    linkage gives the tree of merging the nearest pair each time.  Clusters never merge across components
    of the pairs within the largest cut; a component of up to task_links pairs goes through its rounds in
    one task, a larger one by joins until that few are left.  Both give the same rows but for sums of
    distances that agree to twelve decimals.
    """
    top = max(cuts)
    if top >= 1:
        raise ValueError("cuts must be below 1, the distance of missing pairs")
    d = F.col("distance").cast("double")
    pairs = distances.filter("a is not null and b is not null and distance is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), d.alias("d"))
    pairs = cut(pairs.groupBy("a", "b").agg(F.min("d").alias("d")))
    kind = dict(pairs.dtypes)["a"]
    named = cut(connected_components(pairs.filter(F.col("d") <= top), "a", "b", task_links))
    of = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").filter("c_a = c_b").select(F.col("c_a").alias("component"), "a", "b", (1 - F.col("d")).alias("s"), F.lit(1.0).alias("n_a"), F.lit(1.0).alias("n_b"))
    rows = cut(rows)
    sizes = rows.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_links).select("component")
    large = cut(rows.join(sizes, "component", "left_semi"))
    made = None
    if not large.isEmpty():
        rest, made = _merge_rounds(large.drop("component"), top, task_links)
        rows = rows.join(sizes, "component", "left_anti").unionByName(rest.withColumn("component", F.lit(None).cast(kind)))
    spread = rows.repartition(parallelism(rows.sparkSession), "component").sortWithinPartitions("component")
    merges = spread.mapInArrow(_linkage(top), f"a {kind}, b {kind}, distance double")
    merges = cut(merges if made is None else merges.unionByName(made))
    out = None
    for limit in sorted(cuts):
        inside = connected_components(merges.filter(F.col("distance") <= limit), "a", "b", task_links)
        part = inside.select("component", F.col("node").alias("member"), F.lit(float(limit)).alias("distance"))
        out = part if out is None else out.unionByName(part)
    every = cut(out)
    heads = every.groupBy("component", "distance").agg(F.min("member").alias("first"), F.count("*").alias("n"))
    # a larger cut only adds members, so the smallest one and the number tell clusters apart
    once = heads.withColumn("nth", F.row_number().over(W.partitionBy("first", "n").orderBy("distance"))).filter("nth = 1").drop("nth")
    once = cut(once.withColumn("cluster", F.concat(F.col("first").cast("string"), F.lit("+"), F.col("n").cast("string"))))
    flat = every.join(once, ["component", "distance"])
    if not nested:
        return flat.select("cluster", "distance", "member")
    around = flat.select(F.col("member").alias("first"), F.col("cluster").alias("over"), F.col("n").alias("m"))
    up = once.join(around, "first").filter("m > n").groupBy("cluster").agg(F.min_by("over", "m").alias("parent"))
    return flat.join(up, "cluster", "left").select("cluster", "distance", "member", "parent")


def cluster_topics(topics: DataFrame, cuts: tuple[float, ...] = DEFAULTS.cluster_distances, nested: bool = False, task_links: int = TASK_LINKS, keyed: bool = False, unit: bool = False) -> DataFrame:
    """cluster_cuts of topics (with keyed: within each key) by 1 - topic_similarity (unit: as similar_topics).

    Pairs within the largest cut are found first; all distances are then computed within what they join.
    """
    near = similar_pairs(topics, 1 - max(cuts), keyed=keyed, unit=unit)
    named = cut(connected_components(near, "a", "b", task_links)).select(F.col("node").alias("topic"), F.col("component").alias("key"))
    held = cut(topics.drop("key").join(named, "topic"))
    pairs = similar_pairs(held, -math.inf, keyed=True, unit=unit)
    return cluster_cuts(pairs.select("a", "b", (1 - F.col("similarity")).alias("distance")), cuts, nested, task_links)


def multi_parents(leaves: DataFrame, uppers: DataFrame, links: DataFrame, least: float = DEFAULTS.multi_parent, most: int = DEFAULTS.multi_parent_candidates, keyed: bool = False) -> DataFrame:
    """child, parent, similarity: the best links from upper topics of less depth that are no parents yet.

    At most `most` of them, with keyed for each key.
    """
    pairs = similar_topics(leaves, uppers, least, keyed=keyed).filter(F.col("similarity") > least)
    key = F.col("key") if keyed else F.lit(0)
    depths = pairs.join(leaves.select(F.col("topic").alias("a"), F.col("depth").alias("da"), key.alias("key")), "a").join(uppers.select(F.col("topic").alias("b"), F.col("depth").alias("db")), "b")
    new = depths.filter("db < da").join(links.select(F.col("child").alias("a"), F.col("parent").alias("b")), ["a", "b"], "left_anti")
    return best_of(new, most, keyed, [F.desc("similarity"), "a", "b"]).select(F.col("a").alias("child"), F.col("b").alias("parent"), "similarity")


def best_of(rows: DataFrame, most: int, keyed: bool, order: list) -> DataFrame:
    """The first rows in that order, with keyed of each key."""
    if not keyed:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def greedy_descent(new: DataFrame, topics: DataFrame, links: DataFrame, root, least: float = DEFAULTS.multi_parent) -> DataFrame:
    """topic, visited, depth: from the root to the best child again and again, while it is similar enough.

    new and topics have label, label_vector, summary_vector, keywords.  One join per level; only the
    children of the nodes where some topic stands are looked at.
    """
    fields = ["label", "label_vector", "summary_vector", "keywords"]
    x = new.select("topic", F.struct(*fields).alias("x"))
    y = topics.select(F.col("topic").alias("child"), F.struct(*fields).alias("y"))
    at = x.select("topic", F.lit(root).alias("visited"), F.lit(0).alias("depth"))
    out, level = at, 0
    while True:
        level += 1
        ways = at.join(links.select(F.col("parent").alias("visited"), "child"), "visited").filter("child <> topic").join(x, "topic").join(y, "child")
        scored = ways.withColumn("s", F.round(topic_similarity("x", "y"), 9)).filter(F.col("s") >= least)
        best = scored.groupBy("topic").agg(F.min(F.struct(-F.col("s"), F.col("child").alias("child")))["child"].alias("visited"))
        at = cut(best.join(out.select("topic", "visited"), ["topic", "visited"], "left_anti").select("topic", "visited", F.lit(level).alias("depth")))
        if at.isEmpty():
            return out
        out = cut(out.unionByName(at))


def drift(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, jsd between the two distributions of a value per key; ln 2, the most there is, for keys on one side only."""
    part = lambda df, n: df.groupBy(*keys, value).agg(F.count("*").cast("double").alias("c")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(value, "c"))).alias(n))
    score = F.when(F.col("__p").isNull() | F.col("__q").isNull(), F.lit(math.log(2))).otherwise(jsd(F.col("__p"), F.col("__q")))
    return part(before, "__p").join(part(after, "__q"), keys, "full").select(*keys, score.alias("jsd"))


def split_halves(members: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds half: 0 for the first floor(n / 2) rows of a group, 1 for the others; large groups are spread."""
    placed = with_positions(members, [group], order, "__pos")
    sizes = members.groupBy(group).agg(F.count("*").alias("__n"))
    return placed.join(sizes, group).withColumn("half", (F.col("__pos") >= F.floor(F.col("__n") / 2)).cast("int")).select(*members.columns, "half")


def split_topics(topics: DataFrame, links: DataFrame, members: DataFrame, gone: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """topics, links and members(topic, memory, ...) with each topic of gone split into its halves.

    The halves are new topics, named by the old one and "/1" or "/2"; they keep its other columns, take
    its parents and children and half of its memories by order; a half without memories is made, too.
    """
    old = gone.select("topic").distinct()
    rest = lambda df, c: df.join(old.select(F.col("topic").alias(c)), c, "left_anti")
    halves = old.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("new", F.concat("topic", F.lit("/"), (F.col("half") + 1).cast("string")))
    made = topics.join(halves.select("topic", "new"), "topic").withColumn("topic", F.col("new")).select(*topics.columns)
    moved = split_halves(members.join(old, "topic", "left_semi"), "topic", order).join(halves, ["topic", "half"]).withColumn("topic", F.col("new")).select(*members.columns)
    out = links.select("parent", "child")
    for end in ("parent", "child"):
        named = halves.select(F.col("topic").alias(end), F.col("new").alias("__new"))
        out = out.join(named, end, "left").withColumn(end, F.coalesce("__new", end)).select("parent", "child")
    return rest(topics, "topic").unionByName(made), out, rest(members, "topic").unionByName(moved)


def merge_topics(topics: DataFrame, links: DataFrame, members: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """topics, links and members(topic, memory) with the topics of merged(topic, into) taken into the others.

    What is left keeps its row and gets the keywords of all; it is virtual if all were.  Children, parents
    and memories follow; loops and repeats disappear.
    """
    named = topics.select("topic", "keywords", "is_virtual").join(merged, "topic", "left").withColumn("into", F.coalesce("into", "topic"))
    words_of = named.groupBy(F.col("into").alias("topic")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("keywords", F.array().cast("array<string>")))))).alias("keywords"), F.min("is_virtual").alias("is_virtual"))
    several = words_of.join(merged.select(F.col("into").alias("topic")).distinct(), "topic", "left_semi")
    kept = topics.join(merged, "topic", "left_anti").join(several.withColumnsRenamed({"keywords": "__k", "is_virtual": "__v"}), "topic", "left")
    kept = kept.withColumn("keywords", F.coalesce("__k", "keywords")).withColumn("is_virtual", F.coalesce("__v", "is_virtual")).select(*topics.columns)
    moved = members.join(merged, "topic", "left").withColumn("topic", F.coalesce("into", "topic")).select(*members.columns).distinct()
    return kept, rewire(links, merged), moved


def mergeable_siblings(topics: DataFrame, links: DataFrame, counts: DataFrame, settings: Settings = DEFAULTS, unit: bool = False) -> DataFrame:
    """a < b, similarity of similar topics (of the same key, if topics has one) with a parent in common and few memories each.

    Similar pairs are found first, then those with a common parent, so the children of one parent are
    never paired with each other.
    """
    pairs = similar_pairs(topics, settings.sibling_merge, keyed="key" in topics.columns, unit=unit).filter(F.col("similarity") > settings.sibling_merge)
    few = topics.select("topic").join(counts, "topic", "left").filter(F.coalesce("n_topic", F.lit(0)) < settings.sibling_merge_memories).select("topic")
    small = pairs.join(few.withColumnRenamed("topic", "a"), "a", "left_semi").join(few.withColumnRenamed("topic", "b"), "b", "left_semi")
    up = lambda n, p: links.select(F.col("child").alias(n), F.col("parent").alias(p))
    return small.join(up("a", "p"), "a").join(up("b", "q"), "b").filter("p = q").select("a", "b", "similarity").distinct()


def merge_map(pairs: DataFrame) -> DataFrame:
    """topic, into: topics that hang together by pairs become the smallest of them (whatever their order)."""
    named = connected_components(pairs, "a", "b")
    first = named.groupBy("component").agg(F.min("node").alias("into"))
    return named.join(first, "component").filter("node <> into").select(F.col("node").alias("topic"), "into")


def rewire(links: DataFrame, merged: DataFrame) -> DataFrame:
    """links with merged topics replaced; loops and repeats disappear."""
    m = merged.select(F.col("topic").alias("k"), "into")
    a = links.join(m, F.col("parent") == F.col("k"), "left").select(F.coalesce("into", "parent").alias("parent"), "child")
    b = a.join(m, F.col("child") == F.col("k"), "left").select("parent", F.coalesce("into", "child").alias("child"))
    return b.filter("parent <> child").distinct()


def siblings_of(links: DataFrame, topics: DataFrame, part: int = 100_000) -> DataFrame:
    """topic, sibling of the given topics: the other children of their parents.

    The children of a parent are dealt to parts of that many, so a large parent is spread over tasks.
    """
    up = links.select(F.col("child").alias("topic"), "parent").join(topics.select("topic").distinct(), "topic", "left_semi")
    parts = links.groupBy("parent").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    asked = up.join(parts, "parent").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    down = links.join(parts, "parent").select("parent", F.pmod(F.xxhash64("child"), F.col("parts")).cast("int").alias("part"), F.col("child").alias("sibling"))
    return asked.join(down, ["parent", "part"]).filter("topic <> sibling").select("topic", "sibling").distinct()


def summaries_due(topics: DataFrame, members: DataFrame, memories: DataFrame, interval: int = DEFAULTS.summary_interval, first: int = 20) -> DataFrame:
    """topic, texts: the first memories (by id) of the topics that grew by the interval since their summary."""
    due = topics.filter((F.col("memory_count_since_summary") >= interval) & ~F.col("is_virtual")).select("topic")
    rows = members.join(due, "topic", "left_semi").join(memories.select("memory", "content"), "memory").filter("content is not null")
    order = W.partitionBy("topic").orderBy("memory")
    kept = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return kept.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("memory", "content")))["content"].alias("texts"))


def tree_lines(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """path (ids joined by /), line: an indented line per node and top; virtual ones are marked."""
    named = paths.join(nodes, "node", "left")
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.coalesce("is_virtual", F.lit(False)), "[V] ").otherwise(""), F.coalesce("label", F.col("node")))
    return named.select(F.array_join("path", "/").alias("path"), text.alias("line"))
