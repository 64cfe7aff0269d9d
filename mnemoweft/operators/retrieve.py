"""Topic-routed retrieval for batches of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS, Settings
from mnemoweft.functions.text import ENUMERATIONS, REASONS, has_any, keyword_ratio
from mnemoweft.operators.ppr import personalized_pagerank
from mnemoweft.operators.search import by_size, candidates, dots, in_cells, nearest_items
from mnemoweft.runtime import cut

# Weights of the scores.
ROUTE_LABEL, ROUTE_SUMMARY, ROUTE_KEYWORDS = 0.40, 0.35, 0.25
INTRA_TOPIC, INTRA_KEYWORDS, INTRA_IMPORTANCE = 0.20, 0.10, 0.08
SIBLING = 0.7


@dataclass(frozen=True)
class Store:
    """What retrieval reads.

    topics(topic, label_vector, summary_vector, keywords, is_virtual), memories(item, vector, topics,
    keywords, importance), dag(parent, child), closure(ancestor, descendant), edges(source, target, weight).
    Where topics and memories have a scope, queries have one, too, and see nothing of other scopes.
    """

    topics: DataFrame
    memories: DataFrame
    dag: DataFrame
    closure: DataFrame
    edges: DataFrame
    settings: Settings = DEFAULTS

    @property
    def scoped(self) -> bool:
        return "scope" in self.topics.columns


def _nearest(store: Store, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """nearest_items among items(item, vector, ...) of the query's scope, or all."""
    if not store.scoped:
        return nearest_items(items.select("item", "vector"), queries.select("query", "qv"), k)
    scope = F.array("scope").alias("topics")
    return nearest_items(items.select("item", "vector", scope), queries.select("query", "qv", scope), k, filtered=True)


def _live(store: Store) -> DataFrame:
    """Topics that are not virtual and have memories."""
    used = store.memories.select(F.explode("topics").alias("topic")).distinct()
    return store.topics.filter(~F.col("is_virtual")).join(used, "topic", "left_semi")


def _routing(held):
    """Kernel of route_all."""
    labels, summaries = (by_size(held.field(c)) for c in ("label_vector", "summary_vector"))
    lists = [[k.lower() if k is not None else None for k in v or []] for v in held.field("keywords").to_pylist()]
    known = sorted({k for v in lists for k in v if k is not None})
    number = {k: i for i, k in enumerate(known)}
    of = np.array([number[k] for v in lists for k in v if k is not None], np.int64)
    at = np.array([t for t, v in enumerate(lists) for k in v if k is not None], np.int64)
    size = np.array([len(v) for v in lists], float)

    def ask(asked):
        shape = (len(asked), len(held))
        vectors = by_size(asked.field("label_vector"))
        label = np.maximum(0.0, np.nan_to_num(dots(vectors, labels, shape)))
        about = dots(vectors, summaries, shape)
        ratio = np.zeros(shape)
        for k, text in enumerate(asked.field("text").to_pylist()):
            if text is not None and len(of):
                inside = np.array([w in text for w in known])
                ratio[k] = np.bincount(at, inside[of], minlength=len(held)) / np.maximum(size, 1.0)
        score = ROUTE_LABEL * label + ROUTE_SUMMARY * np.where(np.isnan(about), label, np.maximum(0.0, about)) + ROUTE_KEYWORDS * ratio
        r, c = np.nonzero(score > 0)
        yield r, c, score[r, c]

    return ask


def route_all(store: Store, queries: DataFrame) -> DataFrame:
    """query, topic, score of every live topic with a positive score (no index needed).

    By blocks of topics and queries; null vectors and texts add nothing to the score.
    """
    double = lambda c, name: F.col(c).cast("array<double>").alias(name)
    key = [F.col("scope").alias("key")] if store.scoped else []
    topics = _live(store).select(F.col("topic").alias("item"), *key, F.struct(double("label_vector", "label_vector"), double("summary_vector", "summary_vector"), "keywords", F.lit(None).cast("string").alias("text")).alias("p"))
    asked = queries.select("query", *key, F.struct(double("qv", "label_vector"), double("qv", "summary_vector"), F.lit(None).cast("array<string>").alias("keywords"), F.lower("text").alias("text")).alias("p"))
    return in_cells(topics, asked, _routing, keyed=store.scoped).select("query", F.col("item").alias("topic"), "score")


def route_indexed(store: Store, queries: DataFrame) -> DataFrame:
    """query, topic, score of the topics that a search by label or by summary vector brings.

    Either search takes three times max_routed of all topics; virtual and empty ones go afterwards.
    """
    k = 3 * store.settings.max_routed
    by = lambda c, w: _nearest(store, store.topics.withColumn("vector", c).withColumnRenamed("topic", "item"), queries, k).select("query", F.col("item").alias("topic"), (w * F.col("score")).alias("s"))
    hits = by(F.col("label_vector"), ROUTE_LABEL).unionByName(by(F.coalesce("summary_vector", "label_vector"), ROUTE_SUMMARY))
    summed = hits.groupBy("query", "topic").agg(F.sum("s").alias("s")).join(_live(store).select("topic", "keywords"), "topic").join(queries.select("query", "text"), "query")
    return summed.select("query", "topic", (F.col("s") + ROUTE_KEYWORDS * keyword_ratio(F.col("keywords"), F.col("text"))).alias("score"))


def adjust(store: Store, routed: DataFrame) -> DataFrame:
    """query, topic, score, rank: siblings join where few topics were routed, ancestors leave where many were; at most max_routed stay."""
    s = store.settings
    routed = cut(routed)
    per = routed.groupBy("query").agg(F.count("*").alias("n"))
    few = routed.join(per.filter(F.col("n") < s.min_routed).select("query"), "query", "left_semi")
    # only parents of routed topics, not all pairs of siblings
    up = few.join(store.dag.withColumnRenamed("child", "topic"), "topic").select("query", "parent", "score")
    kin = up.join(store.dag, "parent").groupBy("query", F.col("child").alias("topic")).agg((SIBLING * F.max("score")).alias("score"))
    more = kin.join(few.select("query", "topic"), ["query", "topic"], "left_anti")
    every = cut(routed.unionByName(more.select("query", "topic", "score")))
    sizes = every.groupBy("query").agg(F.count("*").alias("n"))
    many = every.join(sizes.filter(F.col("n") > s.max_routed).select("query"), "query", "left_semi").select("query", "topic")
    below = many.join(store.closure.withColumnRenamed("ancestor", "topic"), "topic").filter("topic <> descendant").select("query", "topic", F.col("descendant").alias("d"))
    over = below.join(many.select("query", F.col("topic").alias("d")), ["query", "d"]).select("query", "topic").distinct()
    best = W.partitionBy("query").orderBy(F.round("score", 9).desc(), "topic")
    kept = every.join(over, ["query", "topic"], "left_anti")
    return cut(kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.max_routed))


def intra(store: Store, queries: DataFrame, adjusted: DataFrame, precut: bool = True) -> DataFrame:
    """query, item, score, matched, rank: the best memories of the routed topics.

    The vector search takes 2 x intra_top_k of the memories with a routed topic; without precut it takes
    all whose similarity is not too far below the best intra_top_k for the rest of the score to make up.
    Those of a scoring topic gain by the topic's score, keywords and importance.
    """
    s = store.settings
    lists = adjusted.groupBy("query").agg(
        F.collect_list("topic").alias("topics"),
        F.map_from_entries(F.collect_list(F.struct("topic", "score"))).alias("scores"),
        F.collect_list(F.when(F.col("rank") <= s.scoring_topics, F.col("topic"))).alias("scoring"),
    )
    lists = cut(lists.join(queries, "query"))
    rows = store.memories.select("item", "vector", "topics")
    if precut:
        hits = nearest_items(rows, lists, 2 * s.intra_top_k, filtered=True).select("query", "item", F.col("score").alias("sim"))
    else:
        # the gain lies between low and high, so what is further below the k-th best cannot come in
        most = adjusted.agg(F.max("score")).first()[0] or 0.0
        weight = INTRA_IMPORTANCE * F.coalesce("importance", F.lit(0.5))
        low, high = store.memories.agg(F.min(weight), F.max(weight)).first()
        slack = INTRA_TOPIC * max(0.0, most) + INTRA_KEYWORDS + max(0.0, high or 0.0) - min(0.0, low or 0.0)
        hits = candidates(rows, lists, s.intra_top_k, slack + 1e-6).select("query", "item", F.col("score").alias("sim"))
    full = hits.join(store.memories.drop("vector"), "item").join(lists.select("query", "scores", "scoring", "text"), "query")
    found = F.array_sort(F.filter("topics", lambda t: F.map_contains_key("scores", t)))
    best = F.coalesce(F.array_max(F.transform(found, lambda t: F.col("scores")[t])), F.lit(0.0))
    bonus = INTRA_TOPIC * F.greatest(best, F.lit(0.0)) + INTRA_KEYWORDS * keyword_ratio(F.col("keywords"), F.col("text")) + INTRA_IMPORTANCE * F.coalesce("importance", F.lit(0.5))
    score = F.col("sim") + F.when(F.arrays_overlap("topics", "scoring"), bonus).otherwise(F.lit(0.0))
    order = W.partitionBy("query").orderBy(F.round("score", 9).desc(), "item")
    ranked = full.select("query", "item", score.alias("score"), found.alias("matched")).withColumn("rank", F.row_number().over(order))
    return cut(ranked.filter(F.col("rank") <= s.intra_top_k))


def fuse(store: Store, queries: DataFrame, inner: DataFrame, k: int) -> DataFrame:
    """query, item, score, source_type, matched: intra hits and the 2k nearest of all memories, these discounted."""
    near = _nearest(store, store.memories, queries, 2 * k).select("query", "item", (store.settings.global_weight * F.col("score")).alias("g"))
    both = inner.select("query", "item", "score", "matched").join(near, ["query", "item"], "full")
    return cut(both.select(
        "query", "item", F.greatest("score", "g").alias("score"),
        F.when(F.col("score").isNull(), "global_dense").otherwise("intra").alias("source_type"), "matched",
    ))


def expands(store: Store, queries: DataFrame, inner: DataFrame) -> DataFrame:
    """query, expand: nothing found, a question for reasons or lists, or low scores."""
    mean = inner.groupBy("query").agg(F.round(F.avg("score"), 9).alias("mean"))
    asks = has_any(F.col("text"), REASONS) | has_any(F.col("text"), ENUMERATIONS)
    low = F.col("mean").isNull() | (F.col("mean") < store.settings.low_score)
    return queries.join(mean, "query", "left").select("query", (low | asks).alias("expand"))


def cross(store: Store, queries: DataFrame, adjusted: DataFrame, seen: DataFrame, epsilon: float | None = None) -> DataFrame:
    """query, item, score, topic: memories of topics that PageRank reaches from the routed ones.

    Per reached topic the five nearest are looked at; a memory reached twice counts by its best score.
    """
    s = store.settings
    seeds = adjusted.select("query", F.col("topic").alias("node"), F.lit(1.0).alias("mass"))
    reached = cut(personalized_pagerank(store.edges, seeds, s, epsilon).select("query", F.col("node").alias("topic"), F.col("score").alias("activation")))
    asked = reached.join(queries.select(F.col("query"), "qv"), "query").select(F.struct("query", "topic").alias("query"), "qv", F.array("topic").alias("topics"))
    hits = nearest_items(store.memories.select("item", "vector", "topics"), asked, 5, filtered=True)
    scored = hits.select("query.query", "query.topic", "item", "score").join(reached, ["query", "topic"])
    fresh = scored.withColumn("score", F.col("score") * F.col("activation") * s.cross_discount).join(seen.select("query", "item"), ["query", "item"], "left_anti")
    once = fresh.groupBy("query", "item").agg(F.max("score").alias("score"), F.max_by("topic", F.struct(F.round("score", 9), "topic")).alias("topic"))
    best = W.partitionBy("query").orderBy(F.round("score", 9).desc(), "item")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.ppr_top_k).drop("rank")


def retrieve(store: Store, queries: DataFrame, k: int = 10, mode: str = "store", diversify: bool = False, use_dag: bool = True, use_cross: bool = True, epsilon: float | None = None) -> DataFrame:
    """query, item, score, source_type, matched, rank: routing, adjustment, search, fusion, expansion.

    mode "memory" routes by all topics, searches without a pre-cut and does not fuse with the global
    search.  Flags leave out the hierarchy or the expansion, for ablations.
    """
    # both are read by several stages
    store = replace(store, topics=cut(store.topics), memories=cut(store.memories))
    routed = route_indexed(store, queries) if mode == "store" else route_all(store, queries)
    if use_dag:
        adjusted = adjust(store, routed)
    else:
        best = W.partitionBy("query").orderBy(F.round("score", 9).desc(), "topic")
        adjusted = cut(routed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= store.settings.max_routed))
    inner = intra(store, queries, adjusted, precut=mode == "store")
    found = fuse(store, queries, inner, k) if mode == "store" else inner.select("query", "item", "score", F.lit("intra").alias("source_type"), "matched")
    if use_cross:
        go = expands(store, queries, inner).filter("expand").select("query")
        more = cross(store, queries.join(go, "query", "left_semi"), adjusted.join(go, "query", "left_semi"), found, epsilon)
        found = found.unionByName(more.select("query", "item", "score", F.lit("cross").alias("source_type"), F.array("topic").alias("matched")))
    order = W.partitionBy("query").orderBy(F.round("score", 9).desc(), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if diversify:
        return diversified(ranked.join(store.memories.select("item", "vector", "topics"), "item"), k, store.settings)
    return ranked.filter(F.col("rank") <= k)


def diversified(candidates: DataFrame, k: int, settings: Settings = DEFAULTS) -> DataFrame:
    """query, item, score, rank by maximal marginal relevance.

    candidates(query, item, score, rank, vector, topics); a query has at most some tens of them (the
    searches cut them), which one task orders greedily.
    """
    lam, share = settings.mmr_lambda, settings.mmr_topic_weight

    def order(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank").reset_index(drop=True)
        top = p["score"].max()
        if len(p) <= k or top <= 0:
            chosen = list(range(min(len(p), k)))
        else:
            v = np.array([np.zeros(1) if x is None else x for x in p["vector"]], dtype=object)
            sets = [set(t) if t is not None else set() for t in p["topics"]]
            chosen = [0]
            rest = list(range(1, len(p)))
            same = np.zeros(len(p))

            def likeness(i, j):
                union = sets[i] | sets[j]
                overlap = len(sets[i] & sets[j]) / len(union) if union else 0.0
                cos = max(0.0, float(np.dot(np.asarray(v[i], float), np.asarray(v[j], float)))) if len(v[i]) == len(v[j]) else 0.0
                return share * overlap + (1 - share) * cos

            while rest and len(chosen) < k:
                for i in rest:
                    same[i] = max(same[i], likeness(i, chosen[-1]))
                best = max(rest, key=lambda i: (round(lam * p["score"][i] / top - (1 - lam) * same[i], 9), -i))
                chosen.append(best)
                rest.remove(best)
        out = p.iloc[chosen][["query", "item", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    kinds = dict(candidates.dtypes)
    return candidates.select("query", "item", "score", "rank", "vector", "topics").groupBy("query").applyInPandas(
        order, f"query {kinds['query']}, item {kinds['item']}, score double, rank int"
    )


def formatted(found: DataFrame, memories: DataFrame, topics: DataFrame) -> DataFrame:
    """query, rank, item, content, score (two decimals), source_type, labels of what retrieve found.

    labels names the topics of each memory in their order; ids without a topic are left out.
    """
    flat = memories.select("item", F.posexplode("topics").alias("at", "topic")).join(topics.select("topic", "label"), "topic").filter("label is not null")
    named = flat.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "label")))["label"].alias("labels"))
    none = F.array().cast("array<string>")
    rows = found.join(memories.select("item", "content"), "item", "left").join(named, "item", "left")
    return rows.select("query", "rank", "item", "content", F.round("score", 2).alias("score"), "source_type", F.coalesce("labels", none).alias("labels"))
