"""Association graph: co-occurrence, NPMI, direction, weights, pruning, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS, Settings
from mnemoweft.functions.info import clamp, half_life, npmi
from mnemoweft.functions.loose_json import json_text, number_or
from mnemoweft.operators.search import items_above
from mnemoweft.runtime import with_positions


def bridge(memories: DataFrame, memory: str, topics: str) -> DataFrame:
    """memory, topic: distinct memberships from an array; nulls are dropped."""
    return memories.select(F.col(memory).alias("memory"), F.explode(F.array_distinct(topics)).alias("topic")).filter("memory is not null and topic is not null")


def soft_memberships(hard: DataFrame, memories: DataFrame, topics: DataFrame, threshold: float = DEFAULTS.soft_membership) -> DataFrame:
    """hard plus the topics whose label vector is at least that similar to the memory's vector.

    memories(memory, vector), topics(topic, vector): unit vectors.  Where both have a scope, only
    topics of the memory's scope count.
    """
    items, asked = memories.withColumnsRenamed({"memory": "item"}), topics.withColumnsRenamed({"topic": "query", "vector": "qv"})
    near = items_above(items, asked, threshold, scoped="scope" in memories.columns)
    return hard.select("memory", "topic").unionByName(near.select(F.col("item").alias("memory"), F.col("query").alias("topic"))).distinct()


def cooccurrences(members: DataFrame, block: int = 256) -> DataFrame:
    """a < b, n_ab over memory, topic rows (distinct); counted with map-side combine.

    A memory with more than `block` topics is dealt to blocks before anything is collected, and pairs of
    blocks are spread over the tasks, so no row holds more than 2 x block topics.
    """
    sized = members.select("memory", "topic", F.count("*").over(W.partitionBy("memory")).alias("n")).filter("n > 1")
    rows = sized.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("topic"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    side = lambda end: F.sort_array(F.collect_set(F.when(F.col("block") == F.col(end), F.col("topic"))))
    sets = cells.select("memory", lo, hi, "block", "topic").groupBy("memory", "lo", "hi").agg(side("lo").alias("x"), side("hi").alias("y"))
    later = lambda i: F.slice(F.col("x"), i + 2, F.size("x"))
    inside = F.transform("x", lambda x, i: F.transform(later(i), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    across = F.transform("x", lambda x: F.transform("y", lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    pairs = F.flatten(F.when(F.col("lo") == F.col("hi"), inside).otherwise(across))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_ab"))


def marginals(members: DataFrame) -> DataFrame:
    return members.groupBy("topic").agg(F.count("*").alias("n_topic"))


def with_npmi(pairs: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """Adds n_a, n_b, n and npmi; total has one row and one column, or scope and n where counts has a scope."""
    scope = ["scope"] if "scope" in counts.columns else []
    a = counts.select(F.col("topic").alias("a"), F.col("n_topic").alias("n_a"), *scope)
    b = counts.select(F.col("topic").alias("b"), F.col("n_topic").alias("n_b"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    joined = joined.join(total.select("scope", "n"), "scope") if scope else joined.join(F.broadcast(total.toDF("n")))
    score = npmi(F.col("n_ab"), F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)), F.col("n"))
    return joined.select("a", "b", "n_ab", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), "n", score.alias("npmi"), *scope)


def directed(pairs: DataFrame, threshold: float = DEFAULTS.npmi, least: int = DEFAULTS.min_cooccurrence, epsilon: float = DEFAULTS.direction_epsilon) -> DataFrame:
    """source, target, npmi_mem of the pairs that pass: from the topic more often met with the other, or both ways."""
    lean = F.col("n_ab") / F.col("n_a") - F.col("n_ab") / F.col("n_b")
    forth = F.struct(F.col("a").alias("source"), F.col("b").alias("target"))
    back = F.struct(F.col("b").alias("source"), F.col("a").alias("target"))
    ways = F.when(lean > epsilon, F.array(forth)).when(lean < -epsilon, F.array(back)).otherwise(F.array(forth, back))
    kept = pairs.filter((F.col("n_ab") >= least) & (F.col("npmi") > threshold))
    return kept.select(F.explode(ways).alias("e"), "npmi").select("e.source", "e.target", F.col("npmi").alias("npmi_mem"))


def weight(npmi_mem: Column, llm: Column, npmi_temp: Column, weights: tuple[float, float, float] = DEFAULTS.edge_weights) -> Column:
    return clamp(weights[0] * npmi_mem + weights[1] * llm + weights[2] * npmi_temp)


def merge_edges(edges: DataFrame, weights: tuple[float, float, float] = DEFAULTS.edge_weights, at: str | None = None) -> DataFrame:
    """One row per source and target: the largest of each score, its weight, and the last type that is not "co".

    edges(source, target, edge_type, npmi_mem, llm_score, npmi_temp); missing scores count as 0.  The last
    type is that with the greatest `at` (a column; null is the earliest), then the greatest name.
    """
    known = F.struct(F.col(at) if at else F.lit(None).cast("int"), F.col("edge_type"))
    best = lambda c: F.greatest(F.coalesce(F.max(F.nanvl(F.col(c), F.lit(None).cast("double"))), F.lit(0.0)), F.lit(0.0)).alias(c)
    merged = edges.groupBy("source", "target").agg(
        best("npmi_mem"), best("llm_score"), best("npmi_temp"),
        F.coalesce(F.max(F.when(F.col("edge_type") != "co", known))["edge_type"], F.lit("co")).alias("edge_type"),
    )
    return merged.withColumn("weight", weight(F.col("npmi_mem"), F.col("llm_score"), F.col("npmi_temp"), weights))


def prune(edges: DataFrame, least: float = DEFAULTS.prune_weight, degree: int = DEFAULTS.max_out_degree) -> DataFrame:
    """The heaviest edges out of each source; ties go to the smaller target."""
    best = W.partitionBy("source").orderBy(F.desc("weight"), "target")
    return edges.filter(F.col("weight") >= least).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= degree)


def causal_candidates(topics: DataFrame, edges: DataFrame, low: float = DEFAULTS.causal_low, high: float = DEFAULTS.causal_high, most: int = DEFAULTS.causal_candidates) -> DataFrame:
    """a < b, similarity of topics without an edge whose similarity is strictly between, nearest the middle first.

    At most `most` of them; where topics(topic, vector) has a scope, that many pairs of each scope.
    """
    scoped = "scope" in topics.columns
    known = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    near = items_above(topics.withColumnsRenamed({"topic": "item"}), topics.withColumnsRenamed({"topic": "query", "vector": "qv"}), low, scoped=scoped)
    pairs = near.filter("query < item").select(F.col("query").alias("a"), F.col("item").alias("b"), F.col("score").alias("similarity"))
    fit = pairs.filter((F.col("similarity") > low) & (F.col("similarity") < high)).join(known, ["a", "b"], "left_anti")
    order = [F.round(F.abs(F.col("similarity") - (low + high) / 2), 9), F.col("a"), F.col("b")]
    if not scoped:
        return fit.orderBy(*order).limit(most)
    own = fit.join(topics.select(F.col("topic").alias("a"), "scope"), "a").withColumn("__r", F.row_number().over(W.partitionBy("scope").orderBy(*order)))
    return own.filter(F.col("__r") <= most).select("a", "b", "similarity")


def judged_edges(replies: DataFrame) -> DataFrame:
    """source, target, npmi_mem, edge_type, llm_score, npmi_temp of a model's verdicts (a, b, reply).

    A reply is a JSON object, loosely written: related, type, score, direction ("a->b", "b->a" or both
    ways).  Unrelated pairs and replies that are no object give no edge; a missing score is 0.
    """
    v = F.from_json(json_text(F.col("reply")), "struct<related boolean, type string, score string, direction string>")
    score = F.when(v["score"].isNull(), 0.0).otherwise(number_or(v["score"]))
    seen = replies.select("a", "b", v.alias("v"), score.alias("llm_score")).filter("v.related")
    forth, back = F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target"))
    ways = F.when(F.col("v.direction") == "a->b", F.array(forth)).when(F.col("v.direction") == "b->a", F.array(back)).otherwise(F.array(forth, back))
    rows = seen.select(F.explode(ways).alias("e"), F.coalesce("v.type", F.lit("causal")).alias("edge_type"), "llm_score")
    return rows.select("e.source", "e.target", F.lit(0.0).alias("npmi_mem"), "edge_type", "llm_score", F.lit(0.0).alias("npmi_temp"))


def decayed(edges: DataFrame, as_of: Column, days: float = DEFAULTS.half_life_days, when: str = "last_updated", value: str = "weight") -> DataFrame:
    """weight as of a time, halved every `days`; edges keep their row."""
    return edges.withColumn(value, F.col(value) * half_life(F.col(when), as_of, days))


def reinforced(events: DataFrame, keys: list[str], delta: str, ts: str, tie: str, settings: Settings = DEFAULTS, state: DataFrame | None = None) -> DataFrame:
    """keys, weight, last_updated after all events of a key: decay to the event, then reinforce by delta in [0, 1].

    state (keys, weight, last_updated), if given, is what was before the events, which are later.
    w' = d (1 - r) w + r with r = rate * delta is affine, so steps compose: n of them give
    sum_i r_i D_i prod_{j>i} (1 - r_j) with D_i the decay from event i to the last one, and the first event of
    a new key starts at clamp(edge weight * delta).  Products run as sums of logs.  The events of a key are
    composed by day first and then the days, so a key's events are never in one task unless of one
    day.  Rates must be below 1.
    """
    days = settings.half_life_days
    rows = events.withColumn("__day", F.to_date(ts))
    rate = settings.learning_rate * F.col(delta)
    new = rows.groupBy(*keys).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))).alias("__first"))
    if state is not None:
        new = new.join(state.select(*keys), keys, "left_anti")
    rows = rows.join(new, keys, "left")
    first = F.coalesce((F.col(ts) == F.col("__first.t")) & (F.col(tie) == F.col("__first.i")), F.lit(False))

    def compose(df, part, order, step, log, t):
        """Of rows with a step, the log of what they leave of earlier ones and a time: the same per part."""
        base = W.partitionBy(*part)
        later = base.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, -1)
        tail = F.exp(F.coalesce(F.sum(log).over(later), F.lit(0.0)))
        moved = step * tail * half_life(F.col(t), F.max(t).over(base), days)
        return df.select(*part, moved.alias("__s"), log.alias("__r"), F.col(t).alias("__t")).groupBy(*part).agg(F.sum("__s").alias("__s"), F.sum("__r").alias("__r"), F.max("__t").alias("__t"))

    start = F.when(first, clamp(settings.edge_weights[0] * F.col(delta))).otherwise(rate)
    daily = compose(rows, [*keys, "__day"], [ts, tie], start, F.log1p(-rate), ts)
    done = compose(daily, keys, ["__day"], F.col("__s"), F.col("__r"), "__t")
    if state is None:
        return done.select(*keys, F.col("__s").alias("weight"), F.col("__t").alias("last_updated"))
    old = state.select(*keys, F.col("weight").alias("__w"), F.col("last_updated").alias("__l"))
    both = done.join(old, keys, "full")
    carried = F.col("__w") * F.exp(F.coalesce("__r", F.lit(0.0))) * F.coalesce(half_life(F.col("__l"), F.col("__t"), days), F.lit(1.0))
    return both.select(*keys, (F.coalesce(carried, F.lit(0.0)) + F.coalesce("__s", F.lit(0.0))).alias("weight"), F.coalesce("__t", "__l").alias("last_updated"))


def neighbours(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges out of the given sources, heaviest first; the edges of one source may be any number."""
    kept = edges.join(sources.select("source").distinct(), "source", "left_semi").withColumn("__w", -F.col("weight"))
    return with_positions(kept, ["source"], ["__w", "target"], "__pos").withColumn("rank", (F.col("__pos") + 1).cast("int")).drop("__w", "__pos")
