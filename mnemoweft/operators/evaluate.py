"""Evaluation of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS
from mnemoweft.functions.vector import dot
from mnemoweft.operators.search import items_above


def matches(retrieved: DataFrame, memories: DataFrame, evidence: DataFrame, texts: DataFrame, least: float = DEFAULTS.evidence_similarity) -> DataFrame:
    """query, item, dia: retrieved memories that hold a piece of evidence or are similar to its text.

    retrieved(query, sample, item), memories(item, sources, vector), evidence(query, dia), texts(sample, dia, vector).
    """
    rows = retrieved.join(memories.select("item", "sources", F.col("vector").alias("mv")), "item").join(evidence, "query")
    full = rows.join(texts.select("sample", "dia", F.col("vector").alias("ev")), ["sample", "dia"], "left")
    similar = F.coalesce(F.round(dot(F.col("mv"), F.col("ev")), 9) >= least, F.lit(False))
    return full.filter(F.coalesce(F.array_contains("sources", F.col("dia")), F.lit(False)) | similar).select("query", "item", "dia").distinct()


def precision_recall(queries: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """queries(query, evidence, ...) with p_at_k (relevant memories / k) and r_at_k (evidence found / listed).

    Without evidence they are 0 and 1; the list's repeats count in its length.
    """
    hits = found.groupBy("query").agg(F.count_distinct("item").alias("__i"), F.count_distinct("dia").alias("__e"))
    n = F.size(F.coalesce("evidence", F.array().cast("array<string>")))
    zero = F.lit(0)
    return queries.join(hits, "query", "left").select(
        *queries.columns,
        F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce("__i", zero) / k).alias("p_at_k"),
        F.when(n == 0, F.lit(1.0)).otherwise(F.coalesce("__e", zero) / F.greatest(n, F.lit(1))).alias("r_at_k"),
    )


def by_category(scores: DataFrame, measures: list[str], digits: int = 4) -> DataFrame:
    """category, n and the mean of each measure, and a row of null category over all.

    The overall means are those of the rounded values, as reports print them.
    """
    mean = lambda m: F.round(F.when(F.grouping("category") == 1, F.avg(F.round(m, digits))).otherwise(F.avg(m)), digits).alias(m)
    return scores.rollup("category").agg(*[mean(m) for m in measures], F.count("*").alias("n"), F.grouping("category").cast("int").alias("overall"))


def macro_mean(scores: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Mean over groups of the groups' means, one row."""
    per = scores.groupBy(group).agg(*[F.avg(m).alias(m) for m in measures])
    return per.agg(*[F.avg(m).alias(m) for m in measures], F.count("*").alias("n_groups"))


def compare(scores: DataFrame, variant: str, variants: list[str], measures: list[str]) -> DataFrame:
    """measure and one column per variant: means side by side."""
    parts = ", ".join(f"'{m}', {m}" for m in measures)
    long = scores.selectExpr(variant, f"stack({len(measures)}, {parts}) as (measure, value)")
    return long.groupBy("measure").pivot(variant, variants).agg(F.avg("value"))


def summary(df: DataFrame, category: str, value: str) -> DataFrame:
    """category, mean, std (of a sample; 0 for one row), median, min, max, n, and a row over all (overall = 1)."""
    v = F.col(value).cast("double")
    return df.rollup(category).agg(
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.median(v).alias("median"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"), F.grouping(category).cast("int").alias("overall"),
    )


def noise(retrieved: DataFrame, members: DataFrame, reference: DataFrame) -> DataFrame:
    """query, n_noise: retrieved memories without any of the query's reference topics."""
    good = retrieved.join(members, "item").join(reference, ["query", "topic"], "left_semi").select("query", "item").distinct()
    bad = retrieved.select("query", "item").distinct().join(good, ["query", "item"], "left_anti").groupBy("query").agg(F.count("*").alias("n"))
    return retrieved.select("query").distinct().join(bad, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n_noise"))


def evidence_memories(memories: DataFrame, evidence: DataFrame, texts: DataFrame, least: float = DEFAULTS.evidence_similarity) -> DataFrame:
    """query, item: the memories of the query's sample that hold a piece of its evidence or are similar to its text.

    memories(item, sample, sources, vector), evidence(query, sample, dia), texts(sample, dia, vector).
    """
    own = memories.select("item", "sample", F.explode("sources").alias("dia"))
    held = evidence.join(own, ["sample", "dia"]).select("query", "item")
    asked = evidence.join(texts, ["sample", "dia"]).select(F.struct("query", "dia").alias("query"), F.col("vector").alias("qv"), F.col("sample").alias("scope"))
    near = items_above(memories.select("item", "vector", F.col("sample").alias("scope")), asked, least, scoped=True)
    return held.unionByName(near.select("query.query", "item")).distinct()


def flattened(results: DataFrame, sample: str, items: str, skip: tuple[int, ...] = (5,)) -> DataFrame:
    """sample, pos and the fields of each element of a list of items per sample, but for the skipped categories."""
    rows = results.select(sample, F.posexplode(items).alias("pos", "one")).select(sample, "pos", "one.*")
    return rows.filter(~F.coalesce(F.col("category").isin(*skip), F.lit(False)))


def cross_topic(evidence_memories: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """query, item: evidence memories outside the seed topics, of the queries whose evidence spans two topics or more."""
    rows = evidence_memories.join(members, "item")
    wide = rows.groupBy("query").agg(F.count_distinct("topic").alias("n")).filter("n >= 2").select("query")
    inside = rows.join(seeds, ["query", "topic"], "left_semi").select("query", "item").distinct()
    return evidence_memories.join(wide, "query", "left_semi").select("query", "item").distinct().join(inside, ["query", "item"], "left_anti")


def recall_of(wanted: DataFrame, retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """query, recall of wanted(query, item) among retrieved; 1 where nothing is wanted."""
    got = retrieved.select("query", "item", F.lit(1).alias("g")).distinct()
    per = wanted.join(got, ["query", "item"], "left").groupBy("query").agg(F.avg(F.coalesce("g", F.lit(0))).alias("recall"))
    return queries.select("query").join(per, "query", "left").select("query", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def judged(correct: Column) -> Column:
    return F.avg(correct.cast("double"))
