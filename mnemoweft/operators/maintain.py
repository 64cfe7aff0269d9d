"""Keyed tables: upsert, delete, cascade, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in by key; of new's rows with one key any full row (the largest) counts."""
    rest = [c for c in old.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*old.columns)
    return old.join(once, keys, "left_anti").unionByName(once)


def delete(rows: DataFrame, gone: DataFrame, columns: list[str], key: str) -> DataFrame:
    """rows without those that name a deleted key in one of the columns."""
    for c in columns:
        rows = rows.join(gone.select(F.col(key).alias(c)).distinct(), c, "left_anti").select(*rows.columns)
    return rows


def topic_points(topics: DataFrame) -> DataFrame:
    """topic, label_vector, summary_vector for the vector store: a missing summary takes the label's; topics with neither are left out."""
    summary = F.coalesce("summary_vector", "label_vector")
    return topics.select("topic", F.coalesce("label_vector", "summary_vector").alias("label_vector"), summary.alias("summary_vector")).filter("summary_vector is not null")
