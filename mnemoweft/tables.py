"""Reading the canonical tables and picking each key's current row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.runtime import steady

#: Key and version column of the tables that hold older states.
CURRENT = {
    "topics": (["topic_id"], "updated_at"),
    "memories": (["memory_id"], "ingested_at"),
    "assoc_edges": (["source_id", "target_id"], "last_updated"),
    "turns": (["sample_id", "session_id", "turn_idx"], "ingested_at"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return steady(spark).read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, keys: list[str], version: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key: that with the latest `version`; a null version is the oldest.

    Rows that tie are equal by contract; among unequal ones the largest row wins, so the result
    does not depend on their order.  Rows with a null key are dropped.  Pass only the columns
    you need: the others are never shuffled.  Aggregates, so repeated rows shrink before the
    shuffle and no group is sorted.
    """
    rest = [c for c in (columns or df.columns) if c not in keys and c != version]
    keep = [c for c in (columns or df.columns)]
    maps = {c for c, t in df.dtypes if t.startswith("map")}
    body = F.struct(F.col(version), *[F.col(c) for c in rest if c not in maps])
    row = F.max_by(F.struct(*[F.col(c) for c in rest if c in maps]), body) if maps & set(rest) else F.lit(None)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    out = df.groupBy(*keys).agg(F.max(body).alias("__b"), row.alias("__m"))
    picked = {c: F.col("__m" if c in maps else "__b")[c].alias(c) for c in [*rest, version]}
    return out.select(*[F.col(c) if c in keys else picked[c] for c in keep])


def current(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    keys, version = CURRENT[name]
    return current_rows(table(spark, folder, name), keys, version, columns)
