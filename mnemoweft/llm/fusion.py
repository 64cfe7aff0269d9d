"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.runtime import cut


def _key(score: str) -> Column:
    """Higher is better; null and NaN come last and tie with each other."""
    value = F.col(score).cast("double")
    known = value.isNotNull() & ~F.isnan(value)
    return F.struct(known.alias("known"), F.when(known, value).otherwise(F.lit(0.0)).alias("value"))


def _hot_ranks(df: DataFrame, group: str, score: str) -> DataFrame:
    """rank() of each row in its group without gathering a group.

    A range-partitioned sort on (group, score) spreads a group over many tasks.  The rank is 1 +
    the rows before the row's score in the group: those of earlier partitions, summed up from one
    number per partition and group, and those before it in its own.
    """
    ranged = cut(
        df.select(F.col(group).alias("__g"), _key(score).alias("__v"))
        .groupBy("__g", "__v").agg(F.count("*").alias("__n"))
        .repartitionByRange("__g", F.desc("__v"))
    ).withColumn("__p", F.spark_partition_id())
    parts = ranged.groupBy("__g", "__p").agg(F.sum("__n").alias("__pn"))
    before = W.partitionBy("__g").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(F.col("__g").alias("__h"), F.col("__p").alias("__q"), F.coalesce(F.sum("__pn").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy("__g", "__p").orderBy(F.desc("__v")).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__p") == F.col("__q"))
    return ranged.join(starts, same).select(
        "__g", "__v", (F.col("__start") + F.coalesce(F.sum("__n").over(inside), F.lit(0)) + 1).alias("__rank")
    )


def fuse_ranks(df: DataFrame, group: str, scores: list[str], k0: float = 60.0, max_group_rows: int = 1_000_000) -> DataFrame:
    """Adds rank_<score> for each score, and fused: the sum of 1 / (k0 + rank) over the scores.

    Ranks are those within `group`, 1 for the highest; equal scores share the better rank, null and
    NaN share the last one, so each score has the same say whatever its range.  A score that is null
    throughout ranks every row 1.  Repeated rows are ranked each.  Rows with a null group form one
    group.  Further columns are kept; an empty table stays empty.

    Groups of up to max_group_rows rows are sorted in one task each by window functions that share
    one exchange; larger ones, found by a count with map-side combine, are ranked by range-partitioned
    sorts instead.  Both give the same ranks.
    """
    ranks = [f"rank_{s}" for s in scores]
    clash = sorted({*ranks, "fused"} & set(df.columns))
    if clash:
        raise ValueError(f"columns {clash} are in the input already")
    total = sum((1.0 / (F.col(r) + k0) for r in ranks), F.lit(0.0)).alias("fused")
    rank = lambda s: F.rank().over(W.partitionBy(group).orderBy(_key(s).desc())).cast("long").alias(f"rank_{s}")
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).filter(F.col("__n") > max_group_rows)
    hot = [r[0] for r in sizes.limit(1).collect()]
    if not hot:
        return df.select("*", *[rank(s) for s in scores]).select("*", total)
    large = sizes.select(F.col(group).alias("__k"))
    match = F.col(group).eqNullSafe(F.col("__k"))
    plain = df.join(large, match, "left_anti").select("*", *[rank(s) for s in scores])
    rest = df.join(large, match, "left_semi")
    for s in scores:
        r = _hot_ranks(rest.select(group, s), group, s)
        rest = (
            rest.withColumn("__key", _key(s))
            .join(r, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__key") == F.col("__v")))
            .withColumn(f"rank_{s}", F.col("__rank"))
            .drop("__key", "__g", "__v", "__rank")
        )
    return plain.unionByName(rest).select("*", total)
