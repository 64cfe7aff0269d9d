"""Mixing sources to target weights: hash-random order, prefix sums of tokens, exact cuts."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.functions.tokens import load_encoding, pieces
from mnemoweft.runtime import bounded, cut

def token_counts(df: DataFrame, text: str, vocabulary: str, name: str = "n_tokens") -> DataFrame:
    """df without its text but with the tokens of it; null and empty texts have none.

    vocabulary is the path of a rank file that every executor can read.
    """
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest).schema.add(name, "long")

    def count(batches):
        encoding = load_encoding(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            n = [sum(len(encoding.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*rest, name])

    return df.mapInArrow(count, schema)


def clean_source(c: Column) -> Column:
    return F.lower(F.trim(c))


@dataclass(frozen=True)
class Mixture:
    """selection(id, source, n_tokens, copies) and report, one row per target."""

    selection: DataFrame
    report: DataFrame


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    vocabulary: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: str = "target_share",
    repeats: str = "max_repeats",
    seed: int = 17,
) -> Mixture:
    """Combine documents so that each target source gets its share of the tokens.

    The size to share out is the tokens of all documents whose source is a target; a source gets
    min(share x size, repeats x its own tokens).  It gives whole epochs of itself first and then the
    documents, in an order of hashes of (seed, id), that end within the rest of the budget: it falls
    short by less than one document and never goes beyond.  Sources are trimmed and lower-cased.
    Documents with a null or other source are left out, null and empty texts have no tokens and are
    taken along, repeated ids count each.  Null shares or repeats count as 0, repeated targets as
    the one with the largest share.  Further columns are not read.  A target without documents is
    reported with 0 tokens; without documents at all every target of a positive share is unmet.

    report: source, target_share, max_repeats, target_tokens, own_tokens, taken_tokens,
    actual_share, met (repeats x own_tokens >= target_tokens).
    """
    wanted = (
        targets.select(clean_source(F.col(source)).alias("source"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("target_share"),
                       F.coalesce(F.col(repeats).cast("long"), F.lit(0)).alias("max_repeats"))
        .filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
        .select("source", "t.target_share", "t.max_repeats")
    )
    taken_along = documents.select(F.col(id).alias("id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text")).join(
        bounded(wanted.select("source")), "source", "left_semi"
    )
    key = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    sized = cut(token_counts(taken_along, "text", vocabulary).withColumn("key", key))
    own = sized.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"))
    size = F.coalesce(F.sum("own_tokens").over(W.partitionBy()), F.lit(0))  # one row per target
    plan = cut(
        wanted.join(own, "source", "left")
        .withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)))
        .withColumn("target_tokens", F.col("target_share") * size)
        .withColumn("most", F.col("max_repeats") * F.col("own_tokens"))
        .withColumn("budget", F.floor(F.least(F.col("target_tokens"), F.col("most").cast("double"))))
        .withColumn("epochs", F.when(F.col("own_tokens") > 0, F.floor(F.col("budget") / F.col("own_tokens"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("own_tokens"))
    )
    ranged = cut(sized.repartitionByRange("source", "key", "id").sortWithinPartitions("source", "key", "id"))
    ranged = ranged.withColumn("part", F.spark_partition_id())
    sums = ranged.groupBy("source", "part").agg(F.sum("n_tokens").alias("s"))
    # one number per partition and source, whatever the number of documents
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy("source", "part").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        ranged.join(starts, ["source", "part"])
        .withColumn("end", F.col("start") + F.sum("n_tokens").over(inside))
        .join(bounded(plan.select("source", "epochs", "rest", "max_repeats")), "source")
    )
    extra = ((F.col("end") <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))).cast("long")
    selection = placed.select("id", "source", "n_tokens", (F.col("epochs") + extra).alias("copies")).filter(F.col("copies") > 0)
    taken = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("taken_tokens"))
    all_taken = F.sum("taken_tokens").over(W.partitionBy())
    report = (
        plan.join(taken, "source", "left")
        .withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0)))
        .select(
            "source", "target_share", "max_repeats", "target_tokens", "own_tokens", "taken_tokens",
            F.when(all_taken > 0, F.col("taken_tokens") / all_taken).otherwise(F.lit(0.0)).alias("actual_share"),
            ((F.col("most") >= F.col("target_tokens")) & ((F.col("own_tokens") > 0) | (F.col("target_share") <= 0))).alias("met"),
        )
    )
    return Mixture(selection, report)
