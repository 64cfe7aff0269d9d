"""Queries on incremental maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.plans import bindings as B
from mnemoweft.plans.bindings import rounded
from mnemoweft.runtime import cut, ensure_checkpoint_dir, remove
from mnemoweft.streaming.incremental import IncrementalAssociation, event_sessions
from mnemoweft.tables import table


def stream_incremental_npmi(spark: SparkSession, sf: str) -> DataFrame:
    """The memories as a file stream in several micro-batches; the same pairs and scores as from the whole table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    whole = table(spark, sf, "memories").select("memory_id", "topic_ids", "ingested_at")
    whole.repartition(2).write.parquet(f"{folder}/files")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/files")
    rows = stream.select(F.col("memory_id").alias("memory"), F.col("topic_ids").alias("topics"), F.col("ingested_at").alias("version"))
    state = IncrementalAssociation(spark, f"{folder}/state")
    state.start(rows, f"{folder}/progress").awaitTermination()
    found = cut(state.npmi().select("a", "b", "n_ab", "n_a", "n_b", *rounded("npmi")))
    remove(spark, folder)
    return found


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return event_sessions(table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts").select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "n")


QUERIES = {f.__name__: f for f in (stream_incremental_npmi, user_sessions)}

SQL = {
    "stream_incremental_npmi": f"""WITH {B.MEMORY_TOPICS}, tot AS (SELECT count(DISTINCT memory_id) AS n FROM memories), {B.PAIRS}, {B.NPMI}
SELECT a, b, n_ab, n_a, n_b, round(npmi, 6) + 0.0 AS npmi FROM np""",
    "user_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(t) AS started, max(t) + 1800000000 AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
}
