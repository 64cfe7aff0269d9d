"""Association statistics kept up to date by micro-batches.

State is a set of Parquet tables per version in a shared folder.  Micro-batch b reads the version before
it and writes version b: a batch that runs again writes the same version again, so each row counts
exactly once.  Rows may be late, repeated or supersede earlier ones; counts of superseded rows
are taken back.  Event time comes from the rows, never from the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS, Settings
from mnemoweft.operators.assoc import bridge, cooccurrences, directed, marginals, reinforced, with_npmi
from mnemoweft.runtime import cut, remove, steady
from mnemoweft.tables import current_rows

SCHEMAS = {
    "memories": "memory string, topics array<string>, version timestamp_ntz",
    "pairs": "a string, b string, n_ab long",
    "counts": "topic string, n_topic long",
    "edges": "source string, target string, weight double, last_updated timestamp_ntz",
    "progress": "total long, since_rebuild long",
}


@dataclass
class IncrementalAssociation:
    """memories, pairs, counts, edges and progress of a stream of (memory, topics, version).

    edges are those of the association graph: every memory that a batch brings reinforces, at its
    version, the edges of its pairs, directed by the counts after the batch, by their NPMI; weights decay
    between.  What a superseded memory reinforced before is not taken back.  Two versions of the state
    are kept, the last whole one and the one before, which a batch that runs again reads.
    """

    spark: SparkSession
    folder: str
    settings: Settings = DEFAULTS
    on_rebuild: Callable[[int], None] | None = None

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/progress/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/v{known[-1]}/{name}")

    def _write(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{batch}/{name}")

    def process(self, rows: DataFrame, batch: int) -> None:
        """Take in one micro-batch; progress is written last and marks the version as whole."""
        steady(rows.sparkSession)
        state = self.read("memories", batch)
        new = current_rows(rows, ["memory"], "version", ["memory", "topics", "version"])
        held = state.select("memory", F.col("version").alias("v"), F.lit(True).alias("known"))
        # what a batch changes is used several times; it is a version's own table, so no lineage grows
        fresh = new.join(held, "memory", "left").filter(F.col("v").isNull() | (F.col("version") > F.col("v")))
        self._write("changed", fresh.select("memory", "topics", "version", F.coalesce("known", F.lit(False)).alias("known")), batch)
        newer = self.spark.read.parquet(f"{self.folder}/v{batch}/changed")
        replaced = state.join(newer.select("memory"), "memory", "left_semi")
        signed = lambda df, keys, n: df.groupBy(*keys).agg(F.sum(n).alias(n)).filter(F.col(n) != 0)
        plus, minus = bridge(newer, "memory", "topics"), bridge(replaced, "memory", "topics")
        met = cut(cooccurrences(plus))
        pairs = self.read("pairs", batch).unionByName(met).unionByName(cooccurrences(minus).withColumn("n_ab", -F.col("n_ab")))
        counts = self.read("counts", batch).unionByName(marginals(plus)).unionByName(marginals(minus).withColumn("n_topic", -F.col("n_topic")))
        self._write("pairs", signed(pairs, ["a", "b"], "n_ab"), batch)
        self._write("counts", signed(counts, ["topic"], "n_topic"), batch)
        self._write("memories", state.join(newer.select("memory"), "memory", "left_anti").unionByName(newer.drop("known")), batch)
        self._write("edges", self._reinforced(newer, plus, met, batch), batch)
        last = self.read("progress", batch).first()
        added = newer.filter(~F.col("known")).count()
        total, since = (last["total"], last["since_rebuild"]) if last else (0, 0)
        since += added
        if since >= self.settings.rebuild_interval:
            if self.on_rebuild:
                self.on_rebuild(batch)
            since = 0
        self._write("progress", self.spark.createDataFrame([(total + added, since)], SCHEMAS["progress"]).coalesce(1), batch)

        for old in [v for v in self._versions() if v < batch][:-1]:
            remove(self.spark, f"{self.folder}/v{old}")

    def _reinforced(self, newer: DataFrame, members: DataFrame, met: DataFrame, batch: int) -> DataFrame:
        """The edges after the batch whose memories' memberships and pairs are given."""
        new = lambda name: self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/v{batch}/{name}")
        last = self.read("progress", batch).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"))
        total = last.crossJoin(newer.agg(F.count_if(~F.col("known")).alias("m"))).select((F.col("n") + F.col("m")).alias("n"))  # one row each
        scored = with_npmi(new("pairs").join(met, ["a", "b"], "left_semi"), new("counts"), total)
        s = self.settings
        ways = directed(scored, s.npmi, s.min_cooccurrence, s.direction_epsilon)
        ends = lambda end: members.select("memory", F.col("topic").alias(end))
        each = ways.join(ends("source"), "source").join(ends("target"), ["memory", "target"]).join(newer.select("memory", "version"), "memory")
        events = each.select("source", "target", F.col("npmi_mem").alias("delta"), "version", "memory")
        out = reinforced(events, ["source", "target"], "delta", "version", "memory", s, self.read("edges", batch))
        return out.select("source", "target", F.least("weight", F.lit(s.weight_max)).alias("weight"), F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))

    def start(self, stream: DataFrame, checkpoint: str):
        """Run over all that is available of a streaming frame (memory, topics, version)."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def npmi(self) -> DataFrame:
        return with_npmi(self.read("pairs"), self.read("counts"), self.read("progress").select("total"))


def reinforce_onto(state: DataFrame, events: DataFrame, keys: list[str], delta: str, ts: str, tie: str, settings: Settings = DEFAULTS) -> DataFrame:
    """state (keys, weight, last_updated) after the events of a batch, which are later than it."""
    return reinforced(events, keys, delta, ts, tie, settings, state)


def event_sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str | None = "1 day") -> DataFrame:
    """user, started, ended, n of runs of events without a longer gap; with a watermark on streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    runs = rows.groupBy(F.col(user), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return runs.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
