"""A memory store as Parquet tables under one folder and namespace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("topics", "memories", "memory_topics", "dag_edges", "assoc_edges")


@dataclass(frozen=True)
class TableStore:
    """Each table is a folder with one partition per namespace; a write replaces its namespace only."""

    spark: SparkSession
    folder: str
    namespace: str = "default"

    def write(self, name: str, df: DataFrame) -> None:
        rows = df.withColumn("namespace", F.lit(self.namespace))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(f"{self.folder}/{name}"))

    def write_by_topic(self, memories: DataFrame, buckets: int = 64) -> None:
        """memories(item, topics, ...) once per topic, by buckets of topics, for by_topic."""
        rows = memories.withColumn("topic", F.explode(F.array_distinct("topics"))).filter("topic is not null")
        bucket = F.pmod(F.xxhash64(F.col("topic").cast("string")), F.lit(buckets)).cast("int")
        held = rows.withColumns({"bucket": bucket, "namespace": F.lit(self.namespace)})
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "bucket").parquet(f"{self.folder}/memories_by_topic")

    def by_topic(self, topics: list, buckets: int = 64) -> DataFrame:
        """The memories of some topics, once each; only the buckets of these topics are read."""
        rows = self.spark.read.parquet(f"{self.folder}/memories_by_topic").filter(F.col("namespace") == self.namespace)
        wanted = {r[0] for r in self.spark.createDataFrame([(str(t),) for t in topics], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).collect()}
        found = rows.filter(F.col("bucket").isin(sorted(wanted)) & F.col("topic").isin(list(topics)))
        return found.drop("topic", "bucket", "namespace").dropDuplicates(["item"])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").filter(F.col("namespace") == self.namespace).drop("namespace")

    def clear(self, name: str) -> None:
        """Empty this namespace's part, others stay."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/namespace={self.namespace}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def sync(self, **tables: DataFrame) -> None:
        """Replace the given tables of this namespace."""
        for name, df in tables.items():
            self.write(name, df)

    def assert_unique(self, name: str, keys: list[str]) -> None:
        twice = self.read(name).groupBy(*keys).count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"{name}: {keys} occurs twice")


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines under a folder.  With by (such as the sample) only the parts of its values in df are replaced."""
    if by is None:
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def exposed_ids(df: DataFrame, node_id: str = "node_id", raw_id: str = "raw_id") -> DataFrame:
    """df with its id as users see it: the raw one, or the stored one where there is none."""
    return df.withColumn("id", F.coalesce(raw_id, node_id)).drop(node_id, raw_id)
