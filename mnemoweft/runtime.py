"""Things that depend on the running session: checkpoints, parallelism, dense codes."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low 33 bits


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; make one only for a local master.

    On a cluster a machine-local folder would not survive the loss of an executor, so there an
    unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mnemoweft-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def steady(spark: SparkSession) -> SparkSession:
    """Turn off a feature of Spark 4.1 that gives wrong results.

    With it a union claims its inputs' common partitioning; adaptive coalescing can then leave these with
    different partitions, and a distinct or aggregate above keeps duplicates or fails to zip them.
    """
    if spark.conf.get("spark.sql.unionOutputPartitioning", None) != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage (eager).

    A checkpoint keeps the estimated size of its plan, and a join's is the product of its inputs': through
    a chain of joins and cuts the digits grow exponentially, and planning never ends.  An estimate
    beyond 2^62 bytes is therefore dropped.  What is a checkpoint already stays as it is.
    """
    spark = steady(df.sparkSession)
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().isCheckpointed():
        return df
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    execution = done._jdf.queryExecution()
    if execution.optimizedPlan().stats().sizeInBytes() <= 1 << 62:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(execution.logical().rdd(), done._jdf.schema(), False), spark)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Hint a broadcast if df is known to have at most that many rows; else leave it to Catalyst."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parallelism(spark: SparkSession, rows: int | None = None, per_task: int = 1_000_000) -> int:
    """Partitions for stages whose work is CPU and whose shuffled bytes are few.

    AQE sizes partitions by bytes, which would leave such stages on one core.  Where the number of rows is
    known there are as many as keep a task at per_task of them.
    """
    steady(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // per_task))


def with_dense_codes(df: DataFrame, order: list, name: str = "code") -> DataFrame:
    """Number the rows 0..n-1 in the given order without gathering them.

    Range-partitioned sort, one count per partition (that many numbers reach the driver, not
    rows), then offset + position.  The result is materialised, so codes stay what they are.
    """
    part, row = F.shiftright(F.col("__mid"), _ROW_BITS), F.col("__mid").bitwiseAND((1 << _ROW_BITS) - 1)
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    ranged = ranged.withColumn("__mid", F.monotonically_increasing_id())
    counts = ranged.groupBy(part.alias("p")).count().collect()
    offsets, total = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        offsets[r["p"]] = total
        total += r["count"]
    if not offsets:
        return ranged.select("*", F.lit(0).cast("long").alias(name)).drop("__mid")
    table = np.zeros(max(offsets) + 1, dtype=np.int64)
    for p, o in offsets.items():
        table[p] = o
    starts = F.array(*[F.lit(int(x)) for x in table]) if len(table) <= 64 else None
    if starts is not None:
        return ranged.withColumn(name, F.get(starts, part.cast("int")) + row).drop("__mid")
    lookup = df.sparkSession.createDataFrame([(int(p), int(o)) for p, o in offsets.items()], "__p long, __o long")
    # one row per partition, so its size is bounded by the partition count
    return (
        ranged.withColumn("__p", part.cast("long"))
        .join(F.broadcast(lookup), "__p")
        .withColumn(name, F.col("__o") + row)
        .drop("__mid", "__p", "__o")
    )


def split_join(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, share: float = 0.001) -> DataFrame:
    """Inner join of left with right (unique in `on`) that no hot key can overload.

    right carries in `weight` how many left rows have its key and `total` is their sum, so at
    most 1/share keys reach total*share rows: those, and no more, are broadcast.  All other
    keys hold less than that share of the rows and are joined as Catalyst sees fit.
    """
    limit = max(1.0, total * share)
    hot = F.broadcast(right.filter(F.col(weight) >= limit))
    cold = right.filter(F.col(weight) < limit)
    first = left.join(hot.withColumnRenamed(on, "__hot"), left[on] == F.col("__hot"), "left")
    others = [c for c in right.columns if c != on]
    hits = first.filter(F.col("__hot").isNotNull()).select(*left.columns, *others)
    rest = left.join(hot.select(on), on, "left_anti")
    return hits.unionByName(rest.join(cold, on).select(*left.columns, *others))


def iter_groups(batches, keys: list[str]):
    """Groups of neighbouring rows with equal keys, from an iterator of Arrow batches sorted by them.

    Yields one table per group and holds one group at a time.
    """
    held: list[pa.Table] = []

    def edges(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def same(a: pa.Table, b: pa.Table) -> bool:
        return all(a[k][a.num_rows - 1].as_py() == b[k][0].as_py() for k in keys)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if held and not same(held[-1], t):
            yield pa.concat_tables(held)
            held = []
        cuts = [*edges(t).tolist(), t.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if s and held:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(s, e - s))
    if held:
        yield pa.concat_tables(held)


def with_positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Adds the row's place in its group (from 0) without gathering a group in a task.

    A sort range-partitioned on group and order spreads a large group; one count per partition and
    group gives the offsets.  order must tell the rows of a group apart.
    """
    keys = [*group, *order]
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy(*group, "__p").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    of = [F.col(g).alias(f"__g{k}") for k, g in enumerate(group)]
    starts = counts.select(*of, F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = F.col("__p") == F.col("__q")
    for k, g in enumerate(group):  # a null group is a group
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    inside = W.partitionBy(*group, "__p").orderBy(*order)
    placed = ranged.join(starts, same).withColumn(name, F.col("__start") + F.row_number().over(inside) - 1)
    return placed.select(*df.columns, name)
