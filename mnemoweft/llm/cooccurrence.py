"""Items that appear together: external sort of packed 64-bit pair codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweft.runtime import cut, parallelism, split_join, with_dense_codes

RUN = 4_000_000  # pair codes sorted at once, 32 MB


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """Run-length count of sorted codes."""
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[first, len(codes)]) if counts is None else np.add.reduceat(counts, first) if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(n.astype(np.int64))], names=["pair", "n_ab"])


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths


def _pair_codes(left, right):
    """Arrays of packed pair codes of the baskets (or of the blocks of large baskets) of a batch."""
    a, la = _lists(left)
    b, lb = _lists(right)
    sa, sb = np.cumsum(la) - la, np.cumsum(lb) - lb
    within = lb == 0
    for size in np.unique(la[within]):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, RUN // len(i))
        at = sa[within & (la == size)]
        for k in range(0, len(at), step):
            rows = np.sort(a[at[k : k + step, None] + np.arange(size)], axis=1)
            yield ((rows[:, i] << 32) | rows[:, j]).ravel()
    for k in np.flatnonzero(~within):
        x, y = a[sa[k] : sa[k] + la[k], None], b[None, sb[k] : sb[k] + lb[k]]
        yield ((np.minimum(x, y) << 32) | np.maximum(x, y)).ravel()


def _spill_runs(batches):
    """Packed codes leave as sorted runs with counts, so a hot pair is one row of a run."""
    held, size = [], 0
    for batch in batches:
        for codes in _pair_codes(batch.column(0), batch.column(1)):
            held.append(codes)
            size += len(codes)
            if size >= RUN:
                yield _runs(np.sort(np.concatenate(held)))
                held, size = [], 0
    if size:
        yield _runs(np.sort(np.concatenate(held)))


def _merge_runs(minimum: int):
    """Sum the counts of equal neighbours of a sorted stream."""

    def merge(batches):
        last_code, last_n = None, 0

        def out(codes, counts):
            keep = counts >= minimum
            return pa.RecordBatch.from_arrays([pa.array(codes[keep]), pa.array(counts[keep])], names=["pair", "n_ab"])

        for batch in batches:
            codes, counts = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(codes):
                continue
            if last_code is not None:
                codes, counts = np.r_[last_code, codes], np.r_[last_n, counts]
            run = _runs(codes, counts)
            codes, counts = run.column(0).to_numpy(), run.column(1).to_numpy()
            last_code, last_n = codes[-1], counts[-1]
            if len(codes) > 1:
                yield out(codes[:-1], counts[:-1])
        if last_code is not None:
            yield out(np.array([last_code]), np.array([last_n]))

    return merge


def cooccurrence(records: DataFrame, record: str, items: str, min_count: int = 1, block: int = 512) -> DataFrame:
    """How often each pair of items shares a record, and how much more often than chance.

    records has one row per record, with an array of items; repeats and nulls in the array are
    ignored, a record with a null or empty array only counts towards n, one with a null id is
    dropped, further columns are never read.  An empty table gives no rows.  Pairs met in fewer than
    min_count records are left out; then items in fewer records cannot be part of any, and go first.

    Returns item_a < item_b, n_ab, n_a, n_b, n (all records), pmi, npmi, lift, odds_ratio and
    log_odds, the last two with 0.5 added to each cell of the two-by-two table.  npmi is 0 where
    every record holds both.

    Method: items get dense codes, a basket becomes packed codes (a << 32 | b), sorted runs with
    counts are spilled, merged by Spark's external sort and run-length counted.  The items of a basket of
    more than `block` are dealt to blocks of about that many, and pairs of blocks are spread over the tasks.
    """
    base = records.filter(F.col(record).isNotNull()).select(
        F.col(record).alias("r"),
        F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())).alias("xs"),
    )
    base = cut(base)
    total = base.count()
    flat = base.select("r", F.greatest(F.lit(1), F.ceil(F.size("xs") / block)).cast("int").alias("blocks"), F.explode("xs").alias("item"))
    counted = flat.groupBy("item").agg(F.count("*").alias("n_item")).filter(F.col("n_item") >= min_count)
    codes = with_dense_codes(counted, ["item"])
    stats = codes.agg(F.sum("n_item").alias("s"), F.count("*").alias("c")).first()
    if stats["c"] >= 1 << 31:
        raise ValueError("more than 2^31 different items do not fit packed pair codes")
    coded = split_join(flat, codes, "item", "n_item", stats["s"] or 0).select("r", "blocks", F.col("code").cast("int").alias("code"))
    # items are dealt to blocks before anything of a basket is collected
    own = coded.withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("r", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "code")
    side = lambda end: F.collect_list(F.when(F.col("own") == F.col(end), F.col("code")))
    inside = F.col("lo") == F.col("hi")
    both = cells.groupBy("r", "lo", "hi").agg(side("lo").alias("x"), side("hi").alias("z"))
    both = both.filter(F.when(inside, F.size("x") > 1).otherwise((F.size("x") > 0) & (F.size("z") > 0)))
    baskets = both.select("x", F.when(inside, F.array().cast("array<int>")).otherwise(F.col("z")).alias("y"))
    n = parallelism(records.sparkSession)
    runs = baskets.mapInArrow(_spill_runs, "pair long, n_ab long")
    pairs = (
        runs.repartition(n, "pair")
        .sortWithinPartitions("pair")
        .mapInArrow(_merge_runs(min_count), "pair long, n_ab long")
        .select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n_ab")
    )
    a = codes.select(F.col("code").alias("a"), F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = codes.select(F.col("code").alias("b"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    named = pairs.join(a, "a").join(b, "b").withColumn("n", F.lit(total).cast("long"))
    return with_association(named).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n", "pmi", "npmi", "lift", "odds_ratio", "log_odds"
    )


def with_association(pairs: DataFrame) -> DataFrame:
    """pmi, npmi, lift and corrected odds of rows with n_ab, n_a, n_b and n."""
    n_ab, n_a, n_b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    lift = n_ab * n / (n_a * n_b)
    spread = -F.ln(n_ab / n)
    odds = ((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))
    return pairs.select(
        "*",
        F.ln(lift).alias("pmi"),
        F.when(spread > 0, F.ln(lift) / spread).otherwise(F.lit(0.0)).alias("npmi"),
        lift.alias("lift"),
        odds.alias("odds_ratio"),
        F.ln(odds).alias("log_odds"),
    )
