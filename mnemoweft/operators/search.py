"""Exact vector search of a set of queries against all rows: each side is read once, whatever its size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.runtime import bounded, cut, parallelism, split_join

BLOCK = 2048  # queries that are sent to the tasks with the plan; more are shuffled
ROWS = 1024  # rows that a task multiplies them with, 16 MB of products
HELD = 2_000_000  # candidates that it holds before it drops those that are out
PART = 8192  # rows of a part, which a task holds as one matrix, 25 MB of 384 numbers
PRODUCTS = 2_000_000  # products of a part with queries that it holds at once
TASK_ROWS = 100_000  # rows of one task of the shuffled search


def matrix(column, dim: int, unit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lists of that many numbers, and these as rows, with unit divided by their lengths."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    v = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if unit:
        n = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        with np.errstate(invalid="ignore"):
            v = v / np.where(n == 0, 1.0, n)
    return at, np.nan_to_num(v)


def sizes_of(column) -> list[int]:
    """The different lengths of some lists, without empty ones."""
    lengths = np.unique(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return [int(n) for n in lengths if n > 0]


def by_size(column, unit: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and rows of the lists of each length."""
    return {n: matrix(column, n, unit) for n in sizes_of(column)}


def dots(asked: dict, held: dict, shape: tuple[int, int]) -> np.ndarray:
    """Products (nine decimals) of the lists of two columns, given by_size; NaN where the sizes differ."""
    out = np.full(shape, np.nan)
    for dim in sorted(set(asked) & set(held)):
        (r, a), (c, b) = asked[dim], held[dim]
        if len(r) == shape[0] and len(c) == shape[1]:
            return np.round(a @ b.T, 9)
        out[np.ix_(r, c)] = np.round(a @ b.T, 9)
    return out


class Shared:
    """How many values the sets of some rows share with those of the held ones."""

    def __init__(self, sizes: np.ndarray, rows: dict):
        """How many values each held set has, and the sets (numbers, ascending) that have each value."""
        self.sizes, self.rows = sizes.astype(float), rows

    def counts(self, sets: list) -> np.ndarray:
        out = np.zeros((len(sets), len(self.sizes)))
        for k, s in enumerate(sets):
            for x in s:
                if x in self.rows:
                    out[k, self.rows[x]] += 1
        return out


class _Best:
    """The k best scores of each query, ties included, of a stream of candidates."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, c: np.ndarray, s: np.ndarray, items: pa.Array) -> None:
        self.parts.append((c, s, items))
        self.size += len(c)
        if self.size > HELD:
            self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        c, s = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        items = pa.concat_arrays([p[2] for p in self.parts])
        order = np.lexsort((-s, c))
        c, s = c[order], s[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        rank = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
        at = rank == self.k - 1
        self.least[c[at]] = s[at]
        keep = s >= self.least[c]
        self.parts = [(c[keep], s[keep], items.take(pa.array(order[keep])))]
        self.size = int(keep.sum())


def _block_scan(names, queries, k: int | None, least: float | None):
    """The items' batches against a bounded block of queries that came with the plan."""

    def out(c, s, items):
        return pa.RecordBatch.from_arrays([names.take(pa.array(c)), items, pa.array(s)], names=["query", "item", "score"])

    def scan(batches):
        best = _Best(len(queries), k) if k is not None else None
        for batch in batches:
            at, v = matrix(batch.column(1), queries.shape[1])
            for lo in range(0, len(at), ROWS):
                rows = pa.array(at[lo : lo + ROWS])
                g = np.round(v[lo : lo + ROWS] @ queries.T, 9)
                keep = np.ones(g.shape, bool) if best is None else g >= best.least[None, :]
                if least is not None:
                    keep &= g >= least
                if best is not None and len(g) > k:
                    keep &= g >= np.partition(g, len(g) - k, axis=0)[len(g) - k][None, :]
                r, c = np.nonzero(keep)
                if not len(r):
                    continue
                items = batch.column(0).take(rows).take(pa.array(r))
                if best is None:
                    yield out(c, g[r, c], items)
                else:
                    best.add(c, g[r, c], items)
        if best is not None:
            best.shrink()
            for c, s, items in best.parts:
                yield out(c, s, items)

    return scan


def _best_of(k: int | None, least: float | None, slack: float):
    """Kernel: per query the scores up to slack below the k-th best of a part, or those from least on."""

    def hold(held):
        parts = by_size(held.field("vector"))

        def ask(asked):
            for dim, (qs, a) in by_size(asked.field("vector")).items():
                if dim not in parts:
                    continue
                at, m = parts[dim]
                g = np.round(a @ m.T, 9)
                keep = np.ones(g.shape, bool) if least is None else g >= least
                if k is not None and g.shape[1] > k:
                    keep &= g >= np.partition(g, g.shape[1] - k, axis=1)[:, g.shape[1] - k, None] - slack
                r, c = np.nonzero(keep)
                yield qs[r], at[c], g[r, c]

        return ask

    return hold


def _runs_of(batches):
    """Neighbouring rows of one key, part and side: (whether the key or part is new, side, rows)."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        change = np.zeros(n, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(change).tolist(), n]
        for s, e in zip(edges, edges[1:]):
            cell = (cols[0][s], cols[1][s])
            yield cell != last, int(cols[2][s]), batch.slice(s, e - s)
            last = cell


def _cells(kernel):
    def run(batches):
        parts, ask = [], None
        for new, side, rows in _runs_of(batches):
            if new:
                parts, ask = [], None
            if side == 0:
                parts.append(rows)
                continue
            if parts:
                held = pa.Table.from_batches(parts).combine_chunks()
                items, ask, parts = held["item"].combine_chunks(), kernel(held["p"].combine_chunks()), []
            if ask is None:
                continue
            step = max(1, PRODUCTS // len(items))
            for lo in range(0, rows.num_rows, step):
                part = rows.slice(lo, step)
                for q, i, s in ask(part.column(5)):
                    if len(q):
                        yield pa.RecordBatch.from_arrays([part.column(4).take(pa.array(q)), items.take(pa.array(i)), pa.array(s)], names=["query", "item", "score"])

    return run


def in_cells(items: DataFrame, queries: DataFrame, kernel, keyed: bool = False) -> DataFrame:
    """query, item, score that a kernel gives for the items and the queries that meet.

    items(item, p), queries(query, p) with p a struct of the same type; all meet, or with keyed those of
    the same key (a column of both).  The items of a key are dealt to parts of about PART rows; a query
    goes to all parts of its key.  A task holds one part and streams the queries past it, so neither side
    has to fit and each is shuffled once, the queries as often as there are parts.

    kernel gets the p of a part and returns a function of the p of some queries that yields arrays of the
    positions of queries, of items, and scores.
    """
    spark = items.sparkSession
    qtype, itype = dict(queries.dtypes)["query"], dict(items.dtypes)["item"]
    if keyed:
        wanted = queries.select("key").distinct()
        counts = items.select("key").join(wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        sizes = counts.withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
        small = bounded(sizes, 100_000)
        few = small is not sizes
        held, asked = (df.join(small.drop("n"), "key") if few else split_join(df, sizes, "key", "n", total) for df in (items, queries))
    else:
        total = items.count()
        parts = max(1, -(-total // PART), min(parallelism(spark), -(-total // 256)))
        held, asked = (df.withColumn("key", F.lit(0)).withColumn("parts", F.lit(parts)) for df in (items, queries))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = held.select("key", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "item", none(qtype, "query"), "p")
    rows = rows.unionByName(asked.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), none(itype, "item"), "query", "p"))
    if keyed:
        spread = rows.repartition(parallelism(spark, total, TASK_ROWS), "key", "part")
    else:
        spread = rows.repartitionById(parts, "part")
    return spread.sortWithinPartitions("key", "part", "side").mapInArrow(_cells(kernel), f"query {qtype}, item {itype}, score double")


def _pack(batches):
    """The rows (item, p) of a partition as blocks of about PART rows, compressed, with a number."""
    held, number = [], TaskContext.get().partitionId() << 32

    def block():
        rows, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
        held.clear()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(rows)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])

    for batch in batches:
        for lo in range(0, batch.num_rows, PART):
            part = batch.slice(lo, PART)
            if held and sum(b.num_rows for b in held) + part.num_rows > PART:
                yield block()
                number += 1
            held.append(part)
    if held:
        yield block()


def _opened(body) -> pa.RecordBatch:
    return pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _block_pairs(kernel):
    def run(batches):
        last = None
        for batch in batches:
            for left, body, right, other in zip(*batch.columns):
                if left != last:
                    last, held = left, _opened(body)
                    ask, step = kernel(held["p"]), max(1, PRODUCTS // len(held))
                asked = held if left == right else _opened(other)
                for lo in range(0, len(asked), step):
                    part = asked.slice(lo, step)
                    for q, i, s in ask(part["p"]):
                        if left == right:
                            once = q + lo < i
                            q, i, s = q[once], i[once], s[once]
                        if len(q):
                            yield pa.RecordBatch.from_arrays([part["item"].take(pa.array(q)), held["item"].take(pa.array(i)), pa.array(s)], names=["x", "y", "score"])

    return run


def pairs_in_blocks(items: DataFrame, kernel) -> DataFrame:
    """a < b, score that a symmetric kernel gives for the pairs of items(item, p); kernel and p as for in_cells.

    The items are packed where they are into blocks of up to PART rows, written once and compressed; a
    task reads two blocks where they lie.  So what is written follows the number of items, not that of
    the pairs of blocks, and no pair of blocks is compared twice.
    """
    kind = dict(items.dtypes)["item"]
    parts = max(4, -(-items.select("item").count() // PART))
    blocks = cut(items.select("item", "p").coalesce(parts).mapInArrow(_pack, "block long, body binary"))
    other = blocks.select(F.col("block").alias("other"), F.col("body").alias("with"))
    # by nested loops over the files of the two sides, which shuffle nothing
    met = blocks.crossJoin(other.hint("shuffle_replicate_nl")).filter("block <= other")
    found = met.mapInArrow(_block_pairs(kernel), f"x {kind}, y {kind}, score double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score").filter("a < b")


def _search(items: DataFrame, queries: DataFrame, k: int | None, least: float | None) -> DataFrame:
    """Unkeyed search; up to BLOCK queries go with the plan and no row is shuffled."""
    asked, rows = queries.filter("qv is not null").select("query", "qv"), items.select("item", "vector")
    t = asked.limit(BLOCK + 1).toArrow()
    if t.num_rows > BLOCK:
        return in_cells(rows.select("item", F.struct(F.col("vector").cast("array<double>").alias("vector")).alias("p")), asked.select("query", F.struct(F.col("qv").cast("array<double>").alias("vector")).alias("p")), _best_of(k, least, 0.0))
    schema = f"query {dict(asked.dtypes)['query']}, item {dict(rows.dtypes)['item']}, score double"
    qv = t["qv"].combine_chunks()
    out = None
    # each row is compared with the queries of its own size
    for dim in sizes_of(qv) if t.num_rows else []:
        at, q = matrix(qv, dim)
        found = rows.mapInArrow(_block_scan(t["query"].combine_chunks().take(pa.array(at)), q, k, least), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else items.sparkSession.createDataFrame([], schema)


def candidates(items: DataFrame, queries: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
    """query, item, score of items that share a topic with the query: all up to slack below its k-th best.

    items(item, vector, topics), queries(query, qv, topics); some lower ones may come along.
    """
    flat = lambda df, id, v: df.filter(f"{v} is not null").select(id, F.struct(F.col(v).cast("array<double>").alias("vector")).alias("p"), F.explode(F.array_distinct("topics")).alias("key")).filter("key is not null")
    found = in_cells(flat(items, "item", "vector"), flat(queries, "query", "qv"), _best_of(k, None, slack), keyed=True)
    return found.groupBy("query", "item").agg(F.max("score").alias("score"))


def nearest_items(items: DataFrame, queries: DataFrame, k: int, filtered: bool = False) -> DataFrame:
    """query, item, score, rank: the k items of the greatest dot product (nine decimals); ties go to the smaller item.

    With filtered, both have an array of topics and only items that share one with the query count: the
    topics are joined, never all pairs.  Each task keeps its own best k (and ties) per query before
    anything is shuffled.  Vectors of another size than the query's do not count.
    """
    best = W.partitionBy("query").orderBy(F.desc("score"), "item")
    found = candidates(items, queries, k) if filtered else _search(items, queries, k, None)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def items_above(items: DataFrame, queries: DataFrame, least: float, scoped: bool = False) -> DataFrame:
    """query, item, score of all pairs (with scoped: of the same scope) whose dot product is at least that."""
    if not scoped:
        return _search(items, queries, None, least)
    body = lambda df, id, v: df.filter(f"{v} is not null and scope is not null").select(id, F.col("scope").alias("key"), F.struct(F.col(v).cast("array<double>").alias("vector")).alias("p"))
    return in_cells(body(items, "item", "vector"), body(queries, "query", "qv"), _best_of(None, least, 0.0), keyed=True)
