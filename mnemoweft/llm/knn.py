"""Most similar vectors for every vector: shifted space-filling curves."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoweft.operators.components import connected_components, smallest_labels
from mnemoweft.runtime import cut, iter_groups, parallelism

ROWS = 2_000_000  # places on curves that a task passes, some 100 MB sorted
WANTED = 1_000_000  # 64-bit ids broadcast at most, some 16 MB
BLOCK = 4_096  # different vectors of a group that a task compares with as many others, 25 MB


@dataclass(frozen=True)
class Curves:
    """Parameters of the index; recall grows with curves and window."""

    curves: int = 16
    dims: int = 12
    bits: int = 5
    window: int = 64
    sketch_bits: int = 256
    seed: int = 29


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers (0 .. 2^bits - 1).

    Gray-code form: from the highest bit down, every coordinate either reflects the lower bits of the
    first or swaps them with it; then the coordinates are Gray-decoded and their bits interleaved.
    """
    x = [c.astype(np.uint32) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(len(x)):
            set_ = (x[i] >> np.uint32(b)) & np.uint32(1)
            swap = np.where(set_ == 1, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ swap ^ (set_ * low)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= ((x[-1] >> np.uint32(b)) & np.uint32(1)) * np.uint32((1 << b) - 1)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return key


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a list column (dim finite numbers, not all 0) and their unit vectors."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        biggest = np.abs(values).max(axis=1, initial=0.0)
        good = np.isfinite(biggest) & (biggest > 0)
        values = values[good] / biggest[good, None]
    return fit[good], values / np.linalg.norm(values, axis=1, keepdims=True)


def _directions(dim: int, p: Curves):
    rng = np.random.default_rng(p.seed)
    frames = [np.linalg.qr(rng.standard_normal((dim, min(dim, p.dims))))[0] * math.sqrt(dim) for _ in range(p.curves)]
    return frames, rng.random((p.curves, min(dim, p.dims))), rng.standard_normal((dim, p.sketch_bits)).astype(np.float32)


def _index(dim: int, p: Curves):
    """Rows of (collection, id, version, vid, same, vector) to the same with sketch and keys for the vector."""
    kept = ["collection", "id", "version", "vid", "same"]

    def run(batches):
        frames, shifts, planes = _directions(dim, p)
        frame = np.concatenate(frames, axis=1).astype(np.float32)
        d = frames[0].shape[1]
        for batch in batches:
            rows, v = unit_rows(batch.column(5), dim)
            v = v.astype(np.float32)
            sketch = np.packbits(v @ planes > 0, axis=1)
            spread = 1.0 / (1.0 + np.exp(-1.702 * (v @ frame)))  # near the normal distribution's share below
            keys = np.empty((len(v), p.curves), np.int64)
            for c in range(p.curves):
                cells = (spread[:, c * d : (c + 1) * d] + shifts[c]) * (0.5 * (1 << p.bits))
                keys[:, c] = hilbert_keys(np.minimum(cells.astype(np.uint32), (1 << p.bits) - 1), p.bits)
            width = p.sketch_bits // 8
            at = pa.array(np.arange(len(v) + 1, dtype=np.int32) * width)
            cols = [batch.column(k).take(pa.array(rows)) for k in range(5)]
            cols.append(pa.Array.from_buffers(pa.binary(), len(v), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(sketch))]))
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * p.curves), pa.array(keys.ravel())))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sketch", "keys"])

    return run


def _windows(p: Curves, most: int):
    """Links (collection, x, y) that tell which rows of a window hang together by sketches that differ in at most `most` bits."""
    words = p.sketch_bits // 64

    def pairs(line, vid, sk, fresh):
        """fresh: rows before that position have met each other already."""
        n, w = len(vid), p.window
        xs, ys = [], []
        for o in range(1, min(w, n - 1) + 1):
            s = max(0, fresh - o)
            h = np.bitwise_count(sk[0][s : n - o] ^ sk[0][s + o :]).astype(np.uint16)
            for q in range(1, words):
                h += np.bitwise_count(sk[q][s : n - o] ^ sk[q][s + o :])
            at = np.flatnonzero((h <= most) & (line[s : n - o] == line[s + o :]))
            if len(at):
                xs.append(at + s), ys.append(at + s + o)
        if not xs:
            return None
        label = smallest_labels(n, np.concatenate(xs), np.concatenate(ys))
        x = np.flatnonzero(label != np.arange(n))
        x = x[vid[x] != vid[label[x]]]
        y = label[x]
        return pa.RecordBatch.from_arrays([pa.array(line[x] // p.curves, pa.int32()), pa.array(vid[x]), pa.array(vid[y])], names=["collection", "x", "y"])

    def run(batches):
        line, vid, sk = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * words
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, words)
            fresh = len(vid)
            line = np.r_[line, batch.column(0).to_numpy().astype(np.int64)]
            vid = np.r_[vid, batch.column(1).to_numpy()]
            sk = [np.r_[a, raw[:, q]] for q, a in enumerate(sk)]
            got = pairs(line, vid, sk, fresh)
            if got is not None and got.num_rows:
                yield got
            line, vid, sk = line[-p.window :], vid[-p.window :], [a[-p.window :] for a in sk]

    return run


def _tops(u: np.ndarray, v: np.ndarray, most: int):
    """For each row of u, the `most` rows of v with the highest cosine and these; ties go to the first rows."""
    most = min(most, len(v))
    step = max(1, 2_000_000 // len(v))
    last = np.int64(len(v) - 1)
    for s in range(0, len(u), step):
        # twelve decimals, so that ties do not hang on the order of additions
        cos = np.rint(u[s : s + step] @ v.T * 1e12).astype(np.int64)
        key = (cos << 13) + (last - np.arange(len(v)))
        at = np.argpartition(-key, most - 1, axis=1)[:, :most]
        yield s, at, np.take_along_axis(cos, at, axis=1) / 1e12


def _exact(dim: int, k: int, min_cosine: float):
    """Cells of a group (collection, group, lo, hi, block, same, sketch, ids, vector) to each vector's best ids in the cell."""

    def run(batches):
        for t in iter_groups(batches, ["collection", "group", "lo", "hi"]):
            t = t.combine_chunks()
            t = t.take(np.argsort(np.array([i[0] for i in t["ids"].to_pylist()], object), kind="stable"))
            ids, block = t["ids"].to_pylist(), t["block"].to_numpy()
            v = t["vector"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            source, found, cosine = [], [], []
            for x, y in [(lo, hi)] if lo == hi else [(lo, hi), (hi, lo)]:
                rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
                if not len(rows) or not len(cols):
                    continue
                for s, at, cos in _tops(v[rows], v[cols], k + 1):
                    for r in range(len(at)):
                        best = sorted((-c, i) for c, j in zip(cos[r].tolist(), cols[at[r]].tolist()) if c >= min_cosine for i in ids[j])
                        for c, i in best[: k + 1]:
                            source.append(rows[s + r]), found.append(i), cosine.append(-c)
            of = t.select(["collection", "same", "sketch"]).take(pa.array(source, pa.int64()))
            out = of.append_column("neighbour", pa.array(found, pa.string())).append_column("cosine", pa.array(cosine, pa.float64()))
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    return run


def _grouped(current: DataFrame, fit: DataFrame, links: DataFrame, dim: int, k: int, min_cosine: float) -> DataFrame:
    """The k most similar of each vector within the groups that links (of classes of equal vectors) join.

    A group is compared with itself in full, whatever its size: beyond BLOCK different vectors by blocks,
    each pair of them in a task of its own.  Of equal vectors one is compared; as neighbours the
    k + 1 smallest ids are enough.
    """
    one = ["collection", "same", "sketch"]
    # `same` hashes the collection, too; if two hashes meet, two groups are one, which loses nothing
    groups = connected_components(links, "x", "y").select(F.col("node").alias("same"), F.col("component").alias("group"))
    several = current.groupBy(*one).agg(F.count("*").alias("n")).filter("n > 1").select("same").distinct()
    wanted = cut(several.join(groups, "same", "full_outer").select("same", F.coalesce("group", "same").alias("group")))
    few = wanted.count() <= WANTED
    members = cut(current.select(*one, "vid", "id", "version").join(F.broadcast(wanted) if few else wanted, "same"))
    first = members.withColumn("nth", F.row_number().over(W.partitionBy(*one).orderBy("id"))).filter(F.col("nth") <= k + 1)
    classes = first.groupBy(*one, "group").agg(F.min(F.struct("id", "vid", "version")).alias("r"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = cut(classes.select(*one, "group", "r.*", "ids"))
    heads = classes.select("collection", "vid", "id", "same", F.col("version").alias("last"))
    ids = classes.select("vid").distinct()
    # up to WANTED vectors are picked at the scan; beyond, the join moves all vectors once
    scan = fit.join(F.broadcast(ids), "vid", "left_semi") if few else fit
    vectors = (
        scan.join(heads, ["collection", "vid", "id", "same"])
        .filter(F.col("version").eqNullSafe(F.col("last")))
        .groupBy("collection", "vid", "id").agg(F.max("vector").alias("vector"))
    )
    blocks = classes.groupBy("collection", "group").agg(F.count("*").alias("n")).select("collection", "group", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks"))
    cells = (
        classes.join(vectors, ["collection", "vid", "id"]).join(blocks, ["collection", "group"])
        .withColumn("block", F.pmod(F.xxhash64("same", "sketch"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *one, "ids", "vector")
    )
    cell = ["collection", "group", "lo", "hi"]
    spread = cells.repartition(parallelism(current.sparkSession), *cell).sortWithinPartitions(*cell)
    lists = spread.mapInArrow(_exact(dim, k, min_cosine), "collection int, same long, sketch binary, neighbour string, cosine double")
    order = [F.desc("cosine"), "neighbour"]
    best = lists.withColumn("nth", F.row_number().over(W.partitionBy(*one).orderBy(*order))).filter(F.col("nth") <= k + 1)
    best = best.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour", "cosine"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["neighbour"] != F.col("id")), 1, k)
    rows = members.join(best, one).select("collection", "id", F.posexplode(others).alias("at", "b"))
    return rows.select("collection", "id", "b.neighbour", "b.cosine", (F.col("at") + 1).alias("rank"))


def nearest(
    collections: list[DataFrame],
    dim: int,
    k: int = 5,
    min_cosine: float = 0.9,
    params: Curves = Curves(),
) -> DataFrame:
    """collection, id, neighbour, cosine, rank: the k most similar vectors of each vector, of those at least that similar.

    Each collection has the columns id (string), version and vector; its number in the list is its name in the
    result.  A row counts if its version is the latest of its id and its vector has exactly dim finite
    numbers that are not all 0; of an id's rows that tie the greatest sketch counts, rows that are equal
    count once, null ids are dropped and further columns not read.  Norms do not matter.  Ties in cosine
    go to the smaller id.  A vector without neighbours, and an empty table, give no rows.

    Vectors that lie within `window` rows on one of the curves and whose sketches do not rule out
    min_cosine by more than four standard deviations hang together; all that hang together, by others too,
    are compared exactly, so a neighbour is missed only if no curve leads to it.  The work is quadratic in
    the different vectors of a group: a min_cosine that most pairs reach makes all of them one group.
    Cosines have twelve decimals.  Without any bound operators.search.nearest_items is the exact way.

    Method: each curve projects the unit vectors on random orthonormal directions, shifts them, and
    orders them by their place on a Hilbert curve; a range-partitioned sort per collection and
    curve puts neighbours into one window.  Only 64-bit ids and sketches of random sign bits travel with
    the curves; the vectors themselves are joined to the surviving pairs for exact cosines.  Equal vectors
    spread over partitions, as the sort ends with the id.
    """
    p = params
    spark = collections[0].sparkSession
    vectors = None
    for c, df in enumerate(collections):
        part = df.filter(F.col("id").isNotNull()).select(F.lit(c).alias("collection"), "id", "version", F.xxhash64("id").alias("vid"), F.xxhash64(F.lit(c), "vector").alias("same"), F.col("vector"))
        vectors = part if vectors is None else vectors.unionByName(part)
    fit = vectors.filter(F.size("vector") == dim)
    schema = vectors.select("collection", "id", "version", "vid", "same").schema.add("sketch", "binary").add("keys", T.ArrayType(T.LongType()))
    # ids without a usable vector take part too: their current row may be the unusable one
    versions = vectors.groupBy("collection", "vid", "id").agg(F.max("version").alias("version"))
    indexed = fit.mapInArrow(_index(dim, p), schema)
    latest = indexed.groupBy("collection", "vid", "id").agg(F.max(F.struct("version", "sketch", "same", "keys")).alias("r"))
    current = cut(
        latest.join(versions.withColumnRenamed("version", "last"), ["collection", "vid", "id"])
        .filter(F.col("r.version").eqNullSafe(F.col("last")))
        .select("collection", "vid", "id", "r.*")
    )
    # equal vectors take one place on the curves
    points = current.groupBy("collection", "same", "sketch").agg(F.first("keys").alias("keys"))
    lines = points.select("same", "sketch", F.col("collection"), F.posexplode("keys").alias("curve", "key")).select(
        (F.col("collection") * p.curves + F.col("curve")).cast("int").alias("line"), F.col("same").alias("vid"), "sketch", "key"
    )
    tasks = parallelism(spark, current.count() * p.curves, ROWS)
    ordered = lines.repartitionByRange(tasks, "line", "key", "vid").sortWithinPartitions("line", "key", "vid").drop("key")
    share = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    most = min(p.sketch_bits, math.ceil(p.sketch_bits * share + 4 * math.sqrt(p.sketch_bits * share * (1 - share))))
    links = cut(ordered.mapInArrow(_windows(p, most), "collection int, x long, y long").distinct())
    return _grouped(current, fit, links, dim, k, min_cosine)
