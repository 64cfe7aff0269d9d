"""Vectors as arrays of numbers.  A null or empty vector gives a null similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    # bound by an outer lambda, else the length would be computed again for each number
    lengths = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.element_at(F.transform(lengths, lambda n: F.transform(as_double(v), lambda x: x / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    """Of any two vectors; 0 if one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(n == 0, F.lit(0.0))


def _sums(batches):
    """Rows of keys and a vector last to keys, the sum of their vectors and how many, per batch and length."""
    for batch in batches:
        names = batch.schema.names
        v = batch.column(len(names) - 1)
        lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        keys = [batch.column(k).dictionary_encode() for k in range(len(names) - 1)]
        codes = np.stack([lengths, *[k.indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]], axis=1).astype(np.int64)
        for dim in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == dim)
            x = v.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            _, first, group = np.unique(codes[rows], axis=0, return_index=True, return_inverse=True)
            order = np.argsort(group.ravel(), kind="stable")
            starts = np.searchsorted(group.ravel()[order], np.arange(len(first)))
            fits = ~np.isnan(x)
            total, n = (np.add.reduceat(y[order], starts, axis=0) for y in (np.where(fits, x, 0.0), fits.astype(np.int64)))
            at = pa.array(rows[first])
            ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * dim)
            lists = [pa.ListArray.from_arrays(ends, pa.array(y.ravel())) for y in (total, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(names) - 1)], *lists], names=[*names[:-1], "__s", "__n"])


def mean_vector(df, keys: list[str], vector: str, name: str):
    """Normalised mean vector per key; null numbers and vectors do not count.

    Whole vectors are summed per batch, so only these sums are taken apart and shuffled.
    """
    schema = df.select(*keys).schema.add("__s", T.ArrayType(T.DoubleType())).add("__n", T.ArrayType(T.LongType()))
    sums = df.select(*keys, as_double(F.col(vector)).alias("__v")).mapInArrow(_sums, schema)
    parts = sums.select(*keys, F.posexplode(F.arrays_zip("__s", "__n")).alias("i", "x")).groupBy(*keys, "i").agg((F.sum("x.__s") / F.nullif(F.sum("x.__n"), F.lit(0))).alias("x"))
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
    return listed.select(*keys, normalise(F.col("l")["x"]).alias(name))
