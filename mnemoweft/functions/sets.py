"""Arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """0 if both are empty; null counts as empty."""
    none = F.array().cast("array<string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def evidence_recall(evidence: Column, retrieved: Column) -> Column:
    """Share of the listed evidence that was retrieved, repeats counted; 1 without evidence."""
    got = F.size(F.filter(evidence, lambda e: F.array_contains(retrieved, e)))
    return F.when(F.size(F.coalesce(evidence, F.array().cast("array<string>"))) == 0, F.lit(1.0)).otherwise(got / F.size(evidence))
