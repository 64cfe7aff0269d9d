"""Segmentation of ordered turns and chunking of texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS, Settings
from mnemoweft.functions.text import has_transition
from mnemoweft.functions.tokens import load_encoding, pieces
from mnemoweft.functions.vector import dot


def boundaries(turns: DataFrame, session: list[str], order: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds pos (from 0), similarity to the turn before, and boundary.

    A boundary stands before a turn whose similarity is low, or below a higher threshold if the turn
    holds a transition phrase; never before the first.  turns has content and a vector; similarities are
    compared at nine decimals; a turn without words is similar to nothing.
    """
    w = W.partitionBy(*session).orderBy(order)
    before = F.lag("vector").over(w)
    placed = turns.withColumn("pos", F.row_number().over(w) - 1).withColumn("__before", before)
    sim = F.when(F.col("__before").isNotNull(), F.round(F.coalesce(dot(F.col("vector"), F.col("__before")), F.lit(0.0)), 9))
    s = F.col("similarity")
    turn = has_transition(F.col("content")) & (s < settings.boundary_similarity + settings.transition_margin)
    return placed.withColumn("similarity", sim).drop("__before").withColumn("boundary", F.coalesce((s < settings.boundary_similarity) | turn, F.lit(False)))


def kept_boundaries(marks: Column, n: Column, least: int = DEFAULTS.min_segment_turns) -> Column:
    """Ascending boundaries that leave segments of at least `least` turns, chosen greedily.

    One is kept if it is that far from the one kept before (from 0 at first); in the end the last is
    dropped once if what follows is too short.
    """
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(s, b):
        take = F.struct(b.alias("last"), F.concat(s["kept"], F.array(b)).alias("kept"))
        return F.when(b - s["last"] >= least, take).otherwise(s)

    kept = F.aggregate(marks, start, step)["kept"]
    size = F.size(kept)
    short = (size > 0) & (n - F.get(kept, size - 1) < least)
    return F.when(short, F.slice(kept, 1, F.greatest(size - 1, F.lit(0)))).otherwise(kept)


def segments(marked: DataFrame, session: list[str], least: int = DEFAULTS.min_segment_turns) -> DataFrame:
    """session, segment, start_pos, end_pos (inclusive) of rows with pos and boundary."""
    per = marked.groupBy(*session).agg(
        F.array_sort(F.collect_list(F.when(F.col("boundary"), F.col("pos")))).alias("__b"), F.count("*").cast("int").alias("__n")
    )
    kept = per.select(*session, "__n", kept_boundaries(F.col("__b"), F.col("__n"), least).alias("__k"))
    edges = F.concat(F.array(F.lit(0)), F.col("__k"), F.array(F.col("__n")))
    cut = kept.select(*session, edges.alias("__e"), F.posexplode(F.slice(edges, 1, F.size(edges) - 1)).alias("segment", "start_pos"))
    return cut.select(*session, "segment", "start_pos", (F.get("__e", F.col("segment") + 1) - 1).alias("end_pos"))


def fixed_windows(turns: DataFrame, session: list[str], order: str, size: int = 5) -> DataFrame:
    """session, segment, start_pos, end_pos of runs of `size` turns that do not overlap."""
    w = W.partitionBy(*session).orderBy(order)
    placed = turns.select(*session, (F.row_number().over(w) - 1).alias("pos")).withColumn("segment", F.floor(F.col("pos") / size).cast("int"))
    return placed.groupBy(*session, "segment").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"))


def chunks(documents: DataFrame, id: str, text: str, size: int = 500) -> DataFrame:
    """id, chunk, text of runs of `size` words; -1 keeps each document whole; without words there is no chunk."""
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    if size < 0:
        return documents.select(id, F.lit(0).alias("chunk"), F.array_join(tokens, " ").alias("text")).filter("text <> ''")
    rows = documents.select(id, tokens.alias("__t")).filter(F.size("__t") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("__t") - 1) / size).cast("int"))
    return rows.select(id, "__t", F.explode(starts).alias("chunk")).select(id, "chunk", F.array_join(F.slice("__t", F.col("chunk") * size + 1, size), " ").alias("text"))


def token_chunks(documents: DataFrame, id: str, text: str, vocabulary: str, size: int = 500) -> DataFrame:
    """id, chunk, text of runs of `size` tokens of a public byte-level vocabulary (the path of its rank file).

    -1 keeps each document whole; null and empty texts have no chunk.  A character that two chunks share
    the bytes of is shown as the replacement character in both.
    """
    kind = dict(documents.dtypes)[id]

    def run(batches):
        encoding = load_encoding(vocabulary)
        for batch in batches:
            rows, numbers, texts = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                tokens = [x for p in pieces(t) for x in encoding.encode_ordinary(p)]
                step = len(tokens) if size < 0 else size
                for c, s in enumerate(range(0, len(tokens), step)):
                    rows.append(k)
                    numbers.append(c)
                    texts.append(encoding.decode_bytes(tokens[s : s + step]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["id", "chunk", "text"])

    return documents.select(F.col(id), F.col(text)).mapInArrow(run, f"id {kind}, chunk int, text string").select(F.col("id").alias(id), "chunk", "text")
