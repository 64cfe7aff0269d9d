"""All similar pairs between set-valued records: T-occurrence merging of partitioned inverted lists."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoweft.runtime import bounded, cut, iter_groups, parallelism, split_join, with_dense_codes

EPS = 1e-9


def clean_set(c: Column) -> Column:
    """Trimmed, lower-cased, without null, empty and repeated values, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))


def merge_lists(lists: list[list[int]], need: int):
    """(value, lists that hold it) of the values in at least `need` sorted lists.

    The longest lists, at most need - 1, are left aside and only looked up by binary search.  The
    others are merged by a heap; whatever cannot reach the count any more is skipped.
    """
    lists = sorted(lists, key=len)
    aside = min(max(0, need - 1), int(need / (0.02 * math.log2(len(lists[-1]) + 2) + 1)), len(lists) - 1) if lists else 0
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = need - aside
    heap = [(v[0], k, 0) for k, v in enumerate(short) if v]
    heapq.heapify(heap)
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if (n := len(popped)) >= least:
            for v in long:
                i = bisect_left(v, value)
                n += i < len(v) and v[i] == value
            if n >= need:
                yield value, n
            for _, k, i in popped:
                if i + 1 < len(short[k]):
                    heapq.heappush(heap, (short[k][i + 1], k, i + 1))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            return
        goal = heap[0][0]
        for _, k, i in popped:
            j = bisect_left(short[k], goal, i)
            if j < len(short[k]):
                heapq.heappush(heap, (short[k][j], k, j))


def _join_group(token: int, second: int, rids, sides, blocks, sets, threshold: float, two: bool, crossing: bool, lone: bool):
    """Pairs whose rarest common token is `token` (and the next `second`, if not -1): (rid, rid, overlap).

    With lone only pairs that have no other token in common.
    """
    order = sorted(range(len(rids)), key=lambda k: (len(sets[k]), rids[k]))
    lists: dict[int, list[int]] = defaultdict(list)
    tails, firsts, sizes = [], [], []
    known = 1 if second < 0 else 2
    for at, k in enumerate(order):
        s = sets[k]
        here = bisect_left(s, token if second < 0 else second)
        tail, size = s[here + 1 :], len(s)
        head = s[:here] if second < 0 else [t for t in s[:here] if t != token]
        least = math.ceil(threshold * size - EPS)  # of any partner's size, and of the common tokens
        start = bisect_left(sizes, least)
        need = least - known
        if need <= 0:
            found = ((p, None) for p in range(start, at))
        else:
            cut_lists = []
            for t in tail:
                v = lists.get(t)
                if v and (i := bisect_left(v, start)) < len(v):
                    cut_lists.append(v[i:] if i else v)
            found = merge_lists(cut_lists, need) if len(cut_lists) >= need else ()
        before = set(head)
        for p, n in found:
            o = order[p]
            if two and sides[o] == sides[k] or crossing and blocks[o] == blocks[k]:
                continue
            if n is None:
                n = len(set(tail) & set(tails[p]))
            overlap = n + known
            if overlap * (1 + threshold) < threshold * (size + sizes[p]) - EPS or not before.isdisjoint(firsts[p]):
                continue
            if lone and overlap > 1:  # pairs with more in common meet at their second token
                continue
            yield rids[k], rids[o], overlap
        for t in tail:
            lists[t].append(at)
        tails.append(tail)
        firsts.append(head)
        sizes.append(size)


def _join(threshold: float, two: bool):
    names = ["x", "y", "overlap"]

    def run(batches):
        held: list[tuple[int, int, int]] = []

        def out():
            cols = [pa.array([h[k] for h in held], pa.int64()) for k in range(3)]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for g in iter_groups(batches, ["token", "second", "i", "j"]):
            if g.num_rows < 2:
                continue
            g = g.combine_chunks()
            col = {c: g[c].to_pylist() for c in ("rid", "side", "block", "codes")}
            token, second, i, j, lone = (g[c][0].as_py() for c in ("token", "second", "i", "j", "lone"))
            for pair in _join_group(token, second, col["rid"], col["side"], col["block"], col["codes"], threshold, two, i != j, lone):
                held.append(pair)
                if len(held) >= 50_000:
                    yield out()
        yield out()

    return run


@dataclass(frozen=True)
class SimilarSets:
    """classes(class_id, side, size, copies), members(class_id, side, id) and pairs of different sets."""

    classes: DataFrame
    members: DataFrame
    pairs: DataFrame

    def expanded(self, part: int = 2_000) -> DataFrame:
        """id_a < id_b, overlap, jaccard of all pairs, those of equal sets too.

        A class of many records is dealt to parts of that many and paired part by part.
        """
        m = self.members
        a = m.select(F.col("class_id").alias("class_a"), F.col("id").alias("a"))
        b = m.select(F.col("class_id").alias("class_b"), F.col("id").alias("b"))
        apart = self.pairs.join(a, "class_a").join(b, "class_b").select("a", "b", "overlap", "jaccard")
        several = self.classes.filter("copies > 1").select("class_id", F.col("size").cast("long").alias("overlap"), F.ceil(F.col("copies") / part).cast("int").alias("parts"))
        mates = m.join(several, "class_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        first = mates.select("class_id", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"), F.col("id").alias("a"), "overlap")
        same = first.join(mates.select("class_id", F.col("own").alias("to"), F.col("id").alias("b")), ["class_id", "to"])
        both = apart.unionByName(same.filter("a < b").select("a", "b", "overlap", F.lit(1.0).alias("jaccard")))
        return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "overlap", "jaccard").filter("id_a < id_b")


def similar_sets(
    records: DataFrame,
    id: str,
    values: str,
    threshold: float = 0.6,
    min_size: int = 1,
    other: DataFrame | None = None,
    group_rows: int = 2_000,
) -> SimilarSets:
    """Pairs of records whose sets have a Jaccard similarity of at least threshold.

    Values are trimmed and lower-cased; null, empty and repeated ones do not count.  Records of fewer
    than min_size values, of none, or with a null id take no part; records with a repeated id take part
    once per different set; further columns are not read; empty tables give empty results.  With `other`
    (same two columns) only pairs of one record of either table count; a class then holds equal sets of
    one table (side 0 or 1).

    Equal sets form a class and join once.  pairs has class_a, class_b, overlap, jaccard, each pair once;
    expanded() lists all pairs of ids.

    Method: tokens are numbered from rare to common; a record goes to the inverted lists of the
    tokens in its prefix (similar sets share one), where T-occurrence merging finds the records that
    share enough tokens; a pair counts in the group of its rarest common token.  A token of more than
    group_rows records is divided by the next token that a pair must share, too, and pairs that share no
    other are joined apart; what still is larger is split into blocks and joined by pairs of blocks.
    Tokens that stand in one prefix only are dropped, as no pair needs them.
    """
    spark = records.sparkSession
    two = other is not None
    tables = [t.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.lit(k).alias("side"), clean_set(F.col(values)).alias("tokens")) for k, t in enumerate([records, *([other] if two else [])])]
    rows = tables[0].unionByName(tables[1]) if two else tables[0]
    rows = rows.filter(F.size("tokens") >= max(1, min_size)).distinct()
    sized = rows.groupBy("side", "tokens").agg(F.count("*").alias("copies"))
    classes = cut(sized.withColumn("size", F.size("tokens"))).withColumn("class_id", F.monotonically_increasing_id())
    members = rows.join(classes.select("side", "tokens", "class_id"), ["side", "tokens"]).select("class_id", "side", "id")
    flat = classes.select("class_id", F.explode("tokens").alias("token"))
    counted = flat.groupBy("token").agg(F.count("*").alias("df"))
    codes = with_dense_codes(counted, ["df", "token"])
    total = codes.agg(F.sum("df")).first()[0] or 0
    sets = cut(
        split_join(flat, codes, "token", "df", total)
        .groupBy("class_id")
        .agg(F.array_sort(F.collect_list("code")).alias("codes"))
        .join(classes.select("class_id", "side"), "class_id")
        .select(F.col("class_id").alias("rid"), "side", "codes")
    )
    required = F.ceil(F.size("codes") * threshold - EPS).cast("int")
    length = F.size("codes") - required + 1
    placed = sets.select("rid", "side", "codes", required.alias("required"), F.posexplode(F.slice("codes", F.lit(1), length)).alias("at", "token"))
    crowd = cut(placed.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    weight = crowd.agg(F.sum("n")).first()[0] or 0
    met = split_join(placed, crowd, "token", "n", weight)
    none = F.lit(-1).cast("long")
    fields = ["token", "second", "lone", "rid", "side", "codes"]
    few = met.filter(F.col("n") <= group_rows).select("token", none.alias("second"), F.lit(False).alias("lone"), "rid", "side", "codes")
    many = met.filter(F.col("n") > group_rows)
    # the next tokens, one further than the prefix: sets with two tokens in common share two there
    after = F.slice("codes", F.col("at") + 2, F.greatest(F.size("codes") - F.col("required") + 1 - F.col("at"), F.lit(0)))
    pairs_of = many.select("token", F.explode(after).alias("second"), F.lit(False).alias("lone"), "rid", "side", "codes")
    lone = many.filter("required = 1").select("token", none.alias("second"), F.lit(True).alias("lone"), "rid", "side", "codes")
    crowded = cut(pairs_of.unionByName(lone).groupBy("token", "second").agg(F.count("*").alias("n")).filter("n > 1"))
    crowded = crowded.withColumn("blocks", F.ceil(F.col("n") / group_rows).cast("int")).drop("n")
    split = pairs_of.unionByName(lone).join(bounded(crowded, 100_000), ["token", "second"])
    grouped = (
        few.withColumn("blocks", F.lit(1)).unionByName(split.select(*fields, "blocks"))
        .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", "second", "lone", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "rid", "side", "block", "codes")
    )
    found = (
        grouped.repartition(parallelism(spark, weight), "token", "second", "i", "j")
        .sortWithinPartitions("token", "second", "i", "j")
        .mapInArrow(_join(threshold, two), "x long, y long, overlap long")
    )
    size = classes.select("class_id", "size")
    pairs = (
        found.join(size.select(F.col("class_id").alias("x"), F.col("size").alias("sx")), "x")
        .join(size.select(F.col("class_id").alias("y"), F.col("size").alias("sy")), "y")
        .select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "overlap", (F.col("overlap") / (F.col("sx") + F.col("sy") - F.col("overlap"))).alias("jaccard"))
    )
    return SimilarSets(classes, members, pairs)
