import math
import random
from collections import defaultdict

import pytest

from mnemoweft.llm.fusion import fuse_ranks
from mnemoweft.runtime import with_positions

SCORES = ["a", "b"]


def data(seed):
    r = random.Random(seed)
    pick = lambda: r.choice([None, float("nan"), float("-inf"), 0.0, -0.0, 1.0, 2.5, 1e9, r.random()])
    rows = [(r.choice(["hot", "hot", "hot", "g1", "g2", None]), f"t{k}", pick(), pick(), "keep") for k in range(150)]
    return rows + rows[:5] + [("single", "t", None, None, None)]


def brute(rows, k0=60.0):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for r in rows:
        total, ranks = 0.0, []
        for c in (2, 3):
            key = lambda x: (x[c] is not None and not math.isnan(x[c]), x[c] if x[c] is not None and not math.isnan(x[c]) else 0)  # noqa: E731, B023
            ranks.append(1 + sum(key(o) > key(r) for o in groups[r[0]]))
            total += 1 / (ranks[-1] + k0)
        out.append((str(r[0]), r[1], r[4], *ranks, round(total, 12)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_brute_force_also_for_hot_groups(spark, bound):
    rows = data(1)
    df = spark.createDataFrame(rows, "g string, target string, a double, b double, note string")
    got = fuse_ranks(df, "g", SCORES, max_group_rows=bound)
    assert got.columns == ["g", "target", "a", "b", "note", "rank_a", "rank_b", "fused"]
    assert sorted([(str(r.g), r.target, r.note, r.rank_a, r.rank_b, round(r.fused, 12)) for r in got.collect()], key=str) == brute(rows)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "g string, a double, b double")
    assert fuse_ranks(df, "g", SCORES).count() == 0
    with pytest.raises(ValueError):
        fuse_ranks(df.selectExpr("*", "1 fused"), "g", SCORES)


def test_range_of_a_score_does_not_matter(spark):
    df = spark.createDataFrame([("g", "x", 0.001, 3.0), ("g", "y", 0.002, 1e12)], "g string, t string, a double, b double")
    assert fuse_ranks(df, "g", SCORES).orderBy("fused", ascending=False).first().t == "y"


def test_a_hot_null_group_keeps_its_rows(spark):
    rows = data(1)
    df = spark.createDataFrame(rows, "g string, target string, a double, b double, note string")
    bound = sum(r[0] is None for r in rows) - 1
    assert bound > 0
    got = fuse_ranks(df, "g", SCORES, max_group_rows=bound)
    assert sorted([(str(r.g), r.target, r.note, r.rank_a, r.rank_b, round(r.fused, 12)) for r in got.collect()], key=str) == brute(rows)


def test_positions_in_a_null_group(spark):
    rows = [(g, h, k) for g in ("x", None) for h in (1, None) for k in range(5)]
    got = with_positions(spark.createDataFrame(rows, "g string, h int, k int"), ["g", "h"], ["k"])
    assert got.columns == ["g", "h", "k", "pos"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*r, r[2]) for r in rows], key=str)
