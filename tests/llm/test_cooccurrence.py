import itertools
import math
import random
from collections import Counter

import pytest

from mnemoweft.llm.cooccurrence import cooccurrence

SCHEMA = "id string, xs array<string>, item_a int, pair string, r int"


def brute(data, least=1):
    baskets = [set(x for x in xs or [] if x is not None) for i, xs in data if i is not None]
    one = Counter(x for b in baskets for x in b)
    two = Counter(p for b in baskets for p in itertools.combinations(sorted(b), 2))
    return {(a, b): (n, one[a], one[b], len(baskets)) for (a, b), n in two.items() if n >= least}


def run(spark, data, **kw):
    df = spark.createDataFrame([(i, xs, k, "x", None) for k, (i, xs) in enumerate(data)], SCHEMA)
    return {(r.item_a, r.item_b): r for r in cooccurrence(df, "id", "xs", **kw).collect()}


@pytest.mark.parametrize(("least", "block"), [(1, 512), (3, 512), (1, 3)])
def test_brute_force(spark, least, block):
    r = random.Random(least)
    items = [f"i{k}" for k in range(25)] + ["hot"]
    data = [(f"m{k}", ["hot"] * r.randrange(3) + r.choices(items, k=r.randrange(9))) for k in range(120)]
    data += [("n", None), ("e", []), ("x", [None, "i1", "i1"]), (None, ["i1", "i2"]), ("big", items * 2)]
    got, want = run(spark, data, min_count=least, block=block), brute(data, least)
    assert {k: (r.n_ab, r.n_a, r.n_b, r.n) for k, r in got.items()} == want
    for (n_ab, n_a, n_b, n), row in ((want[k], got[k]) for k in want):
        assert row.npmi == pytest.approx(math.log(n_ab * n / (n_a * n_b)) / -math.log(n_ab / n))
        odds = (n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))
        assert row.odds_ratio == pytest.approx(odds) and row.log_odds == pytest.approx(math.log(odds))


def test_every_record_and_none(spark):
    got = run(spark, [("a", ["x", "y"]), ("b", ["y", "x"])])
    assert got["x", "y"].npmi == 0 and got["x", "y"].lift == 1
    assert run(spark, []) == {} == run(spark, [("a", None), (None, ["x", "y"])])


def test_npmi_is_one_for_items_that_only_meet(spark):
    assert run(spark, [("a", ["x", "y"]), ("b", ["z"])])["x", "y"].npmi == pytest.approx(1)


def test_one_large_basket_is_dealt_to_blocks(spark):
    data = [("big", [f"i{k:04}" for k in range(1500)])] + [(f"m{k}", ["i0000", "i0001"]) for k in range(5)]
    df = spark.createDataFrame(data, "id string, xs array<string>")
    got = cooccurrence(df, "id", "xs", block=100)
    assert got.count() == 1500 * 1499 // 2
    assert [r.n_ab for r in got.filter("item_a = 'i0000' and item_b = 'i0001'").collect()] == [6]
