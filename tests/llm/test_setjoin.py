import itertools
import random

import pytest

from mnemoweft.llm.setjoin import merge_lists, similar_sets


def clean(xs):
    return frozenset(x.strip(" ").lower() for x in xs or [] if x is not None and x.strip(" "))


def brute(data, t, least=1):
    sets = sorted({(i, clean(xs)) for i, xs in data if i is not None and len(clean(xs)) >= least}, key=lambda p: (p[0], sorted(p[1])))
    out = set()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and len(a & b) >= t * len(a | b) - 1e-9:
            out.add((min(i, j), max(i, j), len(a & b)))
    return out


def sample(seed, n=90):
    r = random.Random(seed)
    common, rare = ["c1", "c2", "c3", "c4"], [f"w{k}" for k in range(60)]
    data = []
    for k in range(n):
        base = r.sample(common, r.randrange(1, 5)) + r.sample(rare, r.randrange(0, 9))
        data.append((f"t{k:03}", base))
        if r.random() < 0.5:
            data.append((f"u{k:03}", [w.upper() + " " for w in base if r.random() < 0.9] + r.sample(rare, r.randrange(2))))
    return data + [("nul", None), ("emp", []), ("bad", [None, "", " "]), (None, ["c1"]), ("t000", data[0][1]), ("dup", data[0][1] + data[0][1])]


@pytest.mark.parametrize(("seed", "t", "least", "rows"), [(1, 0.6, 4, 2000), (2, 0.8, 1, 5), (3, 0.3, 1, 2000), (3, 0.3, 1, 6), (6, 0.45, 1, 3), (4, 1.0, 2, 7)])
def test_brute_force(spark, seed, t, least, rows):
    data = sample(seed)
    df = spark.createDataFrame([(i, xs, "clash", 1) for i, xs in data], "id string, xs array<string>, token string, class_id int")
    got = [(r.id_a, r.id_b, r.overlap) for r in similar_sets(df, "id", "xs", t, least, group_rows=rows).expanded().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(data, t, least)


def test_two_tables(spark):
    a, b = sample(5, 40), [(f"o{i}", xs) for i, xs in sample(5, 40) if i]
    dfs = [spark.createDataFrame(d, "id string, xs array<string>") for d in (a, b)]
    res = similar_sets(dfs[0], "id", "xs", 0.7, other=dfs[1])
    m = {}
    for r in res.members.collect():
        m.setdefault(r.class_id, []).append((r.side, r.id))
    got = {(x[1], y[1]) if x[0] == 0 else (y[1], x[1]) for r in res.pairs.collect() for x in m[r.class_a] for y in m[r.class_b]}
    sa, sb = ({(i, clean(xs)) for i, xs in d if i is not None and clean(xs)} for d in (a, b))
    assert got == {(i, j) for i, x in sa for j, y in sb if len(x & y) >= 0.7 * len(x | y) - 1e-9}


def test_empty(spark):
    res = similar_sets(spark.createDataFrame([], "id string, xs array<string>"), "id", "xs")
    assert res.expanded().count() == res.members.count() == res.classes.count() == 0


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([(f"r{k}", ["a", "b", "c", "d"]) for k in range(300)], "id string, xs array<string>")
    res = similar_sets(df, "id", "xs")
    assert res.pairs.count() == 0 and res.classes.first().copies == 300 and res.members.count() == 300
    assert res.expanded().count() == 300 * 299 // 2


def test_merge_lists():
    r = random.Random(0)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randrange(1, 25))) for _ in range(r.randrange(1, 8))]
        need = r.randrange(1, len(lists) + 1)
        want = {v: n for v in range(30) if (n := sum(v in x for x in lists)) >= need}
        assert dict(merge_lists(lists, need)) == want


def test_a_token_of_a_third_of_all_records(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    data = [(f"a{k:05}", ["hot", "warm"] + r.sample(words, 3)) for k in range(3000)]
    data += [(f"b{k:05}", data[k][1][:4] + r.sample(words, 1)) for k in range(0, 3000, 10)]
    df = spark.createDataFrame(data, "id string, xs array<string>")
    got = {(x.id_a, x.id_b, x.overlap) for x in similar_sets(df, "id", "xs", 0.6, group_rows=100).expanded().collect()}
    one = {(x.id_a, x.id_b, x.overlap) for x in similar_sets(df, "id", "xs", 0.6, group_rows=10**6).expanded().collect()}
    assert got == one and len(got) >= 300
