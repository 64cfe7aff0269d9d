import numpy as np
import pytest

from mnemoweft.llm.knn import hilbert_keys, nearest


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def planted(n, dim, seed):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim))
    for k in range(0, n // 3, 3):
        v[k + 1] = v[k] + r.standard_normal(dim) * 0.3
        v[k + 2] = v[k] * 2 + r.standard_normal(dim) * 0.2
    return v


def test_recall_against_brute_force(spark):
    v = planted(3000, 96, 1)
    df = spark.createDataFrame([(f"v{k:04}", 1, x.tolist(), "clash") for k, x in enumerate(v)], "id string, version int, vector array<double>, keys string")
    got = {(r.id, r.neighbour): r.cosine for r in nearest([df], 96, k=5, min_cosine=0.9).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -1)
    want = {(f"v{a:04}", f"v{b:04}") for a, b in zip(*np.nonzero(g >= 0.9))}
    assert set(got) <= want
    assert len(set(got) & want) >= 0.97 * len(want)
    for (a, b), c in got.items():
        assert c == pytest.approx(g[int(a[1:]), int(b[1:])], abs=1e-6)


def test_dirty_vectors_and_versions(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    data = [
        ("a", 1, e), ("b", 1, [2.0, 0.0, 0.0, 0.01]), ("b", 1, [2.0, 0.0, 0.0, 0.01]),
        ("c", 1, e), ("c", 2, [0.0, 1.0, 0.0, 0.0]), ("d", 1, e), ("d", 2, None),
        ("n", 1, None), ("z", 1, [0.0] * 4), ("s", 1, [1.0]), ("l", 1, e + [0.0]), ("x", 1, []),
        ("q", 1, [float("nan"), 1.0, 0.0, 0.0]), ("i", 1, [float("inf"), 1.0, 0.0, 0.0]), ("u", 1, [None, 1.0, 0.0, 0.0]), (None, 1, e),
        ("t", None, [3e30, 0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(data, "id string, version int, vector array<double>")
    got = {(r.id, r.neighbour) for r in nearest([df, df.limit(0)], 4, min_cosine=0.9).collect()}
    assert got == {(x, y) for x in "abt" for y in "abt" if x != y}


def test_many_equal_vectors(spark):
    df = spark.range(2000).selectExpr("concat('k', id) id", "1 version", "array(1.0, 2.0, 3.0, 4.0) vector")
    rows = nearest([df], 4, k=3, min_cosine=0.9).collect()
    assert len({r.id for r in rows}) == 2000 and all(r.cosine > 0.999999 for r in rows)


def test_dense_clusters_lose_nothing(spark, monkeypatch):
    r = np.random.default_rng(5)
    parts = [r.standard_normal((800, 64))]
    for size in (20, 64, 500):
        parts.append(r.standard_normal(64) + r.standard_normal((size, 64)) * 0.28)
    v = np.concatenate(parts)
    df = spark.createDataFrame([(f"v{k:04}", 1, x.tolist()) for k, x in enumerate(v)], "id string, version int, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    want = {(f"v{a:04}", f"v{b:04}") for a in range(len(v)) for b in np.argsort(-g[a])[:5] if g[a, b] >= 0.9}
    assert len(want) > 2500
    for block in (4096, 200):  # 200: the largest group is compared in several cells
        monkeypatch.setattr("mnemoweft.llm.knn.BLOCK", block)
        got = {(r.id, r.neighbour) for r in nearest([df], 64, k=5, min_cosine=0.9).collect()}
        assert len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def test_equal_vectors_take_the_smallest_ids(spark):
    df = spark.range(500).selectExpr("concat('k', lpad(id, 3, '0')) id", "1 version", "array(1.0, 2.0, 3.0, 4.0 + id div 498) vector")
    got = {}
    for r in nearest([df], 4, k=3, min_cosine=0.9).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert sorted(got["k400"]) == [(1, "k000"), (2, "k001"), (3, "k002")]
    assert sorted(got["k001"]) == [(1, "k000"), (2, "k002"), (3, "k003")]
    assert sorted(got["k498"]) == [(1, "k499"), (2, "k000"), (3, "k001")]
