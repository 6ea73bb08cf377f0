import numpy as np
import pytest

from rankloom.llm import cap_filters as cf


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def clusters(seed, n=300, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[rng.integers(0, n, n)] + rng.standard_normal((n, dim)) * rng.uniform(0.01, 0.4, (n, 1))
    return np.concatenate([base, near, near[:20]]).astype(np.float32)


def brute(x, bound):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = y @ y.T >= bound
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return hit.sum(axis=1), label


@pytest.mark.parametrize("dim", [2, 32, 64])
def test_against_brute_force(spark, dim):
    x = clusters(dim, dim=dim)
    degree, label = brute(x, 0.95)
    rows = cf.near_duplicates(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).orderBy("vec_id").collect()
    found = np.array([r["n_links"] for r in rows])
    assert (found <= degree).all()  # none below the bound
    assert found.sum() >= 0.99 * degree.sum()
    assert np.mean([r["component_id"] == label[r["vec_id"]] for r in rows]) >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_recall_at_the_bound():
    """Pairs at a cosine of exactly 0.95 share a cap."""
    rng = np.random.default_rng(1)
    a = cf.unit_rows(rng.standard_normal((400, 64)))
    n = rng.standard_normal((400, 64))
    n = cf.unit_rows(n - (n * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * n
    filters = cf.CapFilters.for_rows(64, 50_000)
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(filters.decode(a), filters.decode(b), strict=True)]
    assert np.mean(shared) >= 0.97


def test_exceeding_is_complete():
    filters = cf.CapFilters.for_rows(8, 300)
    turn, words, parts = filters.tables()
    unit = cf.unit_rows(np.random.default_rng(2).standard_normal((20, 8)))
    moved = unit @ turn
    all_scores = sum(np.repeat(np.tile((moved[:, p] @ w.T), (1, filters.codes**i)), filters.codes ** (len(words) - 1 - i), axis=1) for i, (w, p) in enumerate(zip(words, parts, strict=True)))
    for got, row in zip(filters.exceeding(unit, 0.2), all_scores, strict=True):
        assert sorted(got.tolist()) == np.flatnonzero(row >= 0.2).tolist()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, -0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cf.near_duplicates(frame(spark, rows)).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i, True)
    assert got[None][0] == 0
    assert cf.near_duplicates(frame(spark, [])).count() == 0


def skewed(n, dim, seed):
    """Dense clusters of all sizes in few directions: links at every angle about the bound."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim)) * np.linspace(3, 0.1, dim)
    which = np.minimum(rng.zipf(1.3, n) - 1, 39)
    return (centres[which] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.15, 0.3], (n, 1)) * np.abs(centres[which]).mean(axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("block", [2048, 64])
def test_dense_clusters(spark, monkeypatch, block):
    """Caps of hundreds of rows, in one block and in many, with pairs counted and not listed."""
    monkeypatch.setattr(cf, "ROWS_OF_BLOCK", block)
    monkeypatch.setattr(cf, "LARGE", 50)
    x = np.concatenate([skewed(1200, 24, 3), skewed(1200, 24, 3)[:100]])
    degree, label = brute(x, 0.95)
    rows = cf.near_duplicates(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).orderBy("vec_id").collect()
    found = np.array([r["n_links"] for r in rows])
    assert (found <= degree).all() and found.sum() >= 0.98 * degree.sum()
    if block == 2048:
        assert degree.max() > 300
    assert np.mean([r["component_id"] == label[r["vec_id"]] for r in rows]) >= 0.98


def test_roots():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sure = rng.random((7, 9)) < 0.12
        a, b = cf.joined_roots(sure, False)
        for i, j in zip(*np.nonzero(sure), strict=True):
            assert a[i] == b[j]
        links = {(i, 7 + j) for i, j in zip(*np.nonzero(sure), strict=True)}
        label = list(range(16))
        for _ in range(16):
            for x, y in links:
                label[x] = label[y] = min(label[x], label[y])
        assert [*a, *b] == label


def test_recall_on_many_skewed_rows(spark):
    """100,000 vectors in clusters of all sizes; every hundredth against all."""
    rng = np.random.default_rng(8)
    n, dim = 100_000, 32
    centres = rng.standard_normal((20_000, dim)) * np.linspace(2, 0.3, dim)
    which = np.minimum(rng.zipf(1.5, n) * 13 - rng.integers(0, 13, n), 19_999)
    x = (centres[which] + rng.standard_normal((n, dim)) * rng.choice([0.1, 0.2, 0.35], (n, 1))).astype(np.float32)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}), "vec_id long, embedding array<float>").repartition(4)
    found = {r["vec_id"]: r["n_links"] for r in cf.near_duplicates(rows).where("vec_id % 100 = 0").collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y[::100] @ y.T >= 0.95).sum(axis=1) - 1
    got = np.array([found[i] for i in range(0, n, 100)])
    assert (got <= want).all() and want.max() > 1000
    assert got.sum() >= 0.97 * want.sum()
    some = want > 0
    assert np.mean(got[some] / want[some]) >= 0.95
