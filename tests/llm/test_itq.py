import numpy as np
import pytest

from mapweave.llm import blocks, itq


def brute(rows, least=0.95):
    """n_links and component of each row, by all pairs."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    u = [unit(v) for _, v in rows]
    link = np.array([[a is not None and b is not None and len(a) == len(b) and i != j and a @ b >= least for j, b in enumerate(u)] for i, a in enumerate(u)])
    comp = np.array([i for i, _ in rows])
    for _ in range(len(rows)):
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    return link.sum(axis=1), comp


def table(seed=0, n=250, d=32):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = r.normal(size=d) if not rows or r.random() < 0.5 else rows[r.integers(len(rows))][1] + r.normal(size=d) * r.choice([0, 0.03, 0.1, 0.2])
        rows.append((i, np.asarray(v, np.float32)))
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    odd = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] * d, [], [1.0] * 5, [2.0] * 5, [-0.0] * (d - 1) + [1.0], [0.0] * (d - 1) + [3.0], [1.0], [-2.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string")


@pytest.mark.parametrize("block", [1024, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)
    if block == 8:
        monkeypatch.setattr(itq, "CODE_BLOCK", 2)
        monkeypatch.setattr(blocks, "PART", 1)
    rows = table()
    got = {r.vec_id: r for r in itq.near_duplicate_vectors(frame(spark, rows)).collect()}
    links, comp = brute(rows)
    found = sum(got[i].n_links for i, _ in rows)
    assert len(got) == len(rows) and found >= 0.97 * links.sum()
    for (i, _), n, c in zip(rows, links, comp, strict=True):
        assert got[i].n_links <= n and got[i].component_id >= c and got[i].kept == (got[i].component_id == i)
    assert sum(got[i].component_id == c for (i, _), c in zip(rows, comp, strict=True)) >= 0.97 * len(rows)


def clusters(n, d=64, seed=3):
    """Vectors in groups round a centre, whose cosines lie on both sides of 0.95, and unrelated ones."""
    r = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = r.normal(size=d)
        spread = r.choice([0.05, 0.12, 0.15, 0.16, 0.2])
        out += [centre + r.normal(size=d) * spread for _ in range(r.choice([1, 1, 2, 5, 12]))]
    return [(i, [float(x) for x in v]) for i, v in enumerate(np.array(out[:n], np.float32))]


@pytest.mark.parametrize(("n", "as_if"), [(4_000, None), (20_000, None), (4_000, 300_000_000)])
def test_recall_of_links_near_the_limit(spark, monkeypatch, n, as_if):
    """Thousands of links at and above 0.95 against all pairs; also with the tables that hundreds of millions of vectors would have."""
    if as_if:
        shape = itq.Shape.of(as_if)
        assert shape.width > 16
        monkeypatch.setattr(itq.Shape, "of", staticmethod(lambda _: shape))
    rows = clusters(n)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    links = (cosine >= 0.95).sum(axis=1) - 1
    just = ((cosine >= 0.95) & (cosine < 0.96)).sum()
    got = {r.vec_id: r.n_links for r in itq.near_duplicate_vectors(frame(spark, rows)).collect()}
    assert links.sum() > n and just > 100
    assert all(got[i] <= k for (i, _), k in zip(rows, links, strict=True))
    assert sum(got.values()) >= 0.95 * links.sum()


def test_shape_grows_with_the_vectors():
    small, large = itq.Shape.of(50_000), itq.Shape.of(10**9)
    assert small == (5, 4, 16) and large.width == 22 and large.rotations * large.parts > 20


def test_empty_and_copies(spark):
    df = frame(spark, [(5, [1.0, 2.0]), (3, [1.0, 2.0]), (9, [1.0, 2.0])])
    assert itq.near_duplicate_vectors(df.limit(0)).count() == 0
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicate_vectors(df).collect()) == [(3, 2, 3, True), (5, 2, 3, False), (9, 2, 3, False)]
