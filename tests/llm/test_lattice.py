"""Lattice hashing against all cosines."""

import numpy as np
import pytest

from weftline.llm import lattice_dedup as lattice

from .cases import by_id

SCHEMA = "vec_id long, embedding array<float>, label int, node long, key string, home int"


def plain(rows, cosine=0.93):
    """vec_id, n_links, component_id, kept by comparing all pairs of rows."""
    good = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if g else None for r, g in zip(rows, good, strict=True)]
    low, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                low[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    out = [(r[0], n[i], c := least.get(find(i)), r[0] == c) for i, r in enumerate(rows)]
    return sorted(out, key=repr)


def made(seed=1, d=64):
    """Families around the threshold, chains, copies, and every odd vector."""
    r = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    add = lambda v, label: rows.append((len(rows) + 1, None if v is None else [float(np.float32(x)) for x in v], label))
    for f in range(30):
        base = unit(r.normal(size=d))
        for k in range(int(r.integers(1, 9))):
            add(unit(base + r.normal(size=d) * 0.03 * (k % 4)) * (1 + f % 3), f % 3)
    x, y = unit(r.normal(size=d)), unit(r.normal(size=d))
    for k in range(6):  # a chain whose ends are far apart
        a = 0.3 * k
        add(unit(np.cos(a) * x + np.sin(a) * y), 1)
    for label in (1, 1, 2, None):
        add(x * 2, label)
    for v in (None, [], [0.0] * d, [np.nan] * d, [np.inf] * d, [1.0, 2.0], [1.0, 2.1], [-1.0, -2.0]):
        add(v, 1)
    rows.append((1000, [1.0] * (d - 1) + [None], 1))
    rows.append((1001, [None] * d, 1))
    rows.append(rows[0])
    rows.append((None, *rows[0][1:]))
    rows.append((None, [float(z) for z in r.normal(size=d)], 2))
    return [(i, None if v is None else [None if z is None else float(np.float32(z)) for z in v], label) for i, v, label in rows]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, "k", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("split", [2048, 4])
def test_links_and_components(spark, monkeypatch, split):
    """The second time every cell of over four nodes is split into blocks, and none is small."""
    monkeypatch.setattr(lattice, "SPLIT", split)
    monkeypatch.setattr(lattice, "SMALL", 24 if split > 4 else 2)
    rows = made()
    out = lattice.near_duplicates(vectors(spark, rows).repartition(3))
    assert by_id(out, "vec_id", "n_links", "component_id", "kept") == plain(rows)


def test_nothing_and_doubles(spark):
    assert lattice.near_duplicates(vectors(spark, [])).count() == 0
    rows = made(2)
    wide = vectors(spark, rows).selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding", "CAST(label AS long) AS label")
    assert by_id(lattice.near_duplicates(wide), "vec_id", "n_links", "component_id", "kept") == plain(rows)


def test_nearest_point_is_the_nearest():
    """No neighbour of the point found is nearer, and minimal vectors are lattice points of norm two."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8)) * 2
    c = lattice.nearest_point(x)
    own = ((x - c) ** 2).sum(axis=1)
    others = ((x[:, None] - c[:, None] - lattice.MINIMAL[None]) ** 2).sum(axis=2)
    assert (own[:, None] <= others + 1e-9).all() and own.max() <= 1 + 1e-9
    assert lattice.MINIMAL.shape == (240, 8) and np.allclose((lattice.MINIMAL**2).sum(axis=1), 2)
    assert np.allclose(lattice.nearest_point(lattice.MINIMAL), lattice.MINIMAL)


def test_recall_at_the_threshold():
    """Pairs at cosine 0.93 exactly: nearly all meet in some cell; unrelated ones seldom do."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    salt = np.zeros(len(x), dtype=np.uint64)

    def meet(y):
        (hx, px), (hy, py) = lattice.cells(x, salt), lattice.cells(y, salt)
        near = lambda h, p: (h[:, :, None] == p.reshape(len(h), lattice.TABLES, lattice.PROBES)).any(axis=(1, 2))
        return (hx == hy).any(axis=1) | near(hx, py) | near(hy, px)

    assert meet(0.93 * x + np.sqrt(1 - 0.93**2) * z).mean() > 0.995
    assert meet(0.98 * x + np.sqrt(1 - 0.98**2) * z).mean() == 1
    assert meet(z).mean() < 0.01
    # of the sketches, none of the pairs at the threshold is lost, and hardly an unrelated one stays
    differ = lambda y: np.bitwise_count(lattice.sketches(x).view(np.uint64) ^ lattice.sketches(y).view(np.uint64)).sum(axis=1)
    most = lattice.most_differing_signs(0.93)
    assert (differ(0.93 * x + np.sqrt(1 - 0.93**2) * z) <= most).mean() > 0.999 and (differ(z) <= most).mean() < 0.001
