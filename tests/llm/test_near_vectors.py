"""Near vectors against all pairs, and the recall of the tables."""

import numpy as np
import pytest

from lexmill.llm import near_vectors as nv

KIND = "vec_id long, embedding array<float>, label int, node long, v string"


def table(spark, vectors, ids=None, kind=KIND):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 5, "x") for i, v in zip(ids, vectors, strict=True)], kind)


def slow(ids, vectors, cosine=0.9, single=True):
    """n_links and component of every row, all pairs compared."""
    kind = np.float32 if single else np.float64
    wide = max([len(v) for v in vectors if v] + [1])
    use = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(np.array(v, kind)).all() and np.array(v, kind).any() and ids[i] is not None]
    full = np.array([list(vectors[i]) + [0] * (wide - len(vectors[i])) for i in use], kind).astype(float).reshape(len(use), wide)
    full /= np.abs(full).max(1, keepdims=True) if len(use) else 1
    full /= np.linalg.norm(full, axis=1)[:, None] if len(use) else 1
    hit = full @ full.T >= cosine
    np.fill_diagonal(hit, False)
    label = np.array([ids[i] for i in use])
    while True:
        low = np.array([min([label[k], *label[hit[k]]]) for k in range(len(use))])
        if (low == label).all():
            break
        label = low
    out = {i: (ids[i], 0, ids[i], ids[i] is not None) for i in range(len(ids))}
    out |= {i: (ids[i], int(hit[k].sum()), int(label[k]), ids[i] == label[k]) for k, i in enumerate(use)}
    return sorted(out.values(), key=repr)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def near(rng, v, cosine):
    away = rng.normal(size=len(v))
    away -= (away @ v) * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


@pytest.fixture(scope="module")
def clusters():
    """Chains, copies, a large group of near copies and vectors by themselves."""
    rng = np.random.default_rng(4)
    out = [rng.normal(size=16) for _ in range(300)]
    for _ in range(8):
        v = out[0]
        for _ in range(5):
            v = near(rng, v, 0.95)
            out.append(v)
    out += [near(rng, out[7], 0.995) for _ in range(150)] + [out[9] * 1.0] * 40 + [-out[11], out[11] * 3]
    return [np.asarray(v, np.float32).tolist() for v in out]


@pytest.mark.parametrize("slab", [1024, 7])
def test_all_found_equal_brute_force(spark, clusters, slab):
    assert got(nv.near_vectors(table(spark, clusters), slab=slab, found=1.0)) == slow(list(range(len(clusters))), clusters)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    base = nv.units(rng.normal(size=(4000, 64)) + 0.5)
    tables = nv.learn_tables(base[:2000], 50_000)
    assert tables.bits >= 10
    for cosine, least in ((0.9001, 0.95), (0.95, 0.98), (0.98, 0.995)):
        for other in nv.partners(base[2000:], cosine, seed=9):
            assert (tables.keys(base[2000:]) == tables.keys(other)).any(1).mean() >= least


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, nan], [inf, 1.0], [1.0, 0.0], [1.0], [-0.0, 1.0], [0.0, 1.0], [1.0, 0.4], [1.0, 0.0], [1.0, 0.0]]
    ids = [0, 1, 2, 3, 4, 5, 16, 15, 14, 13, 12, None, 16]
    assert got(nv.near_vectors(table(spark, vectors, ids))) == slow(ids, vectors)
    assert got(nv.near_vectors(table(spark, []))) == []
    assert got(nv.near_vectors(table(spark, [None, [0.0]], [None, 3]))) == [(3, 0, 3, True), (None, 0, None, False)]


def test_doubles_of_any_size(spark):
    vectors = [[1e300, 1e300], [1e-300, 1.1e-300], [1.0, -1.0], [2e-320, -2e-320]]
    df = table(spark, vectors, kind=KIND.replace("float", "double"))
    assert got(nv.near_vectors(df)) == slow([0, 1, 2, 3], vectors, single=False)


def test_stars_join_what_is_linked():
    hit = np.zeros((6, 6), bool)
    for a, b in ((0, 2), (2, 5), (1, 4)):
        hit[a, b] = hit[b, a] = True
    assert [(r, sorted(x.tolist())) for r, x in nv.stars(hit)] == [(0, [2, 5]), (1, [4])]
