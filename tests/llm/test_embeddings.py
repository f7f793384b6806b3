import numpy as np
import pytest

from ticketflow.llm import embedding_dedup as E


def brute(ids, x, threshold=0.9):
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = (u @ u.T >= threshold) & ~np.eye(len(u), dtype=bool)
    label = np.array(ids)
    while True:
        low = np.array([min([label[i], *label[near[i]]]) for i in range(len(label))])
        if (low == label).all():
            return near.sum(axis=1), label
        label = low


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([centres[rng.integers(0, 60, 900)] + 0.22 * rng.standard_normal((900, 32)), np.repeat(centres[:1], 40, axis=0), rng.standard_normal((200, 32))])
    return list(range(len(x))), x.astype(np.float32).astype(float)


@pytest.mark.parametrize("block", [16, 1024])
def test_recall_and_precision(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    ids, x = clustered
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    links, _ = brute(ids, x)
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    n = np.array([got[i].n_links for i in ids])
    assert (n <= links).all() and n.sum() >= 0.97 * links.sum() > 1000
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert [got[i].component_id for i in ids] == brute(ids, x)[1].tolist()


def test_recall_on_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    near = np.array([r.embedding for r in rows], float)
    near = np.concatenate([near, near + 0.03 * np.random.default_rng(4).standard_normal(near.shape)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<double>")
    links, _ = brute(list(range(len(near))), near)
    n = np.array([r.n_links for r in E.near_duplicates(df).orderBy("vec_id").collect()])
    assert (n <= links).all() and n.sum() >= 0.95 * links.sum() >= len(rows)


def test_lengths_that_squares_cannot_hold(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1.0]), (3, [3.0, 0.0]), (4, [1e-200, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1.7e308]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def pairs_off_centre(rng, share, n, dim=64, threshold=0.9):
    """n pairs of unit vectors at the threshold about a common mean of the given squared norm."""
    mean = np.zeros(dim)
    mean[0] = np.sqrt(share)
    u, z = (np.pad(rng.standard_normal((n, dim - 1)), ((0, 0), (1, 0))) for _ in range(2))
    u /= np.linalg.norm(u, axis=1)[:, None]
    z -= (z * u).sum(axis=1)[:, None] * u
    z /= np.linalg.norm(z, axis=1)[:, None]
    turn = (threshold - share) / (1 - share)
    return mean + np.sqrt(1 - share) * u, mean + np.sqrt(1 - share) * (turn * u + np.sqrt(1 - turn**2) * z)


@pytest.mark.parametrize("rows", [10_000, 3_000_000])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.7])
def test_cells_of_vectors_with_a_common_mean(share, rows):
    rng = np.random.default_rng(7)
    x, y = pairs_off_centre(rng, share, 4096)
    g = E.Geometry.of(64, rows, 0.9, x)
    x, y = pairs_off_centre(rng, share, 1000)
    together = (g.cells(x) == g.cells(y)).any(axis=1).mean()
    assert together >= 0.97, (g.bits, g.tables, together)


def test_recall_with_a_common_mean(spark):
    x, y = pairs_off_centre(np.random.default_rng(2), 0.7, 2000, threshold=0.901)
    x = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, _ = brute(list(range(len(x))), x)
    n = np.array([r.n_links for r in E.near_duplicates(df).orderBy("vec_id").collect()])
    assert (n <= links).all() and n.sum() >= 0.97 * links.sum() >= 3800


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    rows = [(1, a), (2, a), (3, b), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 1.0, 0.0]), (None, a), (10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cell string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 12)) and got[None] == (0, None, True)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_count_needed():
    assert E.count_needed(64, 0.9, 0.002) in range(48, 54) and E.count_needed(10, 1.0, 0.01) == 10
